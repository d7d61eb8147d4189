from dqspark.plans.deliveries import (  # noqa: F401
    channel_stats, definition_stats, definition_values, filename_check, flatten_inventory,
    missing_files, recent, search_definitions, verdict, zone_counts,
)
from dqspark.plans.intake import Delivery, process_delivery  # noqa: F401
from dqspark.plans.reports import (  # noqa: F401
    investigation_report, metrics_report, run_summary, status_counts, summarize, tests_report,
)
from dqspark.plans.result import SuiteResult, consolidate  # noqa: F401
from dqspark.plans.suite import run_suite, run_suites  # noqa: F401
from dqspark.plans.validate import check_ids, check_refs, validate_suite  # noqa: F401
