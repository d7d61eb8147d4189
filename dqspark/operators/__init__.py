from dqspark.operators.checks import (  # noqa: F401
    assert_output_schema, columns_present, columns_typed, interval_check_columns, metric_checks,
    metric_tests, range_columns, regex_check, resolve_bounds,
)
from dqspark.operators.custom import CheckContext, check, run_check  # noqa: F401
from dqspark.operators.investigate import (  # noqa: F401
    duplicate_total, investigate_bounds, investigate_duplicates, investigate_missing, investigate_orphans,
    investigate_where,
)
from dqspark.operators.metrics import (  # noqa: F401
    METRIC_TYPES, Metric, compute_metrics, declared_output, metric, metric_details, metric_table,
    orphan_count,
)
from dqspark.operators.ordered import as_of, balances, merged_periods, overlaps, trailing  # noqa: F401
from dqspark.operators.sequence import gaps, jumps, orphans_at  # noqa: F401
