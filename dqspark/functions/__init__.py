from dqspark.functions.frames import first_rows, local_frame  # noqa: F401
from dqspark.functions.predicates import (  # noqa: F401
    WHERE_KEYS, Scope, pick_where, predicate_columns, resolve_columns,
)
from dqspark.functions.types import (  # noqa: F401
    OUTPUT_TYPES, TYPE_CODES, is_numeric, matches_code, simple_type,
)
from dqspark.functions.value_filters import (  # noqa: F401
    check_value_filter, apply_value_filter, keep_column, value_filter_prechecks,
)
from dqspark.functions.values import (  # noqa: F401
    absent, field_of, how_many, key_digest, missing, named, number, number_text, quarter_label, share,
)
