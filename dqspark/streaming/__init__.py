from dqspark.streaming.event_time import (  # noqa: F401
    Windows, advance_overdue, advance_windows, overdue, window_metrics,
)
from dqspark.streaming.intake import watch_deliveries  # noqa: F401
