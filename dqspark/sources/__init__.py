from dqspark.sources.readers import load, preview, sample, schema_table, work_folder  # noqa: F401
from dqspark.sources.registry import DatasetRegistry  # noqa: F401
from dqspark.sources.sinks import write_results, write_sample  # noqa: F401
