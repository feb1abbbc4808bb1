"""notewright: a Spark-first engine that turns message and document tables into
deduplicated, clustered, materialised notes, with operators for training-data
preparation in the optional ``llm`` subpackage."""

__version__ = "0.1.0"
