"""tessera: Spark-first operators for curating, scoring and analysing streaming-agent data."""

__version__ = "0.1.0"
