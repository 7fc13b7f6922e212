"""vacantia: a Spark-native analytics engine for job-opportunity archives."""

__version__ = "0.1.0"
