"""cadenza: a Spark-first engine for subscription lifecycle analytics."""

__version__ = "0.1.0"
