"""quern: DataFrame-first text, retrieval and data-preparation operators for Spark."""

__version__ = "0.1.0"
