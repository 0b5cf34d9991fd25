"""rallylens: classification and summaries of political event tables on Spark."""

__version__ = "0.1.0"
