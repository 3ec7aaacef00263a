"""Point-in-time dataset building, time-aware retrieval and evaluation analytics on Spark."""

__version__ = "0.1.0"
