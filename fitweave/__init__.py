"""Job-ad extraction, profile matching and application history as Spark jobs."""

__version__ = "0.1.0"
