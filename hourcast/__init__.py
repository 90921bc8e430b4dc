"""hourcast: engineering-hours estimation as Spark DataFrame jobs."""

__version__ = "0.1.0"
