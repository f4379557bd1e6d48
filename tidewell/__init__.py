"""Service-availability and public-information analytics as Spark jobs."""

__version__ = "0.1.0"
