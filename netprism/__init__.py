"""netprism: network-evidence analytics as Spark DataFrame and streaming jobs."""

__version__ = "0.1.0"
