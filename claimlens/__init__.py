"""Package-reference analytics on Spark: scans, extraction, joins, rate control, sinks."""

__version__ = "0.1.0"
