"""Security-log analytics on Spark: readers, detectors, rules, correlation, reports."""

__version__ = "0.1.0"
