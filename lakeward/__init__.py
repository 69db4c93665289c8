"""lakeward: a Spark-native batch event data platform.

Landing, normalisation, quality classification, deduplication, quarantine,
incremental publishing, reconciliation suites, operational monitors and
metadata checks, all expressed as DataFrame / Spark SQL plans.
"""

__version__ = "0.1.0"
