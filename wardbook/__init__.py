"""wardbook: clinic billing, scheduling and reporting as Spark jobs.

Sub-packages: ``sources`` (scans, sinks, JSON, test-data mapping),
``functions`` (scalar column functions), ``operators`` (billing, reports,
listings, changes, checks, scoping), ``plans`` (the registered queries and
their SQL oracles), ``streaming`` (micro-batch billing and payments).
"""

from wardbook.session import get_spark

__all__ = ["get_spark"]
