"""Spark-native retrieval and context analytics.

Sub-packages: ``functions`` (Column builders), ``operators`` (DataFrame to
DataFrame), ``sources`` (scans, predicates, sinks), ``plans`` (named queries and
their SQL counterparts), ``streaming`` (Structured Streaming pipelines).
"""
