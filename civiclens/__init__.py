"""civiclens: service-request analytics operators on Spark.

Every operator is a function ``(DataFrame, params) -> DataFrame`` built from
Spark SQL / DataFrame expressions so that Catalyst can prune, push down and
plan the work; see README.md for the module map.
"""

__version__ = "0.1.0"
