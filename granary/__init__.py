"""granary: aggregation-based analytics on labelled vectors, expressed as Spark DataFrame plans."""

from granary.session import get_spark, load

__all__ = ["get_spark", "load"]
