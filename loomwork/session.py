"""Session defaults; anything already set wins."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "loomwork", **conf: str) -> SparkSession:
    """UTC and adaptive execution; sizes of partitions are left to the cluster."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()
