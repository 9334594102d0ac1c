"""Expectations: one-row reports that can raise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ExpectationError(AssertionError):
    pass


def _checked(report: DataFrame, fail: bool) -> DataFrame:
    if fail and not (r := report.first()).ok:
        raise ExpectationError(str(r.asDict()))
    return report


def expect_rows(df: DataFrame, n: int, fail: bool = False) -> DataFrame:
    return _checked(df.agg(F.count("*").alias("actual")).select(F.lit(n).cast("long").alias("expected"), "actual", (F.col("actual") == n).alias("ok")), fail)


def missing_hours(df: DataFrame, time: str, first: str, last: str) -> DataFrame:
    """Hours of a closed range without a row."""
    spark = df.sparkSession
    every = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"), F.expr("interval 1 hour"))).alias(time))
    return every.join(df.select(F.col(time).cast("timestamp").alias(time)), time, "left_anti")


def expect_no_nulls(df: DataFrame, fail: bool = False) -> DataFrame:
    total = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    return _checked(df.agg(total.alias("nulls")).select("nulls", (F.col("nulls") == 0).alias("ok")), fail)
