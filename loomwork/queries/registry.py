"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.scalars import round_half_up
from loomwork.plans.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, make: Callable[[Views], DataFrame], oracle: str | None = None) -> None:
    """Register a query over the views, with SQL for the same rows where there is any."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: make(Views(spark, sf_dir))
    if oracle is not None:
        ORACLES[name] = oracle


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """Doubles to ``n`` places: sums differ in their last bits by order."""
    return df.select(*[round_half_up(F.col(f"`{c}`"), n).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])
