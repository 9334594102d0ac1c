"""Set operations and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(dfs: list[DataFrame], missing: bool = False) -> DataFrame:
    """Union by name; unless ``missing`` allows it, columns must be equal."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), dfs)


def append_columns(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Columns of another table put beside, aligned by a row key."""
    return df.join(other, key, "left")


def pivot_dense(df: DataFrame, row: str, col: str, value: str, values: list) -> DataFrame:
    """Long → wide with 0 for missing; a (row, col) given twice is an error.  For output only."""
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a pair occurs twice")).cast("double")).otherwise(F.first(value).cast("double"))
    return df.groupBy(row).pivot(col, values).agg(one).na.fill(0.0)


def ticker_wide(df: DataFrame, order: str, ticker: str, value: str, tickers: list[str]) -> DataFrame:
    return df.groupBy(order).pivot(ticker, tickers).agg(F.first(value))


def explode_list(df: DataFrame, arr: str, out: str) -> DataFrame:
    return df.withColumn(out, F.explode(arr)).drop(arr)
