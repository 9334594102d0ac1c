"""Ordered operations.  Windows are per series, long series in blocks; windows over all rows follow an aggregation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.scratch import scratch

from .series import ROWS, carried, ewma, number, numbered, placed, windowed


def moving_avg(df: DataFrame, by: str, order: str, col: str, n: int = 30, rows: int = ROWS) -> DataFrame:
    """Mean of ``n`` rows ending here; null until there are as many, and while one is null."""

    def make(frame: DataFrame, w) -> DataFrame:
        w = w.rowsBetween(-(n - 1), 0)
        return frame.withColumn("moving_avg", F.when(F.count(col).over(w) == n, F.avg(col).over(w)))

    return windowed(df, by, order, n - 1, make, rows)


def pct_change(df: DataFrame, by: str, order: str, col: str, fill: bool = False, rows: int = ROWS) -> DataFrame:
    """x / previous - 1; with ``fill`` gaps take the last value."""
    x = "carried" if fill else col
    make = lambda frame, w: frame.withColumn("pct_change", F.col(x) / F.nullif(F.lag(x).over(w), F.lit(0.0)) - 1)
    return windowed(carried(df, by, order, col, rows) if fill else df, by, order, 1, make, rows).select(*df.columns, "pct_change")


def mean_return(df: DataFrame, by: str, order: str, col: str, rows: int = ROWS) -> DataFrame:
    return pct_change(df, by, order, col, rows=rows).groupBy(by).agg(F.avg("pct_change").alias("mean_return"))


def bin_of(ret: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the bin (edge, next edge] that holds the value; outside → null."""
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((ret > lo) & (ret <= hi), name).otherwise(out)
    return out


def binned_returns(df: DataFrame, by: str, ret: str, edges: list[float], labels: list[str]) -> DataFrame:
    """(by, label, count, percent) of every bin of every group, empty ones too."""
    named = df.select(by, bin_of(F.col(ret), edges, labels).alias("label"))
    counts = named.where("label is not null").groupBy(by, "label").count()
    every = df.select(by).distinct().select(by, F.explode(F.array(*map(F.lit, labels))).alias("label"))
    full = every.join(counts, [by, "label"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = F.sum("count").over(Window.partitionBy(by))
    return full.withColumn("percent", 100.0 * F.col("count") / F.nullif(total, F.lit(0)))


def rank_total(df: DataFrame, key: str, measure: str, lo: int = 1, hi: int = 10) -> DataFrame:
    """(key, total, rank) with competition ranks lo..hi of the totals; ties may give more rows."""
    total = df.groupBy(key).agg(F.sum(measure).alias("total"))
    return total.withColumn("rank", F.rank().over(Window.orderBy(F.desc("total")))).where(F.col("rank").between(lo, hi))


def topn_by(df: DataFrame, key: str, measure: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.sum(measure).alias("total")).orderBy(F.desc("total"), key).limit(n)


def number_rows(df: DataFrame, *order: str | Column) -> DataFrame:
    """1..n after a sort, for a result that is already limited."""
    return df.withColumn("serial", F.row_number().over(Window.orderBy(*order)))


def cumulative_share(df: DataFrame, value: str) -> DataFrame:
    """Running sum of a small table's values, largest first, and its share of all."""
    w = Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum(value).over(w)).withColumn("share", F.col("cumulative") / F.nullif(F.sum(value).over(Window.partitionBy(F.lit(1))), F.lit(0.0)))


def lag_vector(df: DataFrame, by: str, order: str, col: str, n: int = 60, rows: int = ROWS) -> DataFrame:
    """The ``n`` values before each row, in order; rows with fewer go."""
    make = lambda frame, w: frame.withColumn("lags", F.collect_list(F.col(col)).over(w.rowsBetween(-n, -1)))
    return windowed(df, by, order, n, make, rows).where(F.size("lags") == n)


def ordered_split(df: DataFrame, by: str, order: str, n: int, rows: int = ROWS) -> DataFrame:
    """'train' for the first ``n`` rows of a series, 'valid' for the rest."""
    return number(df, by, order, rows).withColumn("part", F.when(F.col("rn") <= n, "train").otherwise("valid")).drop("rn")


def yoy(df: DataFrame, entity: str, year: str, month: str, measure: str) -> DataFrame:
    """Percent change against the same month a year before; null where that month has no row."""
    w = Window.partitionBy(entity, month).orderBy(year)
    before = F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag(measure).over(w))
    return df.withColumn("yoy", 100.0 * (F.col(measure) / F.nullif(before, F.lit(0.0)) - 1))


def background_diff(df: DataFrame, by: str, order: str, col: str, warm: int = 60, alpha: float = 0.5, t: float = 25.0) -> DataFrame:
    """Background = EWMA at the last of the first ``warm`` rows; later rows are flagged when farther than ``t`` from it."""
    place = number(df, by, order)
    first = ewma(place.where(F.col("rn") <= warm).select(by, order, col), by, order, col, alpha)
    background = first.groupBy(by).agg(F.max_by("ewma", order).alias("background"))
    return place.where(F.col("rn") > warm).join(background, by).withColumn("moved", F.abs(F.col(col) - F.col("background")) > t).drop("rn")


#: Distinct values at either end of a group that a task trims at a time.
ENDS = 1_000_000


def drop_far_from_mean(df: DataFrame, by: str, col: str, t: float = 0.2, ends: int = ENDS, rows: int = ROWS) -> DataFrame:
    """Per group: while some value is farther than ``t`` from the mean, drop the farthest (the smaller on a tie).

    Dropping a value moves the mean away from its equals, so they go with it: what stays is a range of
    values, and the farthest is always at an end of it.  Distinct values with their counts are numbered in
    blocks; a round trims each group that isn't done by the ``ends`` values at either end, knowing the sum
    and count of all between, until one end is used up.  So no task holds more of a group than its ends,
    and a group whose values all stay takes one round.  Nulls and NaN go.
    """
    kind, ends = df.schema[by].dataType.simpleString(), max(2, ends)
    counts = df.select(F.col(by).alias("_g"), F.col(col).cast("double").alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)").groupBy("_g", "_x").agg(F.count("*").alias("_c"))
    values = numbered(placed(counts, ["_g"], ["_x"], rows), ["_g"]).drop("_part", "_at")
    schema = f"_k {kind}, _a long, _z long, _sum double, _rows long, _lo double, _hi double, _done boolean"

    def trim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        x, n, rn = pdf["_x"].to_numpy(), pdf["_c"].to_numpy(), pdf["rn"].to_numpy()
        first, last, total, count = (pdf[c].iloc[0] for c in ("_a", "_z", "_sum", "_rows"))
        left_end, right_start = min(first + ends - 1, last), max(last - ends + 1, first)
        a, b, whole = 0, len(x) - 1, right_start <= left_end + 1
        done = False
        while True:
            mean = total / count
            lo, hi = mean - x[a], x[b] - mean
            if a >= b or max(lo, hi) <= t:
                done = True
                break
            out = a if lo >= hi else b
            if not whole and (rn[out] == left_end if out == a else rn[out] == right_start):
                break  # its neighbour isn't here: the next round begins with this value
            total, count = total - x[out] * n[out], count - int(n[out])
            a, b = (a + 1, b) if out == a else (a, b - 1)
        return pd.DataFrame({"_k": pdf["_g"].iloc[:1].to_numpy(), "_a": rn[a : a + 1], "_z": rn[b : b + 1], "_sum": [float(total)], "_rows": [int(count)], "_lo": x[a : a + 1], "_hi": x[b : b + 1], "_done": [done]})

    weigh = F.sum(F.col("_x") * F.col("_c"))
    state = values.groupBy(F.col("_g").alias("_k")).agg(F.lit(1).cast("long").alias("_a"), F.max("rn").alias("_z"), weigh.alias("_sum"), F.sum("_c").alias("_rows"))
    state = state.withColumns({"_lo": F.lit(None).cast("double"), "_hi": F.lit(None).cast("double"), "_done": F.lit(False)})
    while True:
        at_end = F.col("_g").eqNullSafe(F.col("_k")) & F.col("rn").between(F.col("_a"), F.col("_z")) & ((F.col("rn") < F.col("_a") + ends) | (F.col("rn") > F.col("_z") - ends))
        moved = values.join(state.where("not _done"), at_end).groupBy("_g").applyInPandas(trim, schema)
        path = scratch(df.sparkSession, "trim")
        moved.unionByName(state.where("_done")).write.parquet(path)
        state = df.sparkSession.read.schema(schema.replace("long", "bigint")).parquet(path)
        if state.where("not _done").isEmpty():
            break
    inside = F.col(by).eqNullSafe(F.col("_k")) & F.col(col).cast("double").between(F.col("_lo"), F.col("_hi"))
    return df.join(state, inside).select(*df.columns)
