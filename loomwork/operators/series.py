"""Long series in blocks, so that no task holds a whole series.

``placed`` writes the rows once, range-partitioned and sorted by series and order; a row's number is then
its place in its partition plus the sizes of the partitions before it, which are one row each.  Windows
of bounded length run in blocks of consecutive numbers, each with the few rows before it (its halo).
State that runs through a whole series passes from block to block as one row a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.scratch import scratch

#: Rows of a range partition, of a block, and of a series that one task may hold.
ROWS = 500_000


def placed(df: DataFrame, by: list[str], order: list[str], rows: int = ROWS) -> DataFrame:
    """``df`` with ``_part``, ``_at``: partition and unique place in the order of ``by``, ``order`` (nulls first).

    Equal keys are told apart by a hash of the row, so a mass of ties is split too; equal rows stay together.
    """
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))])
    keyed = df.withColumn("_tie", tie)
    parts = max(1, -(-df.count() // rows))
    keys = [F.col(f"`{c}`") for c in (*by, *order)] + [F.col("_tie")]
    laid = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    path = scratch(df.sparkSession, "placed")
    laid.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(table: DataFrame, by: list[str]) -> DataFrame:
    """A ``placed`` table with ``rn``: 1..n within ``by``, from the sizes of its partitions."""
    keys = [f"_k{i}" for i in range(len(by))]
    sizes = table.groupBy(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], F.col("_part").alias("_p")).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = F.col("_part") == F.col("_p")
    for c, k in zip(by, keys):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(k))
    return table.join(starts, same).withColumn("rn", F.col("_start") + F.col("_at") - F.col("_low") + 1).drop(*keys, "_p", "_low", "_start")


def number(df: DataFrame, by: str, order: str, rows: int = ROWS) -> DataFrame:
    """``df`` with ``rn``: 1..n in each series by ``order``; ties in an order of their own that repeats."""
    return numbered(placed(df, [by], [order], rows), [by]).drop("_part", "_at")


def _longest(df: DataFrame, by: str) -> int:
    return df.groupBy(by).count().agg(F.max("count")).first()[0] or 0


def windowed(df: DataFrame, by: str, order: str, halo: int, make, rows: int = ROWS) -> DataFrame:
    """``make(frame, window)`` over each series in order, where ``make`` adds columns that look at no more than ``halo`` rows before.

    ``window`` is partitioned and ordered, its frame is still to be set.  If all series are of at most ``rows`` rows it
    runs over whole series, else over blocks of ``rows`` numbers with a halo before each.
    """
    if _longest(df, by) <= rows:
        return make(df, Window.partitionBy(by).orderBy(order))
    size = max(rows, halo)
    block = F.floor((F.col("rn") - 1) / F.lit(size)).cast("int")
    own, next_ = F.struct(block.alias("b"), F.lit(False).alias("halo")), F.struct((block + 1).alias("b"), F.lit(True).alias("halo"))
    dealt = number(df, by, order, rows).withColumn("_to", F.explode(F.when(F.col("rn") > (block + 1) * size - halo, F.array(own, next_)).otherwise(F.array(own))))
    made = make(dealt.withColumn("_b", F.col("_to.b")), Window.partitionBy(by, "_b").orderBy("rn"))
    return made.where("not _to.halo").drop("_to", "_b", "rn")


def carried(df: DataFrame, by: str, order: str, col: str, rows: int = ROWS) -> DataFrame:
    """``df`` with ``carried``: the last value of ``col`` that isn't null, up to the row."""
    if _longest(df, by) <= rows:
        return df.withColumn("carried", F.last(col, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    dealt = number(df, by, order, rows).withColumn("_b", F.floor((F.col("rn") - 1) / F.lit(rows)).cast("int"))
    last = dealt.groupBy(F.col(by).alias("_k"), F.col("_b").alias("_c")).agg(F.max_by(F.when(F.col(col).isNotNull(), F.col(col)), F.when(F.col(col).isNotNull(), F.col("rn"))).alias("_v"))
    before = F.last("_v", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    inner = F.last(col, ignorenulls=True).over(Window.partitionBy(by, "_b").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    met = dealt.withColumn("_own", inner).join(last.withColumn("_v", before), F.col(by).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c")))
    return met.withColumn("carried", F.coalesce("_own", "_v")).select(*df.columns, "carried")


def _local(x: pd.Series, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: how many values there are up to it, and the average that starts from 0."""
    n = x.notna().to_numpy().cumsum()
    b = pd.concat([pd.Series([0.0]), x.astype(float)]).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[1:]
    return n, b


def _scan(blocks: DataFrame, keep: Column, longest: int) -> DataFrame:
    """Maps s → keep^n s + b of the blocks (_k, _b, n, b), each composed with all before it, in a logarithmic number of steps."""
    w, step = Window.partitionBy("_k").orderBy("_b"), 1
    while step < longest:
        n, b = F.lag("n", step).over(w), F.lag("b", step).over(w)
        blocks = blocks.withColumns({"_n": n, "_s": b}).withColumns({"b": F.col("b") + F.when(F.col("_n").isNotNull(), F.pow(keep, F.col("n").cast("double")) * F.col("_s")).otherwise(0.0), "n": F.col("n") + F.coalesce("_n", F.lit(0))}).drop("_n", "_s")
        step *= 2
    return blocks


def ewma(df: DataFrame, by: str, order: str, col: str, alpha: float, rows: int = ROWS) -> DataFrame:
    """s0 = x0, s = (1 - alpha) s + alpha x, per series in order; rows with a null value keep the last s.

    A block maps the s before it to (1 - alpha)^n s + b.  One pass gathers (n, b) of each block, a scan
    composes them, a second pass applies each block's start to its rows.  Leading nulls give null; rows
    with a null order come first; ties in an order that repeats; an empty table gives an empty result.
    """
    dealt = number(df, by, order, rows).withColumn("_block", F.floor((F.col("rn") - 1) / F.lit(rows)).cast("int"))
    kind = df.schema[by].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        n, b = _local(pdf["_x"], alpha)
        first = pdf["_x"].dropna().head(1).tolist() or [None]
        return pd.DataFrame({"_k": pdf["_k"].iloc[:1].to_numpy(), "_b": pdf["_block"].iloc[:1].to_numpy(), "n": n[-1:], "b": b[-1:], "first": first})

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        n, b = _local(pdf[col], alpha)
        return pdf.assign(_n=n, _e=b)

    narrow = dealt.select(F.col(by).alias("_k"), "_block", "rn", F.col(col).cast("double").alias("_x"))
    sums = narrow.groupBy("_k", "_block").applyInPandas(fold, f"_k {kind}, _b int, n long, b double, first double")
    longest = -(-_longest(df, by) // rows)
    w = Window.partitionBy("_k").orderBy("_b")
    start = F.first("first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))  # known from the first value on
    keep = F.lit(1.0 - alpha)
    after = _scan(sums.withColumn("_first", start), keep, longest)
    at_end = F.when(F.col("n") > 0, F.pow(keep, F.col("n").cast("double")) * F.col("_first") + F.col("b"))
    starts = after.select("_k", "_b", F.lag(at_end).over(w).alias("_s"), F.col("_first").alias("_x0"))
    full = dealt.groupBy(by, "_block").applyInPandas(apply, dealt.schema.simpleString()[7:-1] + ",_n:long,_e:double")
    joined = full.join(starts, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    value = F.when((F.col("_n") > 0) | F.col("_s").isNotNull(), F.pow(keep, F.col("_n").cast("double")) * F.coalesce("_s", "_x0") + F.col("_e"))
    return joined.withColumn("ewma", value).select(*df.columns, "ewma")
