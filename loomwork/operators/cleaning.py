"""Projection, filters and cleaning."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_names(df: DataFrame) -> DataFrame:
    """Strip, lower, spaces to underscores; names that then agree are an error."""
    new = [c.strip().lower().replace(" ", "_") for c in df.columns]
    if len(set(new)) < len(new):
        raise ValueError(f"column names clash: {sorted(c for c in new if new.count(c) > 1)}")
    return df.toDF(*new)


def schema_report(df: DataFrame, expected: list[str]) -> DataFrame:
    """(column, status) of missing and extra columns; never fails."""
    rows = [(c, "missing") for c in expected if c not in df.columns] + [(c, "extra") for c in df.columns if c not in expected]
    return df.sparkSession.createDataFrame(rows, "column string, status string")


def cast_if_present(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast listed columns; what doesn't parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop columns whose one distinct value is null or ''; an empty table drops nothing.  One pass."""
    if not df.columns:
        return df
    stats = []
    for i, c in enumerate(df.columns):
        text = F.col(f"`{c}`").cast("string")
        stats += [F.count_if(text.isNull()).alias(f"n{i}"), F.count_if(text == "").alias(f"e{i}")]
    r = df.agg(F.count("*").alias("rows"), *stats).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if r.rows and r.rows in (r[f"n{i}"], r[f"e{i}"])])


def drop_sparse(df: DataFrame, max_null: float = 0.25) -> DataFrame:
    """Drop columns with a larger share of nulls.  One pass."""
    r = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if (r[i] or 0) > max_null])


def keep_positive(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose listed columns, as far as they exist, are above 0; null fails."""
    tests = [F.col(c) > 0 for c in cols if c in df.columns]
    return df.filter(reduce(and_, tests)) if tests else df


def time_range(df: DataFrame, col: str, lo: str, hi: str, closed: str = "left") -> DataFrame:
    """``closed='left'``: lo <= t < hi.  ``'both'``: BETWEEN, which for dates ends at midnight of ``hi``."""
    a, b = F.lit(lo).cast(df.schema[col].dataType), F.lit(hi).cast(df.schema[col].dataType)
    return df.filter((F.col(col) >= a) & (F.col(col) < b)) if closed == "left" else df.filter(F.col(col).between(a, b))


def map_codes(df: DataFrame, col: str, mapping: dict, out: str) -> DataFrame:
    """Code → label; unknown code → null."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(out, F.try_element_at(table, F.col(col)))


def clamp_negative(c: Column) -> Column:
    """Below 0 becomes 0; null stays."""
    return F.when(c < 0, F.lit(0)).otherwise(c)


def flag_yes_no(c: Column) -> Column:
    """Yes → 1, No → 0, others as they are (text)."""
    return F.when(c == "Yes", "1").when(c == "No", "0").otherwise(c)


def conditional_measure(test: Column, value: Column) -> Column:
    return F.when(test, value).otherwise(0.0)


def modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent value of each column, the smallest on a tie in the column's own order; none for an all-null column."""
    found = {}
    for kind in {df.schema[c].dataType.simpleString() for c in cols}:  # columns of one type are counted in one job
        own = [c for c in cols if df.schema[c].dataType.simpleString() == kind]
        values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in own])).alias("x")).select("x.*").where("v is not null")
        counted = values.groupBy("c", "v").count()  # combined before the shuffle, so a hot value costs little
        best = counted.groupBy("c").agg(F.min(F.struct((-F.col("count")).alias("n"), "v")).alias("b"))
        found |= {r.c: r.b.v for r in best.collect()}
    return found


def fill(df: DataFrame, values: dict) -> DataFrame:
    """Null → the given value of its column; columns that are not there are passed over."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in values.items() if c in df.columns})


def impute_mode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null → most frequent value, the smallest on a tie; an all-null column stays."""
    return fill(df, modes(df, cols))


def fraction_sample(df: DataFrame, f: float, seed: int = 42, key: str | None = None) -> DataFrame:
    """Bernoulli sample; with ``key`` by the whole 64-bit hash of it, the same rows under any plan and for any small share."""
    if key is None:
        return df.sample(f, seed=seed)
    return df if f >= 1 else df.filter(F.xxhash64(F.col(key), F.lit(seed)) < F.lit(-(1 << 63) + int(f * (1 << 64))))


def add_ingest_time(df: DataFrame, time: str) -> DataFrame:
    """Constant load time, and the day of ``time`` if it is there."""
    df = df.withColumn("_ingest_time", F.current_timestamp())
    return df.withColumn("pickup_day", F.to_date(time)) if time in df.columns else df


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=cols)


def count_duplicates(df: DataFrame) -> DataFrame:
    """(rows, duplicates): rows that repeat another."""
    each = df.groupBy(*df.columns).count()
    return each.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)
