"""Aggregation.  Each is a partial and a final aggregate; orders are left to the reader."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.scalars import duration_min, hour_of_day, round_half_up, trunc_to

#: Names of the summary's buckets by granularity.
UNITS = {"HOUR": "pickup_hour", "DAY": "pickup_day", "WEEK": "pickup_week"}


def _measures(extra: bool = False, times: tuple[str, str] = ("pickup", "dropoff")) -> list[Column]:
    base = [F.count("*").alias("trip_count"), round_half_up(F.avg("fare")).alias("avg_fare"), round_half_up(F.avg("tip")).alias("avg_tip"), F.sum("passengers").alias("total_passengers"), round_half_up(F.avg("distance")).alias("avg_distance")]
    return base + [round_half_up(F.avg("total")).alias("avg_total_amount"), round_half_up(F.avg(duration_min(F.col(times[0]), F.col(times[1])))).alias("avg_duration_min")] if extra else base


def trip_summary(df: DataFrame, unit: str, time: str = "pickup", extra: bool = False) -> DataFrame:
    """Counts and means per hour, day or week (weeks start on Sunday); another unit is an error."""
    if unit.upper() not in UNITS:
        raise ValueError(f"granularity must be one of {sorted(UNITS)}")
    out = UNITS[unit.upper()]
    if extra:
        df = df.filter((F.col("distance") > 0) & (F.col("total") > 0))
    return df.groupBy(trunc_to(F.col(time), unit, "sunday").alias(out)).agg(*_measures(extra, (time, "dropoff")))


def zone_summary(df: DataFrame, unit: str, side: str, range_: tuple[str, str] | None = None) -> DataFrame:
    """Per day or week and zone of the pickup or dropoff side; the bucket is that side's own time, a range always means pickup time."""
    if unit.upper() not in ("DAY", "WEEK") or side not in ("pickup", "dropoff"):
        raise ValueError("unit is DAY or WEEK, side is pickup or dropoff")
    if range_:
        df = df.filter(F.col("pickup").between(F.lit(range_[0]).cast("timestamp"), F.lit(range_[1]).cast("timestamp")))
    bucket = trunc_to(F.col(side), unit, "sunday").alias(f"{side}_{unit.lower()}")
    return df.groupBy(bucket, F.col(f"{side}_zone").alias("zone_id")).agg(*_measures())


def hour_profile(summary: DataFrame, metrics: list[str], time: str = "pickup_hour") -> DataFrame:
    return summary.groupBy(hour_of_day(F.col(time)).alias("hour")).agg(*[F.avg(m).alias(m) for m in metrics])


def rollup_mean(summary: DataFrame, unit: str, metrics: list[str], time: str = "pickup_hour") -> DataFrame:
    """Unweighted mean of the finer rows: an average of averages, as wanted here."""
    return summary.groupBy(trunc_to(F.col(time), unit).alias(unit.lower())).agg(*[F.avg(m).alias(m) for m in metrics])


def zone_mean(zones: DataFrame, metric: str, lo: str, hi: str, day: str = "pickup_day") -> DataFrame:
    kept = zones.filter(F.col(day).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    return kept.groupBy("zone_id").agg(F.avg(metric).alias(metric))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def value_counts(df: DataFrame, col: str, n: int | None = None, where: Column | None = None) -> DataFrame:
    """(value, count), most frequent first, then by value; null isn't counted."""
    kept = df.where(F.col(col).isNotNull() & (where if where is not None else F.lit(True)))
    out = kept.groupBy(F.col(col).alias("value")).count().orderBy(F.desc("count"), "value")
    return out if n is None else out.limit(n)


def counts_by(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).count()


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    return df.agg((F.approx_count_distinct(col) if approx else F.count_distinct(col)).alias("n"))


def array_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.explode(col).alias("value")).distinct()


def mean_by_array_value(df: DataFrame, arr: str, value: str) -> DataFrame:
    """Mean per entry of an array column (a row counts for each); entries without a value → null."""
    return df.select(F.explode(F.array_distinct(arr)).alias("value"), F.col(value).alias("x")).groupBy("value").agg(F.avg("x").alias("mean"))


def top_by(df: DataFrame, key: str, agg: Column, n: int) -> DataFrame:
    """The ``n`` keys with the highest aggregate, by key on a tie; null keys go."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(agg.alias("measure")).orderBy(F.desc("measure"), key).limit(n)


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, fraction) in one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns])
    return one.select("_n", F.explode(pairs).alias("p")).select("p.column", "p.nulls", (F.col("p.nulls") / F.nullif(F.col("_n"), F.lit(0))).alias("fraction"))


#: Rows within a bracket that the driver may read as distinct values with counts, and the sketch's accuracy.
BRACKET_ROWS, ACCURACY = 50_000, 10_000


def _number(c: str) -> Column:
    v = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(v), v)


def select_ranks(df: DataFrame, ranks: dict[str, list[int]], most: int = BRACKET_ROWS, accuracy: int = ACCURACY, brackets: dict[tuple[str, int], tuple[float, float]] | None = None) -> dict[tuple[str, int], float]:
    """The values at 0-based ``ranks`` of numeric columns, nulls and NaN left out, exactly: {(column, rank): value}.

    Each rank lies in a bracket of values, at first all or the one given in ``brackets``.  A pass counts the rows below and within every
    bracket and sketches quantiles just around its rank, which narrow the bracket about ``accuracy`` / 4
    times; if a count shows that a sketch missed, the bracket moves to the side where the rank is.  Brackets
    of at most ``most`` rows end with their values and counts.  No task holds more than a sketch for each
    bracket, however the values are spread.
    """
    x = _number
    inf = float("inf")
    todo = {(c, r): (-inf, inf) for c, rs in ranks.items() for r in rs}
    outer, counted, done = dict(todo), {}, {}
    todo |= brackets or {}

    def inside(c, lo, hi):
        return (x(c) >= lo) & (x(c) <= hi)

    while todo:
        keys = list(todo)
        counts = [e for i, (c, r) in enumerate(keys) for lo, hi in [todo[c, r]] for e in (F.count_if(x(c) < lo).alias(f"b{i}"), F.count_if(inside(c, lo, hi)).alias(f"n{i}"))]
        row = df.agg(*counts).first()
        small, narrow = [], []
        for i, (c, r) in enumerate(keys):
            (lo, hi), below, n = todo[c, r], row[f"b{i}"], row[f"n{i}"]
            if r < below:  # the sketch lay too high
                todo[c, r] = (outer[c, r][0], math.nextafter(lo, -inf))
            elif r >= below + n:
                todo[c, r] = (math.nextafter(hi, inf), outer[c, r][1])
            elif lo == hi:
                done[c, r] = lo
            else:
                counted[c, r] = (below, n)
                (small if n <= most else narrow).append((c, r))
        if small:
            near = F.array(*[F.when(inside(c, *todo[c, r]), F.struct(F.lit(i).alias("i"), x(c).alias("v"))) for i, (c, r) in enumerate(small)])
            found: dict[int, list[tuple[float, int]]] = {}
            for p in df.select(F.explode(near).alias("p")).where("p is not null").groupBy("p.i", "p.v").count().collect():  # most rows a bracket
                found.setdefault(p.i, []).append((p.v, p["count"]))
            for i, key in enumerate(small):
                at = counted[key][0]
                for v, n in sorted(found[i]):
                    at += n
                    if key[1] < at:
                        done[key] = v
                        break
        if narrow:
            wanted = []
            for i, (c, r) in enumerate(narrow):
                below, n = counted[c, r]
                p = (r - below + 0.5) / n
                wanted.append(F.percentile_approx(F.when(inside(c, *todo[c, r]), x(c)), [max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)], accuracy).alias(f"q{i}"))
            row = df.agg(*wanted).first()
            for i, key in enumerate(narrow):
                outer[key], before = todo[key], todo[key]
                todo[key] = tuple(row[f"q{i}"])
                if todo[key] == before:  # few distinct values: halve the bracket
                    mid = before[0] / 2 + before[1] / 2
                    todo[key] = (before[0], mid if before[0] < mid < before[1] else before[0])
        for key in done:
            todo.pop(key, None)
    return done


def quantiles_exact(df: DataFrame, cols: list[str], pcts: list[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column; None where it has no value."""
    edges = [min(1.0, max(0.0, p + d / ACCURACY)) for p in pcts for d in (-2, 2)]
    seen = df.agg(*[e for i, c in enumerate(cols) for e in (F.count(_number(c)).alias(f"n{i}"), F.percentile_approx(_number(c), edges, ACCURACY).alias(f"q{i}"))]).first()
    place, brackets = {}, {}
    for i, c in enumerate(cols):
        if n := seen[f"n{i}"]:
            place[c] = [(n - 1) * p for p in pcts]
            for j, h in enumerate(place[c]):
                brackets |= {(c, r): (seen[f"q{i}"][2 * j], seen[f"q{i}"][2 * j + 1]) for r in (int(h), min(int(h) + 1, n - 1))}
    found = select_ranks(df, {c: sorted({r for k, r in brackets if k == c}) for c in place}, brackets=brackets)
    out: dict[str, list[float | None]] = {c: [None] * len(pcts) for c in cols}
    for c, hs in place.items():
        last = seen[f"n{cols.index(c)}"] - 1
        out[c] = [found[c, int(h)] + (h - int(h)) * (found[c, min(int(h) + 1, last)] - found[c, int(h)]) if h > int(h) else found[c, int(h)] for h in hs]
    return out


def describe_exact(df: DataFrame, cols: list[str], pcts: list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, count, mean, std, min, p.., max); quantiles are exact, linearly interpolated, found by counting within brackets."""
    at = quantiles_exact(df, cols, list(pcts))
    stats = {"count": lambda c: F.count(c).cast("double"), "mean": F.avg, "std": F.stddev_samp, "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double")}
    one = df.agg(*[f(F.col(c)).alias(f"{c}_{s}") for c in cols for s, f in stats.items()])
    names = {c: {**{s: F.col(f"{c}_{s}") for s in ("count", "mean", "std", "min")}, **{f"p{round(100 * p)}": F.lit(v).cast("double") for p, v in zip(pcts, at[c])}, "max": F.col(f"{c}_max")} for c in cols}
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[v.alias(s) for s, v in names[c].items()]) for c in cols])).alias("x")).select("x.*")


def skew_g1(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, skew): bias-corrected skewness."""
    one = df.agg(*[(F.skewness(c) * F.sqrt((F.count(c) * (F.count(c) - 1)).cast("double")) / F.nullif((F.count(c) - 2).cast("double"), F.lit(0.0))).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("skew")) for c in cols])).alias("x")).select("x.*")


def corr_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) of all pairs over complete rows, in one aggregate."""
    full = df.na.drop("any", subset=cols)
    pairs = [(a, b) for a in cols for b in cols]
    one = full.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs if a <= b])
    col = lambda a, b: F.col(f"`{min(a, b)}|{max(a, b)}`")
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), col(a, b).alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """(bin, lo, count) of equal widths over the range, the last bin closed, empty bins included."""
    edges = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).where("lo is not null")
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    frame = edges.select("lo", width.alias("w"))
    at = F.least(F.floor((F.col(col).cast("double") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(col).isNotNull()).join(F.broadcast(frame)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row is broadcast
    every = frame.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "w")
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lo"), F.coalesce("n", F.lit(0)).alias("count"))


def value_range(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): the largest class's count over the own count."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).count()
    return n.select(label, (F.max("count").over(Window.partitionBy(F.lit(1))) / F.col("count")).alias("weight"))


def class_share(df: DataFrame, subset: Column, cond: Column) -> DataFrame:
    """(n, total, share): rows of ``subset`` for which ``cond`` holds, and their percentage to 3 places."""
    s = df.where(subset).agg(F.count_if(cond).alias("n"), F.count("*").alias("total"))
    return s.withColumn("share", F.round(100.0 * F.col("n") / F.nullif("total", F.lit(0)), 3))


def kpis(df: DataFrame, dims: list[str]) -> DataFrame:
    """Sales, profit, margin and return rate; no sales → null margin."""
    return df.groupBy(*dims).agg(
        F.sum("sales").alias("sales"), F.sum("profit").alias("profit"), (F.sum("profit") / F.nullif(F.sum("sales"), F.lit(0.0))).alias("margin"), (F.count_if(F.col("returned") == "Yes") / F.count("*")).alias("return_rate")
    )


def monthly(df: DataFrame, date: str, by: list[str], measures: list[str], where: Column) -> DataFrame:
    return df.where(where).groupBy(trunc_to(F.col(date), "month").alias("month"), *by).agg(*[F.sum(m).alias(m) for m in measures])


def fit_line(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept per group, and the fitted y at the least and greatest x."""
    fit = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    at = lambda c: F.col("slope") * F.col(c) + F.col("intercept")
    return fit.withColumn("y_lo", at("lo")).withColumn("y_hi", at("hi"))
