"""Monthly forecasts of many series, and chunk scores of a reconstruction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import number


def _holt_winters(x: np.ndarray, a: float, b: float, g: float, season: int) -> tuple[np.ndarray, float, float, np.ndarray]:
    """One-step errors and the last level, trend and seasonal terms, additive."""
    cyc = season if len(x) >= 2 * season else 1
    s = x[:cyc] - x[:cyc].mean() if cyc > 1 else np.zeros(1)
    level, trend, err = x[:cyc].mean(), (x[cyc : 2 * cyc].mean() - x[:cyc].mean()) / cyc if cyc > 1 else 0.0, []
    s = s.copy()
    for t, v in enumerate(x):
        err.append(v - (level + trend + s[t % cyc]))
        before = level
        level = a * (v - s[t % cyc]) + (1 - a) * (level + trend)
        trend = b * (level - before) + (1 - b) * trend
        if cyc > 1:
            s[t % cyc] = g * (v - level) + (1 - g) * s[t % cyc]
    return np.array(err), level, trend, s


def forecast(df: DataFrame, by: str, month: str, value: str, horizon: int = 12, level: float = 0.95, season: int = 12) -> DataFrame:
    """(by, month, forecast, lower, upper) of the next ``horizon`` months of each series.

    Months without a row count as 0 and the last month, which may be incomplete, is ignored.  The
    smoothing is additive Holt-Winters with the best of a fixed grid by squared one-step error; a
    series shorter than two seasons has no seasonal term.
    """
    z = {0.9: 1.6449, 0.95: 1.96, 0.99: 2.5758}.get(level, 1.96)
    m = df.groupBy(by, F.trunc(month, "month").alias("m")).agg(F.sum(value).cast("double").alias("v"))
    span = m.groupBy(by).agg(F.min("m").alias("a"), F.add_months(F.max("m"), -1).alias("b")).where("a <= b")
    full = span.select(by, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m")).join(m, [by, "m"], "left").na.fill(0.0, ["v"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("m")
        x = pdf["v"].to_numpy(float)
        grid = [(a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.0, 0.1) for g in (0.1, 0.4)]
        fits = [_holt_winters(x, *p, season) for p in grid]
        err, lev, trend, s = min(fits, key=lambda f: float((f[0] ** 2).sum()))
        h = np.arange(1, horizon + 1)
        mean = lev + h * trend + s[(len(x) + h - 1) % len(s)]
        width = z * err.std() * np.sqrt(h)
        months = pd.date_range(pd.Timestamp(pdf["m"].iloc[-1]) + pd.offsets.MonthBegin(1), periods=horizon, freq="MS")
        return pd.DataFrame({by: pdf[by].iloc[0], "month": months.date, "forecast": mean, "lower": mean - width, "upper": mean + width})

    kind = df.schema[by].dataType.simpleString()
    return full.groupBy(by).applyInPandas(one, f"{by} {kind}, month date, forecast double, lower double, upper double")


def chunk_score(df: DataFrame, by: str, order: str, x: str, xhat: str, size: int = 10, t: float = 0.00074) -> DataFrame:
    """(by, chunk, n, score, alert): root of the squared error sum over the number of values, of whole chunks of ``size`` rows."""
    placed = number(df, by, order).withColumn("chunk", F.floor((F.col("rn") - 1) / size))
    e = F.col(x) - F.col(xhat)
    scored = placed.groupBy(by, "chunk").agg(F.count("*").alias("n"), (F.sqrt(F.sum(e * e)) / F.count("*")).alias("score")).where(F.col("n") == size)
    return scored.withColumn("alert", F.col("score") > t)
