"""Scores of predictions, in one aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def regression_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    """(n, rmse, r2)."""
    e = F.col(y) - F.col(p)
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("label"), F.col(p).alias("predicted")).count()


def binary_scores(df: DataFrame, y: str, p: str, positive: int = 1) -> DataFrame:
    """Accuracy, precision, recall (sensitivity), specificity and F1; ``positive`` names the positive class."""
    is_, said = F.col(y) == positive, F.col(p) == positive
    n = df.agg(F.count_if(is_ & said).alias("tp"), F.count_if(~is_ & said).alias("fp"), F.count_if(is_ & ~said).alias("fn"), F.count_if(~is_ & ~said).alias("tn"))
    over = lambda a, b: a / F.nullif(b, F.lit(0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.select("*", over(tp + tn, tp + fp + fn + tn).alias("accuracy"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(tn, tn + fp).alias("specificity"), over(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr, auc) for each distinct score; the area is the rank sum over all scores.

    Scores are counted first.  Running sums use ranges of scores: a sum within each, then the offsets
    of the few ranges, so no task sorts all of them.
    """
    each = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    edge = each.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    part = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("hi") - F.col("s")) / (F.col("hi") - F.col("lo")) * 255)).otherwise(0).cast("int")
    cut = each.join(F.broadcast(edge)).withColumn("part", part).drop("lo", "hi")  # one row is broadcast
    sums = cut.groupBy("part").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    offsets = sums.select("part", F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("op"), F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("on"), F.sum("sp").over(whole).alias("tp"), F.sum("sn").over(whole).alias("tn"))  # 256 rows at most
    w = Window.partitionBy("part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    run = cut.withColumns({"cp": F.sum("p").over(w), "cn": F.sum("n").over(w)}).join(F.broadcast(offsets), "part")
    points = run.select("s", "p", "n", (F.col("cp") + F.col("op")).alias("cp"), (F.col("cn") + F.col("on")).alias("cn"), "tp", "tn")
    area = points.agg((F.sum(F.col("n") * (F.col("cp") - F.col("p") / 2.0)) / F.nullif(F.max("tp") * F.max("tn"), F.lit(0))).alias("auc"))
    return points.join(F.broadcast(area)).select(F.col("s").alias("threshold"), (F.col("cn") / F.nullif("tn", F.lit(0))).alias("fpr"), (F.col("cp") / F.nullif("tp", F.lit(0))).alias("tpr"), "auc")


def leaderboard(spark: SparkSession, rows: list[dict], by: str) -> DataFrame:
    """A small table of fit results, best first."""
    return spark.createDataFrame(rows).orderBy(F.desc(by), "model")


def importance(model, df: DataFrame, cols: list[str], label: str, key: str, seed: int = 42) -> DataFrame:
    """(column, drop): fall of R2 when a column is shuffled among rows.

    A column is shuffled by joining each row's value to the row of another random order; both orders
    are ranges of row numbers made per partition, so no task holds all rows.
    """
    from loomwork.operators.features import assemble

    def numbered(d: DataFrame, salt: str) -> DataFrame:
        placed = d.withColumn("_h", F.xxhash64(F.col(key), F.lit(salt), F.lit(seed))).withColumn("_b", F.pmod("_h", F.lit(64)))
        sizes = placed.groupBy("_b").count().withColumn("_o", F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
        return placed.join(F.broadcast(sizes.select("_b", F.coalesce("_o", F.lit(0)).alias("_o"))), "_b").withColumn("_n", F.col("_o") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).drop("_h", "_b", "_o")

    score = lambda d: regression_scores(model.transform(assemble(d, cols)), label, "prediction").first().r2
    whole, rows = score(df), numbered(df, "rows")
    out = []
    for c in cols:
        other = numbered(df.select(key, F.col(c).alias("_v")), c).select("_n", "_v")
        out.append((c, float(whole - score(rows.join(other, "_n").withColumn(c, F.col("_v"))))))
    return df.sparkSession.createDataFrame(out, "column string, drop double").orderBy(F.desc("drop"))
