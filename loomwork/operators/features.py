"""Encoders, scalers, text features and splits.  ``fit_*`` returns an object that never refits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import ROWS, numbered, placed


@dataclass
class LabelEncoder:
    """Sorted distinct values → 0..n-1; unseen → null.  The table of values stays distributed."""

    table: DataFrame
    col: str

    def transform(self, df: DataFrame) -> DataFrame:
        return df.join(self.table, self.col, "left")


def fit_label_encode(df: DataFrame, col: str, rows: int = ROWS) -> LabelEncoder:
    """Codes are places among the distinct values, from range partitions and their sizes."""
    values = df.where(F.col(col).isNotNull()).select(col).distinct()
    table = numbered(placed(values, [], [col], rows), [])
    return LabelEncoder(table.select(col, (F.col("rn") - 1).cast("int").alias(f"{col}_code")), col)


@dataclass
class TargetEncoder:
    table: DataFrame
    prior: float
    col: str

    def transform(self, df: DataFrame) -> DataFrame:
        return df.join(self.table, self.col, "left").withColumn(f"{self.col}_enc", F.coalesce(f"{self.col}_enc", F.lit(self.prior)))


def fit_target_encode(df: DataFrame, col: str, y: str, m: float = 1.0, s: float = 1.0) -> TargetEncoder:
    """Smoothed target mean with weight 1 / (1 + exp(-(n - m) / s)); the prior for one row and for unseen values."""
    prior = df.agg(F.avg(y)).first()[0]
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"), F.avg(y).alias("a"))
    w = 1 / (1 + F.exp(-(F.col("n") - m) / s))
    enc = F.when(F.col("n") == 1, F.lit(prior)).otherwise(prior * (1 - w) + F.col("a") * w)
    return TargetEncoder(g.select(col, enc.alias(f"{col}_enc")), prior, col)


def fit_one_hot(train: DataFrame, col: str, drop_first: bool = True):
    """Spark ML one-hot vector; with ``drop_first`` the alphabetically first category has no entry."""
    index = StringIndexer(inputCol=col, outputCol=f"{col}_ix", stringOrderType="alphabetDesc" if drop_first else "alphabetAsc", handleInvalid="keep" if not drop_first else "error")
    return Pipeline(stages=[index, OneHotEncoder(inputCol=f"{col}_ix", outputCol=f"{col}_vec", dropLast=drop_first)]).fit(train)


def one_hot_columns(df: DataFrame, col: str, classes: list) -> DataFrame:
    """One 0/1 column for each class, none dropped."""
    return df.withColumns({f"{col}_{c}": F.when(F.col(col) == c, 1).otherwise(0) for c in classes})


@dataclass
class Scaler:
    """(x - centre) / width for each column; a constant column becomes 0."""

    stats: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame, suffix: str = "_scaled") -> DataFrame:
        return df.withColumns({c + suffix: (F.col(c) - a) / b if b else F.when(F.col(c).isNotNull(), 0.0) for c, (a, b) in self.stats.items()})

    def inverse(self, df: DataFrame, suffix: str = "_scaled") -> DataFrame:
        return df.withColumns({c + "_back": F.col(c + suffix) * b + a for c, (a, b) in self.stats.items()})


def fit_standard(df: DataFrame, cols: list[str]) -> Scaler:
    """Mean and population deviation."""
    r = df.agg(*[F.struct(F.avg(c).cast("double"), F.stddev_pop(c)).alias(c) for c in cols]).first()
    return Scaler({c: (r[c][0] or 0.0, r[c][1] or 0.0) for c in cols})


def fit_minmax(df: DataFrame, cols: list[str]) -> Scaler:
    r = df.agg(*[F.struct(F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")).alias(c) for c in cols]).first()
    return Scaler({c: (r[c][0] or 0.0, r[c][1] or 0.0) for c in cols})


def zscore_clip(df: DataFrame, by: str, col: str) -> DataFrame:
    """z-score within a group, then cut to [0, 1]; group statistics are aggregated and joined, so a hot group isn't sorted."""
    g = df.groupBy(by).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    z = (F.col(col) - F.col("_m")) / F.nullif("_s", F.lit(0.0))
    return df.join(g, by, "left").withColumn("z", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(z, F.when(F.col(col).isNotNull(), 0.0))))).drop("_m", "_s")


def word_tokens(c: Column, stop: list[str] | None = None) -> Column:
    """Lower-case tokens of two word characters or more, without stop words."""
    t = F.regexp_extract_all(F.lower(c), F.lit(r"\b\w\w+\b"), F.lit(0))
    return F.filter(t, lambda w: ~w.isin(stop)) if stop else t


def count_vector(df: DataFrame, id_: str, text: str, stop: list[str] | None = None) -> DataFrame:
    """Long form (id, token, n)."""
    return df.select(id_, F.explode(word_tokens(F.col(text), stop)).alias("token")).groupBy(id_, "token").agg(F.count("*").alias("n"))


def tfidf(df: DataFrame, id_: str, text: str, max_df: float = 0.7, stop: list[str] | None = None) -> DataFrame:
    """Long form (id, token, weight): ln((1 + n) / (1 + df)) + 1 times the count, rows of length 1; tokens in more than ``max_df`` of all rows go."""
    tf = count_vector(df, id_, text, stop)
    rows = df.agg(F.count("*").alias("rows"))
    seen = tf.groupBy("token").agg(F.count("*").alias("df"))
    idf = seen.join(F.broadcast(rows)).where(F.col("df") <= max_df * F.col("rows")).select("token", (F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row is broadcast
    w = tf.join(idf, "token").withColumn("w", F.col("n") * F.col("idf"))
    norm = w.groupBy(id_).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, id_).select(id_, "token", (F.col("w") / F.col("norm")).alias("weight"))


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="skip").transform(df)


def fit_pca(df: DataFrame, col: str, share: float = 0.8):
    """PCA on a vector column with as few components as explain ``share`` of the variance, up to all; the fitted model and their number."""
    size = df.select(col).first()[0].size
    full = PCA(k=size, inputCol=col, outputCol="pca").fit(df)
    total, k = 0.0, 0
    for k, v in enumerate(full.explainedVariance, 1):
        total += v
        if total >= share - 1e-12:
            break
    return PCA(k=k, inputCol=col, outputCol="pca").fit(df), k


def hash_share(key: str, seed: int = 42) -> Column:
    """A number in [0, 100) that depends on the key alone, so splits repeat under any plan."""
    return (F.xxhash64(F.col(key), F.lit(seed)) / F.lit(2.0**64) + 0.5) * 100.0


def split(df: DataFrame, key: str, weights: dict[str, float], seed: int = 42) -> DataFrame:
    """Name a part for each row, about in proportion to ``weights``."""
    total, edge, name = sum(weights.values()), 0.0, F.lit(list(weights)[-1])
    cuts = []
    for n, w in weights.items():
        edge += 100.0 * w / total
        cuts.append((edge, n))
    for e, n in reversed(cuts[:-1]):
        name = F.when(hash_share(key, seed) < e, n).otherwise(name)
    return df.withColumn("part", name)


def split_three_way(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """80 % train, of which a tenth is validation; the rest is test."""
    return split(df, key, {"valid": 8, "train": 72, "test": 20}, seed)
