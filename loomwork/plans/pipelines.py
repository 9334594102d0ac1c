"""Layered pipelines: raw, cleaned and summarised tables, and a complaints model."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.scalars import days_between, week_bucket
from loomwork.operators.aggregates import trip_summary, zone_summary
from loomwork.operators.cleaning import add_ingest_time, cast_if_present, clamp_negative, clean_names, drop_empty, drop_sparse, fill, keep_positive, modes
from loomwork.sources.tables import read_layer, read_months, write_layer

#: Columns that must be above 0 in a cleaned trip.
POSITIVE = ["fare", "distance", "passengers", "total"]


@dataclass
class Config:
    source: str
    target: str
    prefix: str = "trips"
    year: int = 2024
    months: list[int] = field(default_factory=lambda: [1])
    time: str = "pickup"
    fmt: str = "parquet"
    casts: dict[str, str] = field(default_factory=lambda: {"passengers": "bigint", "pickup_zone": "bigint", "dropoff_zone": "bigint"})


def bronze(spark: SparkSession, cfg: Config) -> DataFrame:
    """Months → ingest time and day → layer partitioned by day."""
    raw = add_ingest_time(read_months(spark, cfg.source, cfg.prefix, cfg.year, cfg.months), cfg.time)
    write_layer(raw, f"{cfg.target}/bronze", "pickup_day", cfg.fmt)
    return read_layer(spark, f"{cfg.target}/bronze", cfg.fmt)


def silver(df: DataFrame, casts: dict[str, str] | None = None, positive: list[str] = POSITIVE) -> DataFrame:
    """Clean names, cast, drop empty columns, keep positive rows."""
    return keep_positive(drop_empty(cast_if_present(clean_names(df), casts or {})), positive)


def gold(df: DataFrame) -> dict[str, DataFrame]:
    return {"trip_summary": trip_summary(df, "HOUR"), "pickup_zones": zone_summary(df, "DAY", "pickup"), "dropoff_zones": zone_summary(df, "DAY", "dropoff")}


def run(spark: SparkSession, cfg: Config, step: str | None = None) -> list[str]:
    """All layers, or one by name, each from the stored one before it; the names of the layers written."""
    done = []
    if step not in (None, "bronze", "silver", "gold"):
        raise ValueError("step is bronze, silver or gold")
    if step in (None, "bronze"):
        bronze(spark, cfg)
        done.append("bronze")
    if step in (None, "silver"):
        write_layer(silver(read_layer(spark, f"{cfg.target}/bronze", cfg.fmt), cfg.casts), f"{cfg.target}/silver", "pickup_day", cfg.fmt)
        done.append("silver")
    if step in (None, "gold"):
        for name, df in gold(read_layer(spark, f"{cfg.target}/silver", cfg.fmt)).items():
            write_layer(df, f"{cfg.target}/gold/{name}", None, cfg.fmt)
            done.append(f"gold/{name}")
    return done


CATEGORIES = ["product", "channel", "timely", "week"]


def prepare_complaints(df: DataFrame) -> DataFrame:
    """Days held (not below 0), week of the month and label."""
    held = clamp_negative(days_between(F.col("received"), F.col("sent"))).cast("double")
    out = df.withColumn("days_held", held).withColumn("week", week_bucket(F.col("received")).cast("string"))
    return out.withColumn("label", F.when(F.col("disputed") == "Yes", 1.0).otherwise(0.0)) if "disputed" in df.columns else out


def complaints_pipeline(train: DataFrame, test: DataFrame, share: float = 0.8) -> DataFrame:
    """Drop sparse columns, impute, encode, scale, reduce to ``share`` of the variance, fit; predictions for every row of ``test``.

    Modes, medians, codes, scales, components and weights all come from ``train``.
    """
    kept = drop_sparse(train)
    common = modes(kept, [c for c in kept.columns if c in ("state", "product", "channel", "timely")])
    ready = prepare_complaints(fill(kept, common))
    cats = [c for c in CATEGORIES if c in ready.columns]
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep", stringOrderType="alphabetAsc") for c in cats]
    stages += [OneHotEncoder(inputCols=[f"{c}_ix" for c in cats], outputCols=[f"{c}_vec" for c in cats]), Imputer(inputCols=["days_held"], outputCols=["days_filled"], strategy="median")]
    stages += [VectorAssembler(inputCols=[*[f"{c}_vec" for c in cats], "days_filled"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)]
    encoded = Pipeline(stages=stages).fit(ready)
    vectors = encoded.transform(ready)
    width = len(vectors.select("scaled").first().scaled) if not vectors.isEmpty() else 1
    explained = np.cumsum(PCA(k=width, inputCol="scaled", outputCol="features").fit(vectors).explainedVariance.toArray())
    k = min(width, int(np.searchsorted(explained, share)) + 1)
    model = Pipeline(stages=[PCA(k=k, inputCol="scaled", outputCol="features"), LogisticRegression(labelCol="label", featuresCol="features", maxIter=20)]).fit(vectors)
    asked = prepare_complaints(fill(test.select(*[c for c in kept.columns if c in test.columns]), common))
    made = model.transform(encoded.transform(asked))
    return made.drop("raw", "scaled", "features", "rawPrediction", "probability", "days_filled", *[f"{c}_ix" for c in cats], *[f"{c}_vec" for c in cats])
