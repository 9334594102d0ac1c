"""Readers and writers.  Work goes through Spark's sources, so any file system Spark knows will do."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    """Does the path exist, in whatever store it is?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_months(spark: SparkSession, base: str, prefix: str, year: int, months: list[int], schema: StructType | str | None = None) -> DataFrame:
    """Monthly files ``prefix_YYYY-MM.parquet``; months without a file are skipped, none at all is an error."""
    paths = [p for m in months if exists(spark, p := f"{base}/{prefix}_{year}-{m:02d}.parquet")]
    if not paths:
        raise FileNotFoundError(f"no file of {prefix} for {year}, months {months}, in {base}")
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", True)
    return reader.parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True, **options: str) -> DataFrame:
    """Typed CSV; without header the schema names the columns."""
    return spark.read.schema(schema).options(header=header, **options).csv(path)


def read_headerless(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.option("header", False).option("inferSchema", True).csv(path).toDF(*names)


def features(df: DataFrame, array: str = "features") -> DataFrame:
    """(zone_id, zone) of ``features[].properties``; a missing name becomes ''."""
    p = df.select(F.explode(array).alias("f")).select("f.properties.*")
    return p.select(F.try_to_number("location_id", F.lit("999999")).cast("int").alias("zone_id"), F.coalesce("zone", F.lit("")).alias("zone"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    schema = "features array<struct<properties: struct<location_id: string, zone: string>>>"
    return features(spark.read.schema(schema).option("multiLine", True).json(path))


def file_manifest(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """Manifest of image files below a path; their contents aren't read."""
    return manifest_of(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path"))


def manifest_of(files: DataFrame) -> DataFrame:
    """``path``, label (the character before the extension) and the parts of names like ``8863_idx5_x451_y1451_class0``."""
    name = F.regexp_extract("path", r"([^/]+)\.\w+$", 1)
    part = lambda pattern: F.regexp_extract(name, pattern, 1)
    return files.select("path", F.substring(name, -1, 1).alias("label"), part(r"^(\d+)_").alias("patient_id"), part(r"_x(\d+)").try_cast("int").alias("x"), part(r"_y(\d+)").try_cast("int").alias("y"))


def calendar(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row a day with its parts."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias("date"))
    return days.select("date", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"))


def sql_view(spark: SparkSession, frames: dict[str, DataFrame], text: str) -> DataFrame:
    """Run query text over frames by name, without leaving views behind."""
    return spark.sql(text, **frames)


def create_or_replace(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def write_layer(df: DataFrame, path: str, partition_by: str | None = None, fmt: str = "parquet") -> None:
    """Overwrite a path, by partitions if the column is there; rows of a partition value go to a few files."""
    writer = df
    if partition_by and partition_by in df.columns:
        writer = df.hint("rebalance", partition_by)
        writer.write.mode("overwrite").format(fmt).partitionBy(partition_by).save(path)
    else:
        writer.write.mode("overwrite").format(fmt).save(path)


def read_layer(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
