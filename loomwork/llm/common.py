"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to Python, whichever is reached first; texts may be long.
ARROW_ROWS, ARROW_BYTES = 4000, 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a local session may leave that unset: it gets a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_folder, "own", None)
        if base is None:
            base = shared_folder.own = "file://" + tempfile.mkdtemp(prefix="spark-loomwork-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut lineage with a table in the shared folder; every executor can read it again.

    Once the table is whole, nothing reads the shuffle files behind it, so Spark is asked to remove them.
    """
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = shared_folder(spark, name), spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Free the space of ``written`` tables that no later query reads: each is overwritten by an empty one."""
    for t in tables:
        t.sparkSession.range(0, 0, 1, 1).write.mode("overwrite").parquet(t.written_path)


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key's decimal text, modulo 5; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % 5


def held_out(number: int, key: str = "doc_id") -> Column:
    """Is the key's fold ``number``? A null key is in none: it is never learned from and not held out."""
    return F.coalesce(fold(key) == number, F.lit(False))


def hash_share(hashed: Column, share: float) -> Column:
    """Does a 64-bit hash lie in the lowest ``share`` of its range? Any share above 2^-50 or so is told apart."""
    return F.lit(True) if share >= 1 else hashed < F.lit(min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64))))
