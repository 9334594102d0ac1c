"""Tables as streams: one ordered write, then a file source that takes the files one after the other."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file, and so of a micro-batch.
FILE_ROWS = 1_000_000


def write_in_order(df: DataFrame, order: str, path: str, rows: int = FILE_ROWS) -> int:
    """Write ``df`` as files of at most ``rows`` rows that follow each other by ``order`` (nulls first), and date them so; their number.

    The table is range-partitioned once, into as many parts as its rows fill: each file costs a micro-batch.
    Equal order values stay in one partition, so a partition of one value is several files whose rows count
    in any order, as equal times do.
    """
    spark = df.sparkSession
    parts = max(1, -(-df.count() // rows))
    df.repartitionByRange(parts, order).sortWithinPartitions(order).write.option("maxRecordsPerFile", rows).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(tuple(map(int, m.groups())), s.getPath()) for s in fs.listStatus(folder) if (m := re.match(r"part-(\d+)-.*-c(\d+)", s.getPath().getName()))]
    start = int(time.time() * 1000) - 10 * len(found)
    for i, (_, file) in enumerate(sorted(found, key=lambda x: x[0])):
        fs.setTimes(file, start + 10 * i, -1)  # the source goes by these
    return len(found)


def drained(spark: SparkSession, source: str, schema, build: Callable[[DataFrame], DataFrame], base: str) -> DataFrame:
    """Run ``build`` over the files of ``source``, a file a micro-batch, until all are read; the table that it fills.

    Every micro-batch runs a task and commits a store for each state partition, so there are no more of these
    than tasks run at a time.
    """
    parts, key = "spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass"
    before = {k: spark.conf.get(k, None) for k in (parts, key)}
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(parts, min(int(before[parts]), max(2, spark.sparkContext.defaultParallelism)))
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = build(stream)
        query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
    return spark.read.schema(out.schema).parquet(f"{base}/out")
