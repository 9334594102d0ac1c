"""Connected components of an edge table by alternating large-star and small-star steps.

Nothing is gathered on the driver but one checksum a round; each round is cut with a table in the
shared folder.  Ids may be of any orderable type; a component is named by its smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import release, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _star(neighbours: DataFrame, keep, low) -> DataFrame:
    """Link the chosen neighbours of each ``u`` to its least neighbour; the least is a plain aggregate, so a hub isn't gathered."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = neighbours.join(least, "u").where(keep).select(F.col("v").alias("b"), F.col("m").alias("a"))
    own = least.select(F.col("u").alias("b"), F.col("m").alias("a")) if low else linked.limit(0)
    return linked.union(own).where("a <> b").distinct() if low else linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; self links and repeats don't matter."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    before, last = None, None
    while True:  # each round but the last joins trees; the number of rounds grows with the logarithm of the longest chain
        edges = written(edges, "components")
        if last is not None:
            release(last)
        last = edges
        mark = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        large = _star(_both(edges), F.col("v") > F.col("u"), low=False)
        small = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        edges = _star(small, F.lit(True), low=True).select("a", "b")
    return edges.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node").unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
