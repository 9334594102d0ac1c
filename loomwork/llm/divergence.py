"""How far the word use of sources of one language lies apart, by products of one-hot level matrices.

Every group (language, source) gives each kept term of its language an integer share p that depends on
the term's count there alone, so the divergence of two groups needs no more than their joint table: how
many terms have count a in the one and count b in the other.  Terms of a language are dealt into blocks
of alike frequency; in a block each (group, count) pair is a 0/1 column over the terms, the product of
the block's matrix with its own transpose is every joint table at once, and the tables are priced where
they are made.  The products count at most ``BLOCK`` terms, so they are exact in floats; all other
arithmetic is on 64-bit integers and decimals.  Blocks of alike frequency have few distinct counts.

Terms are counted in Arrow batches, combined in each task before the shuffle, so a source with a third
of all rows ships no more than its distinct terms a task.  Many groups are dealt into blocks of groups,
and tasks hold one pair of those and one block of terms.

Null text, language and source are ''.  Texts of any length are taken whole.  Repeated rows count as
often as they occur.  Groups without a kept term are reported with value 0 or, where others of their
language have kept terms, with the share of count 0.  Equal values rank by item, as UTF-8 bytes.  Columns
of any other name are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import written

#: Terms of a block, and groups of a block of groups.
BLOCK, GROUPS = 256, 64
#: Columns of a matrix product at a time.
COLUMNS = 2048
#: Entries that a task counts before it hands them on.
ENTRIES = 400_000
#: A-Z lower-cased; every byte that is no letter and below 0x80 ends a term.
_LETTERS = bytes(i if i >= 0x80 or 97 <= i <= 122 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))


def _count(batches):
    """Batches of (text, lang, source) → (lang, source, term, n, d): occurrences, and rows with the term."""
    seen: dict[tuple, tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (n, d) in seen.items():
            if n:
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                size = len(terms)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array([source] * size), terms, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "d"])
        seen.clear()

    for b in batches:
        for text, lang, source in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            n, d = seen.setdefault((lang, source), (Counter(), Counter()))
            terms = text.translate(_LETTERS).split()
            n.update(terms)
            d.update(set(terms))
        if sum(len(n) for n, _ in seen.values()) > ENTRIES:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d) of all rows of ``docs(text, lang, source)``."""
    parts = docs.mapInArrow(_count, "lang string, source string, term string, n long, d long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)), in decimals: the product may pass 64 bits."""
    return (F.lit(1) + F.call_function("div", (F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")).cast("decimal(38,0)"), (total + 2 * v).cast("decimal(38,0)"))).cast("long")


def _price(p, q):
    return (p - q) ** 2 // (p + q)


def joint_tables(level_i: np.ndarray, level_j: np.ndarray, sizes_i: list[int], sizes_j: list[int]) -> np.ndarray:
    """Terms by count for every two groups: one-hot columns of (group, level) times their transpose.

    ``level_i`` holds a level 0..size-1 for each term (row) and group; groups lie one after the other in the result.
    """

    def one_hot(level, sizes):
        x = np.zeros((level.shape[0], sum(sizes)), np.float32)
        x[np.arange(level.shape[0])[:, None], level + np.cumsum([0, *sizes[:-1]])] = 1
        return x

    return one_hot(level_i, sizes_i).T @ one_hot(level_j, sizes_j)


def _chunks(sizes: list[int]):
    """Runs of groups with about ``COLUMNS`` columns."""
    at, held = 0, 0
    for i, s in enumerate(sizes):
        if held and held + s > COLUMNS:
            yield at, i
            at, held = i, 0
        held += s
    if sizes:
        yield at, len(sizes)


def _pair_sums(cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Of one block of terms: the summed price of every two of its groups, one row for each order of them."""
    names = groups.column("source").to_pylist()
    n_terms = groups.column("terms")[0].as_py() if len(names) else 0
    at = {s: i for i, s in enumerate(names)}
    row_of: dict[str, int] = {}
    rows = np.array([row_of.setdefault(t, len(row_of)) for t in cells.column("term").to_pylist()], np.int64)
    cols = np.array([at[s] for s in cells.column("source").to_pylist()], np.int64)
    p = cells.column("p").to_numpy() if len(cells) else np.zeros(0, np.int64)
    zero, part = groups.column("p0").to_numpy(), groups.column("part").to_numpy()
    value = np.tile(zero, (n_terms, 1))  # the share of count 0; terms that none of these groups has keep it
    value[rows, cols] = p
    prices, level = [], np.zeros(value.shape, np.int64)
    for g in range(len(names)):
        own, level[:, g] = np.unique(value[:, g], return_inverse=True)
        prices.append(own)
    out: list[tuple[str, str, int]] = []
    order = np.argsort(part, kind="stable")
    left, right = (order[part[order] == x] for x in (part.min(), part.max())) if len(names) else ([], [])
    same = len(names) and part.min() == part.max()
    if same and groups.column("gi")[0].as_py() != groups.column("gj")[0].as_py():
        left = right = left[:0]  # the other block of groups is empty
    for a, b in _chunks([len(prices[g]) for g in left]):
        for c, d in _chunks([len(prices[g]) for g in right]):
            if same and c < a:
                continue
            gi, gj = left[a:b], right[c:d]
            si, sj = [len(prices[g]) for g in gi], [len(prices[g]) for g in gj]
            table = joint_tables(level[:, gi], level[:, gj], si, sj).astype(np.int64)
            cost = table * _price(np.concatenate([prices[g] for g in gi])[:, None], np.concatenate([prices[g] for g in gj])[None, :])
            sums = np.add.reduceat(np.add.reduceat(cost, np.cumsum([0, *si[:-1]]), axis=0), np.cumsum([0, *sj[:-1]]), axis=1)
            for x, g in enumerate(gi):
                for y, h in enumerate(gj):
                    if g != h and not (same and (a == c) and h < g):
                        out += [(names[g], names[h], int(sums[x, y])), (names[h], names[g], int(sums[x, y]))]
    lang = groups.column("lang")[0].as_py() if len(names) else None
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array([o[0] for o in out], pa.string()), "item": pa.array([o[1] for o in out], pa.string()), "value": pa.array([o[2] for o in out], pa.int64())})


def audit(df: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``df(text, lang, source)``.

    Part ``pair``: the divergence from every other source of the language, all ranks.  Part ``term``: the
    ``top`` kept terms that the group uses more than its language, by their part of the divergence from it.
    A term is kept if ``least_docs`` rows of the language have it.
    """
    docs = df.select(*[F.coalesce(df[c].cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    raw = written(term_counts(docs), "term-counts")
    kept = raw.groupBy("lang", "term").agg(F.sum("n").alias("c"), F.sum("d").alias("d")).where(F.col("d") >= least_docs).drop("d")
    placed = kept.repartitionByRange("lang", F.desc("c"), "term").sortWithinPartitions("lang", F.desc("c"), "term")
    kept = written(placed.withColumn("block", F.floor(F.monotonically_increasing_id() / F.lit(BLOCK))), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("c").alias("total"))

    counted = raw.join(kept, ["lang", "term"]).select("lang", "source", "term", "block", "n", "c")
    sums = counted.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "v", "total"])
    parts = groups.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(GROUPS)).cast("int").alias("parts"))
    groups = groups.join(parts, "lang").withColumn("part", F.pmod(F.xxhash64("source"), F.col("parts")).cast("int"))
    groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("size"), F.col("v")))), "groups")

    full = counted.join(groups.select("lang", "source", "size", "v", "total", "part", "parts"), ["lang", "source"])
    cells = written(full.select("lang", "source", "part", "parts", "term", "block", _share(F.col("n"), F.col("size"), F.col("v")).alias("p"), _share(F.col("c"), F.col("total"), F.col("v")).alias("q")), "cells")

    meets = lambda d: d.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_y")).withColumns({"gi": F.least("part", "_y"), "gj": F.greatest("part", "_y")}).drop("_y", "parts")
    blocks = kept.groupBy("lang", "block").agg(F.count("*").cast("int").alias("terms"))
    key = ["lang", "block", "gi", "gj"]
    sides = meets(blocks.join(groups.select("lang", "source", "part", "parts", "p0"), "lang"))  # every block of terms meets every group of its language once
    priced = meets(cells.drop("q")).groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(_pair_sums, "lang string, source string, item string, value long")
    own = lambda d: d.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    name = groups.select("lang", "source")
    every = name.join(name.withColumnRenamed("source", "item"), "lang").where("source <> item")  # what the result holds: each group's other groups
    pairs = every.join(own(priced), ["lang", "source", "item"], "left").na.fill(0, ["value"])
    terms = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return (
        pairs.withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
        .unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
    )


#: The same over the table ``documents``.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT x.lang, count(k.term) AS v, coalesce(sum(k.c), 0) AS n FROM (SELECT DISTINCT lang FROM g) x LEFT JOIN k USING (lang) GROUP BY 1),
x AS (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(x.c), 0) AS n FROM g LEFT JOIN x USING (lang, source) GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(x.c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(x.c, 0) + 2)) // (s.n + 2 * l.v) AS p
      FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN x ON x.lang = s.lang AND x.source = s.source AND x.term = k.term),
q AS (SELECT k.lang, k.term, 1 + (CAST(1000000000 AS HUGEINT) * (k.c + 2)) // (l.n + 2 * l.v) AS q FROM k JOIN l USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, CAST((p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""
