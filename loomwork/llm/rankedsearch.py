"""Ranked lexical search: accumulators are limited, terms are taken rarest first.

One pass over the texts counts the items' terms and keeps one row a document: its length and (term,
count) of the terms that some item has.  Of each term the number of documents and the greatest
contribution are summed over those rows.  An item's terms are then taken rarest first.  Rounds over the
rows build partial scores of a growing first part of the terms; the kth best partial score is a floor for
the kth best score, and once the greatest contributions of all later terms together are below it, a
document without an accumulator can't be among the best any more: no new ones are made.  The last pass
makes accumulators with the first terms only, drops those that can't reach the floor, and adds the later
terms of the survivors exactly.

All terms of a document stand in its row, so accumulators are never shuffled; each task keeps the ``k``
best of each item and a window ranks those.  Items are taken in blocks of at most ``BLOCK_TERMS`` (item,
term) pairs, each against all rows.

Null and empty texts have no terms: such documents count nowhere and such items have no result.  Texts of
any length are taken whole.  Rows that repeat a doc_id are documents of their own; a null doc_id ranks
before all others on a tie.  Repeated rows of ``items`` count once, and rows with one id and different
texts are one item with the terms of all.  Columns of any other name are ignored.  An empty table on
either side gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import written

#: (item, term) pairs of a block of items: what the driver and each task hold.
BLOCK_TERMS = 1 << 20
#: Postings of an item's first round, as a multiple of k, and how much further each later round goes.
FIRST, GROWTH = 16, 8
#: Accumulator updates that a task holds at a time.
UPDATES = 1 << 21
#: A-Z lower-cased; every byte that is no letter or digit and below 0x80 ends a term.
_TERM = bytes(i if i >= 0x80 or 97 <= i <= 122 or 48 <= i <= 57 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM).split() if text else []


def _item_terms(batches):
    for b in batches:
        at, terms, n = [], [], []
        for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
            for t, c in Counter(terms_of(text)).items():
                at.append(i), terms.append(t), n.append(c)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.binary()), pa.array(n, pa.int64())], ["item", "term", "n"])


def document_rows(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, t, tf) of ``docs(doc_id, text)`` with a term: length, and sorted numbers with counts of those in ``terms``."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        number = known.value
        for b in batches:
            keep, n, t, tf, ends = [], [], [], [], [0]
            for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                own = sorted((number[w], c) for w, c in Counter(words).items() if w in number)
                keep.append(i), n.append(len(words)), t.extend(x[0] for x in own), tf.extend(x[1] for x in own), ends.append(len(t))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(t, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], ["doc_id", "n", "t", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, t array<int>, tf array<long>")


def contribution(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_norm(n, docs: int, total: int):
    return 25 + (75 * n * docs) // total


@dataclass
class Plan:
    """Entries (item, term, weight) sorted by item, rarest term first, and what limits the accumulators."""

    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    start: np.ndarray  # of each item's entries
    docs: int
    total: int
    n_terms: int
    stop: np.ndarray  # of each item: number of terms that make accumulators
    rest: np.ndarray  # what later terms can add at most
    floor: np.ndarray  # the kth best score is at least this
    k: int


def _segments(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices start..start+count-1 one after the other, and which segment each belongs to."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return starts[owner] + np.arange(len(owner)) - first[owner], owner


def _slices(cost: np.ndarray):
    """Ranges of rows whose costs sum to about ``UPDATES``."""
    mark = np.cumsum(cost) // UPDATES
    edges = [0, *(np.nonzero(np.diff(mark))[0] + 1).tolist(), len(cost)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _best(best, new, k: int):
    """The k best (item, null id, id, score) of each item; the lower id on a tie, null first."""
    item, null, ids, score = (np.concatenate(x) for x in zip(best, new))
    order = np.lexsort((ids, ~null, -score, item))
    item, null, ids, score = item[order], null[order], ids[order], score[order]
    first = np.searchsorted(item, item, side="left")
    keep = np.arange(len(item)) - first < k
    return item[keep], null[keep], ids[keep], score[keep]


def _scored(plan: Plan, exact: bool):
    """Arrow task: the k best of each item among the task's documents, by partial or by exact scores."""

    def run(batches):
        place = np.arange(len(plan.item)) - plan.start[plan.item]
        making = np.nonzero(place < plan.stop[plan.item])[0]
        making = making[np.argsort(plan.term[making], kind="stable")]
        by_term = np.searchsorted(plan.term[making], np.arange(plan.n_terms + 1))
        later = np.diff(np.append(plan.start, len(plan.item))) - plan.stop
        best = tuple(np.zeros(0, x) for x in (np.int64, bool, np.int64, np.int64))
        for b in batches:
            key = b.column(0)
            null = key.is_null().to_numpy(zero_copy_only=False)
            ids = key.fill_null(0).to_numpy(zero_copy_only=False)
            n = b.column(1).to_numpy()
            size = b.column(2).value_lengths().to_numpy().astype(np.int64)
            t, tf = b.column(2).flatten().to_numpy().astype(np.int64), b.column(3).flatten().to_numpy()
            of = np.repeat(np.arange(len(n)), size)
            f = contribution(tf, length_norm(n, plan.docs, plan.total)[of])
            posted = of * plan.n_terms + t
            count = by_term[t + 1] - by_term[t]
            from_ = np.cumsum(size) - size
            for lo, hi in _slices(np.bincount(of, count, len(n)).astype(np.int64)):
                a, z = from_[lo], from_[hi - 1] + size[hi - 1]
                e, owner = _segments(by_term[t[a:z]], count[a:z])
                if not len(e):
                    continue
                e, owner = making[e], owner + a
                pair = plan.item[e] * len(n) + of[owner]
                order = np.argsort(pair, kind="stable")
                pair, first = np.unique(pair[order], return_index=True)
                score = np.add.reduceat((plan.weight[e] * f[owner])[order], first)
                item, doc = pair // len(n), pair % len(n)
                if exact:
                    live = score + plan.rest[item] >= plan.floor[item]
                    item, doc, score = item[live], doc[live], score[live]
                    for x, y in _slices(later[item]):
                        e, owner = _segments((plan.start + plan.stop)[item[x:y]], later[item[x:y]])
                        asked = doc[x:y][owner] * plan.n_terms + plan.term[e]
                        at = np.minimum(np.searchsorted(posted, asked), len(posted) - 1)
                        hit = posted[at] == asked
                        np.add.at(score, x + owner[hit], plan.weight[e[hit]] * f[at[hit]])
                good = score > 0
                best = _best(best, (item[good], null[doc[good]], ids[doc[good]], score[good]), plan.k)
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[2], mask=best[1]), pa.array(best[3])], ["q", "doc_id", "score"])

    return run


def _top(rows: DataFrame, plan: Plan, exact: bool) -> DataFrame:
    found = rows.mapInArrow(_scored(plan, exact), "q long, doc_id long, score long")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= plan.k)


def limit_accumulators(rows: DataFrame, plan: Plan, bound: np.ndarray, df: np.ndarray) -> int:
    """Set ``stop``, ``rest`` and ``floor``: rounds over a growing first part of the terms; returns their number."""
    ends = np.append(plan.start, len(plan.item))
    after = [np.append(np.cumsum(bound[a:z][::-1])[::-1], 0) for a, z in zip(ends, ends[1:])]  # what terms from here on can add
    posts = [np.cumsum(df[plan.term[a:z]]) for a, z in zip(ends, ends[1:])]
    size = np.diff(ends)
    open_, budget, rounds = np.ones(len(size), bool), FIRST * plan.k, 0
    while open_.any():
        reach = np.array([min(int(np.searchsorted(posts[q], budget)) + 1, size[q]) if open_[q] else 0 for q in range(len(size))])
        every = (reach == size) & open_  # nothing is left to stop
        plan.stop[every] = size[every]
        open_ &= ~every
        if not open_.any():
            break
        trial = Plan(**(plan.__dict__ | {"stop": np.where(open_, reach, 0)}))
        for r in _top(rows, trial, exact=False).where(F.col("rank") == plan.k).select("q", "score").collect():  # one row an item
            plan.floor[r.q] = max(plan.floor[r.q], r.score)
            below = np.nonzero(after[r.q] < plan.floor[r.q])[0]
            if below[0] <= reach[r.q]:
                plan.stop[r.q], plan.rest[r.q], open_[r.q] = below[0], after[r.q][below[0]], False
        budget, rounds = budget * GROWTH, rounds + 1
    return rounds


def make_plan(rows: DataFrame, entries: list[tuple[int, int, int]], n_terms: int, k: int) -> tuple[Plan, np.ndarray, np.ndarray] | None:
    """The unlimited plan of (item, term, repeats), the greatest contribution of each entry, and documents by term."""
    docs, total = rows.agg(F.count("*"), F.sum("n")).first()
    if not docs:
        return None
    m = F.lit(25) + F.call_function("div", F.lit(75 * docs) * F.col("n"), F.lit(total))
    each = rows.select("n", F.explode(F.arrays_zip("t", "tf")).alias("p")).select("p.t", F.call_function("div", F.col("p.tf") * 1_000_000_000, F.col("p.tf") * 1000 + m * 8).alias("f"))
    df, most = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
    for r in each.groupBy("t").agg(F.count("*").alias("df"), F.max("f").alias("f")).collect():  # one row a term of the block
        df[r.t], most[r.t] = r.df, r.f
    w = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    item, term, repeats = (np.array(x, np.int64) for x in zip(*entries))
    order = np.lexsort((term, df[term], item))
    item, term, repeats = item[order], term[order], repeats[order]
    n_items = int(item.max()) + 1
    plan = Plan(item, term, repeats * w[term], np.searchsorted(item, np.arange(n_items)), docs, total, n_terms, np.zeros(n_items, np.int64), np.zeros(n_items, np.int64), np.zeros(n_items, np.int64), k)
    return plan, plan.weight * most[term], df


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs(doc_id, text)`` for each of ``items(item_id, text)``, with scores above 0."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", "text").distinct().mapInArrow(_item_terms, f"item_id {kind}, term binary, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))
    asked = written(asked, "item-terms")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = -(-asked.count() // BLOCK_TERMS)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()  # about BLOCK_TERMS rows
        items_, terms = {}, {}
        entries = [(items_.setdefault(r.item_id, len(items_)), terms.setdefault(bytes(r.term), len(terms)), r.n) for r in own]
        if not entries:
            continue
        rows = written(document_rows(held, terms), "document-terms")
        made = make_plan(rows, entries, len(terms), k)
        if made is None:
            continue
        plan, bound, df = made
        limit_accumulators(rows, plan, bound, df)
        names = spark.createDataFrame(list(zip(range(len(items_)), items_)), f"q long, item_id {kind}")
        found = _top(rows, plan, exact=True).join(names, "q")
        out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out


#: The same over the tables ``documents`` and ``benchmark``.
ORACLE = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
t AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY 1) CROSS JOIN a),
m AS (SELECT doc_id, 25 + (75 * n * docs) // total AS m FROM n CROSS JOIN a),
s AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
