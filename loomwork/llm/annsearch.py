"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries walk it greedily.

Rows with one vector are one node (the least vec_id names it), so copies neither fill each other's lists
nor need an index each.  The first lists come from brute force within blocks of ``BLOCK`` nodes that lie
next to each other on a few random lines.  Each round of NN-descent then joins neighbours of neighbours:
a node gathers up to ``SAMPLE`` new and old neighbours in either direction with their vectors, every pair
with a new one is measured, and what improves a list is merged into it.  Rounds end when fewer than
``STILL`` of all entries are new, or after ``ROUNDS``.

A query holds a beam of the ``beam`` nearest nodes found; each round its ``STEP`` nearest nodes not yet
expanded ask for their neighbours, until none is left.  Vectors travel to the joins as bytes of their own
precision, distances are summed in double precision on the original components, so the scores returned
are exact; which rows are found is approximate.  What bounds the work are sizes of lists, samples and
beams only: every row is indexed, and every copy of a found vector can be returned.

Rows with a null vec_id take no part, nor vectors that are null, empty, zero, hold null or non-finite
components, or are not of the most frequent length (the longer on a tie).  Of rows that repeat a vec_id
the least vector counts.  With fewer candidates than k all are returned.  Equal distances rank by vec_id.
Columns of any other name are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import release, written

#: Neighbours of a node; how many new and old ones of either direction join in a round.
NEIGHBOURS, SAMPLE = 30, 12
#: Nodes of a block of the first lists, and lines that they are laid along.
BLOCK, LINES = 512, 3
ROUNDS, STILL = 8, 0.05
#: Nodes that a query holds, and expands in a round.
BEAM, STEP = 256, 64
#: Nodes of a task: when lists merge, and when members meet with their vectors; and rows of a task that measures.
MERGED, MET, MEASURED = 4096, 1024, 50_000
#: Entries that a task gathers before it keeps the best of each node.
HELD = 1 << 21


def _tasks(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df`` in as many tasks as its ``rows`` need, where the shuffle made more."""
    return df.coalesce(max(1, -(-rows // each)))


# --- rows and vectors
def _bytes(double: bool):
    kind = np.float64 if double else np.float32

    def run(batches):
        for b in batches:
            flat = np.ascontiguousarray(b.column(1).flatten().to_numpy(zero_copy_only=False), kind)
            size = flat.itemsize * (len(flat) // max(1, b.num_rows))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), b.num_rows, [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary()) if size else pa.array([], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), packed], ["id", "v"])

    return run


def _matrix(column: pa.Array, double: bool) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.float64 if double else np.float32).reshape(n, -1).astype(np.float64)


def taking_part(df: DataFrame) -> tuple[DataFrame, bool]:
    """(id, v): vectors that take part, as bytes, one a vec_id; and whether they are doubles."""
    double = "double" in df.schema["embedding"].dataType.simpleString()
    rows = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("x")).where("id is not null and size(x) > 0")
    finite = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("x", lambda c: c != 0))
    common = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()  # one row a length
    if common is None:
        return rows.limit(0).mapInArrow(_bytes(double), "id long, v binary"), double
    return rows.where(F.size("x") == common.n).groupBy("id").agg(F.min("x").alias("x")).mapInArrow(_bytes(double), "id long, v binary"), double


# --- lists of neighbours
def _best_of(u, w, d, fresh, k: int):
    """Entries (u, w, d, fresh), each pair once (kept as old if it was), the k nearest of each u, sorted."""
    order = np.lexsort((fresh, w, u))
    u, w, d, fresh = u[order], w[order], d[order], fresh[order]
    once = np.ones(len(u), bool)
    once[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    u, w, d, fresh = u[once], w[once], d[once], fresh[once]
    order = np.lexsort((w, d, u))
    u, w, d, fresh = u[order], w[order], d[order], fresh[order]
    keep = np.arange(len(u)) - np.searchsorted(u, u) < k
    return u[keep], w[keep], d[keep], fresh[keep]


_LISTS = "u long, w array<long>, d array<double>, fresh array<boolean>"


def _lists(u, w, d, fresh) -> pa.RecordBatch:
    first = np.nonzero(np.append(True, u[1:] != u[:-1]))[0] if len(u) else np.zeros(0, np.int64)
    ends = pa.array(np.append(first, len(u)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(u[first], pa.int64()), *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in (w, d, fresh)]], ["u", "w", "d", "fresh"])


class _Held:
    """Entries of a task, cut to the best of each node when they grow."""

    def __init__(self, k: int):
        self.k, self.parts, self.n = k, [], 0

    def add(self, *entries):
        self.parts.append(entries)
        self.n += len(entries[0])
        if self.n > HELD:
            self.cut()

    def cut(self):
        if self.parts:
            self.parts = [_best_of(*(np.concatenate(x) for x in zip(*self.parts)), self.k)]
            self.n = len(self.parts[0][0])

    def batches(self):
        self.cut()
        if self.parts and self.n:
            u = self.parts[0][0]
            at = 0
            while at < len(u):  # whole nodes, about 100,000 entries a batch
                end = len(u) if at + 100_000 >= len(u) else int(np.searchsorted(u, u[at + 100_000]))
                end = end if end > at else int(np.searchsorted(u, u[at], side="right"))
                yield _lists(*(x[at:end] for x in self.parts[0]))
                at = end


def _block_lists(k: int, double: bool):
    """Arrow task over (id, v) in the order of a line: brute force within blocks."""

    def run(batches):
        held, ids, vectors, n = _Held(k), [], [], 0

        def block(i, x):
            square = (x * x).sum(axis=1)
            d = square[:, None] + square[None, :] - 2 * x @ x.T
            np.fill_diagonal(d, np.inf)
            m = min(k, len(i) - 1)
            if m > 0:
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                far = np.sqrt(np.maximum(np.take_along_axis(d, near, axis=1), 0)).ravel()
                held.add(np.repeat(i, m), i[near].ravel(), far, np.ones(len(far), bool))

        for b in batches:
            ids.append(b.column(0).to_numpy()), vectors.append(_matrix(b.column(1), double))
            n += b.num_rows
            while n >= 2 * BLOCK:
                i, x = np.concatenate(ids), np.concatenate(vectors)
                block(i[:BLOCK], x[:BLOCK])
                ids, vectors, n = [i[BLOCK:]], [x[BLOCK:]], n - BLOCK
        if n:
            block(np.concatenate(ids), np.concatenate(vectors))
        yield from held.batches()

    return run


def _merged(lists: DataFrame, k: int, n: int) -> DataFrame:
    """Lists of the same node as one."""

    def run(batches):
        for b in batches:
            ids, rows = b.column(0).to_numpy(), b.column(1)
            inner = rows.flatten()
            owner = np.repeat(ids, rows.value_lengths().to_numpy())
            w = inner.field("w")
            size = w.value_lengths().to_numpy()
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (w, inner.field("d"), inner.field("fresh"))]
            yield _lists(*_best_of(np.repeat(owner, size), *flat, k))

    return _tasks(lists.groupBy("u").agg(F.collect_list(F.struct("w", "d", "fresh")).alias("l")), n, MERGED).mapInArrow(run, _LISTS)


def _first_lists(nodes: DataFrame, n: int, k: int, double: bool, seed: int) -> DataFrame:
    def along(line: int):
        def run(batches):
            for b in batches:
                x = _matrix(b.column(1), double)
                at = x @ np.random.default_rng([seed, line]).normal(size=x.shape[1]) if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at)], ["id", "v", "at"])

        laid = nodes.mapInArrow(run, "id long, v binary, at double").repartitionByRange("at", "id").sortWithinPartitions("at", "id")
        return _tasks(laid.select("id", "v"), n, MERGED).mapInArrow(_block_lists(k, double), _LISTS)

    lists = along(0)
    for line in range(1, LINES):
        lists = lists.unionByName(along(line))
    return _merged(lists, k, n)


def _draw(a: Column | str, b: Column | str, turn: int) -> Column:
    return F.xxhash64(F.lit(turn), a, b)


def _descend(nodes: DataFrame, n: int, graph: DataFrame, k: int, double: bool, turn: int) -> DataFrame:
    """One round: samples of both directions meet at a node, improving pairs are merged into the lists."""
    entry = lambda x: F.struct(x["fresh"].alias("fresh"), _draw("u", x["w"], turn).alias("o"), x["w"].alias("w"), x["d"].alias("d"))
    drawn = graph.select("u", F.array_sort(F.transform(F.arrays_zip("w", "d", "fresh"), entry)).alias("l"), F.element_at("d", -1).alias("far"), F.size("w").alias("n"))
    part = lambda fresh: F.slice(F.filter("l", lambda x: x["fresh"] == F.lit(fresh)), 1, SAMPLE)
    chosen = drawn.select("u", F.explode(F.concat(part(True), part(False))).alias("e")).select("u", "e.w", "e.fresh")
    back = chosen.select(F.col("w").alias("x"), F.col("u").alias("m"), "fresh")
    place = F.row_number().over(Window.partitionBy("x", "fresh").orderBy(_draw("m", "x", turn), "m"))
    offers = chosen.select(F.col("u").alias("x"), F.col("w").alias("m"), "fresh").unionByName(back.withColumn("_r", place).where(F.col("_r") <= SAMPLE).drop("_r"))
    far = F.when(F.col("n") == k, F.col("far")).otherwise(float("inf"))
    member = nodes.join(drawn.select(F.col("u").alias("id"), far.alias("far")), "id").withColumnRenamed("id", "m")
    met = offers.join(member, "m").groupBy("x").agg(F.collect_list(F.struct("m", "fresh", "far", "v")).alias("l"))  # 4 * SAMPLE at most

    def local(batches):
        held = _Held(k)
        for b in batches:
            rows = b.column(1)
            inner, ends = rows.flatten(), np.append(0, np.cumsum(rows.value_lengths().to_numpy()))
            m, fresh, reach = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("m", "fresh", "far"))
            v = _matrix(inner.field("v"), double)
            square = (v * v).sum(axis=1)
            for a, z in zip(ends, ends[1:]):
                new = a + np.nonzero(fresh[a:z])[0]
                if not len(new):
                    continue
                d = np.sqrt(np.maximum(square[new, None] + square[None, a:z] - 2 * v[new] @ v[a:z].T, 0))
                i, j = np.nonzero((d < np.maximum(reach[new][:, None], reach[None, a:z])) & (m[new][:, None] != m[None, a:z]))
                p, q, d = new[i], a + j, d[i, j]
                u, w, d, r = np.append(m[p], m[q]), np.append(m[q], m[p]), np.append(d, d), np.append(reach[p], reach[q])
                good = d < r
                held.add(u[good], w[good], d[good], np.ones(int(good.sum()), bool))
        yield from held.batches()

    found = _tasks(met, n, MET).mapInArrow(local, _LISTS)
    taken = lambda x: x["fresh"] & ~F.exists("_new", lambda y: y["w"] == x["w"])
    old = drawn.withColumn("_new", part(True)).select("u", F.transform("l", lambda x: x["w"]).alias("w"), F.transform("l", lambda x: x["d"]).alias("d"), F.transform("l", taken).alias("fresh"))
    return _merged(old.unionByName(found), k, n)


def neighbour_graph(nodes: DataFrame, double: bool, k: int = NEIGHBOURS, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """(u, w, d, fresh): the ``k`` nearest found of each of ``nodes(id, v)``, nearest first; ``nodes`` is a written table."""
    n = nodes.count()
    graph = written(_first_lists(nodes, n, k, double, seed), "graph")
    for turn in range(rounds):
        after = written(_descend(nodes, n, graph, k, double, turn), "graph")
        release(graph)
        graph = after
        fresh = graph.agg(F.avg(F.size(F.filter("fresh", lambda x: x)) / F.size("fresh"))).first()[0]  # one number
        if fresh is None or fresh < STILL:
            break
    return graph


# --- search
def _beams(states: DataFrame, beam: int, n: int) -> DataFrame:
    """(query, node, d, done) rows of a query as its beam of the nearest."""

    def run(batches):
        for b in batches:
            rows = b.column(1)
            inner, size = rows.flatten(), rows.value_lengths().to_numpy()
            owner = np.repeat(np.arange(b.num_rows), size)
            node, d, done = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("node", "d", "done"))
            owner, node, d, todo = _best_of(owner, node, d, ~done, beam)
            ends = pa.array(np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (node, d, ~todo)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["query", "node", "d", "done"])

    return _tasks(states.groupBy("query").agg(F.collect_list(F.struct("node", "d", "done")).alias("l")), n * beam, MEASURED).mapInArrow(run, "query long, node array<long>, d array<double>, done array<boolean>")


def _measured(asked: DataFrame, nodes: DataFrame, double: bool, rows: int) -> DataFrame:
    """(query, node, d) of ``asked(query, node, qv, far)``, where nearer than far."""

    def run(batches):
        for b in batches:
            q, v = _matrix(b.column(2), double), _matrix(b.column(4), double)
            d = np.sqrt(((q - v) ** 2).sum(axis=1)) if b.num_rows else np.zeros(0)
            good = pa.array(d < b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good), pa.array(d).filter(good)], ["query", "node", "d"])

    both = asked.join(nodes.withColumnRenamed("id", "node"), "node").select("query", "node", "qv", "far", "v")
    return _tasks(both, rows, MEASURED).mapInArrow(run, "query long, node long, d double")


def walk(nodes: DataFrame, graph: DataFrame, queries: DataFrame, seeds: DataFrame, double: bool, beam: int = BEAM, step: int = STEP) -> DataFrame:
    """(query, node, d, done): the ``beam`` nearest nodes that a greedy walk from ``seeds(query, node)`` finds for ``queries(query, qv)``."""
    n = queries.count()
    links = graph.select(F.col("u").alias("node"), F.col("w").alias("next"))
    start = _measured(seeds.join(queries, "query").select("query", "node", "qv", F.lit(float("inf")).alias("far")), nodes, double, n * step)
    state = written(_beams(start.withColumn("done", F.lit(False)), beam, n), "beam")
    while True:  # each round expands nodes that no round before did
        pairs = state.select("query", F.arrays_zip("node", "d", "done").alias("l"), F.when(F.size("d") >= beam, F.element_at("d", -1)).otherwise(float("inf")).alias("far"))
        todo = pairs.withColumn("go", F.slice(F.filter("l", lambda x: ~x["done"]), 1, step))
        if todo.where(F.size("go") > 0).isEmpty():
            return state
        asked = todo.select("query", "far", F.explode("go.node").alias("node")).join(links, "node").select("query", "far", F.explode("next").alias("node")).distinct()
        found = _measured(asked.join(queries, "query").select("query", "node", "qv", "far"), nodes, double, n * step * NEIGHBOURS).withColumn("done", F.lit(False))
        held = todo.select("query", F.explode("l").alias("x"), "go").select("query", "x.node", "x.d", (F.col("x.done") | F.array_contains("go.node", F.col("x.node"))).alias("done"))
        after = written(_beams(held.unionByName(found), beam, n), "beam")
        release(state)
        state = after


def near_rows(df: DataFrame, is_query: Column, k: int = 10, beam: int = BEAM, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found rows of ``df(vec_id, embedding)`` for each of its rows with ``is_query(vec_id)``, itself left out."""
    rows, double = taking_part(df)
    rows = written(rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}), "vectors")
    first = rows.groupBy("h1", "h2").agg(F.min("id").alias("node"))  # equal vectors by 128 bits of hash
    named = written(rows.select("id", "h1", "h2").join(first, ["h1", "h2"]).select("id", "node"), "names")
    nodes = written(rows.select("id", "v").join(named.where("id = node").select("id"), "id", "left_semi"), "nodes")
    graph = neighbour_graph(nodes, double, neighbours, rounds)
    asked = named.where(is_query(F.col("id"))).withColumnRenamed("id", "query")
    queries = written(asked.select(F.col("node").alias("id"), "query").join(nodes, "id").select("query", F.col("v").alias("qv")), "queries")
    own = asked.join(graph.select(F.col("u").alias("node"), F.concat(F.array("u"), "w").alias("next")), "node", "left")  # a lone node has no list
    seeds = own.select("query", F.explode(F.coalesce("next", F.array("node"))).alias("node"))
    state = walk(nodes, graph, queries, seeds, double, beam)
    hits = state.select("query", F.explode(F.arrays_zip("node", "d")).alias("x")).select("query", "x.node", "x.d")
    place = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    copies = named.withColumn("_r", place).where(F.col("_r") <= k + 1).drop("_r")  # the query itself may be one of them
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))
    ranked = hits.join(copies, "node").where("id <> query").withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("d").alias("score"))
