"""Joins.  Sides are broadcast by the engine's own size estimate, never by fiat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.scratch import stored


def lookup(df: DataFrame, dim: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Columns of a dimension by key; missing → null."""
    return df.join(dim.select(key, *cols), key, "left")


def with_returns(orders: DataFrame, returns: DataFrame, key: str) -> DataFrame:
    """Orders with the mark of their return; an order id repeated in ``returns`` doesn't fan out."""
    return orders.join(returns.dropDuplicates([key]), key, "left")


def star(fact: DataFrame, dims: list[tuple[DataFrame, str]]) -> DataFrame:
    for dim, key in dims:
        fact = fact.join(dim, key, "left")
    return fact


def semi_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_semi")


def nearest(points: DataFrame, palette: DataFrame, vector: str, name: str, order: str, most: int = 4096) -> DataFrame:
    """``points`` with ``name`` of the palette row at the least L1 distance (``nearest``, ``distance``); the last wins a tie.

    The palette is of a fixed, checked size and travels inside the expression, so no join is needed.
    """
    rows = palette.select(name, order, vector).orderBy(order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a palette has {most} rows at most")
    table = F.array(*[F.struct(F.lit(r[name]).alias("name"), F.lit(-i).alias("ord"), F.array(*[F.lit(float(x)) for x in r[vector]]).alias("v")) for i, r in enumerate(rows)])
    far = lambda v: F.aggregate(F.zip_with(F.col(vector), v, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform(table, lambda p: F.struct(far(p["v"]).alias("d"), p["ord"].alias("o"), p["name"].alias("n"))))
    return points.withColumn("_b", best).withColumn("nearest", F.col("_b.n")).withColumn("distance", F.col("_b.d")).drop("_b")


#: Pivots of a nearest-neighbour join, and rows of a block of either side.
PIVOTS, BASE_ROWS, QUERY_ROWS = 64, 4096, 2048


def _distances(q: np.ndarray, x: np.ndarray, p: int) -> np.ndarray:
    """All distances of rows of ``q`` and ``x``, from differences, so equal rows are at 0."""
    out = np.empty((len(q), len(x)))
    for i, v in enumerate(q):
        d = x - v
        out[i] = np.abs(d).sum(axis=1) if p == 1 else np.sqrt((d * d).sum(axis=1))
    return out


def _rows(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def knn(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, p: int = 2, pivots: int = PIVOTS, base_rows: int = BASE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query, neighbour, distance, rank): the ``k`` nearest base rows of each query row but itself, exactly, by L1 (``p`` 1) or L2.

    Every base row goes to the nearest of a bounded set of pivots.  A query's distances to the pivots bound
    its kth distance from above (by the rows nearest to each pivot) and each pivot's rows from below (by the
    triangle inequality), so it visits only pivots that can hold one of its neighbours.  A pivot's rows are
    dealt into blocks of about ``base_rows``, the queries that visit it into blocks of about ``query_rows``; a
    task holds one pair of blocks and answers with the ``k`` nearest in it, which a window then ranks.  It is one plan
    for any number of queries.  Least key first on a tie.  Null vectors and keys take no part; keys of
    ``base`` are unique, and all vectors are of one length.
    """
    spark = base.sparkSession
    held = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    q, x = held(queries), held(base)
    chosen = [r.v for r in x.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]  # bounded by the parameter
    if not chosen:
        return spark.createDataFrame([], "query long, neighbour long, distance double, rank int")
    centre = np.array(chosen, np.float64)

    def assign(batches):
        for b in batches:
            v = _rows(b.column(1))
            if len(v):
                d = _distances(centre, v, p)
                cell = d.argmin(axis=0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(d[cell, np.arange(len(v))])], ["id", "v", "cell", "far"])

    celled = x.mapInArrow(assign, "id long, v array<double>, cell int, far double")
    near = celled.select("cell", "far", F.row_number().over(Window.partitionBy("cell").orderBy("far")).alias("r")).where(F.col("r") <= k + 1)
    sizes = {r.cell: r for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}  # one row a pivot
    bounds = [(r.cell, r.far) for r in near.collect()]  # k + 1 rows a pivot: the query itself may be among them
    radius = np.array([sizes[c].radius if c in sizes else -1.0 for c in range(len(centre))])
    blocks = np.array([-(-sizes[c].n // base_rows) if c in sizes else 0 for c in range(len(centre))])
    of, inner = np.array([c for c, _ in bounds]), np.array([d for _, d in bounds])

    def reach(batches):
        for b in batches:
            v = _rows(b.column(1))
            if not len(v):
                continue
            d = _distances(centre, v, p).T
            upper = np.sort(d[:, of] + inner[None, :], axis=1)[:, min(k + 1, len(of)) - 1] if len(of) > k else np.full(len(v), np.inf)
            row, cell = np.nonzero((d - radius[None, :] <= (upper * (1 + 1e-9) + 1e-9)[:, None]) & (blocks > 0)[None, :])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    reached = q.mapInArrow(reach, "id long, v array<double>, cell int")
    asking = {r.cell: r.n for r in reached.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a pivot
    of_cell = lambda numbers: F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), F.col("cell") + 1)
    in_cell, parts = of_cell(blocks), of_cell([-(-asking.get(c, 0) // query_rows) for c in range(len(centre))])
    dealt = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    asked = reached.select("id", "v", "cell", F.explode(F.sequence(F.lit(0), in_cell - 1)).alias("block"), dealt(0, parts).alias("part"))
    known = celled.where(parts > 0).select("id", "v", "cell", dealt(1, in_cell).alias("block"), F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("part"))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            q_ids, x_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            vq, vx = _rows(left.column("v")), _rows(right.column("v"))
            for s in range(0, len(q_ids), 256):
                d = _distances(vq[s : s + 256], vx, p)
                d[q_ids[s : s + 256, None] == x_ids[None, :]] = np.inf
                at = min(k, d.shape[1]) - 1
                r, c = np.nonzero(d <= np.partition(d, at, axis=1)[:, at][:, None])
                r, c = r[ok := np.isfinite(d[r, c])], c[ok]
                order = np.lexsort((x_ids[c], d[r, c], r))  # ties at the edge by key
                r, c = r[order], c[order]
                r, c = r[first := np.arange(len(r)) - np.searchsorted(r, r) < k], c[first]
                found.append((q_ids[s + r], x_ids[c], d[r, c]))
        cols = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query", "neighbour", "distance"), cols)))

    keys = ["cell", "block", "part"]
    met = asked.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(answer, "query long, neighbour long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _neighbour_weight(weights: str) -> Column:
    """1 for each, or the inverse distance; if some neighbours are at distance 0, those alone count."""
    if weights == "uniform":
        return F.lit(1.0)
    if weights != "distance":
        raise ValueError("weights are uniform or distance")
    same = F.min("distance").over(Window.partitionBy("query")) == 0  # k rows a query
    return F.when(same, (F.col("distance") == 0).cast("double")).otherwise(1 / F.nullif("distance", F.lit(0.0)))


def knn_classify(near: DataFrame, base: DataFrame, key: str, label: str, weights: str = "uniform") -> DataFrame:
    """(query, predicted): the label with the greatest weight among the neighbours of ``knn``; the least label on a tie, null labels don't vote."""
    voted = near.withColumn("w", _neighbour_weight(weights)).join(base.select(F.col(key).alias("neighbour"), F.col(label).alias("vote")), "neighbour").where("vote is not null")
    votes = voted.groupBy("query", "vote").agg(F.sum("w").alias("w"))
    return votes.groupBy("query").agg(F.min(F.struct((-F.round("w", 9)).alias("w"), "vote")).alias("b")).select("query", F.col("b.vote").alias("predicted"))


def knn_regress(near: DataFrame, base: DataFrame, key: str, target: str, weights: str = "uniform") -> DataFrame:
    """(query, predicted): the weighted mean target of the neighbours of ``knn``; null targets don't count."""
    met = near.withColumn("w", _neighbour_weight(weights)).join(base.select(F.col(key).alias("neighbour"), F.col(target).cast("double").alias("y")), "neighbour").where("y is not null")
    return met.groupBy("query").agg((F.sum(F.col("w") * F.col("y")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("predicted"))


def cosine_pairs(df: DataFrame, row: str, feature: str, value: str, probe: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine) of row pairs that share a feature, over an inverted index; with ``probe`` (rows ``a``) only from those rows."""
    cells = df.groupBy(F.col(row).alias("r"), F.col(feature).alias("f")).agg(F.sum(F.col(value).cast("double")).alias("v"))
    norm = cells.groupBy("r").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    left = cells.join(probe.select(F.col("a").alias("r")).distinct(), "r", "left_semi") if probe is not None else cells
    a, b = left.select(F.col("r").alias("a"), "f", F.col("v").alias("va")), cells.select(F.col("r").alias("b"), "f", F.col("v").alias("vb"))
    dots = a.join(b, "f").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    named = dots.join(norm.toDF("a", "na"), "a").join(norm.toDF("b", "nb"), "b")
    return named.select("a", "b", (F.col("dot") / F.nullif(F.col("na") * F.col("nb"), F.lit(0.0))).alias("cosine"))


#: A list of more rows is multiplied in blocks of ``SIMILAR_ROWS``; and features that a task multiplies at a time.
SHORT_LIST, SIMILAR_ROWS, FEATURE_COLUMNS = 64, 1024, 2048
#: Rows of at most so many features stand whole in each short list; list rows and entries of pairs looked at at a time.
NARROW, LIST_ROWS, ENTRIES = 256, 1 << 15, 1 << 20


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... of runs of these lengths, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)


def _paired(least: float):
    """Arrow task over rows (f, r, p, fs, xs) in the order of ``f``: the pairs of each list, given where their first common feature is.

    There a dot product is at most that of the feature's own values and of the lengths of what follows, which
    leaves most pairs unmeasured.
    """

    def pairs(t: pa.Table):
        f, r, p, fs, xs = (t.column(c).combine_chunks() for c in ("f", "r", "p", "fs", "xs"))
        ends = pc.run_end_encode(f).run_ends.to_numpy().astype(np.int64)
        size = fs.value_lengths().to_numpy().astype(np.int64)
        begin, x = np.cumsum(size) - size, xs.flatten().to_numpy()
        names = fs.flatten().dictionary_encode()
        code, kinds = names.indices.to_numpy().astype(np.int64), len(names.dictionary)
        keys = np.repeat(np.arange(len(size)), size) * kinds + code
        order = np.argsort(keys)
        keys = keys[order]
        at = begin + p.to_numpy()
        squares = np.concatenate([[0.0], np.cumsum(x * x)])
        value, rest = x[at], np.sqrt(np.maximum(0.0, squares[begin + size] - squares[at + 1]))
        rank = np.empty(len(size), np.int64)
        rank[pc.sort_indices(r).to_numpy()] = np.arange(len(size))
        after = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(size)) - 1
        work = np.cumsum(after * size)
        cuts = [0, *np.searchsorted(work, np.arange(ENTRIES, work[-1], ENTRIES), "right"), len(size)]
        for s, z in zip(cuts, cuts[1:]):
            left = np.repeat(np.arange(s, z), after[s:z])
            right = left + 1 + _within(after[s:z])
            can = value[left] * value[right] + rest[left] * rest[right] >= least - 1e-5  # sums of squares are no more exact
            left, right = left[can], right[can]
            if not len(left):
                continue
            own, entry = np.repeat(np.arange(len(left)), size[left]), np.repeat(begin[left], size[left]) + _within(size[left])
            asked = right[own] * kinds + code[entry]
            found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = keys[found] == asked
            own, entry, found = own[hit], entry[hit], order[found[hit]]
            dot = np.bincount(own, x[entry] * x[found], minlength=len(left))
            first = np.bincount(own[entry < at[left[own]]], minlength=len(left)) == 0
            ok = first & (dot > 0) & (dot >= least - 1e-12)
            left, right, dot = left[ok], right[ok], dot[ok]
            swap = rank[left] > rank[right]
            a, b = np.where(swap, right, left), np.where(swap, left, right)
            yield pa.RecordBatch.from_arrays([r.take(pa.array(a)), r.take(pa.array(b)), pa.array(dot)], ["a", "b", "cosine"])

    def run(batches):
        held, n, full = [], 0, LIST_ROWS
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= full:
                t = pa.Table.from_batches(held)
                ends = pc.run_end_encode(t.column("f").combine_chunks()).run_ends.to_numpy()
                if len(ends) > 1:  # the last list may go on in the next batch
                    yield from pairs(t.slice(0, ends[-2]))
                    t = t.slice(ends[-2])
                held, n = t.to_batches(), len(t)
                full = max(LIST_ROWS, 2 * n)
        if n:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _multiplied(least: float, short: int):
    """Arrow group task: the pairs of two blocks, given where their first common prefix feature is ``key``; without a key, is in any long list."""

    def run(table: pa.Table) -> pa.Table:
        rows, own, i, j, key = (table.column(c).combine_chunks() for c in ("r", "own", "i", "j", "key"))
        entries = table.column("all").combine_chunks()
        inner, size = entries.flatten(), entries.value_lengths().to_numpy()
        feature = inner.field("f").dictionary_encode()
        code, weight = feature.indices.to_numpy(), np.zeros(len(feature.dictionary), np.int64)
        weight[code] = inner.field("n").to_numpy()
        by_order = pa.table({"n": weight, "f": feature.dictionary}).sort_by([("n", "ascending"), ("f", "ascending")]).column("f")
        at, value = pc.index_in(feature.dictionary, by_order).to_numpy()[code], inner.field("x").to_numpy()
        owner = np.repeat(np.arange(len(size)), size)
        in_prefix = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) < table.column("size").to_numpy()[owner]
        mine = int((weight <= short).sum()) if key[0].as_py() is None else int(pc.index_in(key[0], by_order).as_py())
        mark = own.to_numpy()
        left, right = np.nonzero(mark == i[0].as_py())[0], np.nonzero(mark == j[0].as_py())[0]
        dot, here = np.zeros((len(left), len(right))), np.ones((len(left), len(right)), bool)
        for lo in range(0, len(weight), FEATURE_COLUMNS):
            part = (at >= lo) & (at < lo + FEATURE_COLUMNS)
            width = min(FEATURE_COLUMNS, len(weight) - lo)
            dense, prefix = np.zeros((len(size), width)), np.zeros((len(size), width), np.float32)
            dense[owner[part], at[part] - lo] = value[part]
            before = part & in_prefix & (at < mine)
            prefix[owner[before], at[before] - lo] = 1
            dot += dense[left] @ dense[right].T
            here &= prefix[left] @ prefix[right].T == 0
        rank = np.empty(len(size), np.int64)
        rank[pc.sort_indices(rows).to_numpy()] = np.arange(len(size))
        apart = rank[left][:, None] < rank[right][None, :] if i[0].as_py() == j[0].as_py() else rank[left][:, None] != rank[right][None, :]
        x, y = np.nonzero(here & apart & (dot > 0) & (dot >= least - 1e-12))
        swap = rank[left[x]] > rank[right[y]]
        a, b = np.where(swap, right[y], left[x]), np.where(swap, left[x], right[y])
        return pa.table({"a": rows.take(pa.array(a)), "b": rows.take(pa.array(b)), "cosine": pa.array(dot[x, y])})

    return run


def _crossed(least: float, short: int):
    """Arrow task over pairs of blocks (i, x, j, y): ``_multiplied`` of each."""
    multiply = _multiplied(least, short)

    def run(batches):
        for batch in batches:
            for i, x, j, y in zip(*(batch.column(c) for c in ("i", "x", "j", "y"))):
                sides = [x.values] if i == j else [x.values, y.values]
                table = pa.concat_tables([pa.Table.from_struct_array(s).append_column("own", pa.array(np.full(len(s), b.as_py(), np.int32))) for s, b in zip(sides, (i, j))])
                kind = table.schema.field("all").type.value_type.field("f").type
                for name, value in (("i", i), ("j", j), ("key", pa.scalar(None, kind))):
                    table = table.append_column(name, pa.repeat(value, len(table)))
                yield from multiply(table).to_batches(max_chunksize=1 << 16)

    return run


def similar_rows(df: DataFrame, row: str, feature: str, value: str, least: float = 0.0, short: int = SHORT_LIST, block: int = SIMILAR_ROWS, narrow: int = NARROW) -> DataFrame:
    """(a, b, cosine) with a < b of row pairs that share a feature and have a cosine above 0 and of at least ``least``.

    Features are ordered rarest first.  What a row has after its prefix is shorter than ``least``, so two rows
    that share no feature in both prefixes can't reach it: only prefixes are listed (all features if
    ``least`` is 0).  A pair is given once, at its first common feature.  Lists of at most ``short`` rows hold
    the rows themselves and are measured where they lie; rows of more than ``narrow`` features are only named
    in them, and their pairs are measured once in a join of their features.  Rows of longer lists are dealt
    into blocks of about ``block`` rows and a task multiplies one pair of blocks, so a feature that every row
    has is many tasks: blocks of each list by itself, or, where lists overlap so much that this is less work,
    blocks of all such rows.  Pairs are never rows before they are results.  Values of a cell are summed;
    rows of norm 0 have no pairs, nor have null rows or features.
    """
    if least < 0:
        raise ValueError("least is 0 or more")
    cells = df.where(F.col(row).isNotNull() & F.col(feature).isNotNull()).groupBy(F.col(row).alias("r"), F.col(feature).alias("f")).agg(F.sum(F.col(value).cast("double")).alias("v")).where("v <> 0")
    lists = cells.groupBy("f").agg(F.count("*").alias("n"))
    rows = cells.join(lists, "f").groupBy("r").agg(F.array_sort(F.collect_list(F.struct("n", "f", "v"))).alias("all"))  # a row's own features
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("all", F.lit(0.0), lambda s, e: s + e["v"] * e["v"])))
    rows = rows.select("r", F.transform("all", lambda e: F.struct(e["n"].alias("n"), e["f"].alias("f"), (e["v"] / F.col("norm")).alias("x"))).alias("all"))
    step = lambda s, e: F.struct((s["left"] - e["x"] * e["x"]).alias("left"), (s["size"] + F.when(s["left"] >= least * least - 1e-9, 1).otherwise(0)).alias("size"))
    kept = stored(rows.withColumn("size", F.aggregate("all", F.struct(F.lit(1.0).alias("left"), F.lit(0).alias("size")), step)["size"]), "rows")
    prefix = F.slice("all", F.lit(1), F.col("size"))
    listed = kept.select("r", "all", "size", F.posexplode(prefix).alias("p", "e"))
    kind = cells.schema["r"].dataType.simpleString()
    out = f"a {kind}, b {kind}, cosine double"

    few = listed.where(F.col("e.n") <= short)
    whole = few.where(F.size("all") <= narrow).select(F.col("e.f").alias("f"), "r", "p", F.transform("all", lambda e: e["f"]).alias("fs"), F.transform("all", lambda e: e["x"]).alias("xs"))
    found = whole.repartition("f").sortWithinPartitions("f").mapInArrow(_paired(least), out)
    if (kept.agg(F.max(F.size("all"))).first()[0] or 0) > narrow:
        named = few.select("r", F.col("e.f").alias("f"), (F.size("all") > narrow).alias("wide"))
        met = named.toDF("a", "f", "wa").join(named.toDF("b", "f", "wb"), "f").where("a < b and (wa or wb)").select("a", "b").distinct()
        side = lambda name: kept.select(F.col("r").alias(name), F.explode("all").alias("e")).select(name, F.col("e.f").alias("f"), F.col("e.x").alias(f"x{name}"))
        measured = met.join(side("a"), "a").join(side("b"), ["b", "f"]).groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("cosine"))
        found = found.unionByName(measured.where((F.col("cosine") > 0) & (F.col("cosine") >= least - 1e-12)))

    common = listed.where(F.col("e.n") > short)
    held = common.groupBy(F.col("e.f").alias("f")).agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0]
    if held is None:
        return found
    own = kept.where(F.exists(prefix, lambda e: e["n"] > short))
    n = own.count()
    if n * n <= held:
        parts = -(-n // block)
        dealt = own.groupBy(F.pmod(F.xxhash64("r"), F.lit(parts)).cast("int").alias("i")).agg(F.collect_list(F.struct("r", "all", "size")).alias("x"))
        blocks = stored(dealt, "blocks")
        ahead = 2 * F.pmod(F.col("j") - F.col("i"), F.lit(parts))  # each block meets itself and the half of the others that follows it
        met = blocks.repartition(parts).crossJoin(blocks.toDF("j", "y")).where((ahead < parts) | ((ahead == parts) & (F.col("i") < F.col("j"))))
        return found.unionByName(met.mapInArrow(_crossed(least, short), out))
    parts = F.ceil(F.col("e.n") / F.lit(block)).cast("int")
    own = common.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("r"), F.col("parts")).cast("int"))
    dealt = own.select("r", "all", "size", "own", F.col("e.f").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return found.unionByName(dealt.groupBy("key", "i", "j").applyInArrow(_multiplied(least, short), out))
