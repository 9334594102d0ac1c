"""Ranked search, neighbour search and the source audit against brute force."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest

pytest.importorskip("loomwork.llm")

import duckdb  # noqa: E402

from loomwork.llm import annsearch, divergence, rankedsearch  # noqa: E402

SF = "/root/testdata/sf0.001"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- 11
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=10):
    terms = [(i, collections.Counter(TERM.findall(low(t)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n_docs, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = collections.Counter(w for _, c in terms for w in c)
    out = []
    for item, words in items.items():
        scored = []
        for i, c in terms:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w, q in words.items() if w in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def ranked(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    zipf = lambda n: " ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(n))
    docs = [(i, zipf(rng.randint(1, 60))) for i in range(900)] + [(900, None), (901, ""), (902, "!? \n"), (None, "w1 w2 w7"), (903, "w1 " * 50_000), (904, "É é w1W W1w"), (5, "w1 w2 w7"), (5, "w1 w2 w7")]
    rows = [(i, zipf(30)) for i in range(12)] + [(20, docs[3][1]), (21, None), (22, ""), (23, "É nowhere W7"), (24, "w1 w1 w1 W2"), (24, "w1 w1 w1 W2"), (25, "w1 w9"), (25, "w9 w11"), (None, "w2 w7"), (26, "nothing holds this")]
    items = {}
    for i, t in dict.fromkeys(rows):
        items[i] = items.get(i, collections.Counter()) + collections.Counter(TERM.findall(low(t)))
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n int, t string").repartition(5)
    asked = spark.createDataFrame([(*r, 1.0) for r in rows], "item_id long, text string, score double")
    want = brute_search(docs, items)
    assert ranked(rankedsearch.search(df, asked)) == want
    monkeypatch.setattr(rankedsearch, "BLOCK_TERMS", 40)  # several blocks of items
    monkeypatch.setattr(rankedsearch, "UPDATES", 50)
    assert ranked(rankedsearch.search(df, asked)) == want
    assert rankedsearch.search(df.limit(0), asked).count() == rankedsearch.search(df, asked.limit(0)).count() == 0


def test_search_stops_making_accumulators(spark):
    docs = [(i, "the of and " + (f"rare{i % 300} rarer{i % 150} " * 3 if i % 2 else "common")) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    terms = {b"the": 0, b"of": 1, b"rare7": 2, b"rarer7": 3}
    rows = rankedsearch.document_rows(df, terms).cache()
    plan, bound, dfs = rankedsearch.make_plan(rows, [(0, t, 1) for t in range(4)], 4, 10)
    assert plan.stop.tolist() == [0]
    rankedsearch.limit_accumulators(rows, plan, bound, dfs)
    assert plan.stop[0] <= 2 and plan.rest[0] < plan.floor[0]  # the rare terms alone
    got = rankedsearch._top(rows, plan, exact=True).collect()
    assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [x[2:] for x in brute_search(docs, {0: collections.Counter(["the", "of", "rare7", "rarer7"])})]
    rows.unpersist()


# --- 12
def brute_near(rows, asked, k=10):
    """The k nearest (distance, id) of each asked id among ``rows`` {id: vector}."""
    ids, x = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)], float)
    out = {}
    for q in asked:
        d = np.sqrt(((x - np.array(rows[q], float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def found_near(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_neighbours_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rng = np.random.default_rng(3)
    more = [(100_000 + i, [float(x) for x in rng.normal(size=64)], 0) for i in range(3000)]
    df = table.unionByName(spark.createDataFrame(more, table.schema))
    rows = {r.vec_id: r.embedding for r in df.collect()}
    got, want = found_near(annsearch.near_rows(df, lambda c: c % 20 == 0)), brute_near(rows, [i for i in rows if i % 20 == 0])
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) >= 0.9 * sum(map(len, want.values()))
    for q, own in got.items():
        assert all(abs(s - math.dist(rows[q], rows[i])) < 1e-9 for i, s in own)


def test_neighbours_of_copies_and_odd_rows(spark):
    rng = np.random.default_rng(9)
    v = lambda: [float(x) for x in rng.normal(size=6)]
    hot, nan, inf = v(), float("nan"), float("inf")
    rows = [(i, hot) for i in range(0, 300)] + [(1000 + i, v()) for i in range(100)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 6), (5003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5004, [nan] * 6), (5005, [inf] + [1.0] * 5), (5006, [1.0, 2.0]), (None, v()), (0, hot), (1000, [9.0] * 6)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<double>, d int, node string")
    rows = {i: x for i, x in reversed(rows)}
    rows[1000] = min(rows[1000], [9.0] * 6)
    got, want = found_near(annsearch.near_rows(df, lambda c: c % 50 == 0)), brute_near(rows, [i for i in rows if i % 50 == 0])
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert {q: [i for i, _ in x] for q, x in found_near(annsearch.near_rows(few, lambda c: c % 50 == 0)).items()} == {0: [50, 3], 50: [0, 3]}
    assert annsearch.near_rows(few.limit(1), lambda c: c % 50 == 0).count() == annsearch.near_rows(few.limit(0), lambda c: c % 50 == 0).count() == 0


# --- 13
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(rows, least=10, top=10):
    seen, count = collections.Counter(), collections.Counter()
    groups = {(lang or "", source or "") for _, lang, source in rows}
    for text, lang, source in rows:
        c = collections.Counter(LETTERS.findall(low(text)))
        for w, n in c.items():
            seen[lang or "", w] += 1
            count[lang or "", source or "", w] += n
    out = []
    for lang, source in groups:
        kept = [w for (x, w), n in seen.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        size = {s: sum(count[lang, s, w] for w in kept) for s in sources}
        share = lambda n, total: 1 + 1000000000 * (n + 2) // (total + 2 * len(kept))
        price = lambda p, q: (p - q) * (p - q) // (p + q)
        p = lambda s, w: share(count[lang, s, w], size[s])
        pairs = [(-sum(price(p(source, w), p(s, w)) for w in kept), s.encode(), s) for s in sources if s != source]
        terms = [(-price(p(source, w), q), w.encode(), w) for w in kept if count[lang, source, w] and p(source, w) > (q := share(sum(count[lang, s, w] for s in sources), sum(size.values())))]
        out += [(lang, source, "pair", x[2], -x[0], i) for i, x in enumerate(sorted(pairs), 1)] + [(lang, source, "term", x[2], -x[0], i) for i, x in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, monkeypatch, small):
    if small:  # several blocks of terms, of groups and of columns
        for name, n in (("BLOCK", 7), ("GROUPS", 2), ("COLUMNS", 5), ("ENTRIES", 20)):
            monkeypatch.setattr(divergence, name, n)
    rng = random.Random(2)
    words = ["the", "of", "é", "ñandú", "Straße", "naïve", *(f"x{chr(97 + i)}" for i in range(26))]
    rows = [(" ".join(rng.choice(words[: rng.randint(3, 32)]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", "é", "", None])) for _ in range(400)]
    rows += [("The-the THE1the", "en", "a")] * 12 + [(None, "fr", "only"), ("few", "xx", "p"), ("few", "xx", "q"), ("", "en", "empty"), ("a" * 100_000 + " of" * 40_000, "en", "long")]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "text string, lang string, source string, n int, item string").repartition(3)
    assert sorted(map(tuple, divergence.audit(df).collect())) == brute_audit(rows)
    if small:
        assert divergence.audit(df.limit(0)).count() == 0


def test_joint_tables_count_terms_by_level():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, (50, 3))
    got = divergence.joint_tables(a, a, [4, 4, 4], [4, 4, 4])
    for g in range(3):
        for h in range(3):
            want = [[int(((a[:, g] == x) & (a[:, h] == y)).sum()) for y in range(4)] for x in range(4)]
            assert got[4 * g : 4 * g + 4, 4 * h : 4 * h + 4].tolist() == want


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_source_divergence"])
def test_new_queries_equal_sql(spark, name):
    from loomwork.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_small_column_and_update_blocks_give_the_same(spark, monkeypatch):
    """Python workers don't see patched limits, so the task functions run here."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    names = list("abcdefg")
    cells = pa.table({"term": [f"t{i}" for i in range(30) for _ in range(5)], "source": [s for _ in range(30) for s in rng.choice(names, 5, replace=False).tolist()], "p": rng.integers(5, 60, 150)})
    groups = pa.table({"lang": ["x"] * 7, "source": names, "part": [0] * 7, "p0": rng.integers(1, 5, 7), "terms": pa.array([40] * 7, pa.int32()), "gi": [0] * 7, "gj": [0] * 7})
    want = sorted(map(str, divergence._pair_sums(cells, groups).to_pylist()))
    assert len(want) == 42
    monkeypatch.setattr(divergence, "COLUMNS", 20)
    assert sorted(map(str, divergence._pair_sums(cells, groups).to_pylist())) == want

    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 12, rng.integers(1, 30)))) for i in range(200)]
    rows = rankedsearch.document_rows(spark.createDataFrame(docs, "doc_id long, text string"), {f"w{i}".encode(): i for i in range(12)})
    plan, bound, df = rankedsearch.make_plan(rows, [(q, t, 1) for q in range(3) for t in range(q, 12, 2)], 12, 10)
    rankedsearch.limit_accumulators(rows, plan, bound, df)
    batches = rows.coalesce(1).toArrow().to_batches(max_chunksize=70)
    run = lambda: [b.to_pydict() for b in rankedsearch._scored(plan, True)(batches)]
    whole = run()
    monkeypatch.setattr(rankedsearch, "UPDATES", 9)
    assert run() == whole
