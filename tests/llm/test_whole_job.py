"""Operators do the whole job: no pair, corner or row is left out to save work."""

from __future__ import annotations

import collections

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from loomwork.llm import imagematch, jaccard, maxent, tokens, toxicity, weightedhash  # noqa: E402


def test_all_codes_within_near_meet(spark):
    rng = np.random.default_rng(5)
    known = rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)
    flip = lambda d, n: int(np.bitwise_xor.reduce([np.int64(d), *(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64)).view(np.int64)]))
    asked = sorted({flip(d, n) for d in known for n in range(10)})
    want = {(q, int(d)) for q in asked for d in known if ((q ^ int(d)) & (1 << 64) - 1).bit_count() <= 7}
    got = imagematch.near_codes(spark.createDataFrame([(q,) for q in asked], "qd long"), spark.createDataFrame([(int(d),) for d in known], "d long"), 7)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_pairs_of_drawn_images_equal_brute_force(spark):
    images = imagematch.rendered(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).withColumnRenamed("vec_id", "id").cache()
    code = lambda df: imagematch.descriptors(df, ["id"]).select("d").distinct()
    asked, known = code(imagematch.edited_queries(images)), code(images)
    q, d = (np.array([r.d for r in x.collect()], np.int64) for x in (asked, known))
    assert imagematch.near_codes(asked.toDF("qd"), known).count() == (np.bitwise_count((q[:, None] ^ d).view(np.uint64)) <= imagematch.NEAR).sum()


def test_votes_of_alike_points_equal_brute_force_and_stay_in_their_task(spark, monkeypatch):
    monkeypatch.setattr(imagematch, "BLOCK", 100)  # several blocks on either side
    monkeypatch.setattr(imagematch, "GROUP", 40)
    rng = np.random.default_rng(8)
    codes = rng.integers(-(1 << 63), 1 << 63, 3, dtype=np.int64)

    def side(n, most):
        flips = lambda: int(np.bitwise_xor.reduce([rng.choice(codes), *(np.uint64(1) << rng.choice(64, rng.integers(0, 6), replace=False).astype(np.uint64)).view(np.int64)]))
        return [(k, float(rng.integers(0, 24)), float(rng.integers(0, 24)), int(rng.choice([1, 2])), int(rng.integers(0, 3)), flips()) for k in range(n) for _ in range(rng.integers(1, most))]

    asked, known = side(12, 30), side(25, 30)
    asked += [(3, *asked[-1][1:]), asked[0], (None, *asked[1][1:])]  # repeated rows and a null key
    cells = collections.defaultdict(set)
    for q, qx, qy, qs, qt, qd in asked:
        for i, x, y, s, t, d in known:
            if ((qd ^ d) & (1 << 64) - 1).bit_count() <= 7:
                turn, zoom = (t - qt) % 16, s / qs
                a = turn * (2 * np.pi / 16)
                dx, dy = x - zoom * (np.cos(a) * qx - np.sin(a) * qy), y - zoom * (np.sin(a) * qx + np.cos(a) * qy)
                for k in (0, 1):
                    cells[q, i, turn, zoom, k, np.floor(dx / 8 + k / 2), np.floor(dy / 8 + k / 2)].add((qx, qy, qs))
    want = collections.Counter()
    for (q, i, *_), points in cells.items():
        want[q, i] = max(want[q, i], len(points))
    columns = "long, x double, y double, scale int, turn int, d long"
    a, b = spark.createDataFrame(asked, f"q {columns}").repartition(3), spark.createDataFrame(known, f"i {columns}").repartition(2)
    for least in (1, 3):
        found = imagematch.votes(a, b, least=least)
        assert {(r.q, r.i): r.votes for r in found.collect()} == {k: n for k, n in want.items() if n >= least}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Aggregate" not in plan  # no pair of points is a row that is shuffled


def test_small_crop_of_a_large_picture(spark):
    rng = np.random.default_rng(6)
    a = 128 + rng.integers(-100, 100, (150, 150)) * np.linspace(1, 0.3, 150)
    large = imagematch.to_pgm(np.kron(a, np.ones((4, 4))))
    crop = imagematch.to_pgm(imagematch.from_pgm(large)[40:150, 460:570])  # away from the strongest corners
    images = spark.createDataFrame([(1, large)], "id long, media binary")
    got = imagematch.find_copies(images, spark.createDataFrame([(1, "crop", crop)], "id long, edit string, media binary")).first()
    assert got.best_id == 1 and got.votes >= 6


def test_every_training_document_reaches_the_weights(spark):
    n = 30
    pair = lambda i, j: f"a{i} b{j} " * 30
    rows = [(i, pair(i, i) * 10) for i in range(n)] + [(100 + i, pair(i, i)) for i in range(n)] + [(200 + i, pair(i, (i + 1) % n)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in maxent.score(docs, F.col("doc_id") < 100).collect()}
    assert all(got[100 + i] > got[200 + i] + 1 for i in range(n))  # same words, but a seen pair


def test_fingerprints_hold_48_samples(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c e")], "doc_id long, text string")
    got = weightedhash.edited_likeness(docs).collect()
    assert {len(r.fingerprint) for r in got} == {4 * 48}
    assert all(abs(r.near_next * 48 - round(r.near_next * 48)) < 1e-9 for r in got if r.near_next is not None)


def test_all_rows_count_frequent_elements(spark):
    docs = spark.createDataFrame([(i, "one two three four five six seven") for i in range(20)], "doc_id long, text string")
    elements, level = jaccard._frequent(docs, 3, 90, "doc_id", "text")  # a quarter of the rows holds fewer than HEAVY
    assert len(set(elements.tolist())) == 2 and level.tolist() == [4, 4]  # of 5 shingles a set posts 2; 20 rows hold them


def test_lexicon_keeps_all_candidates(spark):
    rng = np.random.default_rng(8)
    words = sorted({"".join(map(chr, x)) for x in rng.integers(97, 123, (5600, 8))})
    rows = [(" ".join(rng.permutation(words).tolist()), 1) for _ in range(8)] + [("clean text", 0)] * 40
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "t string, y int"))
    assert sum(w in set(found.terms) or w.startswith(tuple(found.stems)) for w in words) > 5500


def test_chunks_are_remembered_over_a_task_of_rare_words(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    e = tokens.ChunkEncoder(path, "<u2")
    rare = lambda a: pa.array([" ".join(f"w{i}" for i in range(a + k, a + k + 1000)) for k in range(0, 10_000, 1000)])
    first, size = e.encode(rare(0))
    e.known.update((f"filler {i}", 0) for i in range(600_000))  # as many as a task of check_l meets
    learned = []
    monkeypatch.setattr(e, "_learn", lambda keys: learned.extend(keys))
    again, again_size = e.encode(rare(0))
    assert not learned and (first == again).all() and (size == again_size).all()
    assert first.tolist() == [i for t in rare(0).to_pylist() for i in e.library.encode(t, add_special_tokens=False).ids]


def test_word_codes_of_a_batch_equal_the_definition():
    import zlib

    import pyarrow as pa

    texts = ["The cat", None, "", " \u00e9t\u00e9 xy the  THE\n", "zebra cat \U0001f600"]
    codes = maxent.Codes(["the"], {"the": 5, "cat": 2}, 1 << 14)
    token, code, count, ends, coded, unknown = codes.arrays(pa.array(texts))
    want = []
    for t in texts:
        for w in (t or "").lower().split():
            want.append({"the": (2, 2, 5), "cat": (maxent.OTHER, codes.bucket("cat"), 2)}.get(w, (maxent.OTHER, codes.bucket(w), -1)))
        want.append((maxent.END, maxent.END, 0))
    assert list(zip(token.tolist(), code.tolist(), count.tolist())) == want
    assert ends.tolist() == [i for i, x in enumerate(want) if x[0] == maxent.END]
    assert unknown.tolist() == [x[2] < 0 for x in want if x[0] != maxent.END]
    assert codes.bucket("\u00e9t\u00e9") == maxent.HEAD + zlib.crc32("\u00e9t\u00e9".encode()) % codes.buckets


def test_common_points_are_met_only_where_the_others_agree(spark, monkeypatch):
    monkeypatch.setattr(imagematch, "BLOCK", 300)
    monkeypatch.setattr(imagematch, "GROUP", 60)
    rng = np.random.default_rng(9)
    common, rare = rng.integers(-(1 << 63), 1 << 63, 3, dtype=np.int64), rng.integers(-(1 << 63), 1 << 63, 400, dtype=np.int64)

    def image(k, own):
        codes = [*common, *common, *rare[own]]
        return [(k, float(13 * n % 60), float(29 * n % 70), 1, n % 3, int(d)) for n, d in enumerate(codes)]

    known = [r for k in range(60) for r in image(k, slice(6 * k, 6 * k + 6))]
    asked = [r for k in range(0, 60, 7) for r in image(k, slice(6 * k, 6 * k + 6))]
    asked += image(100, slice(0, 0)) + image(101, slice(390, 394))  # common points alone reach 6 votes with all images
    asked += [r for r in image(102, slice(12, 18)) if r[5] not in set(common.tolist())] + image(103, slice(24, 26))[:5]
    want, alike = {}, 0
    points = lambda rows: {k: [r[1:] for r in rows if r[0] == k] for k in {r[0] for r in rows}}
    for q, own in points(asked).items():
        for i, others in points(known).items():
            cells = collections.defaultdict(set)
            for qx, qy, qs, qt, qd in own:
                for x, y, s, t, d in others:
                    if ((qd ^ d) & (1 << 64) - 1).bit_count() <= 7:
                        alike += 1
                        turn = (t - qt) % 16
                        a = turn * (2 * np.pi / 16)
                        dx, dy = x - (np.cos(a) * qx - np.sin(a) * qy), y - (np.sin(a) * qx + np.cos(a) * qy)
                        for k in (0, 1):
                            cells[turn, k, np.floor(dx / 8 + k / 2), np.floor(dy / 8 + k / 2)].add((qx, qy, qs))
            want[q, i] = max(map(len, cells.values()), default=0)
    columns = "long, x double, y double, scale int, turn int, d long"
    a, b = spark.createDataFrame(asked, f"q {columns}").coalesce(1), spark.createDataFrame(known, f"i {columns}").coalesce(1)
    for least in (1, 4, 6, 7, 12):
        assert {(r.q, r.i): r.votes for r in imagematch.votes(a, b, least=least).collect()} == {k: n for k, n in want.items() if n >= least}

    met, crossed, near = [], [], imagematch.Tables.near
    monkeypatch.setattr(imagematch, "_crossed", lambda queries, images, pairs, *rest: crossed.append(pairs))
    monkeypatch.setattr(imagematch.Tables, "near", lambda self, q, n: (met.append(len(x)) or (x, y) for x, y in near(self, q, n)))
    imagematch.votes(a, b, least=7)
    block = lambda rows: (np.array([*collections.Counter(r[0] for r in rows).values()]), np.stack([np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), *(np.array([r[c] for r in rows], np.int64).view(np.float64) for c in (3, 4, 5))]))
    got = sum(len(i) for i, _, _ in crossed[0](block(sorted(asked)), block(sorted(known))))
    assert got == sum(n >= 7 for n in want.values()) and sum(met) < alike / 2


def test_scores_of_small_blocks_hold_for_any_weights(monkeypatch):
    """Blocks of tokens are small, sums of repeated rows are whole, and very large or small logits neither overflow nor vanish."""
    rng = np.random.default_rng(4)
    for size in (1, 30, 60, 400):
        m = maxent.Model(*(rng.normal(size=(b + 64, maxent.CLASSES), scale=size).astype(np.float32) for b in (1, maxent.CLASSES)))
        token, one, two = rng.integers(0, maxent.HEAD, 200), rng.integers(0, 9, 200), rng.integers(0, 9, 200)
        want = np.zeros(200)
        for k, rows, at, outcome in m.steps(token, one, two):
            z = m.tables[k].astype(np.float64)[rows].sum(axis=0)
            z -= z.max(axis=1, keepdims=True)
            want += (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[at, outcome] / np.log(10)
        assert np.allclose(m.log10(token, one, two), want, rtol=1e-5, atol=1e-4)
    for values in (5, 3000, 1):  # many, few and all numbers repeat
        r, p = rng.integers(0, values, 2000), rng.normal(size=(2000, maxent.CLASSES)).astype(np.float32)
        g, own = maxent.row_sums(p, r)
        assert own.tolist() == sorted(set(r.tolist())) and np.allclose(g, [p[r == x].sum(axis=0) for x in own], atol=1e-3)
    sizes, logits = [], maxent.Model.logits
    monkeypatch.setattr(maxent.Model, "logits", lambda self, k, rows: sizes.append(rows.shape[1]) or logits(self, k, rows))
    n = 100_000
    assert len(m.log10(rng.integers(0, maxent.HEAD, n), rng.integers(0, 900, n), rng.integers(0, 900, n))) == n and max(sizes) <= 1 << 15
