"""The numbered operators: brute force, round trips, held-out accuracy, and edge rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import base64  # noqa: E402

import tiktoken  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from loomwork.llm import bpe, components, eliasfano, imagematch, jaccard, langid, linededup, maxent, packing, queries, tokens, toxicity, weightedhash  # noqa: E402
from loomwork.llm.common import fold  # noqa: E402

JSON, RANKS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"
#: Null, empty, blank, odd spaces, special token, repeated, very long, no letters; the clashing columns are extra.
TEXTS = [None, "", " ", "\n\n", "a  b\t c d \n e", "<|endoftext|> it's  'll", "hello world", "hello world", "x" * 3000 + " y" * 3000, "12 ²³ ½ --", "é ñ, ß. ü\nÀb c"]
SCHEMA = "doc_id long, text string, k string, t string, n long, w string, cls string, o long, gone int"


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "k", "t", 1, "w", "c", 2, 3) for i, t in enumerate(TEXTS)] + [(None, "null key", "k", "t", 1, "w", "c", 2, 3), (6, "hello world", "k", "t", 1, "w", "c", 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- 1
def weights(text):
    return collections.Counter((text or "").lower().split())


def test_fingerprints_estimate_jaccard(spark, docs):
    got = {r.doc_id: r for r in weightedhash.edited_likeness(docs).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    errors = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].n_chars == len(a)
        for near, other in ((got[i].near_edited, e), (got[i].near_next, b)):
            x, y = weights(a), weights(other)
            errors.append(near - (sum((x & y).values()) / max(1, sum((x | y).values()))))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.1


def test_fingerprints_of_edge_rows(spark, edge):
    rows = weightedhash.edited_likeness(edge).collect()
    assert len(rows) == edge.count()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.fingerprint)
    assert by[0] == by[1] == by[2] and by[6] == by[7] and len(by[6]) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.n_chars for r in rows if r.doc_id == 8} == {9000}
    assert weightedhash.edited_likeness(edge.limit(0)).count() == 0
    one = weightedhash.edited_likeness(edge.where("doc_id = 10")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0  # after the last: the first
    assert weightedhash.fingerprints(edge).count() == edge.count()


def test_weights_matter(spark):
    df = spark.createDataFrame([(1, "a " * 9 + "b"), (2, "a b"), (3, "a " * 9 + "b")], "doc_id long, text string")
    s = {r.doc_id: r.sig for r in weightedhash.fingerprints(df, m=48).collect()}
    same = sum(x == y for x, y in zip(s[1], s[2])) / 48
    assert s[1] == s[3] and 0.02 < same < 0.45  # 2 of 10


# --- 2
def test_forward_sums_all_segmentations():
    own = langid.lattice(PIECES)
    word, rng = "▁the", np.random.default_rng(1)
    prob = np.vstack([rng.random((own.size, 2)), np.zeros((1, 2))])

    def brute(i):
        return np.ones(2) if i == len(word) else sum((prob[own.id[word[i:j]]] * brute(j) for j in range(i + 1, len(word) + 1) if word[i:j] in own.id), np.zeros(2))

    ids = own.edges([word], len(word))
    assert np.allclose(own.forward(ids, prob)[-1][0], brute(0))
    counts = own.expected(ids, prob, np.ones((1, 2)))
    spelled = sum(counts[i] * len(p) for p, i in own.id.items() if counts[i].any())
    assert np.allclose(spelled, len(word))


def test_long_words_sum_all_segmentations(spark):
    own, rng = langid.lattice(PIECES), np.random.default_rng(2)
    prob = np.vstack([rng.random((own.size, 2)) * 1e-4, np.zeros((1, 2))])
    for word in ("\u2581" + "internationalization" * 3, "\u2581" + "a\U0001f600b" * 20 + "ing"):
        alpha = [np.ones(2)] + [np.zeros(2) for _ in word]
        for j in range(1, len(word) + 1):
            for i in range(j):
                piece = own.id.get(word[i:j], own.other if j - i == 1 else None)
                if piece is not None:
                    alpha[j] = alpha[j] + alpha[i] * prob[piece]
        assert len(word) > 60 and np.allclose(own.log_forward([word, word], prob), np.log(alpha[-1]))
    assert np.isfinite(own.log_forward(["\u2581" + "x" * 20_000], prob)).all()


def test_training_sums_all_segmentations_of_long_words(spark):
    own, rng = langid.lattice(PIECES), np.random.default_rng(5)
    prob = np.vstack([rng.random((own.size, 3)) * 1e-4, np.zeros((1, 3))])
    count = rng.random((2, 3))
    ids = own.edges(["\u2581thereby", "\u2581another"], 8)
    assert np.allclose(own.expected(ids, prob, count), own.expected_long(ids, prob, count))
    word = "\u2581" + "internationalization" * 40
    counts = own.expected(own.edges([word], len(word)), prob, np.ones((1, 3)))
    length = np.ones(own.size)
    for p, i in own.id.items():
        length[i] = len(p)
    assert np.allclose((counts * length[:, None]).sum(axis=0), len(word))  # every segmentation spells the word
    texts = [("en", f"the cat{blank}sat") for blank in (" ", "\u00a0", "\u2003", "\x1c", "\n\t")] * 3 + [("fr", "le chat " + "x" * 5000)] * 3
    made = langid.fit(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, lang string, text string"), PIECES, F.lit(True))
    assert made[0] == ["en", "fr"] and made[2][own.id["\u2581sat"], 0] > 100 * made[2][own.id["\u2581sat"], 1]


def test_prediction_of_no_rows(spark, docs):
    model = langid.fit(docs, PIECES, fold() != 0)
    assert langid.predict(docs.limit(0), PIECES, model).count() == 0


def test_language_held_out(spark, docs, edge):
    model = langid.fit(docs, PIECES, fold() != 0)
    got = langid.predict(docs, PIECES, model).join(docs, "doc_id").where(fold() == 0).collect()
    assert got and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    found = langid.predict(edge, PIECES, model).collect()
    assert {r.lang_pred for r in found if r.doc_id in (0, 1, 2, 3)} == {"und"} and len(found) == edge.count()
    assert all(0 <= r.score <= 1 for r in found)
    none = langid.fit(docs, PIECES, F.lit(False))
    assert {r.lang_pred for r in langid.predict(edge, PIECES, none).collect()} == {"und"}


# --- 3
def test_images(spark):
    got = queries.QUERIES["op3_image_copies"](spark, SF).collect()
    assert len(got) == 2 * spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert sum(r.best_id == r.vec_id for r in got) >= 0.9 * len(got)


def test_image_edges(spark):
    rng = np.random.default_rng(3)
    a = imagematch.to_pgm(np.kron(rng.integers(0, 255, (24, 24)), np.ones((4, 4))))
    b = imagematch.to_pgm(np.kron(rng.integers(0, 255, (24, 24)), np.ones((4, 4))))
    flat = imagematch.to_pgm(np.full((96, 96), 7))
    images = spark.createDataFrame([(1, a, 5), (2, a, 5), (3, b, 5), (4, None, 5), (5, b"no image", 5), (6, flat, 5), (7, b"P5 9999 9999 255 x", 5)], "id long, media binary, content long")
    asked = spark.createDataFrame([(1, "crop", imagematch.edited(a, "crop", 3)), (9, "none", None), (6, "flat", flat)], "id long, edit string, media binary")
    got = {r.id: r for r in imagematch.find_copies(images, asked).collect()}
    assert (got[1].best_id, got[1].n_images, got[1].n_rows) == (1, 1, 2)
    assert got[9].n_points == got[6].n_images == 0
    assert imagematch.find_copies(images.limit(0), asked).count() == 3 and imagematch.find_copies(images, asked.limit(0)).count() == 0


# --- 4
def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(5000))


def test_bpe_equals_library(spark, edge, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (edge, docs):
        texts = collections.defaultdict(set)
        for r in df.collect():
            texts[r.doc_id].add(r.text or "")
        got = bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()
        assert len(got) == df.count()
        for r in got:
            (text,) = texts[r.doc_id]
            ids = own.encode_ordinary(text)
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    ids = bpe.encode_ids(edge, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_ids(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.raw) for r in back) == sorted((t or "").encode() for t in [*TEXTS, "null key", "hello world"])
    assert bpe.round_trip(edge.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# --- 5
def test_scores_match_counts(spark, docs, edge):
    both = docs.select("doc_id", "text").union(edge.select(F.col("doc_id") + 1000, "text"))
    got = maxent.score(both, fold() != 1).collect()
    rows = [(r.doc_id, r.text) for r in both.collect()]
    words = lambda t: [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w] + [None]
    c = collections.Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, len(words(t)), sum(c[w] > 0 for w in words(t)), round(sum(float(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))) for w in words(t)), 6)) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert maxent.score(edge.limit(0), fold() != 1).count() == 0


def test_context_helps_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = maxent.score(docs, fold() != 1).where(fold() == 1).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r.s - r.b) / r.n >= 0.139


def test_model_probabilities_sum_to_one():
    m = maxent.Model.start(np.arange(maxent.HEAD, dtype=float))
    m.learn(np.arange(500) % 90, np.full(500, 7), np.full(500, 9), [np.zeros(len(t), np.float32) for t in m.tables])
    every = np.arange(maxent.HEAD)
    assert abs((10 ** m.log10(every, np.full(maxent.HEAD, 7), np.full(maxent.HEAD, 9))).sum() - 1) < 1e-3


def naive_log10(model, codes, words):
    """log10 probability of each token of a text in the model, one softmax after the other; and the tokens."""
    code = [codes.known[w][1] if w in codes.known else codes.bucket(w) for w in words] + [maxent.END]
    token = [codes.known[w][0] if w in codes.known else maxent.OTHER for w in words] + [maxent.END]
    out, before = [], [maxent.END, maxent.END]
    for t, c in zip(token, code):
        two, one = (np.array([x]) for x in before)
        total = 0.0
        for k, (branch, bias, outcome) in enumerate(((0, 1, t // maxent.CLASSES), (t // maxent.CLASSES, maxent.CLASSES, t % maxent.CLASSES))):
            rows = maxent.features(one, two, branch if k == 0 else np.array([branch]), bias, model.rows)
            z = sum(model.tables[k][r[0]].astype(float) for r in rows)
            total += z[outcome] - np.log(np.exp(z).sum())
        out.append(total / np.log(10))
        before = [before[1], c]
    return out, token


def test_scores_equal_one_token_at_a_time(spark, docs, monkeypatch):
    caught = []
    train = maxent._train
    monkeypatch.setattr(maxent, "_train", lambda df, codes, model, *rest: caught.append((codes, made := train(df, codes, model, *rest))) or made)
    rows = docs.orderBy("doc_id").limit(60).select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "Never SEEN wörd\twörd never")], "doc_id long, text string"))
    found = {r.doc_id: r for r in maxent.score(rows, F.col("doc_id") >= 12).collect()}
    codes, model = caught[0]
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    texts = {r.doc_id: cut(r.text) for r in rows.collect()}
    count = collections.Counter(w for i, ws in texts.items() if i >= 12 for w in ws)
    trained = sum(i >= 12 for i in texts)
    n, head = sum(count.values()) + trained, {w for w, (t, _, _) in codes.known.items() if t != maxent.OTHER}
    rest, kinds = n - trained - sum(count[w] for w in head), len(count) - len(head)
    for i, ws in texts.items():
        logs, token = naive_log10(model, codes, ws)
        want = sum(logs) + sum(np.log10((count[w] + 0.5) / (rest + 0.5 * (kinds + 1))) for w, t in zip(ws, token) if t == maxent.OTHER)
        base = sum(np.log10((c + 0.5) / (n + 0.5 * (len(count) + 2))) for c in [*(count[w] for w in ws), trained])
        assert found[i].score == pytest.approx(want, rel=1e-4, abs=1e-3) and found[i].base_score == pytest.approx(base) and found[i].n_tokens == len(ws) + 1


def test_a_gradient_step_equals_the_naive_one():
    rng = np.random.default_rng(3)
    made = lambda: maxent.Model(rng2.normal(size=(1 + 64, maxent.CLASSES)).astype(np.float32), rng2.normal(size=(maxent.CLASSES + 64, maxent.CLASSES)).astype(np.float32))
    rng2 = np.random.default_rng(4)
    fast = made()
    rng2 = np.random.default_rng(4)
    slow = made()
    token, one, two = rng.integers(0, maxent.HEAD, 40), rng.integers(0, 9, 40), rng.integers(0, 9, 40)
    fast.learn(token, one, two, [np.zeros(len(t), np.float32) for t in fast.tables])
    for k, table in enumerate(slow.tables):
        z_of, grad = [], []
        for t, a, b in zip(token, one, two):
            branch, outcome = (0, t // maxent.CLASSES) if k == 0 else (t // maxent.CLASSES, t % maxent.CLASSES)
            rows = [int(r[0]) for r in maxent.features(np.array([a]), np.array([b]), branch if k == 0 else np.array([branch]), 1 if k == 0 else maxent.CLASSES, slow.rows)]
            z = sum(table[r].astype(float) for r in rows)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[outcome] -= 1
            z_of.append(rows), grad.append(p)
        want = table.astype(float).copy()
        square = np.zeros(len(table))
        for feature in range(4):  # one feature's rows after the other, as the rates grow
            total = collections.defaultdict(lambda: np.zeros(maxent.CLASSES))
            for rows, g in zip(z_of, grad):
                total[rows[feature]] += g
            for r, g in total.items():
                square[r] += (g * g).sum() / maxent.CLASSES
                want[r] -= g * maxent.RATE / np.sqrt(square[r] + 1)
        assert np.allclose(fast.tables[k], want, atol=1e-4)


@pytest.mark.parametrize("n", [5, 60, 4000])
def test_row_sums(n):
    rng = np.random.default_rng(n)
    p, r = rng.random((300, 4)), rng.integers(0, n, 300)
    g, own = maxent.row_sums(p, r)
    assert own.tolist() == sorted(set(r.tolist()))
    assert np.allclose(g, [p[r == x].sum(axis=0) for x in own])


# --- 6
def test_line_dedup(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "a one\nb two\nc three\nd four"), (2, "x\nb two\nc three\nd four\ny"), (3, f"p\n{long}\nq"), (4, f"r\n\n{long}\ns"), (5, "b two"), (6, None), (7, ""), (8, "a one\nb two\nc three\nd four"), (8, "a one\nb two\nc three\nd four"), (None, f"{long}\nz")]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, o int, n_lines int, gone string")
    got = collections.defaultdict(set)
    for r in linededup.dedup_lines(df).collect():
        got[r.doc_id].add((r.text, r.n_lines, r.n_removed, r.o, r.gone))
    want = {1: (rows[0][1], 4, 0), 2: ("x\ny", 5, 3), 3: ("p\nq", 3, 1), 4: ("r\n\ns", 3, 1), 5: ("b two", 1, 0), 6: (None, 0, 0), 7: ("", 0, 0), 8: ("", 4, 4), None: (rows[-1][1], 2, 0)}
    assert got == {k: {(*v, 1, "x")} for k, v in want.items()}
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def brute_line_dedup(rows, run=3, long_words=20):
    """{key: numbers of deleted lines}, one place after the other."""
    split = {k: [x for x in (y.strip(" ") for y in (t or "").split("\n")) if x] for k, t in rows}
    seen, gone = set(), collections.defaultdict(set)
    for k in sorted(split):
        lines = split[k]
        for i in range(len(lines)):
            for n in [run] * (i + run <= len(lines)) + [1] * (len(lines[i].split(" ")) >= long_words):
                if (key := tuple(lines[i : i + n])) in seen:
                    gone[k] |= set(range(i + 1, i + n + 1))
                seen.add(key)
    return {k: sorted(gone[k]) for k in split}


def test_line_dedup_of_numbered_indented_and_split_runs(spark):
    rows = [
        (1, "ak\nht item 1\nht item 2"), (2, "zz\nal\nht item 2\nht item 3"),  # no run of three: nothing goes
        (3, "v 1\nv 2\nv 3\nv 4\nv 5"), (4, "  v 1\n\tv 2\n v 2 \n  v 3\n v 4"), (5, "v 1\nv 2\nv 3\nv 4\nv 5"),
        (6, "m\nk 2\nk 3\nk 4\nn"), (7, "o\nk 4\nk 5\nk 6\np"), (8, "k 2\nk 3\nk 4\nk 5\nk 6"),  # the run's halves come from two documents
        (9, "r\nr\nr\nr\nr\nr"), (10, "10\n11\n12"), (11, " 10 \n 11\n12 "), (12, "a\nb"), (13, "a\nb"),
    ]
    got = {r.doc_id: r.removed for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_line_dedup(rows)
    assert got[1] == got[2] == []
    assert got[5] == [1, 2, 3, 4, 5] and got[8] == [1, 2, 3, 4, 5] and got[9] == [2, 3, 4, 5, 6] and got[11] == [1, 2, 3] and got[13] == []


@pytest.mark.parametrize("window", [2, 4])
def test_line_dedup_equals_brute_force(spark, docs, window):
    rng = random.Random(window)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, "\n".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(20_000, "\n".join(f"line {i % 997}" for i in range(20_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.removed for r in linededup.dedup_lines(df, window=window).collect()} == brute_line_dedup(rows, window + 1)


def test_line_dedup_equals_its_sql(spark, docs):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet' union all select 900000 + i, '  item ' || i || chr(10) || ' item ' || (i + 1) || chr(10) || 'item ' || (i + 2), 'en', 's', 9 from range(20) t(i) union all select 900100 + i, 'item ' || i || chr(10) || 'item ' || (i + 1) || chr(10) || '   item ' || (i + 2), 'en', 's', 9 from range(20) t(i)")
    df = spark.createDataFrame(con.sql("select doc_id, text from documents").fetchall(), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.m) for r in linededup.dedup_lines(df).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("m")).collect())
    assert got == sorted(con.sql(linededup.ORACLE).fetchall())


def test_line_dedup_keeps_first_lines(spark, docs):
    before = {x.strip(" ") for r in docs.collect() for x in r.text.split("\n")}
    after = {x.strip(" ") for r in linededup.dedup_lines(docs).collect() for x in r.text.split("\n")}
    assert before - {""} == after - {""}  # some copy of each line stays


# --- 7
@pytest.mark.parametrize("which", ["edge", "docs"])
def test_packing(request, library, which):
    df = request.getfixturevalue(which)
    texts = collections.defaultdict(list)
    for r in df.collect():
        texts[r.doc_id].append([*ids_of(library, r.text), 1])
    pieces = packing.pack(df, JSON).collect()
    own, windows = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        own[p.doc_id].append(p)
        windows[p.sequence_id].append(p)
    assert set(own) == set(texts)
    for key, group in own.items():
        ids = texts[key][0]
        assert sum(p.length for p in group) == len(ids) * len(texts[key])
        assert all(p.ids_crc32 == crc(ids[p.start : p.start + p.length]) and p.doc_tokens == len(ids) for p in group)
        if len(texts[key]) == 1:
            at = 0
            for p in sorted(group, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    for group in windows.values():
        at = 0
        for p in sorted(group, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(df.limit(0), JSON).count() == 0


def test_neighbours_fill_the_window():
    rng = np.random.default_rng(2)
    topics = [rng.integers(i * 1000, i * 1000 + 300, (6, 100)) for i in range(4)]
    docs = [d for group in zip(*topics) for d in group]  # topics alternate
    pieces = packing.pack_shard(docs, 300, np.ones(4000), 100.0)
    rooms = collections.defaultdict(set)
    for d, _, _, s, _ in pieces:
        rooms[s].add(d % 4)
    assert np.mean([len(x) for x in rooms.values()]) < 1.7
    found = collections.Counter(t for d in docs for t in set(d.tolist()))
    n, mean = len(docs), np.mean([len(d) for d in docs])
    idf = np.zeros(4000)
    for t, c in found.items():
        idf[t] = np.log1p((n - c + 0.5) / (c + 0.5))
    index = packing.Shard(docs, idf, mean)
    for seed in range(len(docs)):  # against BM25 computed pair by pair
        got = np.array(list(index.neighbours(seed, np.arange(len(docs)) != seed)), np.int64)
        size = np.array([len(d) for d in docs])
        score = np.zeros(n)
        for t in set(docs[seed].tolist()):
            tf = np.array([(d == t).sum() for d in docs])
            score += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
        score[seed] = 0
        assert set(got) == set(np.flatnonzero(score)) and np.allclose(np.sort(score[got])[::-1], score[got])


# --- 8
def shingles(text, k):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, num):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, k, num):
    rng = random.Random(k)
    rows = []
    for g in range(12):  # small and large sets, chains of copies, and one large group
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 11, 14, 22, 25, 60, 200]))]
        for c in range(40 if g == 0 else 6):
            w = list(base)
            for _ in range(c % 4):
                w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
            rows.append(" ".join(w[: len(w) - c % 3 // 2]))
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(df, k, num).collect()}
    assert got == brute_components(rows, k, num)


def test_components_edges(spark, edge):
    got = jaccard.near_components(edge, 3, 90).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert len(got) == edge.count() and by[0] == {(0, 0)} and by[1] == {(0, 1)} and by[6] == {(1, 6)} and by[7] == {(1, 6)} and by[None] == {(1, None)}
    assert jaccard.near_components(edge.limit(0), 3, 90).count() == 0
    loops = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (9, 3)], "a long, b long")
    assert {(r.node, r.component) for r in components.components(loops).collect()} == {(2, 2), (3, 2), (9, 2)}


# --- 9
def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, old = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(old[j] + 1, d[j - 1] + 1, old[j - 1] + (x != y)))
    return d[-1] <= 1


def test_automaton_equals_distance():
    terms, stems, rng = ["stupid", "moron", "idiot", "ass"], ["lowei"], random.Random(4)
    own = toxicity.Automaton(terms, stems, bound=50)
    tried = [*terms, "stupd", "stupiid", "morron", "idio", "as", "asss", "loweixyz", "lowei", "lowe", "", "idiott1"]
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "a", "o", "t"])
        tried.append("".join(w))
    for w in tried:
        exact = w in terms or any(w.startswith(s) for s in stems)
        near = any(len(t) >= 5 and within_one(w, t) for t in terms)
        assert own.match(w) == (1 if exact else 2 if near else 0), w


def test_quotation_differs_from_abuse():
    lex = toxicity.Lexicon(["moron"], [])
    assert lex.hits(lex.words('You are a mor0n!')) == [(3, 2, False)]
    assert lex.hits(lex.words('They wrote: "moron" is a word')) == [(2, 1, True)]


def test_lexicon_takes_terms_of_any_length(spark):
    rng = random.Random(1)
    plain = [f"w{i}" for i in range(300)]
    rows = [(" ".join(rng.sample(rng.sample(plain, 20) + (["zq", "y" * 60] if i % 2 else []), 20 + 2 * (i % 2))), i % 2) for i in range(400)]
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "t string, y int"))
    assert {"zq", "y" * 60} <= set(found.terms) | {w for w in ("zq", "y" * 60) if w.startswith(tuple(found.stems))}


def test_label_sample_is_bounded_and_repeats(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    pick = lambda n: {(r.k, r.y) for r in toxicity._sample(labels.repartition(n), F.lit(True), 200, "doc_id", "toxic").collect()}
    assert pick(1) == pick(7) and [sum(y == v for _, y in pick(3)) for v in (0, 1)] == [200, 200]
    assert len(toxicity._sample(labels.where("doc_id < 50"), F.lit(True), 200, "doc_id", "toxic").collect()) == 50


def test_toxicity_held_out(spark, edge):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, fold() != 0)
    got = toxicity.score(docs, model).join(labels, "doc_id").where(fold() == 0).collect()
    assert sum((r.predicted == r.toxic) for r in got) >= 0.9 * len(got)
    assert sum(r.predicted for r in got if r.toxic == 0) <= 1
    found = toxicity.score(edge, model).collect()
    assert len(found) == edge.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    empty = toxicity.fit(docs, labels.limit(0), fold() != 0)
    assert {r.score for r in toxicity.score(edge, empty).collect()} == {0.0}
    assert toxicity.score(edge.limit(0), model).count() == 0


# --- 10
@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 1, 2, 3], [0, 5, 5, 1000000], list(np.cumsum(np.random.default_rng(5).integers(0, 4000, 3000)))])
def test_elias_fano(values):
    own = eliasfano.EliasFano.of(np.array(values))
    assert own.all().tolist() == [int(x) for x in values]
    assert [own[i] for i in range(0, len(values), 7)] == [int(x) for x in values[::7]]
    head, parts = own.parts()
    assert eliasfano.EliasFano.read(head, parts).all().tolist() == [int(x) for x in values]
    if len(values) > 1000:
        assert sum(map(len, parts)) * 8 < 16 * len(values)  # 64 bits each in a plain table


@pytest.mark.parametrize("special", [True, False])
def test_chunks_equal_library(special):
    own, plain = tokens.ChunkEncoder(JSON, "<u4", special_as_text=special), Tokenizer.from_file(JSON)
    plain.encode_special_tokens = special
    rng = random.Random(5)
    parts = ["a", "foo", "Bar", " ", " ", "\n", "\n\n", "  ", "\t", "'s", "'", "1", "23", ".", ",", "!", "é", "ñ", "日", "\u00a0", "<|endoftext|>", "\ufb01", "_", "\r\n", "x" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)] + [None, "", "word " * 5000]
    ids, size = own.encode(pa.array(texts))
    for got, e in zip(np.split(ids, np.cumsum(size)[:-1]), plain.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert got.tolist() == e.ids


def test_token_files_hold_null_keys_and_many_files(spark, edge, tmp_path, monkeypatch):
    monkeypatch.setattr(eliasfano, "FILE_DOCS", 3)
    folder = f"file://{tmp_path}/many"
    assert eliasfano.write_files(edge, folder, JSON, 2).count() > 2
    got = sorted(eliasfano.read_files(spark, folder).collect(), key=lambda r: r.start)
    assert len(got) == edge.count() and got[0].doc_id is None
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()


def test_a_hot_key_is_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(eliasfano, "FILE_DOCS", 100)
    df = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), F.col("id").cast("string"))).otherwise("same").alias("text"))
    folder = f"file://{tmp_path}/hot"
    sizes = [r.docs for r in eliasfano.write_files(df.repartition(4), folder, JSON, 2).collect()]
    got = sorted(eliasfano.read_files(spark, folder).collect(), key=lambda r: r.start)
    assert max(sizes) < 200 and [r.doc_id for r in got] == [None] * 200 + sorted(i for i in range(600) if i % 3)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()


def test_token_files(spark, edge, library, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    made = eliasfano.write_files(edge.where("doc_id is not null"), folder, JSON, 2)
    assert made.count() >= 1
    got = sorted(eliasfano.read_files(spark, folder).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id, r.text or "") for r in edge.where("doc_id is not null").collect()))
    at = 0
    for r, (key, text) in zip(got, rows, strict=True):
        ids = [*ids_of(library, text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (key, at, len(ids), ids)
        at += len(ids)
    digest = eliasfano.read_files(spark, folder, digest=True).collect()
    assert sorted(r.ids_crc32 for r in digest) == sorted(crc(r.ids) for r in got)
    f = eliasfano.TokenFile(folder, made.first().file)
    assert f.ids(0).tolist()[-1] == 2
    empty = f"file://{tmp_path}/none"
    eliasfano.write_files(edge.limit(0), empty, JSON, 2)
    assert eliasfano.read_files(spark, empty).count() == 0
