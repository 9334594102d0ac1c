"""The stages against plain Python on the smallest documents."""

from __future__ import annotations

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline as P  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tests.llm.test_llm import brute_components  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "", None, "s", 0), (9003, "12345 !!", "en", "s", 8), (None, "the of and in", "en", "s", 13)], docs.schema)
    docs = docs.unionByName(extra)
    states = [docs]
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, states[-1], SF)
        assert out.columns == docs.columns
        states.append(spark.createDataFrame(out.collect(), docs.schema))
    start, clean, known, lines, single = states
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean.collect()}
    gone = {r.doc_id for r in start.collect()} - kept
    assert all(labels.get(i, 1) == 1 for i in gone) or sum(labels.get(i, 1) == 0 for i in gone) <= 1
    assert not {9001, 9002, 9003} & {r.doc_id for r in known.collect()}  # nothing to tell a language by
    assert known.count() >= clean.count() - 6
    before = {x.strip(" ") for r in known.collect() for x in (r.text or "").split("\n")} - {""}
    after = {x.strip(" ") for r in lines.collect() for x in (r.text or "").split("\n")} - {""}
    assert before == after
    rows = [(r.doc_id, r.text) for r in lines.where("doc_id is not null").collect()]
    want = {i for i, (_, root) in brute_components(rows, 5, 80).items() if root == i}
    assert {r.doc_id for r in single.where("doc_id is not null").collect()} == want
    pieces = P.STAGES[-1][1](spark, single, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in single.collect()}


def test_rows_are_judged_by_their_own_text(spark):
    """Null and repeated keys, extra columns with clashing names, empty tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    toxic = [r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()]
    bad = {r.doc_id: r.text for r in docs.collect() if r.doc_id in toxic}
    kept = {r.doc_id for r in P.drop_toxic(spark, docs, SF).collect()}
    assert len(set(bad) - kept) >= 0.8 * len(bad)  # toxic documents go
    good = next(r.text for r in docs.where("lang = 'en'").orderBy("doc_id").collect() if r.doc_id in kept and r.doc_id not in toxic)
    bad_text = next(t for i, t in sorted(bad.items()) if i not in kept)
    rows = [(None, bad_text, "k", 1.0, "a"), (None, good, "k", 2.0, "b"), (7, bad_text, "k", 3.0, "c"), (7, good, "k", 4.0, "d"), (8, None, None, None, "e"), (9, "", "k", 5.0, "f"), (10, "123 !", "k", 6.0, "g")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, k string, score double, predicted string")
    mark = lambda df: sorted(r.predicted for r in df.collect())
    left = P.drop_toxic(spark, odd, SF)
    assert left.columns == odd.columns and mark(left) == ["b", "d", "e", "f", "g"]
    wide = odd.drop("predicted").withColumns({"lang": F.lit("en"), "lang_pred": F.lit("x"), "predicted": F.col("score").cast("string")})
    told = P.drop_unknown_language(spark, wide.where("doc_id is null or doc_id > 6"), SF)
    assert told.columns == wide.columns and {r.text for r in told.collect()} <= {bad_text, good}
    for _, stage in P.STAGES[:-1]:
        none = stage(spark, docs.limit(0), SF)
        assert none.columns == docs.columns and none.count() == 0
    assert P.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    out = P.run(spark, SF)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert out.count() > 0
