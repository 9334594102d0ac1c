"""Corpus cleaning as five stages, each written and reread as the next one's documents.

toxicity rejects documents, language ID rejects documents of no known language, line dedup deletes
later repeated runs (documents left without text go), the n-gram Jaccard join keeps one document of
each group, and packing fills the windows.

Every stage takes any number of rows, none included, texts of any length, and columns of any name besides
those it reads.  Toxicity and language are judged row by row, whatever the key.  Null or empty text is not
toxic, is of no language (it goes there), and a line dedup that leaves no line removes the document.  The
Jaccard join judges keys: rows that repeat a key stay or go together, and rows with a null key stay.  A
column of the caller named like one that line dedup adds (n_lines, n_removed, removed) is replaced there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import jaccard, langid, linededup, packing, toxicity
from loomwork.llm.common import fold, read, shared_folder

#: Documents whose best language has less than this posterior are rejected.
LEAST_LANGUAGE = 0.5


def _file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], condition) -> DataFrame:
    """Rows of ``docs`` whose verdict holds.  A whole row is the key of its verdict, so nothing is joined back."""
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in inner.items()])
    found = judge(held.select(F.struct(*inner.values()).alias("doc_id"), F.col(inner["text"]).alias("text")))
    return found.where(condition).select(*[F.col(f"doc_id.{n}").alias(c) for c, n in inner.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    original = read(spark, sf_dir, "documents")
    model = toxicity.fit(original, read(spark, sf_dir, "labels"), fold() != 0)
    return _judged(docs, lambda d: toxicity.score(d, model), F.col("predicted") == 0)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a clearly best language, go."""
    path = _file("piece_bpe_32k.model")
    model = langid.fit(docs, path, fold() != 0)
    return _judged(docs, lambda d: langid.predict(d, path, model), (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted; a document that loses its last line goes."""
    found = linededup.dedup_lines(docs)
    left = found.where("not (n_removed > 0 and n_removed = n_lines)")
    changed = F.col("n_removed") > 0
    n_chars = [F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")] if "n_chars" in docs.columns else []
    return left.select(*[n_chars[0] if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked, directly or over others, the one with the smallest doc_id stays."""
    found = jaccard.near_components(docs, k=5, num=80)
    later = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 ids."""
    return packing.pack(docs, _file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unknown_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack),
]

#: No stage but line dedup can be told in SQL; tests compare the rest with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is written as Parquet and reread."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
