"""One query a numbered operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import annsearch, bpe, divergence, eliasfano, imagematch, jaccard, langid, linededup, maxent, packing, rankedsearch, toxicity, weightedhash
from loomwork.llm.common import fold, held_out, read, shared_folder, written


def _file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weightedhash.edited_likeness(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, _file("piece_bpe_32k.model"), fold() != 0)
    found = langid.predict(docs, _file("piece_bpe_32k.model"), model)
    return found.select("doc_id", held_out(0).alias("held_out"), "lang_pred", "score")


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: each vector is drawn as one, so the work grows with ``embeddings``."""
    images = written(imagematch.rendered(read(spark, sf_dir, "embeddings")).withColumnRenamed("vec_id", "id"), "images")
    found = imagematch.find_copies(images, imagematch.edited_queries(images))
    return found.withColumnRenamed("id", "vec_id")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(read(spark, sf_dir, "documents"), _file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_maxent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = maxent.score(docs, fold() != 1)
    return found.select("doc_id", held_out(1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op7_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), _file("byte_bpe_50k.json"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(read(spark, sf_dir, "documents"), k=3, num=90)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.fit(docs, labels, fold() != 0))
    return found.select("doc_id", held_out(0).alias("held_out"), "score", "predicted", "n_abuse", "n_quoted")


def op10_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    eliasfano.write_files(read(spark, sf_dir, "documents"), folder, _file("byte_bpe_50k.json"), end_id=2)
    return eliasfano.read_files(spark, folder, digest=True)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankedsearch.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.near_rows(read(spark, sf_dir, "embeddings"), lambda key: key % 100 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_weighted_sampling, op2_language_id, op3_image_copies, op4_bpe_round_trip, op5_maxent_score, op6_line_dedup, op7_bm25_packing, op8_ngram_jaccard, op9_toxicity, op10_elias_fano, op11_ranked_search, op12_nn_descent, op13_source_divergence)}
ORACLES: dict[str, str] = {"op6_line_dedup": linededup.ORACLE, "op11_ranked_search": rankedsearch.ORACLE, "op13_source_divergence": divergence.ORACLE}
