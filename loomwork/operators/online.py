"""Passive-aggressive linear classification of long-form rows (id, token, weight), with averaged rounds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a task in a round; its weights are mixed with those of the others after it.
TASK_DOCS = 50_000


@dataclass
class PassiveAggressive:
    """Weights by token, and the bias; the larger of the two labels is told from the smaller."""

    weights: dict[str, float]
    bias: float
    labels: tuple

    def transform(self, rows: DataFrame, ids: DataFrame, id_: str = "id", token: str = "token", weight: str = "weight") -> DataFrame:
        """``ids`` with margin and prediction: tokens meet the weights in a join; documents without a known token have the bias."""
        spark = rows.sparkSession
        table = spark.createDataFrame(pd.DataFrame({"_t": list(self.weights), "_w": list(self.weights.values())}), "_t string, _w double")
        sums = rows.join(table, F.col(token) == F.col("_t")).groupBy(F.col(id_).alias("_i")).agg(F.sum(F.col(weight) * F.col("_w")).alias("_s"))
        low, high = (F.lit(x) for x in self.labels)
        out = ids.join(sums, F.col(id_) == F.col("_i"), "left").withColumn("margin", F.coalesce("_s", F.lit(0.0)) + self.bias).drop("_i", "_s")
        return out.withColumn("prediction", F.when(F.col("margin") > 0, high).otherwise(low))


def _pass(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, w: np.ndarray, bias: float, c: float) -> float:
    """One pass in order: a row within the margin changes nothing, another moves the weights just as far as it asks, ``c`` at most."""
    for (at, v), side in zip(x, y):
        loss = 1.0 - side * (w[at] @ v + bias)
        if loss > 0:
            step = side * min(c, loss / (v @ v + 1.0))
            w[at] += step * v
            bias += step
    return bias


def _numbered(batches) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """The tokens of batches (h, y, x), and h, y and length of each document with the numbers and weights of its tokens, one after another."""
    number: dict[str, int] = {}
    held = []
    for b in batches:
        h, y, x = b.columns
        entries = x.flatten()
        own = entries.field("t").dictionary_encode()
        ids = np.array([number.setdefault(t, len(number)) for t in own.dictionary.to_pylist()], np.int32)
        size = pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64)
        held.append((h.to_numpy().copy(), y.to_numpy().copy(), size, ids[own.indices.to_numpy()], entries.field("v").to_numpy().copy()))
    return ([*number], *(np.concatenate(part) for part in zip(*held))) if sum(len(part[0]) for part in held) else None


def _weights(names: pa.Array, tokens: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The weights of ``names``, 0 for those not among ``tokens``."""
    at = pc.fill_null(pc.index_in(names, tokens), -1).to_numpy()
    return np.append(weights, 0.0)[at]


def fit_passive_aggressive(rows: DataFrame, labels: DataFrame, id_: str = "id", token: str = "token", weight: str = "weight", label: str = "label", c: float = 1.0, epochs: int = 50, still: float = 1e-3, task_docs: int = TASK_DOCS, seed: int = 42) -> PassiveAggressive:
    """Train on ``rows(id, token, weight)`` with ``labels(id, label)`` of two values.

    Documents are dealt to tasks of about ``task_docs``; a round is one pass of every task over its
    documents, in an order drawn for the round, from the common weights, and the mean of the tasks by their
    documents is the next start.  A task holds a number and a weight, 12 bytes, for each token of a document.
    What reaches the driver is one number for each token of the training rows.  Rounds end early when the
    mean hinge loss no longer falls by ``still``.  Documents without a token train the bias only; null labels
    take no part.
    """
    named = labels.where(F.col(label).isNotNull()).select(F.col(id_).alias("i"), F.col(label).alias("y"))
    kinds = sorted(r.y for r in named.select("y").distinct().limit(3).collect())
    if len(kinds) != 2:
        raise ValueError("the labels must have two values")
    n = named.count()
    held = rows.select(F.col(id_).alias("i"), F.col(token).alias("t"), F.col(weight).cast("double").alias("v")).where("t is not null and v is not null")
    docs = named.join(held.groupBy("i").agg(F.collect_list(F.struct("t", "v")).alias("x")), "i", "left")  # a document's own tokens
    docs = docs.select(F.xxhash64("i").alias("h"), F.when(F.col("y") == F.lit(kinds[1]), 1.0).otherwise(-1.0).alias("y"), "x").repartition(max(1, -(-n // task_docs)), "h").persist()
    tokens, weights, bias, best = pa.array([], pa.string()), np.zeros(0), 0.0, float("inf")
    try:
        for epoch in range(epochs):

            def run(batches, tokens=tokens, weights=weights, bias=bias, epoch=epoch):
                held = _numbered(batches)
                if held is None:
                    return
                number, h, y, size, at, v = held
                ends = np.cumsum(size)
                order = np.argsort(pd.util.hash_array(h ^ np.int64(seed * 1_000_003 + epoch)), kind="stable")
                x = [(at[ends[d] - size[d] : ends[d]], v[ends[d] - size[d] : ends[d]]) for d in order]
                names = pa.array(number, pa.string())
                w, y = _weights(names, tokens, weights), y[order]
                loss = sum(max(0.0, 1.0 - s * (w[at] @ v + bias)) for (at, v), s in zip(x, y))
                after = _pass(x, y, w, bias, c)
                yield pa.RecordBatch.from_arrays([names, pa.array(w * len(y)), pa.array(np.full(len(w), len(y))), pa.array(np.zeros(len(w)))], ["t", "w", "n", "loss"])
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([after * len(y)]), pa.array([len(y)]), pa.array([float(loss)])], ["t", "w", "n", "loss"])

            found = docs.mapInArrow(run, "t string, w double, n long, loss double").groupBy("t").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.sum("loss").alias("loss")).toArrow()  # a row a token
            loss = pc.sum(found.column("loss")).as_py() / n
            if epoch and loss > best - still:
                break
            best = min(best, loss)
            common, known = found.filter(pc.is_null(found.column("t"))), found.filter(pc.is_valid(found.column("t")))
            met = known.column("t").combine_chunks()
            weights = (known.column("w").to_numpy() + _weights(met, tokens, weights) * (n - known.column("n").to_numpy())) / n
            tokens, bias = met, common.column("w")[0].as_py() / n
    finally:
        docs.unpersist()
    return PassiveAggressive(dict(zip(tokens.to_pylist(), weights.tolist())), float(bias), tuple(kinds))
