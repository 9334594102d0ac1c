"""Features, splits, models and their scores on rows with known answers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loomwork.operators import cleaning as C
from loomwork.operators import evaluate as E
from loomwork.operators import features as X
from loomwork.operators import models as M
from loomwork.operators import online as M_O


def points(spark, rows, label=True):
    """Rows of (id, features..., label) as a frame with a vector."""
    n = len(rows[0]) - 1 - label
    names = ["id", *[f"x{i}" for i in range(n)], *(["label"] if label else [])]
    df = spark.createDataFrame([(int(r[0]), *map(float, r[1:])) for r in rows], ", ".join(f"{c} {'long' if c == 'id' else 'double'}" for c in names))
    return df.withColumn("features", array_to_vector(F.array(*[F.col(f"x{i}") for i in range(n)])))


def said(model, df):
    return {r.id: r.prediction for r in model.transform(df).select("id", "prediction").collect()}


# --- samples and splits
def test_samples_of_any_share(spark):
    df = spark.range(400_000).withColumn("x", F.col("id") * 2)
    ids = lambda f, d=df, seed=42: {r.id for r in C.fraction_sample(d, f, seed, "id").select("id").collect()}
    small, more = ids(0.00005), ids(0.01)
    assert 5 <= len(small) <= 45 and small < more and 3600 < len(more) < 4400
    assert ids(0.01, df.repartition(7)) == more != ids(0.01, seed=1)
    assert ids(1.0, df.limit(50)) == set(range(50)) and ids(0.0) == set()


def test_splits_cover_all_rows_once_and_repeat(spark):
    df = spark.range(50_000)
    for made, shares in ((X.split(df, "id", {"a": 80, "b": 20}), {"a": 0.8, "b": 0.2}), (X.split_three_way(df, "id"), {"train": 0.72, "valid": 0.08, "test": 0.2}), (X.split(df, "id", {"a": 0.00002, "b": 0.99998}), {"a": 0.00002, "b": 0.99998})):
        count = {r.part: r["count"] for r in made.groupBy("part").count().collect()}
        assert sum(count.values()) == 50_000 and all(abs(count.get(p, 0) / 50_000 - s) < 0.01 for p, s in shares.items())
    part = lambda d: {r.id: r.part for r in X.split(d, "id", {"a": 80, "b": 20}).collect()}
    assert part(df) == part(df.repartition(5))


# --- features
def test_one_hot_drops_the_first_category(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("b",)], "s string")
    code = lambda **k: {r.s: list(r.v) for r in X.fit_one_hot(df, "s", **k).transform(df).select("s", vector_to_array("s_vec").alias("v")).collect()}
    dropped = code()
    assert dropped["a"] == [0.0, 0.0] and sorted([dropped["b"], dropped["c"]]) == [[0.0, 1.0], [1.0, 0.0]]
    assert sorted(x[:3] for x in code(drop_first=False).values()) == [[0, 0, 1], [0, 1, 0], [1, 0, 0]]


def test_pca_keeps_as_few_components_as_needed(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 5)) * [9, 4, 1, 0.5, 0.1]
    df = points(spark, [(i, *r) for i, r in enumerate(a)], label=False)
    share = np.linalg.eigvalsh(np.cov(a.T))[::-1]
    share = share / share.sum()
    for want in (0.5, 0.9, 0.999, 1.0):
        model, k = X.fit_pca(df, "features", want)
        assert k == int(np.searchsorted(np.cumsum(share), want - 1e-12) + 1) and np.allclose(model.explainedVariance.toArray(), share[:k])
    line = points(spark, [(i, i, 2 * i, -i) for i in range(20)], label=False)
    assert X.fit_pca(line, "features", 0.99)[1] == 1
    wide = points(spark, [(i, *r) for i, r in enumerate(rng.normal(size=(400, 90)))], label=False)
    assert X.fit_pca(wide, "features", 0.99)[1] > 64  # no bound on the number


# --- regressors
def test_linear_regression_finds_the_plane(spark):
    df = points(spark, [(i, i % 7, i % 5, 2 * (i % 7) - 3 * (i % 5) + 5) for i in range(60)])
    model = M.fit_model("linear", df)
    assert np.allclose(model.coefficients.toArray(), [2, -3]) and model.intercept == pytest.approx(5)
    assert all(p == pytest.approx(y) for p, y in model.transform(df).select("prediction", "label").collect())


@pytest.mark.parametrize("kind", ["tree", "forest"])
def test_tree_regressors_learn_steps(spark, kind):
    df = points(spark, [(i, i % 40, (i * 7) % 3, 100.0 if i % 40 >= 20 else 10.0) for i in range(400)])
    model = M.fit_model(kind, df, **({"numTrees": 15, "seed": 3} if kind == "forest" else {}))
    got = said(model, points(spark, [(0, 5, 1, 0), (1, 35, 1, 0)]))
    assert got[0] == pytest.approx(10, abs=0.01 if kind == "tree" else 25) and got[1] == pytest.approx(100, abs=0.01 if kind == "tree" else 25)
    with pytest.raises(ValueError):
        M.estimator("unknown")


# --- classifiers
@pytest.mark.parametrize("kind,params", [("logistic", {}), ("svm", {}), ("tree_cls", {}), ("forest_cls", {"numTrees": 15, "seed": 1}), ("gbt_cls", {"maxIter": 5, "seed": 1})])
def test_classifiers_part_two_sides(spark, kind, params):
    rng = np.random.default_rng(2)
    rows = [(i, x, y, float(x + y > 0)) for i, (x, y) in enumerate(rng.normal(size=(300, 2))) if abs(x + y) > 0.6]
    model = M.fit_model(kind, points(spark, rows), **params)
    got = said(model, points(spark, [(0, 2, 1.5, 0), (1, -2, -1.5, 0), (2, 1.5, 2, 0), (3, -1, -2, 0)]))
    assert got == {0: 1.0, 1: 0.0, 2: 1.0, 3: 0.0}
    scores = E.binary_scores(model.transform(points(spark, rows)), "label", "prediction").first()
    assert scores.accuracy > 0.95


def test_logistic_regression_meets_the_odds(spark):
    rows = [(i, 0, float(i % 4 == 0)) for i in range(400)] + [(400 + i, 1, float(i % 4 != 0)) for i in range(400)]
    model = M.fit_model("logistic", points(spark, rows), maxIter=200, tol=1e-10)
    assert model.intercept == pytest.approx(math.log(1 / 3), abs=1e-3) and model.coefficients[0] == pytest.approx(2 * math.log(3), abs=1e-3)


def test_adaboost_weights_and_votes(spark):
    rows = [(i, i, float(3 <= i < 7)) for i in range(10)]  # no single cut parts the middle from both sides
    df = points(spark, rows)
    one = M.fit_model("adaboost", df, rounds=1, depth=1)
    wrong = sum(said(one, df)[i] != y for i, _, y in rows)
    assert wrong == 3 and one.weights == [pytest.approx(0.5 * math.log(0.7 / 0.3))]
    many = M.fit_model("adaboost", df, rounds=12, depth=1)
    assert said(many, df) == {i: y for i, _, y in rows} and len(many.trees) > 2
    margin = np.zeros(10)
    for tree, w in zip(many.trees, many.weights):  # each round's error is that of the weights before it
        bad = np.array([said(tree, df)[i] != y for i, _, y in rows])
        own = np.exp(-margin * np.array([2 * y - 1 for *_, y in rows]))
        error = own[bad].sum() / own.sum()
        assert w == pytest.approx(0.5 * math.log((1 - error) / error))
        margin += w * np.array([2 * said(tree, df)[i] - 1 for i, *_ in rows])
    pure = M.fit_model("adaboost", points(spark, [(i, i, float(i > 4)) for i in range(10)]), rounds=5, depth=1)
    assert len(pure.trees) == 1  # nothing is left to learn


def test_linear_text_classifier_on_held_out_rows(spark):
    from pyspark.ml.feature import HashingTF, Tokenizer

    rows = [(i, f"{'grand prize winner' if i % 2 else 'council budget report'} item{i}", float(i % 2)) for i in range(80)]
    df = HashingTF(inputCol="w", outputCol="features", numFeatures=4096).transform(Tokenizer(inputCol="t", outputCol="w").transform(spark.createDataFrame(rows, "id long, t string, label double")))
    model = M.fit_model("svm", df.where("id < 60"), maxIter=20)
    assert said(model, df.where("id >= 60")) == {i: y for i, _, y in rows if i >= 60}


def brute_passive_aggressive(order, docs, y, c, epochs):
    w, bias = {}, 0.0
    for e in range(epochs):
        for i in order(e):
            loss = 1 - y[i] * (sum(w.get(t, 0.0) * v for t, v in docs[i].items()) + bias)
            if loss > 0:
                step = y[i] * min(c, loss / (sum(v * v for v in docs[i].values()) + 1))
                w |= {t: w.get(t, 0.0) + step * v for t, v in docs[i].items()}
                bias += step
    return w, bias


def test_passive_aggressive_equals_one_row_at_a_time(spark):
    import pandas as pd
    import random

    rng = random.Random(4)
    docs = {i: {f"t{rng.randint(0, 15)}": rng.choice([0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 6))} for i in range(60)}
    y = {i: 1.0 if sum(v for t, v in d.items() if t < "t2") > 1 else -1.0 for i, d in docs.items()}
    rows = spark.createDataFrame([(i, t, v) for i, d in docs.items() for t, v in d.items()] + [(0, None, 1.0), (999, "t1", 1.0)], "id long, token string, weight double")
    labels = spark.createDataFrame([(i, "yes" if s > 0 else "no") for i, s in y.items()] + [(999, None)], "id long, label string")
    hashes = {r.id: r.h for r in labels.select("id", F.xxhash64("id").alias("h")).collect()}
    order = lambda e: sorted(docs, key=lambda i: int(pd.util.hash_array(np.array([hashes[i] ^ (42 * 1_000_003 + e)], np.int64))[0]))
    model = M_O.fit_passive_aggressive(rows, labels, c=0.7, epochs=3, still=-1e9)
    w, bias = brute_passive_aggressive(order, docs, y, 0.7, 3)
    assert model.bias == pytest.approx(bias) and {t: x for t, x in model.weights.items() if abs(x) > 1e-12} == pytest.approx({t: x for t, x in w.items() if abs(x) > 1e-12})
    got = {r.id: (r.margin, r.prediction) for r in model.transform(rows, labels).collect()}
    assert all(got[i][0] == pytest.approx(sum(w.get(t, 0.0) * v for t, v in d.items()) + bias) and got[i][1] == ("yes" if got[i][0] > 0 else "no") for i, d in docs.items())


def test_passive_aggressive_mixes_tasks(spark):
    rows = [(i, t, 1.0) for i in range(300) for t in ((f"good{i % 3}", f"x{i}") if i % 2 else (f"bad{i % 3}", f"x{i}"))]
    df = spark.createDataFrame(rows, "id long, token string, weight double")
    labels = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("label"))
    model = M_O.fit_passive_aggressive(df.where("id < 200"), labels.where("id < 200"), task_docs=40)
    made = model.transform(df, labels.where("id >= 200"))
    assert made.where("prediction <> label").count() == 0  # tokens seen in training decide
    with pytest.raises(ValueError):
        M_O.fit_passive_aggressive(df, labels.withColumn("label", F.lit(1)))


def test_passive_aggressive_holds_few_bytes_a_token(spark):
    import tracemalloc

    import pyarrow as pa

    def batches():
        for k in range(10):
            x = [None if i == 3 else [{"t": f"t{(i * j + k) % 5000}", "v": float(j)} for j in range(100)] for i in range(200)]
            yield pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([1.0] * 200), pa.array(x, pa.list_(pa.struct([("t", pa.string()), ("v", pa.float64())])))], ["h", "y", "x"])

    ready = list(batches())
    tracemalloc.start()
    names, h, y, size, at, v = M_O._numbered(iter(ready))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(h) == len(y) == 2000 and size.sum() == len(at) == len(v) == 199_000 and size[3] == 0
    assert peak < 40 * len(at)  # rows of dicts took hundreds
    assert [names[n] for n in at[size[0] : size[0] + 3]] == ["t0", "t1", "t2"] and M_O._numbered(iter(())) is None


# --- tuning, boards, importance
def test_grid_search_takes_the_depth_that_fits(spark):
    df = points(spark, [(i, i % 32, float((i % 32) // 4)) for i in range(320)])
    found = M.grid_cv(M.estimator("tree", seed=1), {"maxDepth": [1, 3], "minInstancesPerNode": [1, 2]}, df, 3, "mse")
    assert len(found.avgMetrics) == 4 and found.bestModel.depth == 3 and min(found.avgMetrics) < 0.1 < max(found.avgMetrics)


def test_leaderboard_order(spark):
    got = E.leaderboard(spark, [{"model": "b", "r2": 0.5}, {"model": "c", "r2": 0.9}, {"model": "a", "r2": 0.5}], "r2")
    assert [(r.model, r.r2) for r in got.collect()] == [("c", 0.9), ("a", 0.5), ("b", 0.5)]


def test_importance_of_used_and_unused_columns(spark):
    df = points(spark, [(i, i % 11, (i * 7) % 13, 4 * (i % 11)) for i in range(500)])
    found = {r.column: r.drop for r in E.importance(M.fit_model("linear", df), df.drop("features"), ["x0", "x1"], "label", "id").collect()}
    assert abs(found["x1"]) < 1e-9 and 1.5 < found["x0"] < 2.5  # R2 falls from 1 to about -1


def test_predictions_beside_the_rows(spark):
    df = points(spark, [(i, i, 3 * i) for i in range(10)]).withColumn("note", F.lit("n"))
    got = M.predict_append(M.fit_model("linear", df), df)
    assert got.columns == [*df.columns, "predicted"] and all(r.predicted == pytest.approx(3 * r.id) for r in got.collect())
