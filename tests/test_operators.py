"""Hand-made cases: nulls, ties, repeats, empty tables, edges."""

from __future__ import annotations

import collections
import datetime as dt
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomwork.functions import scalars as S
from loomwork.operators import aggregates as A
from loomwork.operators import cleaning as C
from loomwork.operators import evaluate as E
from loomwork.operators import features as X
from loomwork.operators import forecast as FC
from loomwork.operators import joins as J
from loomwork.operators import quality as Q
from loomwork.operators import recommend as R
from loomwork.operators import reshape as RS
from loomwork.operators import series as SE
from loomwork.operators import windows as W
from loomwork.plans import pipelines as P
from loomwork.sources import tables as T


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def values(df, col):
    return [r[col] for r in df.collect()]


def test_clean_names_clash(spark):
    df = frame(spark, "` A b` int, `a_B` int", (1, 2))
    with pytest.raises(ValueError, match="clash"):
        C.clean_names(df)
    assert C.clean_names(df.select("` A b`")).columns == ["a_b"]


def test_drop_empty(spark):
    df = frame(spark, "a string, b string, c string, d int", (None, "", None, 1), (None, "", "", None))
    assert C.drop_empty(df).columns == ["c", "d"]  # null and '' together are two values
    assert C.drop_empty(df.limit(0)).columns == df.columns


def test_drop_sparse_is_strict(spark):
    df = frame(spark, "a int, b int", *[(None if i == 0 else i, None if i < 2 else i) for i in range(4)])
    assert C.drop_sparse(df).columns == ["a"]


def test_keep_positive_and_between(spark):
    df = frame(spark, "x double, t timestamp", (1.0, dt.datetime(2024, 1, 31)), (None, None), (0.0, None), (2.0, dt.datetime(2024, 1, 31, 0, 0, 1)))
    assert values(C.keep_positive(df, ["x", "absent"]), "x") == [1.0, 2.0]
    assert C.time_range(df, "t", "2024-01-01", "2024-01-31", "both").count() == 1  # ends at midnight
    assert C.time_range(df, "t", "2024-01-01", "2024-01-31").count() == 0


def test_impute_mode_compares_numbers(spark):
    df = spark.createDataFrame([(9, "b"), (9, "b"), (10, "a"), (10, "a"), (None, None)], "n int, s string")
    assert [(r.n, r.s) for r in C.impute_mode(df, ["n", "s"]).collect()][-1] == (9, "a")


def test_complaints_use_training_modes_only(spark):
    import datetime as dt

    from loomwork.plans.pipelines import complaints_pipeline

    day = dt.date(2020, 3, 2)
    row = lambda i, product, state: (i, product, "Web", state, "Yes" if i % 3 else "No", day, day + dt.timedelta(days=i % 4), "Yes" if product == "loan" else "No")
    schema = "id long, product string, channel string, state string, timely string, received date, sent date, disputed string"
    train = spark.createDataFrame([row(i, "loan" if i % 4 else "card", "CA") for i in range(60)], schema)
    rows = [row(i, "card", "NY") for i in range(9)] + [(9, None, None, None, None, day, None, "No"), (10, "other", "Mail", "NY", "Yes", None, None, "No")]
    got = {r.id: r for r in complaints_pipeline(train, spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 11 and all(r.prediction in (0.0, 1.0) for r in got.values())  # no row is lost
    assert (got[9].product, got[9].state) == ("loan", "CA")  # not the test rows' own modes
    assert got[0].prediction == 0.0 and got[9].prediction == 1.0


def test_impute_mode_tie_and_numbers(spark):
    df = frame(spark, "a string, b int, c string", ("y", 1, None), ("x", 2, None), (None, None, None), ("x", 2, None), ("y", 1, None))
    out = C.impute_mode(df, ["a", "b", "c"]).collect()
    assert (out[2].a, out[2].b, out[2].c) == ("x", 1, None)


def test_map_codes_clamp_flag(spark):
    df = frame(spark, "k int, s string", (1, "Yes"), (9, "No"), (None, None), (-3, "maybe"))
    assert values(C.map_codes(df, "k", {1: "one"}, "l"), "l") == ["one", None, None, None]
    assert values(df.select(C.clamp_negative(F.col("k")).alias("k")), "k") == [1, 9, None, 0]
    assert values(df.select(C.flag_yes_no(F.col("s")).alias("s")), "s") == ["1", "0", None, "maybe"]


def test_duplicates(spark):
    df = frame(spark, "a int, b string", (1, None), (1, None), (2, "x"))
    assert C.count_duplicates(df).collect() == [Row(rows=3, duplicates=1)]
    assert C.count_duplicates(df.limit(0)).first().rows == 0


def test_weeks_and_buckets(spark):
    df = frame(spark, "d date", (dt.date(2024, 1, 7),), (dt.date(2024, 1, 8),))  # Sunday, Monday
    got = df.select(S.trunc_to(F.col("d"), "week").alias("m"), S.trunc_to(F.col("d"), "week", "sunday").alias("s"), S.week_bucket(F.col("d")).alias("b")).collect()
    assert [(r.m.day, r.s.day, r.b) for r in got] == [(1, 7, 1), (8, 7, 2)]
    with pytest.raises(ValueError):
        S.trunc_to(F.col("d"), "decade")


def test_scalars_edges(spark):
    df = frame(spark, "s string, dx double, dy double, a array<double>", ("Old (1995)", 0.0, 1.0, [1.0, 3.0, 3.0]), ("ab", 1.0, 0.4, []), (None, None, None, None))
    got = df.select(S.trim_suffix(F.col("s")).alias("t"), S.slope_side(F.col("dx"), F.col("dy")).alias("side"), S.argmax(F.col("a")).alias("m")).collect()
    assert [(r.t, r.side, r.m) for r in got] == [("Old", None, 1), ("", None, None), (None, None, None)]
    words = frame(spark, "s string", ("It's the End, 2 ends",)).select(S.remove_stopwords(S.tokenize_alpha(F.col("s")), ["the"]).alias("w")).first().w
    assert words == ["it", "s", "end", "ends"]


def test_joins(spark):
    orders, returns = frame(spark, "order_id int, sales double", (1, 5.0), (2, 6.0)), frame(spark, "order_id int, returned string", (1, "Yes"), (1, "Yes"))
    assert sorted(values(J.with_returns(orders, returns, "order_id"), "order_id")) == [1, 2]
    pts, pal = frame(spark, "v array<double>", ([1.0],)), frame(spark, "name string, ord int, v array<double>", ("a", 1, [0.0]), ("b", 2, [2.0]))
    assert J.nearest(pts, pal, "v", "name", "ord").first().nearest == "b"  # the last wins a tie
    with pytest.raises(ValueError):
        J.nearest(pts, pal, "v", "name", "ord", most=1)


def test_knn_ties_and_nulls(spark):
    base = frame(spark, "id long, v array<double>", (1, [0.0]), (2, [1.0]), (3, [-1.0]), (4, None), (5, [9.0]))
    got = J.knn(base.where("id = 1"), base, "id", "v", 2).orderBy("rank").collect()
    assert [(r.neighbour, r.distance) for r in got] == [(2, 1.0), (3, 1.0)]
    assert J.knn(base.limit(0), base, "id", "v", 2).count() == 0


def brute_knn(rows, asked, k, p):
    dist = lambda a, b: sum(abs(x - y) for x, y in zip(a, b)) if p == 1 else math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
    near = {q: sorted((dist(rows[q], v), i) for i, v in rows.items() if i != q)[:k] for q in asked}
    return {(q, i): (n, pytest.approx(d)) for q, own in near.items() for n, (d, i) in enumerate(own, 1)}


@pytest.mark.parametrize("p", [1, 2])
def test_knn_in_blocks_equals_brute_force(spark, p):
    rng = random.Random(p)
    rows = {i: [rng.gauss(0, 1) + 8 * (i % 3), rng.gauss(0, 1)] for i in range(300)} | {300 + i: [1.0, 1.0] for i in range(80)} | {400: [500.0, 0.0]}
    df = frame(spark, "id long, v array<double>", *rows.items(), (None, [0.0, 0.0]), (999, None))
    asked = [i for i in rows if i % 4 == 0]
    got = J.knn(df.where("id % 4 = 0"), df, "id", "v", 5, p, pivots=9, base_rows=20, query_rows=15)
    assert {(r.query, r.neighbour): (r["rank"], r.distance) for r in got.collect()} == brute_knn(rows, asked, 5, p)
    few = df.where("id < 3")
    assert J.knn(few, few, "id", "v", 5, p).count() == 6  # fewer rows than k


def test_knn_prunes_far_pivots(spark):
    df = frame(spark, "id long, v array<double>", *[(i, [1000.0 * (i % 10), float(i)]) for i in range(200)])
    plan = J.knn(df.where("id = 5"), df, "id", "v", 3, pivots=40)
    assert sorted(values(plan, "neighbour")) == [15, 25, 35]


def test_knn_copies_base_rows_only_for_queries_that_visit_them(spark, monkeypatch):
    df = frame(spark, "id long, v array<double>", *[(i, [1000.0 * (i % 10), float(i)]) for i in range(200)])
    kind, rows = type(df.groupBy("id")), []
    cogroup = kind.cogroup
    monkeypatch.setattr(kind, "cogroup", lambda self, other: rows.append(other._df.count()) or cogroup(self, other))
    got = J.knn(df.where("id % 10 = 5"), df, "id", "v", 3, pivots=40, query_rows=5)
    assert got.count() == 60 and rows[0] <= 20 * 4  # 20 rows near the 20 queries, in 4 blocks of them at most


def test_knn_votes_and_means(spark):
    base = frame(spark, "id long, v array<double>, y double, c string", (1, [0.0], 0.0, "q"), (2, [1.0], 10.0, "a"), (3, [3.0], 20.0, "b"), (4, [3.0], 30.0, "b"), (5, [100.0], 7.0, None), (6, [100.0], 9.0, "z"), (7, [101.0], None, "y"))
    near = J.knn(base.where("id in (1, 5)"), base, "id", "v", 3)
    label = lambda w: {r.query: r.predicted for r in J.knn_classify(near, base, "id", "c", w).collect()}
    mean = lambda w: {r.query: r.predicted for r in J.knn_regress(near, base, "id", "y", w).collect()}
    assert label("uniform") == {1: "b", 5: "b"} and label("distance") == {1: "a", 5: "z"}
    assert mean("uniform") == {1: 20.0, 5: pytest.approx((9 + 20) / 2)}
    assert mean("distance") == {1: pytest.approx((10 + 20 / 3 + 30 / 3) / (1 + 2 / 3)), 5: 9.0}  # a neighbour at distance 0 counts alone
    with pytest.raises(ValueError):
        J.knn_regress(near, base, "id", "y", "other")


@pytest.mark.parametrize("least", [0.0, 0.3, 0.8])
def test_similar_rows_equal_brute_force(spark, least):
    rng = random.Random(3)
    cells = collections.defaultdict(float)
    rows = [(r, rng.choice("abcdefghij") if rng.random() < 0.7 else f"f{rng.randint(0, 60)}", rng.choice([-1.0, 0.5, 1.0, 2.0])) for r in range(70) for _ in range(rng.randint(1, 9))]
    rows += [(200 + i, "all", 1.0) for i in range(50)] + [(300, "x", 1.0), (300, "x", -1.0), (None, "a", 1.0), (301, None, 1.0)]
    for r, f, v in rows:
        if r is not None and f is not None:
            cells[r, f] += v
    vec = collections.defaultdict(dict)
    for (r, f), v in cells.items():
        if v:
            vec[r][f] = v
    dot = lambda a, b: sum(x * b.get(f, 0) for f, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    want = {(a, b): c for a in vec for b in vec if a < b and (c := dot(vec[a], vec[b])) > 1e-12 and c >= least - 1e-12}
    df = frame(spark, "r int, f string, v double", *rows)
    for short, block in ((64, 1024), (3, 7), (1000, 7)):
        got = {(r.a, r.b): r.cosine for r in J.similar_rows(df, "r", "f", "v", least, short, block).collect() if r.cosine > 1e-12}
        assert got == pytest.approx(want)
    assert J.similar_rows(df.limit(0), "r", "f", "v").count() == 0


@pytest.mark.parametrize("least", [0.0, 0.4])
def test_similar_rows_shuffle_no_pairs(spark, least):
    """Rows that share every feature, and rows that share few: pairs come once, and no plan node after the lists groups or joins them."""
    rng = random.Random(5)
    rows = [(r, f, rng.choice([1.0, 2.0, 5.0])) for r in range(150) for f in ({1, 2, 3} | {rng.randint(10, 90) for _ in range(3)})]
    df = frame(spark, "r int, f int, v double", *rows)
    vec = collections.defaultdict(dict)
    for r, f, v in rows:
        vec[r][f] = v
    dot = lambda a, b: sum(x * b.get(f, 0) for f, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    want = {(a, b): c for a in vec for b in vec if a < b and (c := dot(vec[a], vec[b])) > 1e-12 and c >= least - 1e-12}
    found = J.similar_rows(df, "r", "f", "v", least, 20, 40)
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert len(got) == len(want) and {(r.a, r.b): r.cosine for r in got} == pytest.approx(want)
    wide = J.similar_rows(df, "r", "f", "v", least, 20, 40, narrow=5).collect()  # all rows are named only
    assert len(wide) == len(want) and {(r.a, r.b): r.cosine for r in wide} == pytest.approx(want)
    assert "HashAggregate" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def test_pairs_of_lists_cut_anywhere(spark):
    """Lists that go on in later batches, and chunks of several lists, give the pairs of the lists as wholes."""
    import pyarrow as pa

    rng = random.Random(6)
    vec = {r: dict(sorted((f, 1.0) for f in rng.sample(range(12), 4))) for r in range(60)}
    unit = {r: {f: x / 2 for f, x in own.items()} for r, own in vec.items()}
    rows = sorted((f, r, p, list(own), list(own.values())) for r, own in unit.items() for p, f in enumerate(own))
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 7])], ["f", "r", "p", "fs", "xs"]) for i in range(0, len(rows), 7)]
    want = {(a, b): c for a in unit for b in unit if a < b and (c := sum(x * unit[b].get(f, 0) for f, x in unit[a].items())) >= 0.5}
    before = J.LIST_ROWS, J.ENTRIES
    J.LIST_ROWS, J.ENTRIES = 25, 40
    try:
        got = [tuple(r.values()) for b in J._paired(0.5)(iter(batches)) for r in b.to_pylist()]
    finally:
        J.LIST_ROWS, J.ENTRIES = before
    assert len(got) == len(want) and {(a, b): c for a, b, c in got} == pytest.approx(want)


def test_quantiles_equal_sorting(spark):
    rng = random.Random(8)
    rows = [(rng.choice([0.0, 1.0, 1.0, rng.gauss(0, 1e6), 10 ** rng.uniform(-300, 300)]), float(i % 2), None) for i in range(4000)] + [(None, None, None), (float("inf"), 5.0, None), (float("nan"), None, None)]
    df = frame(spark, "x double, y double, z double", *rows).repartition(4)
    pcts = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    xs, ys = sorted(x for x, _, _ in rows if x is not None and x == x), sorted(y for _, y, _ in rows if y is not None)
    at = {"x": sorted({0, 1, 700, 2000, 3999, len(xs) - 1}), "y": [0, 1999, 2000, 2001, len(ys) - 1]}
    for most, accuracy in ((50_000, 10_000), (40, 100), (2, 20)):  # one pass; several; many with a coarse sketch
        got = A.select_ranks(df, at, most, accuracy)
        assert got == {("x", r): xs[r] for r in at["x"]} | {("y", r): ys[r] for r in at["y"]}
    mid = A.quantiles_exact(df, ["y", "z"], pcts)
    assert mid["z"] == [None] * 7 and mid["y"][3] == ys[(len(ys) - 1) // 2]


def test_cosine_pairs(spark):
    df = frame(spark, "r int, f int, v double", (1, 1, 1.0), (2, 1, 2.0), (2, 2, 2.0), (3, 3, 1.0))
    got = {(r.a, r.b): round(r.cosine, 6) for r in J.cosine_pairs(df, "r", "f", "v").collect()}
    assert got == {(1, 2): 0.707107, (2, 1): 0.707107}


def test_summary_units(spark):
    df = frame(spark, "pickup timestamp, fare double, tip double, passengers long, distance double, total double, dropoff timestamp", (dt.datetime(2024, 1, 7, 1), 1.0, None, 1, 1.0, 1.0, dt.datetime(2024, 1, 7, 2)))
    assert A.trip_summary(df, "week").first().pickup_week == dt.date(2024, 1, 7)
    assert A.trip_summary(df, "HOUR", extra=True).first().avg_duration_min == 60.0
    with pytest.raises(ValueError):
        A.trip_summary(df, "YEAR")


def test_statistics(spark):
    df = frame(spark, "x double", (1.0,), (2.0,), (2.0,), (None,), (9.0,))
    d = A.describe_exact(df, ["x"]).first()
    assert (d["count"], d.p50, d.max) == (4.0, 2.0, 9.0)
    h = A.histogram(df, "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in h] == [3, 0, 0, 1]  # the last bin is closed
    assert [r["count"] for r in A.histogram(frame(spark, "x double", (5.0,), (5.0,)), "x", 2).orderBy("bin").collect()] == [2, 0]
    assert A.histogram(df.limit(0), "x", 4).count() == 0
    assert round(A.skew_g1(df, ["x"]).first().skew, 4) == 1.9001  # 36 / 10.25 ** 1.5 * sqrt(12) / 2
    assert [(r.column, r.nulls) for r in A.null_profile(df).collect()] == [("x", 1)]


def test_moving_average_and_returns(spark):
    df = frame(spark, "t string, d int, x double", *[("a", i, None if i == 3 else float(i)) for i in range(6)])
    assert values(W.moving_avg(df, "t", "d", "x", 2).orderBy("d"), "moving_avg") == [None, 0.5, 1.5, None, None, 4.5]
    assert values(W.pct_change(df, "t", "d", "x", fill=True).orderBy("d"), "pct_change")[3] == 0.0
    b = W.binned_returns(frame(spark, "t string, r double", ("a", 0.0), ("a", 0.03), ("a", 0.5), ("b", None)), "t", "r", [-0.03, 0.0, 0.03], ["low", "high"])
    assert sorted((r.t, r.label, r["count"], r.percent) for r in b.collect()) == [("a", "high", 1, 50.0), ("a", "low", 1, 50.0), ("b", "high", 0, None), ("b", "low", 0, None)]


def test_rank_keeps_ties(spark):
    df = frame(spark, "k string, v double", ("a", 5.0), ("b", 5.0), ("c", 1.0), ("d", 0.0))
    assert sorted((r.k, r["rank"]) for r in W.rank_total(df, "k", "v", 1, 3).collect()) == [("a", 1), ("b", 1), ("c", 3)]


def test_lags_split_yoy(spark):
    df = frame(spark, "t string, d int, x double", *[("a", i, float(i)) for i in range(5)])
    assert [r.lags for r in W.lag_vector(df, "t", "d", "x", 3).orderBy("d").collect()] == [[0.0, 1.0, 2.0], [1.0, 2.0, 3.0]]
    assert W.ordered_split(df, "t", "d", 2).where("part = 'train'").count() == 2
    y = frame(spark, "e string, y int, m int, v double", ("a", 2000, 1, 10.0), ("a", 2002, 1, 20.0), ("a", 2003, 1, 30.0))
    assert values(W.yoy(y, "e", "y", "m", "v").orderBy("y"), "yoy") == [None, None, 50.0]


def test_ewma_and_trim(spark):
    df = frame(spark, "k string, i int, x double", ("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, None), ("a", 4, 10.0))
    assert values(W.ewma(df, "k", "i", "x", 0.5).orderBy("i"), "ewma") == [10.0, 15.0, 15.0, 12.5]
    t = frame(spark, "k string, x double", ("a", 0.0), ("a", 0.1), ("a", 0.15), ("a", 5.0), ("b", None))
    assert sorted(values(W.drop_far_from_mean(t, "k", "x"), "x")) == [0.0, 0.1, 0.15]


def test_long_series_pass_their_state_between_blocks(spark):
    rows = [(k, i, None if i % 7 == 3 or (k == "b" and i < 25) else float((i * 37) % 11)) for k in ("a", "b", None) for i in range(60)] + [("c", 1, None), ("d", 1, 4.0)]
    df = frame(spark, "k string, i int, x double", *rows)
    parts = {r.k: r.n for r in SE.placed(df, ["k"], ["i"], 10).groupBy("k").agg(F.countDistinct("_part").alias("n")).collect()}
    assert parts["a"] >= 4  # one series lies in many tasks
    want = {}
    for k in ("a", "b", None, "c", "d"):
        s = None
        for _, i, x in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            s = s if x is None else x if s is None else 0.7 * s + 0.3 * x
            want[k, i] = s
    got = {(r.k, r.i): r.ewma for r in SE.ewma(df, "k", "i", "x", 0.3, 10).collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) if want[c] is not None else got[c] is None for c in want)
    numbered = SE.number(df, "k", "i", 10).collect()
    assert len(numbered) == len(rows) and all(r.rn == r.i + (r.k not in ("c", "d")) for r in numbered)
    assert SE.ewma(df.limit(0), "k", "i", "x", 0.3).count() == SE.number(df.limit(0), "k", "i").count() == 0


def test_windows_in_blocks_equal_whole_series(spark):
    rows = [(k, i, None if i % 11 == 5 else float((i * 53) % 17 + 1)) for k in ("a", None) for i in range(97)] + [("b", 0, 3.0), ("c", None, 1.0), ("c", 4, 2.0)]
    df = frame(spark, "k string, i int, x double", *rows).repartition(3)
    same = lambda a, b: [[repr(c) for c in r] for r in sorted(map(tuple, a.collect()), key=repr)] == [[repr(c) for c in r] for r in sorted(map(tuple, b.collect()), key=repr)]
    for rows_ in (10, 40):
        assert same(W.moving_avg(df, "k", "i", "x", 9, rows_).withColumn("moving_avg", F.round("moving_avg", 9)), W.moving_avg(df, "k", "i", "x", 9).withColumn("moving_avg", F.round("moving_avg", 9)))
        for fill in (False, True):
            assert same(W.pct_change(df, "k", "i", "x", fill, rows_), W.pct_change(df, "k", "i", "x", fill))
        assert same(W.lag_vector(df, "k", "i", "x", 7, rows_), W.lag_vector(df, "k", "i", "x", 7))
        assert same(W.ordered_split(df, "k", "i", 30, rows_), W.ordered_split(df, "k", "i", 30))
        assert same(W.mean_return(df, "k", "i", "x", rows_).withColumn("mean_return", F.round("mean_return", 9)), W.mean_return(df, "k", "i", "x").withColumn("mean_return", F.round("mean_return", 9)))
    gaps = frame(spark, "k string, i int, x double", *[("a", i, 5.0 if i == 2 else None) for i in range(60)])
    assert values(SE.carried(gaps, "k", "i", "x", 8).orderBy("i"), "carried") == [None] * 2 + [5.0] * 58  # over many blocks without a value


def test_ties_are_split_and_numbered_once(spark):
    df = spark.range(400).select(F.lit("a").alias("k"), F.lit(1).alias("i"), "id")
    table = SE.placed(df, ["k"], ["i"], 50)
    assert table.groupBy("_part").count().agg(F.max("count")).first()[0] < 200
    assert sorted(values(SE.number(df, "k", "i", 50), "rn")) == list(range(1, 401))


def test_long_chains_of_blocks(spark):
    df = frame(spark, "k string, i int, x double", *[("a", i, float(i % 5)) for i in range(200)])
    s, want = None, []
    for i in range(200):
        s = float(i % 5) if s is None else 0.9 * s + 0.1 * (i % 5)
        want.append(s)
    assert values(SE.ewma(df, "k", "i", "x", 0.1, 3).orderBy("i"), "ewma") == pytest.approx(want)  # 67 blocks


def test_label_codes_over_many_partitions(spark):
    df = frame(spark, "s string", *[(f"v{(i * 7919) % 300:04d}",) for i in range(600)], (None,), ("é",), ("",))
    codes = {r.s: r.s_code for r in X.fit_label_encode(df, "s", 20).transform(df).collect()}
    assert codes == {v: i for i, v in enumerate(sorted({r.s for r in df.collect()} - {None}, key=lambda v: v.encode()))} | {None: None}


def test_trim_equals_one_row_at_a_time(spark):
    rows = [(k, ((i * i * 31) % 17) / 10) for k in ("a", None) for i in range(40)] + [("b", 1.0), ("b", 1.0), ("b", 3.0), ("e", None), ("e", float("nan"))]
    runs = [sorted((str(r.k), r.x) for r in W.drop_far_from_mean(frame(spark, "k string, x double", *rows), "k", "x", 0.25, *sizes).collect()) for sizes in ((), (2, 3), (4, 5))]
    got = runs[0]
    assert runs[1] == runs[2] == got  # a few values at either end a round
    want = []
    for k in ("a", None, "b"):
        xs = sorted(x for g, x in rows if g == k)
        while xs and max(sum(xs) / len(xs) - xs[0], xs[-1] - sum(xs) / len(xs)) > 0.25:
            mean = sum(xs) / len(xs)
            xs.pop(0 if mean - xs[0] >= xs[-1] - mean else -1)
        want += [(str(k), x) for x in xs]
    assert got == sorted(want)


def test_reshape(spark):
    df = frame(spark, "r int, c string, v double", (1, "a", 2.0), (2, "b", 3.0))
    assert sorted(map(tuple, RS.pivot_dense(df, "r", "c", "v", ["a", "b"]).collect())) == [(1, 2.0, 0.0), (2, 0.0, 3.0)]
    with pytest.raises(Exception, match="twice"):
        RS.pivot_dense(df.union(df), "r", "c", "v", ["a", "b"]).collect()
    with pytest.raises(Exception):
        RS.union_all([df, df.drop("v")]).collect()
    assert RS.union_all([df, df.drop("v")], missing=True).where("v is null").count() == 2


def test_encoders(spark):
    df = frame(spark, "c string, y double", ("b", 1.0), ("a", 0.0), ("b", 3.0), ("z", 9.0))
    e = X.fit_target_encode(df, "c", "y", 1.0, 1.0)
    got = {r.c: r.c_enc for r in e.transform(frame(spark, "c string", ("b",), ("z",), ("new",))).collect()}
    assert got["z"] == got["new"] == 3.25 and 2.0 < got["b"] < 3.25
    codes = X.fit_label_encode(df, "c").transform(frame(spark, "c string", ("a",), ("b",), ("q",)))
    assert {r.c: r.c_code for r in codes.collect()} == {"a": 0, "b": 1, "q": None}
    s = X.fit_standard(frame(spark, "x double", (5.0,), (5.0,)), ["x"]).transform(frame(spark, "x double", (5.0,), (None,)))
    assert values(s, "x_scaled") == [0.0, None]


def test_tfidf(spark):
    df = frame(spark, "id int, t string", (1, "apple apple pear"), (2, "apple plum"), (3, None))
    w = {(r.id, r.token): r.weight for r in X.tfidf(df, "id", "t", max_df=0.9).collect()}
    assert abs(sum(v * v for (i, _), v in w.items() if i == 1) - 1) < 1e-9 and w[1, "apple"] > w[1, "pear"]


def test_roc_and_scores(spark):
    df = frame(spark, "y int, s double", (1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1))
    assert {round(r.auc, 6) for r in E.roc(df, "y", "s").collect()} == {0.875}
    b = E.binary_scores(frame(spark, "y int, p int", (1, 0), (0, 0)), "y", "p").first()
    assert b.precision is None and b.recall == 0.0
    one = E.binary_scores(frame(spark, "y int, p int", (1, 0), (0, 0)), "y", "p", positive=0).first()
    assert one.recall == 1.0


def test_recommenders(spark):
    movies = frame(spark, "movieId long, title string, genres_list array<string>", (1, "A", ["x", "y"]), (2, "B", ["x", "y"]), (3, "C", ["z"]), (4, "D", []))
    assert [r.movieId for r in R.similar_items(movies, "A", 5).collect()] == [2]  # the asked film is left out by id
    ratings = frame(spark, "userId long, movieId long, rating double", (1, 1, 5.0), (2, 1, 5.0), (2, 3, 4.0), (3, 3, 1.0))
    assert [r.movieId for r in R.user_neighbours(ratings, movies, 1, 1, 2).collect()] == [1]
    assert R.popularity(movies, ratings, "x", 3, 5).count() == 0


def test_forecast_fills_gaps(spark):
    rows = [("a", dt.date(2000 + i // 12, i % 12 + 1, 5), float(10 + i % 12)) for i in range(40) if i != 20]
    out = FC.forecast(frame(spark, "k string, d date, v double", *rows), "k", "d", "v").orderBy("month").collect()
    assert len(out) == 12 and out[0].month == dt.date(2003, 4, 1) and all(r.lower <= r.forecast <= r.upper for r in out)
    assert FC.forecast(frame(spark, "k string, d date, v double", ("b", dt.date(2000, 1, 1), 1.0)), "k", "d", "v").count() == 0


def test_chunks_drop_the_rest(spark):
    df = frame(spark, "k string, i int, x double, h double", *[("a", i, 1.0, 0.0) for i in range(25)])
    assert [(r.chunk, r.n) for r in FC.chunk_score(df, "k", "i", "x", "h").orderBy("chunk").collect()] == [(0, 10), (1, 10)]


def test_expectations(spark):
    df = frame(spark, "a int", (1,), (None,))
    assert not Q.expect_no_nulls(df).first().ok
    with pytest.raises(Q.ExpectationError):
        Q.expect_rows(df, 3, fail=True)


def test_layers_and_pipeline(spark, tmp_path):
    df = frame(spark, "trip_id long, pickup timestamp, dropoff timestamp, pickup_zone long, dropoff_zone long, fare double, tip double, passengers long, distance double, total double", *[(i, dt.datetime(2024, 1, 1 + i % 3, i), dt.datetime(2024, 1, 1 + i % 3, i, 30), 1, 2, float(i), 1.0, 1, 1.0, float(i)) for i in range(10)])
    df.write.parquet(f"{tmp_path}/in/trips_2024-01.parquet")
    cfg = P.Config(source=f"{tmp_path}/in", target=f"{tmp_path}/out", months=[1, 2])
    assert P.run(spark, cfg)[-1] == "gold/dropoff_zones"
    assert T.read_layer(spark, f"{tmp_path}/out/silver").count() == 9
    assert P.run(spark, cfg, "gold")[0] == "gold/trip_summary"
    with pytest.raises(FileNotFoundError):
        T.read_months(spark, f"{tmp_path}/in", "trips", 2023, [1])
    with pytest.raises(ValueError):
        P.run(spark, cfg, "platinum")


def test_files(spark, tmp_path):
    (tmp_path / "8863_idx5_x451_y1451_class0.png").write_bytes(b"x")
    r = T.file_manifest(spark, str(tmp_path)).first()
    assert (r.label, r.patient_id, r.x, r.y) == ("0", "8863", 451, 1451)
    (tmp_path / "z.json").write_text('{"features": [{"properties": {"location_id": "4", "zone": null}}]}')
    assert T.read_features(spark, str(tmp_path / "z.json")).collect() == [Row(zone_id=4, zone="")]
    assert T.calendar(spark, dt.date(1997, 1, 1), dt.date(1998, 12, 31)).count() == 730


def test_complaints_are_joined_once(spark, monkeypatch):
    from loomwork import catalog

    plans, made = [], P.complaints_pipeline
    monkeypatch.setattr(P, "complaints_pipeline", lambda train, test: plans.extend(d._jdf.queryExecution().executedPlan().toString() for d in (train, test)) or made(train, test))
    assert catalog.QUERIES["pipe_complaints"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(plans) == 2 and not any("Join" in x or "Exchange" in x for x in plans)


def test_streams_take_files_in_order(spark, tmp_path):
    from loomwork.streaming import running
    from loomwork.streaming.arrivals import drained, write_in_order

    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=(i * 37) % 60), float((i * 37) % 60 % 7)) for i in range(60) for k in ("a", "b")] + [("a", None, 3.0)]
    df = frame(spark, "k string, ts timestamp, x double", *rows)
    base = str(tmp_path)
    assert write_in_order(df, "ts", f"{base}/in", 12) >= 9  # each partition is cut into files
    got = drained(spark, f"{base}/in", df.schema, lambda s: running.running_average(s, "k", "ts", "x", 0.25), base)
    want = SE.ewma(df, "k", "ts", "x", 0.25)
    key = lambda d: {(r.k, r.ts): r.ewma for r in d.collect()}
    assert key(got) == pytest.approx(key(want)) and got.count() == len(rows)
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) >= 9  # a file a micro-batch


def test_streams_take_no_more_batches_and_state_than_rows_need(spark, tmp_path):
    from loomwork.streaming import running
    from loomwork.streaming.arrivals import drained, write_in_order

    df = frame(spark, "k string, ts timestamp, x double", *[("ab"[i % 2], dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), float(i % 7)) for i in range(100)])
    base, key = str(tmp_path), "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        assert write_in_order(df, "ts", f"{base}/in", 60) <= 4  # two parts, each cut at most once
        got = drained(spark, f"{base}/in", df.schema, lambda s: running.chunk_alert(s, "k", "ts", "x", "x", 10), base)
        assert got.count() == 10 and spark.conf.get(key) == "50"
    finally:
        spark.conf.set(key, before)
    assert len(list((tmp_path / "state" / "state" / "0").glob("[0-9]*"))) <= spark.sparkContext.defaultParallelism


def test_running_average_query_takes_one_batch_under_many_partitions(spark):
    from loomwork import catalog

    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "40")
    try:
        made = catalog.QUERIES["stream_running_average"](spark, "/root/testdata/sf0.001")
        files = made.select(F.input_file_name().alias("f")).distinct().count()
        assert made.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    finally:
        spark.conf.set(key, before)
    assert files <= spark.sparkContext.defaultParallelism  # a file a state partition, of one micro-batch
