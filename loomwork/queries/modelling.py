"""Features, models, evaluation, recommenders, forecasts, quality, pipelines, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import aggregates as A
from loomwork.operators import evaluate as E
from loomwork.operators import features as X
from loomwork.operators import forecast as FC
from loomwork.operators import models as M
from loomwork.operators import online as O
from loomwork.operators import quality as Q
from loomwork.operators import recommend as R
from loomwork.plans import pipelines as P
from loomwork.plans.views import Views, r, sql
from loomwork.queries.registry import add, rounded
from loomwork.sources.scratch import scratch, stored
from loomwork.sources.tables import read_csv, write_csv
from loomwork.streaming import running as S
from loomwork.streaming.arrivals import drained, write_in_order

# --- features
add("feat_label_encode", lambda v: X.fit_label_encode(v.cars, "brand").transform(v.cars).select("Id", "brand_code"), sql("cars", "SELECT Id, CAST(dense_rank() OVER (ORDER BY brand) - 1 AS INTEGER) AS brand_code FROM cars"))
add("feat_target_encode", lambda v: rounded(X.fit_target_encode(v.cars, "brand", "price", 20.0, 10.0).transform(v.cars).select("Id", "brand_enc"), 5), sql("cars", f"SELECT Id, {r('CASE WHEN n = 1 THEN p ELSE p * (1 - 1 / (1 + exp(-(n - 20) / 10.0::DOUBLE))) + a / (1 + exp(-(n - 20) / 10.0::DOUBLE)) END', 5)} AS brand_enc FROM (SELECT Id, count(*) OVER w AS n, avg(price) OVER w AS a, avg(price) OVER () AS p FROM cars WINDOW w AS (PARTITION BY brand))"))


def _one_hot(v: Views) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    made = X.fit_one_hot(v.cars, "model").transform(v.cars)
    return made.groupBy("model").agg(F.first(F.array_join(vector_to_array("model_vec").cast("array<string>"), " ")).alias("code"))


add("feat_one_hot_drop_first", _one_hot)
_MODELS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
add("feat_one_hot_full", lambda v: X.one_hot_columns(v.cars, "model", _MODELS).select("Id", *[f"model_{m}" for m in _MODELS]), sql("cars", "SELECT Id, " + ", ".join(f"CASE WHEN model = '{m}' THEN 1 ELSE 0 END AS model_{m}" for m in _MODELS) + " FROM cars"))
add("feat_standard_scale", lambda v: rounded(X.fit_standard(v.cars, ["price", "size"]).transform(v.cars).select("Id", "price_scaled", "size_scaled")), sql("cars", f"SELECT Id, {r('(price - avg(price) OVER ()) / stddev_pop(price) OVER ()', 6)} AS price_scaled, {r('(size - avg(size) OVER ()) / stddev_pop(size) OVER ()', 6)} AS size_scaled FROM cars"))


def _minmax(v: Views) -> DataFrame:
    s = X.fit_minmax(v.cars, ["price"])
    return rounded(s.inverse(s.transform(v.cars)).select("Id", "price_scaled", "price_back"))


add("feat_minmax_scale", _minmax, sql("cars", f"SELECT Id, {r('(price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ())', 6)} AS price_scaled, {r('price', 6)} AS price_back FROM cars"))
add("feat_zscore_clip", lambda v: rounded(X.zscore_clip(v.trips, "payment_type", "fare").select("trip_id", "z")), sql("trips", f"SELECT trip_id, {r('greatest(0, least(1, (fare - avg(fare) OVER w) / stddev_pop(fare) OVER w))', 6)} AS z FROM trips WINDOW w AS (PARTITION BY payment_type)"))
_titles = lambda v: v.table("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name").alias("t"))
_TOKENS = r"t AS (SELECT p_partkey, unnest(regexp_extract_all(lower(concat_ws(' ', p_name, p_type, p_brand, p_name)), '\w\w+')) AS token FROM part), c AS (SELECT p_partkey, token, count(*) AS n FROM t GROUP BY 1, 2)"
add("feat_count_vector", lambda v: X.count_vector(_titles(v), "p_partkey", "t"), f"WITH {_TOKENS} SELECT p_partkey, token, n FROM c")
add("feat_tfidf", lambda v: rounded(X.tfidf(_titles(v), "p_partkey", "t", 0.7, ["red"])), f"""WITH {_TOKENS}, d AS (SELECT token, ln((1.0::DOUBLE + (SELECT count(*) FROM part)) / (1 + count(*))) + 1 AS idf FROM c WHERE token <> 'red' GROUP BY 1 HAVING count(*) <= 0.7 * (SELECT count(*) FROM part)),
 w AS (SELECT p_partkey, token, n * idf AS w FROM c JOIN d USING (token)) SELECT p_partkey, token, {r('w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey))', 6)} AS weight FROM w""")


def _vectors(v: Views) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return v.points.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))


def _pca(v: Views) -> DataFrame:
    from pyspark.ml.feature import StandardScaler

    d = _vectors(v)
    scaled = StandardScaler(inputCol="v", outputCol="z", withMean=True).fit(d).transform(d)
    model, k = X.fit_pca(scaled, "z", 0.8)
    shares = [(i + 1, float(x), k) for i, x in enumerate(model.explainedVariance)]
    return v.spark.createDataFrame(shares, "component int, explained double, kept int")


add("feat_pca", _pca)
add("split_random", lambda v: X.split(v.cars, "Id", {"train": 80, "test": 20}).groupBy("part").count())
add("split_three_way", lambda v: X.split_three_way(v.trips, "trip_id").groupBy("part").count())

# --- models: scores on held-out rows


def _cars(v: Views) -> tuple[DataFrame, DataFrame]:
    coded = X.fit_label_encode(v.cars, "brand").transform(v.cars).withColumn("label", F.col("price"))
    parts = X.split(X.assemble(coded.withColumn("brand_code", F.col("brand_code").cast("double")).withColumn("key", F.col("Id") % 200 * 1.0), ["size", "brand_code", "key"]), "Id", {"train": 80, "test": 20})
    return parts.where("part = 'train'"), parts.where("part = 'test'")


def _regressor(kind: str, **params):
    def make(v: Views) -> DataFrame:
        train, test = _cars(v)
        return rounded(E.regression_scores(M.fit_model(kind, train, **params).transform(test), "label", "prediction").withColumn("model", F.lit(kind)), 3)

    return make


add("model_linear_reg", _regressor("linear"))
add("model_tree_reg", _regressor("tree", maxDepth=6, seed=1))
add("model_forest_reg", _regressor("forest", numTrees=10, maxDepth=6, seed=1))


def _classes(v: Views) -> tuple[DataFrame, DataFrame]:
    d = _vectors(v).select("vec_id", F.col("v").alias("features"), F.when(F.col("label") < 5, 1.0).otherwise(0.0).alias("label"))
    parts = X.split(d, "vec_id", {"train": 70, "test": 30})
    return parts.where("part = 'train'"), parts.where("part = 'test'")


def _classifier(kind: str, **params):
    def make(v: Views) -> DataFrame:
        train, test = _classes(v)
        return rounded(E.binary_scores(M.fit_model(kind, train, **params).transform(test), "label", "prediction").withColumn("model", F.lit(kind)), 3)

    return make


add("model_logistic", _classifier("logistic", maxIter=20))
add("model_tree_cls", _classifier("tree_cls", maxDepth=5, seed=1))
add("model_forest_cls", _classifier("forest_cls", numTrees=10, maxDepth=5, seed=1))
add("model_gbt_cls", _classifier("gbt_cls", maxIter=5, seed=1))
add("model_adaboost", _classifier("adaboost", rounds=5))


def _text_model(v: Views) -> DataFrame:
    """TF-IDF over the whole vocabulary of the training rows, then a linear max-margin classifier; scores of the test rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer

    news = v.news.where("text is not null").select("id", "text", F.col("label").cast("double").alias("label"))
    parts = X.split(news, "id", {"train": 80, "test": 20})
    train = parts.where("part = 'train'")
    words = [RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"), CountVectorizer(inputCol="words", outputCol="counts", maxDF=0.7), IDF(inputCol="counts", outputCol="features")]
    features = Pipeline(stages=words).fit(train)
    model = M.fit_model("svm", features.transform(train), maxIter=10)
    return rounded(E.binary_scores(model.transform(features.transform(parts.where("part = 'test'"))), "label", "prediction"), 3)


add("model_linear_text", _text_model)


def _online_text(v: Views) -> DataFrame:
    """TF-IDF rows of all labelled texts, weights learned from the training rows by passive-aggressive updates; scores of the test rows."""
    news = v.news.where("text is not null").select("id", "text", F.col("label").cast("double").alias("label"))
    parts = X.split(news, "id", {"train": 80, "test": 20})
    rows = X.tfidf(parts, "id", "text", 0.7)  # document frequencies don't look at labels
    train = parts.where("part = 'train'")
    model = O.fit_passive_aggressive(rows.join(train.select("id"), "id", "left_semi"), train, epochs=10)
    return rounded(E.binary_scores(model.transform(rows, parts.where("part = 'test'").select("id", "label")), "label", "prediction"), 3)


add("model_passive_aggressive", _online_text)


def _grid(v: Views) -> DataFrame:
    train, _ = _cars(v)
    model = M.grid_cv(M.estimator("tree", seed=1), {"maxDepth": [2, 5]}, train, 3, "mse")
    return v.spark.createDataFrame([(int(p[next(iter(p))]), float(m)) for p, m in zip(model.getEstimatorParamMaps(), model.avgMetrics)], "max_depth int, mse double")


add("tune_grid_cv", _grid)


def _leaderboard(v: Views) -> DataFrame:
    train, test = _cars(v)
    rows = [{"model": k, "r2": E.regression_scores(M.fit_model(k, train).transform(test), "label", "prediction").first().r2} for k in ("linear", "tree")]
    return E.leaderboard(v.spark, rows, "r2")


add("eval_leaderboard", _leaderboard)


def _importance(v: Views) -> DataFrame:
    train, test = _cars(v)
    cols = ["size", "brand_code", "key"]
    return E.importance(M.fit_model("tree", train, seed=1), test.drop("features"), cols, "label", "Id")


add("eval_permutation_importance", _importance)


def _append(v: Views) -> DataFrame:
    train, test = _cars(v)
    path = scratch(v.spark, "predictions")
    write_csv(M.predict_append(M.fit_model("linear", train), test.drop("part")).select("Id", "price", "predicted"), path)
    return rounded(read_csv(v.spark, path, "Id long, price double, predicted double"), 2)


add("predict_append", _append)

# --- evaluation of given predictions
_pred = lambda v: v.trips.select(F.col("fare").alias("y"), (F.col("k") * 1.0).alias("p"), F.when(F.col("fare") > 50, 1).otherwise(0).alias("label"), F.when(F.col("k") > 60, 1).otherwise(0).alias("said"), "k")
_PRED = "p AS (SELECT fare AS y, k * 1.0::DOUBLE AS p, CASE WHEN fare > 50 THEN 1 ELSE 0 END AS label, CASE WHEN k > 60 THEN 1 ELSE 0 END AS said, k FROM trips)"
_with_p = sql("trips", "") + ", " + _PRED + " "
add("eval_regression", lambda v: rounded(E.regression_scores(_pred(v), "y", "p")), _with_p + f"SELECT count(*) AS n, {r('sqrt(avg((y - p) ** 2))', 6)} AS rmse, {r('1 - sum((y - p) ** 2) / (var_pop(y) * count(*))', 6)} AS r2 FROM p")
add("eval_confusion", lambda v: E.confusion(_pred(v), "label", "said"), _with_p + "SELECT label, said AS predicted, count(*) AS count FROM p GROUP BY 1, 2")
_COUNTS = "n AS (SELECT count(*) FILTER (WHERE label = {1} AND said = {1}) AS tp, count(*) FILTER (WHERE label = {0} AND said = {1}) AS fp, count(*) FILTER (WHERE label = {1} AND said = {0}) AS fn, count(*) FILTER (WHERE label = {0} AND said = {0}) AS tn FROM p)"
_SCORES = f" SELECT tp, fp, fn, tn, {r('(tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE)', 6)} AS accuracy, {r('tp / CAST(tp + fp AS DOUBLE)', 6)} AS precision, {r('tp / CAST(tp + fn AS DOUBLE)', 6)} AS recall, {r('tn / CAST(tn + fp AS DOUBLE)', 6)} AS specificity, {r('2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)', 6)} AS f1 FROM n"
add("eval_binary", lambda v: rounded(E.binary_scores(_pred(v), "label", "said")), _with_p + "," + _COUNTS.format(0, 1) + _SCORES)
add("eval_binary_class0", lambda v: rounded(E.binary_scores(_pred(v), "label", "said", positive=0)), _with_p + "," + _COUNTS.format(1, 0) + _SCORES)
add("eval_roc", lambda v: rounded(E.roc(_pred(v), "label", "k")), _with_p + f""", s AS (SELECT k AS threshold, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM p GROUP BY 1),
 c AS (SELECT threshold, p, n, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM s WINDOW w AS (ORDER BY threshold DESC))
 SELECT threshold, {r('CAST(cn AS DOUBLE) / CAST(tn AS DOUBLE)', 6)} AS fpr, {r('CAST(cp AS DOUBLE) / CAST(tp AS DOUBLE)', 6)} AS tpr, {r('(SELECT CAST(sum(n * (cp - p / 2.0)) AS DOUBLE) / CAST(max(tp) * max(tn) AS DOUBLE) FROM c)', 6)} AS auc FROM c""")

# --- recommenders
add("rec_popularity", lambda v: R.popularity(v.movies, v.ratings, "ring", 20, 15), sql("movies ratings", "SELECT CAST(row_number() OVER (ORDER BY avg_rating DESC, reviews DESC, title) AS INTEGER) AS serial, * FROM (SELECT title, CAST(round_even(avg(rating), 6) AS DOUBLE) AS avg_rating, count(*) AS reviews FROM movies JOIN ratings USING (movieId) WHERE list_contains(genres_list, 'ring') GROUP BY 1 HAVING count(*) >= 20 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 15)"))
_G = "g AS (SELECT movieId, g, count(*) AS n FROM (SELECT movieId, unnest(genres_list) AS g FROM movies) GROUP BY 1, 2), m AS (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY movieId)) AS norm FROM g)"
add("rec_content", lambda v: rounded(R.similar_items(v.movies, v.movies.where("movieId = 1").first().title, 12)), sql("movies", "") + f""", {_G}, x AS (SELECT b.movieId, {r('sum(a.n * b.n) / (any_value(a.norm) * any_value(b.norm))', 6)} AS cosine FROM m a JOIN m b USING (g) WHERE a.movieId = 1 AND b.movieId <> 1 GROUP BY 1)
 SELECT CAST(row_number() OVER (ORDER BY cosine DESC, movieId) AS INTEGER) AS serial, movieId, title, cosine FROM x JOIN movies USING (movieId) ORDER BY cosine DESC, movieId LIMIT 12""")
add("rec_collaborative", lambda v: R.user_neighbours(v.ratings, v.movies, 7, 10, 20), sql("movies ratings", "") + f""", n AS (SELECT *, sqrt(sum(rating * rating) OVER (PARTITION BY userId)) AS norm FROM ratings),
 c AS (SELECT b.userId, round(sum(a.rating * b.rating) / (any_value(a.norm) * any_value(b.norm)), 9) AS cosine FROM n a JOIN n b USING (movieId) WHERE a.userId = 7 AND b.userId <> 7 GROUP BY 1),
 k AS (SELECT userId FROM (SELECT 7 AS userId, 1.0::DOUBLE AS cosine WHERE 7 IN (SELECT userId FROM ratings) UNION ALL SELECT * FROM c) ORDER BY cosine DESC, userId LIMIT 20),
 b AS (SELECT movieId FROM ratings SEMI JOIN k USING (userId) GROUP BY 1 ORDER BY round(sum(rating) / 20, 9) DESC, movieId LIMIT 10)
 SELECT CAST(row_number() OVER (ORDER BY movieId) AS INTEGER) AS serial, movieId, title FROM movies SEMI JOIN b USING (movieId)""")

# --- forecasts and chunk scores
add("forecast_monthly", lambda v: rounded(FC.forecast(v.orders.select("category", "order_date", "sales"), "category", "order_date", "sales"), 1))
_chunks = lambda v: v.frames.withColumn("xhat", F.round("x", 0))
add("anomaly_chunk_score", lambda v: rounded(FC.chunk_score(_chunks(v), "key", "ts", "x", "xhat", 10, 0.08)), sql("frames", f"""SELECT key, c AS chunk, count(*) AS n, {r('sqrt(sum((x - xhat) ** 2)) / count(*)', 6)} AS score, sqrt(sum((x - xhat) ** 2)) / count(*) > 0.08 AS alert
 FROM (SELECT key, x, {r('x', 0)} AS xhat, (row_number() OVER (PARTITION BY key ORDER BY ts) - 1) // 10 AS c FROM frames) GROUP BY 1, 2 HAVING count(*) = 10"""))

# --- quality
add("dq_expect_rows", lambda v: Q.expect_rows(A.trip_summary(v.trips, "HOUR"), 24 * 30), sql("trips", "SELECT CAST(720 AS BIGINT) AS expected, count(DISTINCT date_trunc('hour', pickup)) AS actual, count(DISTINCT date_trunc('hour', pickup)) = 720 AS ok FROM trips"))
add("dq_missing_hours", lambda v: Q.missing_hours(A.trip_summary(v.trips.where("hour(pickup) <> 3"), "HOUR"), "pickup_hour", "2024-01-01 00:00:00", "2024-01-30 23:00:00"), "SELECT h AS pickup_hour FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS h) WHERE h NOT IN (SELECT date_trunc('hour', ts) FROM events WHERE hour(ts) <> 3)")
add("dq_expect_no_nulls", lambda v: Q.expect_no_nulls(v.complaints.select("order_id", "state")), sql("complaints", "SELECT count(*) - count(state) AS nulls, count(*) = count(state) AS ok FROM complaints"))


# --- pipelines
def _config(v: Views, name: str) -> P.Config:
    base = scratch(v.spark, name)
    v.trips.write.parquet(f"{base}/in/trips_2024-01.parquet")
    return P.Config(source=f"{base}/in", target=f"{base}/out", months=[1, 2])


def _bronze(v: Views) -> DataFrame:
    return P.bronze(v.spark, _config(v, "bronze")).select("trip_id", "fare", "pickup_day")


add("pipe_bronze", _bronze, sql("trips", "SELECT trip_id, fare, CAST(pickup AS DATE) AS pickup_day FROM trips"))
_POS = "fare > 0 AND distance > 0 AND passengers > 0 AND total > 0"
add("pipe_silver", lambda v: P.silver(v.trips.withColumn("Empty Note", F.lit("")), {"passengers": "bigint"}).drop("pickup", "dropoff", "tip", "total", "distance"), sql("trips", f"SELECT trip_id, pickup_zone, dropoff_zone, payment_type, fare, passengers, k FROM trips WHERE {_POS}"))


def _gold(v: Views) -> DataFrame:
    g = P.gold(P.silver(v.trips))
    n = lambda name: g[name].agg(F.count("*").alias("rows"), F.sum("trip_count").alias("trips")).withColumn("name", F.lit(name))
    return n("trip_summary").union(n("pickup_zones")).union(n("dropoff_zones"))


add("pipe_gold", _gold, sql("trips", f""", t AS (SELECT * FROM trips WHERE {_POS}) SELECT count(*) AS rows, CAST(sum(n) AS BIGINT) AS trips, 'trip_summary' AS name FROM (SELECT count(*) AS n FROM t GROUP BY date_trunc('hour', pickup))
 UNION ALL SELECT count(*), CAST(sum(n) AS BIGINT), 'pickup_zones' FROM (SELECT count(*) AS n FROM t GROUP BY CAST(pickup AS DATE), pickup_zone)
 UNION ALL SELECT count(*), CAST(sum(n) AS BIGINT), 'dropoff_zones' FROM (SELECT count(*) AS n FROM t GROUP BY CAST(dropoff AS DATE), dropoff_zone)"""))


def _run(v: Views) -> DataFrame:
    cfg = _config(v, "medallion")
    P.run(v.spark, cfg)
    return v.spark.read.parquet(f"{cfg.target}/gold/pickup_zones").groupBy("pickup_day").agg(F.sum("trip_count").alias("trips"))


add("pipe_run", _run, sql("trips", f"SELECT CAST(pickup AS DATE) AS pickup_day, count(*) AS trips FROM trips WHERE {_POS} GROUP BY 1"))


def _complaints(v: Views) -> DataFrame:
    parts = stored(X.split(v.complaints.withColumn("id", F.xxhash64("order_id", "company", "issue", "sent")), "id", {"train": 70, "test": 30}), "complaints")  # fits read it some twenty times
    made = P.complaints_pipeline(parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part"))
    return E.confusion(made, "label", "prediction")


add("pipe_complaints", _complaints)


# --- streams over files, to the end of what is there
def _drained(v: Views, build) -> DataFrame:
    """The frames arrive in the order of their times; each file meets the state of those before."""
    base, rows = scratch(v.spark, "stream"), _chunks(v)
    write_in_order(rows, "ts", f"{base}/in")
    return drained(v.spark, f"{base}/in", rows.schema, build, base)


add("stream_running_average", lambda v: rounded(_drained(v, lambda s: S.running_average(s, "key", "ts", "x", 0.2)).select("key", "ts", "ewma"), 5), "WITH RECURSIVE " + sql("frames", "")[5:] + f""", n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS i FROM frames),
 e AS (SELECT key, ts, i, x AS s FROM n WHERE i = 1 UNION ALL SELECT n.key, n.ts, n.i, 0.8::DOUBLE * e.s + 0.2::DOUBLE * n.x FROM e JOIN n ON n.key = e.key AND n.i = e.i + 1)
 SELECT key, ts, {r('s', 5)} AS ewma FROM e""")
add("stream_chunk_alert", lambda v: rounded(_drained(v, lambda s: S.chunk_alert(s, "key", "ts", "x", "xhat", 10, 0.08))), sql("frames", f"""SELECT key, c AS chunk, count(*) AS n, {r('sqrt(sum((x - xhat) ** 2)) / count(*)', 6)} AS score, sqrt(sum((x - xhat) ** 2)) / count(*) > 0.08 AS alert
 FROM (SELECT key, x, {r('x', 0)} AS xhat, (row_number() OVER (PARTITION BY key ORDER BY ts) - 1) // 10 AS c FROM frames) GROUP BY 1, 2 HAVING count(*) = 10"""))
