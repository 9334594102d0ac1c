"""Joins, aggregation, windows, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import aggregates as A
from loomwork.operators import joins as J
from loomwork.operators import reshape as R
from loomwork.operators import windows as W
from loomwork.plans.views import Views, r, sql
from loomwork.queries.registry import add, rounded

# --- joins
add("join_inner", lambda v: rounded(v.ratings.join(v.movies, "movieId").select("userId", "movieId", "title", "rating")), sql("movies ratings", f"SELECT userId, movieId, title, {r('rating', 6)} AS rating FROM ratings JOIN movies USING (movieId)"))
add("join_left", lambda v: v.movies.select("movieId", "title").join(v.ratings.select("userId", "movieId"), "movieId", "left"), sql("movies ratings", "SELECT movieId, title, userId FROM movies LEFT JOIN ratings USING (movieId)"))
add("join_semi_in_list", lambda v: J.semi_in(v.movies, v.ratings.where("rating >= 4.5").select("movieId"), "movieId").select("movieId", "title"), sql("movies ratings", "SELECT movieId, title FROM movies WHERE movieId IN (SELECT movieId FROM ratings WHERE rating >= 4.5)"))
add("join_lookup", lambda v: J.lookup(v.trips.select("trip_id", F.col("pickup_zone").alias("n_nationkey")), v.table("nation"), "n_nationkey", ["n_name"]), sql("trips", "SELECT trip_id, pickup_zone AS n_nationkey, n_name FROM trips LEFT JOIN nation ON pickup_zone = n_nationkey"))
add("join_orders_returns", lambda v: rounded(J.with_returns(v.orders, v.returns, "order_id").groupBy("returned").agg(F.count("*").alias("n"), F.sum("sales").alias("sales")), 2),
    sql("sales returns", f"SELECT returned, count(*) AS n, {r('sum(sales)', 2)} AS sales FROM sales LEFT JOIN (SELECT DISTINCT * FROM returns) USING (order_id) GROUP BY 1"))


def _star(v: Views):
    dims = [(v.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment"), "o_custkey"), (v.table("nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey"), (v.table("region"), "r_regionkey")]
    return rounded(J.star(v.table("orders"), dims).groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


add("join_star", _star, f"SELECT r_name, c_mktsegment, count(*) AS n, {r('sum(o_totalprice)', 2)} AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
add("join_nearest", lambda v: rounded(J.nearest(v.points, v.palette, "embedding", "name", "label").select("vec_id", "nearest", "distance")), f"""
WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
p AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2),
d AS (SELECT x.vec_id, p.label, sum(abs(x.x - p.m)) AS d FROM x JOIN p USING (i) GROUP BY 1, 2)
SELECT vec_id, 'c' || label AS nearest, {r('d', 6)} AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, label DESC) = 1""")
_KNN = """k AS (SELECT q.vec_id AS query, b.vec_id AS neighbour, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance, b.label AS label, q.label AS own
  FROM embeddings q JOIN embeddings b ON q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, b.vec_id) <= 5)"""
_near = lambda v: J.knn(v.points.where("vec_id % 20 = 0"), v.points, "vec_id", "embedding", 5)
add("join_knn", lambda v: rounded(_near(v)), f"WITH {_KNN} SELECT query, neighbour, {r('distance', 6)} AS distance, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS INTEGER) AS rank FROM k")


add("model_knn", lambda v: J.knn_classify(_near(v), v.points, "vec_id", "label"), f"WITH {_KNN} SELECT query, label AS predicted FROM (SELECT query, label, count(*) AS n FROM k GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, label) = 1")
_WEIGHED = """w AS (SELECT k.*, CASE WHEN min(distance) OVER (PARTITION BY query) = 0 THEN CAST(distance = 0 AS DOUBLE) ELSE 1.0::DOUBLE / nullif(distance, 0) END AS w FROM k)"""
add("model_knn_weighted", lambda v: J.knn_classify(_near(v), v.points, "vec_id", "label", "distance"), f"WITH {_KNN}, {_WEIGHED} SELECT query, label AS predicted FROM (SELECT query, label, round(sum(w), 9) AS w FROM w GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query ORDER BY w DESC, label) = 1")


def _knn_regression(v: Views):
    """Used-car prices from the cars nearest in size and in the remainder of their id (the tables hold one measure only), by L1; ties go to the smaller id."""
    cars = v.cars.select("Id", F.array("size", (F.col("Id") % 97).cast("double")).alias("x"), "price").cache()
    near = J.knn(cars.where("Id % 20 = 0"), cars, "Id", "x", 5, p=1)
    return rounded(J.knn_regress(near, cars, "Id", "price").withColumnRenamed("predicted", "uniform").join(J.knn_regress(near, cars, "Id", "price", "distance").withColumnRenamed("predicted", "weighted"), "query"), 4)


add("model_knn_regression", _knn_regression, sql("cars", f""", c AS (SELECT Id, size, CAST(Id % 97 AS DOUBLE) AS m, price FROM cars),
k AS (SELECT q.Id AS query, b.price, abs(q.size - b.size) + abs(q.m - b.m) AS distance FROM c q JOIN c b ON q.Id % 20 = 0 AND q.Id <> b.Id QUALIFY row_number() OVER (PARTITION BY q.Id ORDER BY distance, b.Id) <= 5), {_WEIGHED}
SELECT query, {r('avg(price)', 4)} AS uniform, {r('sum(w * price) / sum(w)', 4)} AS weighted FROM w GROUP BY 1"""))
_COSINE = f"""SELECT a, b, {r('dot / (na * nb)', 6)} AS cosine FROM (SELECT x.company AS a, y.company AS b, sum(x.q * y.q) AS dot, any_value(x.n) AS na, any_value(y.n) AS nb
    FROM (SELECT *, sqrt(sum(q * q) OVER (PARTITION BY company)) AS n FROM (SELECT company, country, sum(quantity) AS q FROM sales GROUP BY 1, 2)) x
    JOIN (SELECT *, sqrt(sum(q * q) OVER (PARTITION BY company)) AS n FROM (SELECT company, country, sum(quantity) AS q FROM sales GROUP BY 1, 2)) y ON x.country = y.country AND x.company < y.company GROUP BY 1, 2)"""  # fmt: skip
_baskets = lambda v: v.orders.select(F.col("order_id").alias("row"), F.col("product_id").alias("f"), "quantity")
add("join_self_similarity", lambda v: rounded(J.similar_rows(v.orders.select(F.col("company").alias("row"), F.col("country").alias("f"), "quantity"), "row", "f", "quantity")), sql("sales", _COSINE))
#: The SQL compares the rounded cosine, so pairs that only rounding lifts to 0.6 are measured too.
add("join_similar_rows", lambda v: rounded(J.similar_rows(_baskets(v), "row", "f", "quantity", 0.6 - 1e-6)).where("cosine >= 0.6"), sql("sales", f"SELECT * FROM ({_COSINE.replace('country', 'product_id').replace('company', 'order_id')}) WHERE cosine >= 0.6"))

# --- aggregation
_M = f"count(*) AS trip_count, {r('avg(fare)')} AS avg_fare, {r('avg(tip)')} AS avg_tip, CAST(sum(passengers) AS BIGINT) AS total_passengers, {r('avg(distance)')} AS avg_distance"
_SUNDAY = "CAST(CAST({0} AS DATE) - CAST(dayofweek({0}) AS INTEGER) AS DATE)"
_CLEAN = "fare > 0 AND distance > 0 AND passengers > 0 AND total > 0"
_clean = lambda v: v.trips.where(_CLEAN)
add("agg_trip_summary", lambda v: A.trip_summary(_clean(v), "HOUR"), sql("trips", f"SELECT date_trunc('hour', pickup) AS pickup_hour, {_M} FROM trips WHERE {_CLEAN} GROUP BY 1"))
add("agg_trip_summary_week", lambda v: A.trip_summary(v.trips, "WEEK"), sql("trips", f"SELECT {_SUNDAY.format('pickup')} AS pickup_week, {_M} FROM trips GROUP BY 1"))
add("agg_trip_summary_ext", lambda v: A.trip_summary(v.trips, "HOUR", extra=True), sql("trips", f"SELECT date_trunc('hour', pickup) AS pickup_hour, {_M}, {r('avg(total)')} AS avg_total_amount, {r('avg((epoch_us(dropoff) - epoch_us(pickup)) / 6e7)')} AS avg_duration_min FROM trips WHERE distance > 0 AND total > 0 GROUP BY 1"))
add("agg_zone_summary", lambda v: A.zone_summary(v.trips, "DAY", "pickup"), sql("trips", f"SELECT CAST(pickup AS DATE) AS pickup_day, pickup_zone AS zone_id, {_M} FROM trips GROUP BY 1, 2"))
add("agg_zone_summary_dropoff", lambda v: A.zone_summary(v.trips, "WEEK", "dropoff", ("2024-01-02", "2024-01-20")), sql("trips", f"SELECT {_SUNDAY.format('dropoff')} AS dropoff_week, dropoff_zone AS zone_id, {_M} FROM trips WHERE pickup BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20' GROUP BY 1, 2"))
_H = f"h AS (SELECT date_trunc('hour', pickup) AS pickup_hour, {_M} FROM trips GROUP BY 1)"
_hours = lambda v: A.trip_summary(v.trips, "HOUR")
add("agg_hour_profile", lambda v: rounded(A.hour_profile(_hours(v), ["trip_count", "avg_fare"])), sql("trips", "") + f", {_H} SELECT hour(pickup_hour) AS hour, {r('avg(trip_count)', 6)} AS trip_count, {r('avg(avg_fare)', 6)} AS avg_fare FROM h GROUP BY 1")
add("agg_rollup_mean", lambda v: rounded(A.rollup_mean(_hours(v), "week", ["trip_count", "avg_tip"])), sql("trips", "") + f", {_H} SELECT CAST(date_trunc('week', pickup_hour) AS DATE) AS week, {r('avg(trip_count)', 6)} AS trip_count, {r('avg(avg_tip)', 6)} AS avg_tip FROM h GROUP BY 1")
add("agg_zone_mean_range", lambda v: rounded(A.zone_mean(A.zone_summary(v.trips, "DAY", "pickup"), "avg_fare", "2024-01-03", "2024-01-09")), sql("trips", f"SELECT zone_id, {r('avg(avg_fare)', 6)} AS avg_fare FROM (SELECT CAST(pickup AS DATE) AS d, pickup_zone AS zone_id, {r('avg(fare)')} AS avg_fare FROM trips GROUP BY 1, 2) WHERE d BETWEEN DATE '2024-01-03' AND DATE '2024-01-09' GROUP BY 1"))
add("agg_row_count", lambda v: A.row_count(v.trips), sql("trips", "SELECT count(*) AS rows, CAST(12 AS BIGINT) AS columns FROM trips"))
add("agg_volume_hourly", lambda v: v.trips.groupBy(F.date_trunc("hour", "pickup").alias("hour")).count(), sql("trips", "SELECT date_trunc('hour', pickup) AS hour, count(*) AS count FROM trips GROUP BY 1"))
add("agg_value_counts", lambda v: A.value_counts(v.trips, "payment_type"), sql("trips", "SELECT payment_type AS value, count(*) AS count FROM trips GROUP BY 1"))
add("agg_counts_by_two", lambda v: A.counts_by(v.complaints, "product", "disputed"), sql("complaints", "SELECT product, disputed, count(*) AS count FROM complaints GROUP BY 1, 2"))
add("agg_topn_counts", lambda v: A.value_counts(v.complaints, "state", 10, F.col("disputed") == "Yes"), sql("complaints", "SELECT state AS value, count(*) AS count FROM complaints WHERE state IS NOT NULL AND disputed = 'Yes' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
add("agg_yearly_counts", lambda v: v.complaints.groupBy(F.year("received").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("disputed") == "Yes").alias("disputes")), sql("complaints", "SELECT CAST(year(received) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (WHERE disputed = 'Yes') AS disputes FROM complaints GROUP BY 1"))
add("agg_distinct_count", lambda v: A.distinct_count(v.ratings, "userId"), sql("ratings", "SELECT count(DISTINCT userId) AS n FROM ratings"))
add("agg_distinct_array_values", lambda v: A.array_values(v.movies, "genres_list"), sql("movies", "SELECT DISTINCT unnest(genres_list) AS value FROM movies"))
add("agg_mean_by_array_value", lambda v: rounded(A.mean_by_array_value(v.movies.join(v.ratings, "movieId", "left"), "genres_list", "rating")), sql("movies ratings", f"SELECT value, {r('avg(rating)', 6)} AS mean FROM (SELECT movieId, unnest(list_distinct(genres_list)) AS value FROM movies) LEFT JOIN ratings USING (movieId) GROUP BY 1"))
_TOP = "FROM ratings JOIN movies USING (movieId) GROUP BY 1 ORDER BY measure DESC, 1 LIMIT 20"
_rated = lambda v: v.ratings.join(v.movies, "movieId")
add("agg_sum_topn", lambda v: A.top_by(_rated(v), "title", F.round(F.sum("rating"), 6), 20), sql("movies ratings", f"SELECT title, {r('sum(rating)', 6)} AS measure {_TOP}"))
add("agg_count_topn", lambda v: A.top_by(_rated(v), "title", F.count("*"), 20), sql("movies ratings", f"SELECT title, count(*) AS measure {_TOP}"))
add("agg_null_profile", lambda v: rounded(A.null_profile(v.complaints.select("order_id", "state", "issue"))), sql("complaints", f"SELECT unnest(['order_id', 'state', 'issue']) AS \"column\", unnest([a, b, c]) AS nulls, unnest([{r('a / n', 6)}, {r('b / n', 6)}, {r('c / n', 6)}]) AS fraction FROM (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) - count(order_id) AS a, count(*) - count(state) AS b, count(*) - count(issue) AS c FROM complaints)"))
_STATS = lambda c: f"'{c}' AS \"column\", CAST(count({c}) AS DOUBLE) AS count, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, CAST(min({c}) AS DOUBLE) AS min, " + ", ".join(f"{r(f'quantile_cont({c}, {p})', 4)} AS p{round(100 * p)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + f", CAST(max({c}) AS DOUBLE) AS max"
add("agg_describe", lambda v: rounded(A.describe_exact(v.trips, ["fare", "distance"], [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]), 4), sql("trips", f"SELECT {_STATS('fare')} FROM trips UNION ALL SELECT {_STATS('distance')} FROM trips"))
add("agg_skew", lambda v: rounded(A.skew_g1(v.trips, ["fare", "k"]), 4), sql("trips", f"SELECT 'fare' AS \"column\", {r('skewness(fare)', 4)} AS skew FROM trips UNION ALL SELECT 'k', {r('skewness(k)', 4)} FROM trips"))
_CC = ["open", "close", "volume"]
add("agg_corr_matrix", lambda v: rounded(A.corr_long(v.stock, _CC), 5), sql("stock", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 5)} AS r FROM stock" for a in _CC for b in _CC)))
add("agg_histogram", lambda v: rounded(A.histogram(v.trips, "fare", 50), 4), sql("trips", f"""SELECT CAST(b AS INTEGER) AS bin, {r('lo + b * w', 4)} AS lo, count(fare) AS count FROM (SELECT min(fare) AS lo, (max(fare) - min(fare)) / 50 AS w FROM trips)
 CROSS JOIN range(50) AS g(b) LEFT JOIN trips ON least(floor((fare - lo) / w), 49) = b GROUP BY b, lo, w"""))
add("agg_min_max", lambda v: A.value_range(v.trips, "fare"), sql("trips", "SELECT min(fare) AS lo, max(fare) AS hi FROM trips"))
add("agg_class_weights", lambda v: rounded(A.class_weights(v.complaints, "disputed")), sql("complaints", f"SELECT disputed, {r('CAST(max(n) OVER () AS DOUBLE) / n', 6)} AS weight FROM (SELECT disputed, count(*) AS n FROM complaints GROUP BY 1)"))
add("agg_class_share", lambda v: A.class_share(v.complaints, F.col("disputed") == "Yes", F.col("timely") == "No"), sql("complaints", f"SELECT count(*) FILTER (WHERE timely = 'No') AS n, count(*) AS total, {r('100.0::DOUBLE * count(*) FILTER (WHERE timely = ' + chr(39) + 'No' + chr(39) + ') / count(*)', 3)} AS share FROM complaints WHERE disputed = 'Yes'"))
_ret = lambda v: J.with_returns(v.orders, v.returns, "order_id").withColumn("month", F.to_date(F.date_trunc("month", "order_date")))
_RET = "(SELECT *, CAST(date_trunc('month', order_date) AS DATE) AS month FROM sales LEFT JOIN (SELECT DISTINCT * FROM returns) USING (order_id))"
add("agg_sales_kpis", lambda v: rounded(A.kpis(_ret(v), ["region", "month"]), 3), sql("sales returns", f"SELECT region, month, {r('sum(sales)', 3)} AS sales, {r('sum(profit)', 3)} AS profit, {r('sum(profit) / sum(sales)', 3)} AS margin, {r('count(returned) / CAST(count(*) AS DOUBLE)', 3)} AS return_rate FROM {_RET} GROUP BY 1, 2"))
add("agg_monthly_by_category", lambda v: rounded(A.monthly(_ret(v).withColumn("refund", F.col("sales")), "order_date", ["category"], ["sales", "refund", "profit"], F.col("returned") == "Yes"), 3), sql("sales returns", f"SELECT month, category, {r('sum(sales)', 3)} AS sales, {r('sum(sales)', 3)} AS refund, {r('sum(profit)', 3)} AS profit FROM {_RET} WHERE returned = 'Yes' GROUP BY 1, 2"))
add("agg_regression_line", lambda v: rounded(A.fit_line(v.trips, ["payment_type"], "k", "fare"), 4), sql("trips", f"SELECT payment_type, {r('regr_slope(fare, k)', 4)} AS slope, {r('regr_intercept(fare, k)', 4)} AS intercept, min(k) AS lo, max(k) AS hi, {r('regr_slope(fare, k) * min(k) + regr_intercept(fare, k)', 4)} AS y_lo, {r('regr_slope(fare, k) * max(k) + regr_intercept(fare, k)', 4)} AS y_hi FROM trips GROUP BY 1"))

# --- windows and order
add("win_moving_avg", lambda v: rounded(W.moving_avg(v.stock, "ticker", "date", "close").select("ticker", "date", "moving_avg"), 4), sql("stock", f"SELECT ticker, date, CASE WHEN count(close) OVER w = 30 THEN {r('avg(close) OVER w', 4)} END AS moving_avg FROM stock WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING)"))
add("win_pct_change", lambda v: rounded(W.pct_change(v.stock, "ticker", "date", "close").select("ticker", "date", "pct_change")), sql("stock", f"SELECT ticker, date, {r('close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1', 6)} AS pct_change FROM stock"))
_PCT = "p AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS x FROM stock)"
add("win_mean_return", lambda v: rounded(W.mean_return(v.stock, "ticker", "date", "close")), sql("stock", "") + f", {_PCT} SELECT ticker, {r('avg(x)', 6)} AS mean_return FROM p GROUP BY 1")
#: The bins of daily returns.
EDGES, LABELS = [-0.09, -0.06, -0.03, 0.0, 0.03, 0.06, 0.09], ["-9% to -6%", "-6% to -3%", "-3% to 0%", "0% to 3%", "3% to 6%", "6% to 9%"]
add("win_binned_returns", lambda v: rounded(W.binned_returns(W.pct_change(v.stock, "ticker", "date", "close"), "ticker", "pct_change", EDGES, LABELS)), sql("stock", "") + f""", {_PCT}, b AS (SELECT * FROM (VALUES {", ".join(f"({lo}::DOUBLE, {hi}::DOUBLE, '{n}')" for lo, hi, n in zip(EDGES, EDGES[1:], LABELS))}) AS t(lo, hi, label)),
 c AS (SELECT t.ticker, b.label, count(p.x) AS count FROM (SELECT DISTINCT ticker FROM stock) t CROSS JOIN b LEFT JOIN p ON p.ticker = t.ticker AND x > lo AND x <= hi GROUP BY 1, 2)
 SELECT ticker, label, count, {r('100.0::DOUBLE * count / nullif(sum(count) OVER (PARTITION BY ticker), 0)', 6)} AS percent FROM c""")
_RANK = f"SELECT country, {r('sum(sales)', 2)} AS total, CAST(rank() OVER (ORDER BY sum(sales) DESC) AS INTEGER) AS rank FROM sales GROUP BY 1 QUALIFY rank <= 10"
add("win_rank_total", lambda v: rounded(W.rank_total(v.orders, "country", "sales"), 2), sql("sales", _RANK))
add("win_topn_by_measure", lambda v: rounded(W.topn_by(v.orders, "product_id", "sales", 10), 2), sql("sales", f"SELECT product_id, {r('sum(sales)', 2)} AS total FROM sales GROUP BY 1 ORDER BY sum(sales) DESC, 1 LIMIT 10"))
add("win_row_number", lambda v: W.number_rows(A.value_counts(v.movies.select(F.explode("genres_list").alias("g")), "g", 10), F.desc("count"), "value"), sql("movies", "SELECT value, count, CAST(row_number() OVER (ORDER BY count DESC, value) AS INTEGER) AS serial FROM (SELECT unnest(genres_list) AS value, count(*) AS count FROM movies GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"))
add("win_cumulative_share", lambda v: rounded(W.cumulative_share(v.orders.groupBy("category").agg(F.sum("quantity").alias("q")), "q")), sql("sales", f"SELECT category, q, {r('sum(q) OVER (ORDER BY q DESC ROWS UNBOUNDED PRECEDING)', 6)} AS cumulative, {r('sum(q) OVER (ORDER BY q DESC ROWS UNBOUNDED PRECEDING) / sum(q) OVER ()', 6)} AS share FROM (SELECT category, sum(quantity) AS q FROM sales GROUP BY 1)"))
add("win_lag_features", lambda v: rounded(W.lag_vector(v.stock, "ticker", "date", "close").select("ticker", "date", F.get("lags", F.lit(0)).alias("oldest"), F.get("lags", F.lit(59)).alias("newest"), F.aggregate("lags", F.lit(0.0), lambda a, x: a + x).alias("total")), 2), sql("stock", f"SELECT ticker, date, lag(close, 60) OVER w AS oldest, lag(close) OVER w AS newest, {r('sum(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)', 2)} AS total FROM stock WINDOW w AS (PARTITION BY ticker ORDER BY date) QUALIFY lag(close, 60) OVER w IS NOT NULL"))
add("win_ordered_split", lambda v: W.ordered_split(v.stock, "ticker", "date", 987).select("ticker", "date", "part"), sql("stock", "SELECT ticker, date, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY date) <= 987 THEN 'train' ELSE 'valid' END AS part FROM stock"))
_YOY = "m AS (SELECT country, CAST(year(order_date) AS INTEGER) AS y, CAST(month(order_date) AS INTEGER) AS m, sum(sales) AS s FROM sales GROUP BY 1, 2, 3)"
add("win_yoy", lambda v: rounded(W.yoy(v.orders.groupBy("country", F.year("order_date").alias("y"), F.month("order_date").alias("m")).agg(F.sum("sales").alias("s")), "country", "y", "m", "s"), 2), sql("sales", "") + f", {_YOY} SELECT a.country, a.y, a.m, {r('a.s', 2)} AS s, {r('100 * (a.s / b.s - 1)', 2)} AS yoy FROM m a LEFT JOIN m b ON a.country = b.country AND a.m = b.m AND b.y = a.y - 1")
add("win_ewma", lambda v: rounded(W.ewma(v.frames, "key", "ts", "x", 0.2).select("event_id", "ewma"), 5), "WITH RECURSIVE " + sql("frames", "")[5:] + f""", n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS i FROM frames),
 e AS (SELECT event_id, key, i, x AS s FROM n WHERE i = 1 UNION ALL SELECT n.event_id, n.key, n.i, 0.8::DOUBLE * e.s + 0.2::DOUBLE * n.x FROM e JOIN n ON n.key = e.key AND n.i = e.i + 1)
 SELECT event_id, {r('s', 5)} AS ewma FROM e""")
add("win_background_diff", lambda v: W.background_diff(v.frames, "key", "ts", "x").select("event_id", "key", "moved"), "WITH RECURSIVE " + sql("frames", "")[5:] + """, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS i FROM frames),
 e AS (SELECT key, i, x AS s FROM n WHERE i = 1 UNION ALL SELECT n.key, n.i, 0.5::DOUBLE * e.s + 0.5::DOUBLE * n.x FROM e JOIN n ON n.key = e.key AND n.i = e.i + 1 WHERE n.i <= 60)
 SELECT event_id, n.key, abs(x - s) > 25 AS moved FROM n JOIN (SELECT key, arg_max(s, i) AS s FROM e GROUP BY 1) b ON n.key = b.key WHERE n.i > 60""")
add("win_iterative_outliers", lambda v: rounded(W.drop_far_from_mean(v.trips.select("trip_id", "pickup_zone", (F.col("k") / 100).alias("x")), "pickup_zone", "x").groupBy("pickup_zone").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))))
add("ord_sort", lambda v: v.stock.select("ticker", "date", "close").orderBy("ticker", "date"), sql("stock", "SELECT ticker, date, close FROM stock"))
add("ord_top_k", lambda v: v.table("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")

# --- set operations and reshaping
_fares = lambda v: v.trips.select("trip_id", "fare")
add("set_union_by_name", lambda v: R.union_all([_fares(v), v.trips.select("fare", "trip_id")]), sql("trips", "SELECT trip_id, fare FROM trips UNION ALL SELECT trip_id, fare FROM trips"))
add("set_union_missing", lambda v: R.union_all([_fares(v), v.trips.select("trip_id", F.lit("x").alias("extra"))], missing=True), sql("trips", "SELECT trip_id, fare, NULL AS extra FROM trips UNION ALL SELECT trip_id, NULL, 'x' FROM trips"))
add("set_append_columns", lambda v: R.append_columns(v.trips.select("trip_id", "fare"), v.trips.where("k > 50").select("trip_id", "k"), "trip_id"), sql("trips", "SELECT trip_id, fare, CASE WHEN k > 50 THEN k END AS k FROM trips"))
add("reshape_pivot", lambda v: rounded(R.pivot_dense(v.trips.groupBy("pickup_zone", "passengers").agg(F.sum("fare").alias("f")), "pickup_zone", "passengers", "f", [0, 1, 2, 3, 4, 5, 6]), 3), sql("trips", "SELECT pickup_zone, " + ", ".join(f"coalesce({r(f'sum(fare) FILTER (WHERE passengers = {i})', 3)}, 0) AS \"{i}\"" for i in range(7)) + " FROM trips GROUP BY 1"))
_TICK = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
add("reshape_ticker_wide", lambda v: R.ticker_wide(v.stock, "date", "ticker", "close", _TICK), sql("stock", "SELECT date, " + ", ".join(f"max(close) FILTER (WHERE ticker = '{t}') AS \"{t}\"" for t in _TICK) + " FROM stock GROUP BY 1"))
add("reshape_explode", lambda v: R.explode_list(v.movies.select("movieId", "genres_list"), "genres_list", "genre"), sql("movies", "SELECT movieId, unnest(genres_list) AS genre FROM movies"))
