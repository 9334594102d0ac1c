"""Sources and sinks, cleaning, scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import scalars as S
from loomwork.operators import cleaning as C
from loomwork.plans.views import Views, r, sql
from loomwork.queries.registry import add, rounded
from loomwork.sources import tables as T
from loomwork.sources.scratch import scratch


# --- sources and sinks
def _months(v: Views) -> DataFrame:
    base = scratch(v.spark, "months")
    for m in (1, 2):
        v.trips.where(F.month("pickup") == m).write.parquet(f"{base}/trips_2024-{m:02d}.parquet")
    return T.read_months(v.spark, base, "trips", 2024, [1, 2, 3]).select("trip_id", "fare")


add("src_parquet_monthly", _months, sql("trips", "SELECT trip_id, fare FROM trips WHERE month(pickup) IN (1, 2)"))


def _csv(v: Views) -> DataFrame:
    path = scratch(v.spark, "cars-csv")
    T.write_csv(v.cars, path)
    return T.read_csv(v.spark, path, "Id long, brand string, model string, price double, size double, year int")


add("src_csv_typed", _csv, sql("cars", "SELECT Id, brand, model, price, size, CAST(year AS INTEGER) AS year FROM cars"))


def _headerless(v: Views) -> DataFrame:
    path = scratch(v.spark, "colours")
    v.cars.select("Id", "brand", (F.col("Id") % 256).alias("r")).write.csv(path)
    return T.read_headerless(v.spark, path, ["Id", "name", "R"]).select(F.col("Id").cast("long"), "name", F.col("R").cast("long"))


add("src_csv_headerless", _headerless, sql("cars", "SELECT Id, brand AS name, Id % 256 AS R FROM cars"))


def _features(v: Views) -> DataFrame:
    props = F.struct(F.get_json_object("props", "$.k").alias("location_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("zone"))
    return T.features(v.table("events").select(F.array(F.struct(props.alias("properties"))).alias("features")))


add("src_json_features", _features, "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS zone_id, coalesce(nullif(event_type, 'error'), '') AS zone FROM events")


def _manifest(v: Views) -> DataFrame:
    """An empty file for each of eight labelled names, derived from the parts' classes; only paths are read back."""
    base = scratch(v.spark, "images")
    names = v.table("part").select(F.concat(F.lit("8863_idx5_x"), (F.col("p_size") * 50 + 1).cast("string"), F.lit("_y1451_class"), (F.col("p_partkey") % 2).cast("string")).alias("name")).distinct()
    names.select(F.lit("").alias("value"), "name").repartition("name").write.partitionBy("name").text(base)
    files = v.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(base).select("path")
    return T.manifest_of(files.select(F.regexp_replace("path", r"^.*name=([^/]+)/.*$", "$1.png").alias("path")))


add("src_file_manifest", _manifest, "SELECT DISTINCT '8863_idx5_x' || (p_size * 50 + 1) || '_y1451_class' || (p_partkey % 2) || '.png' AS path, CAST(p_partkey % 2 AS VARCHAR) AS label, '8863' AS patient_id, p_size * 50 + 1 AS x, 1451 AS y FROM part")
add("src_calendar", lambda v: v.table("orders").select(F.to_date("o_orderdate").alias("d")).agg(F.min("d").alias("a"), F.max("d").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date")).select("date", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month"), F.dayofmonth("date").alias("day")),
    "SELECT CAST(d AS DATE) AS date, year(d) AS year, quarter(d) AS quarter, month(d) AS month, day(d) AS day FROM (SELECT unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY)) AS d FROM orders)")
add("src_sql_view", lambda v: rounded(T.sql_view(v.spark, {"trips": v.trips}, "SELECT payment_type, count(*) AS n, sum(fare) AS fare FROM {trips} GROUP BY payment_type"), 3),
    sql("trips", f"SELECT payment_type, count(*) AS n, {r('sum(fare)', 3)} AS fare FROM trips GROUP BY 1"))


def _table(v: Views) -> DataFrame:
    name = "trips_by_type_" + scratch(v.spark, "t")[-12:]
    by = v.trips.groupBy("payment_type").agg(F.count("*").alias("n"))
    T.create_or_replace(by.where("n < 0"), name)
    T.create_or_replace(by, name)
    return v.spark.table(name)


add("sink_table_replace", _table, sql("trips", "SELECT payment_type, count(*) AS n FROM trips GROUP BY 1"))


def _layer(v: Views) -> DataFrame:
    path = scratch(v.spark, "layer")
    T.write_layer(v.trips.select("trip_id", "fare", F.to_date("pickup").alias("pickup_day")), path, "pickup_day")
    return T.read_layer(v.spark, path)


_LAYER = sql("trips", "SELECT trip_id, fare, CAST(pickup AS DATE) AS pickup_day FROM trips")
add("sink_partitioned_overwrite", _layer, _LAYER)
add("read_back_layer", lambda v: _layer(v).where(F.col("pickup_day") < dt.date(2024, 1, 8)), _LAYER + " WHERE pickup < DATE '2024-01-08'")


def _sink_csv(v: Views) -> DataFrame:
    path = scratch(v.spark, "csv")
    T.write_csv(v.trips.select("trip_id", "payment_type"), path)
    return T.read_csv(v.spark, path, "trip_id long, payment_type string")


add("sink_csv", _sink_csv, sql("trips", "SELECT trip_id, payment_type FROM trips"))

# --- projection, filter, cleaning
add("clean_column_names", lambda v: C.clean_names(v.trips.select(F.col("trip_id").alias(" Trip ID "), F.col("fare").alias("Fare Amount"))), sql("trips", "SELECT trip_id, fare AS fare_amount FROM trips"))
add("validate_schema", lambda v: C.schema_report(v.trips.select("trip_id", "pickup", "k"), ["trip_id", "pickup", "fare", "tip"]), "SELECT * FROM (VALUES ('fare', 'missing'), ('tip', 'missing'), ('k', 'extra')) AS t(\"column\", status)")
add("cast_columns", lambda v: C.cast_if_present(v.trips.select("trip_id", F.col("k").cast("string").alias("k"), F.col("payment_type").alias("bad")), {"k": "bigint", "bad": "double", "absent": "int"}), sql("trips", "SELECT trip_id, k, CAST(NULL AS DOUBLE) AS bad FROM trips"))
add("drop_empty_columns", lambda v: C.drop_empty(v.trips.select("trip_id", F.lit(None).cast("string").alias("a"), F.lit("").alias("b"), F.when(F.col("k") > 3, "").alias("c"), "fare")), sql("trips", "SELECT trip_id, CASE WHEN k > 3 THEN '' END AS c, fare FROM trips"))
add("drop_sparse_columns", lambda v: C.drop_sparse(v.trips.select("trip_id", F.when(F.col("k") < 50, F.col("fare")).alias("half"), F.when(F.col("k") < 90, F.col("fare")).alias("most"))), sql("trips", "SELECT trip_id, CASE WHEN k < 90 THEN fare END AS most FROM trips"))
add("filter_positive", lambda v: C.keep_positive(v.trips, ["fare", "distance", "passengers", "total", "absent"]).select("trip_id"), sql("trips", "SELECT trip_id FROM trips WHERE fare > 0 AND distance > 0 AND passengers > 0 AND total > 0"))
add("filter_time_half_open", lambda v: C.time_range(v.trips, "pickup", "2024-01-05 00:00:00", "2024-01-10 00:00:00").select("trip_id", "pickup"), sql("trips", "SELECT trip_id, pickup FROM trips WHERE pickup >= TIMESTAMP '2024-01-05' AND pickup < TIMESTAMP '2024-01-10'"))
add("filter_time_between", lambda v: C.time_range(v.trips, "pickup", "2024-01-05", "2024-01-10", "both").select("trip_id", "pickup"), sql("trips", "SELECT trip_id, pickup FROM trips WHERE pickup BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'"))
add("filter_day_equals", lambda v: v.trips.where(F.to_date("pickup") == dt.date(2024, 1, 7)).select("trip_id"), sql("trips", "SELECT trip_id FROM trips WHERE CAST(pickup AS DATE) = DATE '2024-01-07'"))
add("filter_upper_bound", lambda v: v.trips.where((F.col("distance") < 30) & (S.duration_min(F.col("pickup"), F.col("dropoff")) < 60)).select("trip_id"), sql("trips", "SELECT trip_id FROM trips WHERE distance < 30 AND k + 1 < 60"))
add("filter_equals", lambda v: v.stock.where(F.col("ticker") == "1-URGENT").select("date", "close"), sql("stock", "SELECT date, close FROM stock WHERE ticker = '1-URGENT'"))
add("filter_array_contains", lambda v: v.movies.where(F.array_contains("genres_list", "ring")).select("movieId", "title"), sql("movies", "SELECT movieId, title FROM movies WHERE list_contains(genres_list, 'ring')"))
add("add_ingest_time", lambda v: C.add_ingest_time(v.trips, "pickup").select("trip_id", "pickup_day", F.col("_ingest_time").isNotNull().alias("has_time")), sql("trips", "SELECT trip_id, CAST(pickup AS DATE) AS pickup_day, TRUE AS has_time FROM trips"))
add("map_codes", lambda v: C.map_codes(v.trips, "passengers", {0: "none", 1: "one", 2: "two"}, "label").select("trip_id", "label"), sql("trips", "SELECT trip_id, CASE passengers WHEN 0 THEN 'none' WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS label FROM trips"))
add("clamp_negative", lambda v: v.complaints.select("order_id", "received", "sent", C.clamp_negative(S.days_between(F.col("received"), F.col("sent"))).alias("held")), sql("complaints", "SELECT order_id, received, sent, CAST(greatest(date_diff('day', received, sent), 0) AS INTEGER) AS held FROM complaints"))
add("flag_yes_no", lambda v: v.complaints.select("order_id", C.flag_yes_no(F.col("disputed")).alias("flag"), C.flag_yes_no(F.col("state")).alias("other")), sql("complaints", "SELECT order_id, CASE disputed WHEN 'Yes' THEN '1' ELSE '0' END AS flag, state AS other FROM complaints"))
add("conditional_measure", lambda v: rounded(v.orders.select("order_id", C.conditional_measure(F.col("flag") == "R", F.col("sales")).alias("refund")), 4), sql("sales", f"SELECT order_id, {r('CASE WHEN flag = ' + chr(39) + 'R' + chr(39) + ' THEN sales ELSE 0 END', 4)} AS refund FROM sales"))
add("select_drop", lambda v: v.cars.drop("Id", "model", "size"), sql("cars", "SELECT brand, price, year FROM cars"))
add("rename_output", lambda v: v.cars.select("Id", "price").withColumnsRenamed({"Id": "car", "price": "Price_USD"}), sql("cars", "SELECT Id AS car, price AS Price_USD FROM cars"))
add("impute_mode", lambda v: C.impute_mode(v.complaints.select("order_id", "company", "state"), ["state"]), sql("complaints", "SELECT order_id, company, coalesce(state, (SELECT state FROM complaints WHERE state IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS state FROM complaints"))
add("sample_rows", lambda v: C.fraction_sample(v.trips, 0.05, 42, "trip_id").select("trip_id", "fare"))
add("drop_incomplete", lambda v: C.drop_incomplete(v.complaints.select("order_id", "state", "issue")), sql("complaints", "SELECT order_id, state, issue FROM complaints WHERE state IS NOT NULL"))
add("count_duplicates", lambda v: C.count_duplicates(v.table("lineitem").select("l_orderkey", "l_linenumber")), "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
add("preview_rows", lambda v: C.preview(v.trips.select("trip_id", "payment_type"), ["trip_id"], 10), sql("trips", "SELECT trip_id, payment_type FROM trips ORDER BY trip_id LIMIT 10"))

# --- scalar functions
_T, _O = "SELECT trip_id, ", "SELECT o_orderkey, "


def _trip(name: str, **cols) -> None:
    expr = {k: c for k, (c, _) in cols.items()}
    add(name, lambda v: v.trips.select("trip_id", *[c().alias(k) for k, c in expr.items()]), sql("trips", _T + ", ".join(f"{s} AS {k}" for k, (_, s) in cols.items()) + " FROM trips"))


def _order(name: str, **cols) -> None:
    expr = {k: c for k, (c, _) in cols.items()}
    add(name, lambda v: v.table("orders").withColumn("d", F.to_date("o_orderdate")).select("o_orderkey", *[c().alias(k) for k, c in expr.items()]), _O + ", ".join(f"{s} AS {k}" for k, (_, s) in cols.items()) + " FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)")


_c = F.col  # called within lambdas: columns need a session
_trip("fn_trunc_hour", hour=(lambda: S.trunc_to(_c("pickup"), "hour"), "date_trunc('hour', pickup)"))
_trip("fn_trunc_day", day=(lambda: S.trunc_to(_c("pickup"), "day"), "CAST(pickup AS DATE)"))
_order("fn_trunc_week_monday", week=(lambda: S.trunc_to(_c("d"), "week"), "CAST(date_trunc('week', d) AS DATE)"))
_order("fn_trunc_week_sunday", week=(lambda: S.trunc_to(_c("d"), "week", "sunday"), "CAST(d - CAST(dayofweek(d) AS INTEGER) AS DATE)"))
_order("fn_trunc_month", month=(lambda: S.trunc_to(_c("d"), "month"), "CAST(date_trunc('month', d) AS DATE)"))
_order("fn_date_parts", **{k: (lambda k=k: S.date_parts(F.col("d"))[k], f"{k}(d)") for k in ("day", "month", "year")})
_trip("fn_hour_of_day", hour=(lambda: S.hour_of_day(_c("pickup")), "hour(pickup)"))
add("fn_days_between", lambda v: v.complaints.select("order_id", "received", "sent", S.days_between(F.col("received"), F.col("sent")).alias("days")), sql("complaints", "SELECT order_id, received, sent, CAST(date_diff('day', received, sent) AS INTEGER) AS days FROM complaints"))
_trip("fn_duration_min", minutes=(lambda: F.round(S.duration_min(_c("pickup"), _c("dropoff")), 6), r("(epoch_us(dropoff) - epoch_us(pickup)) / 6e7", 6)))
_order("fn_week_of_month_bucket", bucket=(lambda: S.week_bucket(_c("d")), "CASE WHEN day(d) < 8 THEN 1 WHEN day(d) < 16 THEN 2 WHEN day(d) < 22 THEN 3 ELSE 4 END"))
_order("fn_parse_date", iso=(lambda: S.parse_date(F.date_format("d", "yyyy-MM-dd")), "d"), us=(lambda: S.parse_date(F.date_format("d", "M/d/yyyy"), "M/d/yyyy"), "d"), bad=(lambda: S.parse_date(_c("o_orderstatus")), "CAST(NULL AS DATE)"))
add("fn_split", lambda v: v.movies.select("movieId", F.posexplode(S.split_list(F.col("genres"), "|")).alias("i", "g")), sql("movies", "SELECT movieId, CAST(generate_subscripts(string_split(genres, '|'), 1) - 1 AS INTEGER) AS i, unnest(string_split(genres, '|')) AS g FROM movies"))
add("fn_join_tokens", lambda v: v.movies.select("movieId", S.join_tokens(F.col("genres_list")).alias("t")), sql("movies", "SELECT movieId, array_to_string(genres_list, ' ') AS t FROM movies"))
add("fn_trim_suffix", lambda v: v.movies.select("movieId", S.trim_suffix(F.col("title")).alias("t"), S.trim_suffix(F.lit("short")).alias("s")), sql("movies", "SELECT movieId, left(title, length(title) - 7) AS t, '' AS s FROM movies"))
add("fn_tokenize_alpha", lambda v: v.table("benchmark").select("item_id", F.array_join(S.tokenize_alpha(F.col("text")), " ").alias("t")), r"SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '\w+|[^\w\s]+'), lambda w: regexp_full_match(w, '\p{L}+')), ' ') AS t FROM benchmark")
add("fn_remove_stopwords", lambda v: v.table("benchmark").select("item_id", S.join_tokens(S.remove_stopwords(F.split("text", " "), ["the", "of", "and", "de", "la"])).alias("t")), "SELECT item_id, array_to_string(list_filter(string_split(text, ' '), lambda w: w NOT IN ('the', 'of', 'and', 'de', 'la')), ' ') AS t FROM benchmark")
_trip("fn_round2", up=(lambda: S.round_half_up(_c("k") / 8.0, 2), "CAST(round(CAST(k / 8.0 AS DECIMAL(38, 12)), 2) AS DOUBLE)"), even=(lambda: S.round_half_even(_c("k") / 4.0, 1), "CAST(round_even(CAST(k / 4.0 AS DOUBLE), 1) AS DOUBLE)"))
_trip("fn_l1_distance", d=(lambda: S.l1_distance([_c("k"), _c("passengers"), _c("pickup_zone")], [F.lit(50), F.lit(3), F.lit(25)]), "abs(k - 50) + abs(passengers - 3) + abs(pickup_zone - 25)"))
_trip("fn_light_flag", light=(lambda: S.is_light(_c("k") * 2, _c("k") * 3, _c("passengers") * 20), "k * 2 + k * 3 + passengers * 20 >= 600"))
_trip("fn_gray", gray=(lambda: F.round(S.gray(_c("k"), _c("passengers"), _c("pickup_zone")), 6), r("0.2989::DOUBLE * k + 0.5870::DOUBLE * passengers + 0.1140::DOUBLE * pickup_zone", 6)))
_trip("fn_scale_const", x=(lambda: F.round(S.scale_const(_c("k"), 255.0), 9), r("k / 255.0::DOUBLE", 9)))
add("fn_argmax", lambda v: v.points.select("vec_id", S.argmax(F.col("embedding")).alias("at")), "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS at FROM embeddings")
_trip("fn_slope_side", side=(lambda: S.slope_side(_c("passengers"), _c("k") - 50), "CASE WHEN passengers = 0 THEN NULL WHEN (k - 50) / passengers::DOUBLE > 0.4 THEN 'right' WHEN (k - 50) / passengers::DOUBLE < -0.4 THEN 'left' END"))
_trip("fn_percent", p=(lambda: S.percent(_c("k"), _c("passengers")), r("100.0::DOUBLE * k / nullif(passengers, 0)", 3)))
add("fn_age", lambda v: v.cars.select("Id", S.age(F.col("year"), 2060).alias("age")), sql("cars", "SELECT Id, 2060 - year AS age FROM cars"))
