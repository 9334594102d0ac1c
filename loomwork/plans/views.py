"""Views that shape the given tables like the data the operators are meant for, as frames and as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    """Frames over one folder of tables; nothing is read before use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def trips(self) -> DataFrame:
        e = self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("pickup", F.col("ts").cast("timestamp"))
        return e.select(
            F.col("event_id").alias("trip_id"), "pickup", (F.col("pickup") + F.make_dt_interval(mins=(F.col("k") + 1).cast("int"))).alias("dropoff"), F.col("user_id").alias("pickup_zone"), ((F.col("user_id") + F.col("k")) % 50).alias("dropoff_zone"),
            F.col("event_type").alias("payment_type"), F.col("value").alias("fare"), (F.col("value") * 0.1).alias("tip"), (F.col("value") * 1.1).alias("total"), (F.col("k") % 7).alias("passengers"), (F.col("k") / 10.0).alias("distance"), "k",
        )

    @cached_property
    def stock(self) -> DataFrame:
        o = self.table("orders").withColumn("date", F.to_date("o_orderdate"))
        return o.groupBy(F.col("o_orderpriority").alias("ticker"), "date").agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.count("*").alias("volume"))

    @cached_property
    def orders(self) -> DataFrame:
        """Order lines with their dimensions."""
        line, order = self.table("lineitem"), self.table("orders")
        customer, nation, region = self.table("customer"), self.table("nation"), self.table("region")
        part = self.table("part").select("p_partkey", "p_type", "p_brand")
        j = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
        return j.select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.to_date("o_orderdate").alias("order_date"), F.to_date("l_shipdate").alias("ship_date"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sales"), (F.col("l_extendedprice") * (0.2 - F.col("l_discount"))).alias("profit"),
            F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("l_suppkey").alias("company"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"), F.col("o_orderpriority").alias("channel"), F.col("l_quantity").alias("quantity"),
        )

    @cached_property
    def returns(self) -> DataFrame:
        return self.table("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_id"), F.lit("Yes").alias("returned"))

    @cached_property
    def movies(self) -> DataFrame:
        p = self.table("part")
        return p.select(F.col("p_partkey").alias("movieId"), F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string"), F.lit(" (1990)")).alias("title"), F.replace("p_name", F.lit(" "), F.lit("|")).alias("genres"), F.split("p_name", " ").alias("genres_list"))

    @cached_property
    def ratings(self) -> DataFrame:
        j = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return j.groupBy(F.col("o_custkey").alias("userId"), F.col("l_partkey").alias("movieId")).agg((F.avg("l_quantity") / 10).alias("rating"))

    @cached_property
    def complaints(self) -> DataFrame:
        o = self.orders
        return o.select(
            "order_id", F.col("order_date").alias("received"), F.col("ship_date").alias("sent"), F.col("category").alias("product"), F.col("brand").alias("issue"), F.col("company"), F.when(F.col("country") != "NATION_0", F.col("country")).alias("state"), "channel",
            F.when(F.col("flag") == "R", "Yes").otherwise("No").alias("disputed"), F.when(F.col("discount") > 0.08, "No").otherwise("Yes").alias("timely"),
        )

    @cached_property
    def cars(self) -> DataFrame:
        p = self.table("part")
        return p.select(F.col("p_partkey").alias("Id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), (F.lit(2000) + F.col("p_size")).alias("year"))

    @cached_property
    def news(self) -> DataFrame:
        return self.table("documents").join(self.table("labels"), "doc_id").select(F.col("doc_id").alias("id"), "text", F.col("quality").alias("label"))

    @cached_property
    def points(self) -> DataFrame:
        return self.table("embeddings")

    @cached_property
    def palette(self) -> DataFrame:
        """Mean vector of each label."""
        x = self.points.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        return x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding")).withColumn("name", F.concat(F.lit("c"), F.col("label").cast("string")))

    @cached_property
    def frames(self) -> DataFrame:
        return self.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), F.col("value").alias("x"))


#: The same views as SQL; each may use those before it.
SQL = {
    "trips": """SELECT event_id AS trip_id, ts AS pickup, ts + to_minutes(CAST(k + 1 AS INTEGER)) AS dropoff, user_id AS pickup_zone, (user_id + k) % 50 AS dropoff_zone,
        event_type AS payment_type, value AS fare, value * 0.1::DOUBLE AS tip, value * 1.1::DOUBLE AS total, k % 7 AS passengers, k / 10.0::DOUBLE AS distance, k
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "stock": """SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, arg_max(o_totalprice, o_orderkey) AS close,
        max(o_totalprice) AS high, min(o_totalprice) AS low, count(*) AS volume FROM orders GROUP BY 1, 2""",
    "sales": """SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS ship_date, l_extendedprice * (1 - l_discount) AS sales,
        l_extendedprice * (0.2::DOUBLE - l_discount) AS profit, n_name AS country, r_name AS region, p_type AS category, p_brand AS brand, l_suppkey AS company, l_discount AS discount, l_returnflag AS flag, o_orderpriority AS channel, l_quantity AS quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey""",
    "returns": "SELECT l_orderkey AS order_id, 'Yes' AS returned FROM lineitem WHERE l_returnflag = 'R'",
    "movies": "SELECT p_partkey AS movieId, p_name || ' #' || p_partkey || ' (1990)' AS title, replace(p_name, ' ', '|') AS genres, string_split(p_name, ' ') AS genres_list FROM part",
    "ratings": "SELECT o_custkey AS userId, l_partkey AS movieId, avg(l_quantity) / 10 AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "complaints": """SELECT order_id, order_date AS received, ship_date AS sent, category AS product, brand AS issue, company, nullif(country, 'NATION_0') AS state, channel,
        CASE WHEN flag = 'R' THEN 'Yes' ELSE 'No' END AS disputed, CASE WHEN discount > 0.08 THEN 'No' ELSE 'Yes' END AS timely FROM sales""",
    "cars": "SELECT p_partkey AS Id, p_brand AS brand, p_type AS model, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size, 2000 + p_size AS year FROM part",
    "news": "SELECT doc_id AS id, text, quality AS label FROM documents JOIN labels USING (doc_id)",
    "frames": "SELECT event_id, ts, event_type AS key, value AS x FROM events",
}
NEEDS = {"complaints": ["sales"]}


def sql(views: str, body: str) -> str:
    """``body`` with the named views (space separated) as common table expressions."""
    names: list[str] = []
    for v in views.split():
        names += [n for n in (*NEEDS.get(v, []), v) if n not in names]
    return ("WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" if names else "") + body


def r(x: str, n: int = 2) -> str:
    """SQL for ``round_half_up``: cleaned of summation noise at three more places, then half away from zero on the decimal value."""
    return f"CAST(round(CAST({x} AS DECIMAL(38, {n + 3})), {n}) AS DOUBLE)"
