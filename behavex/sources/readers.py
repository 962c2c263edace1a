"""Tables of the behaviour model, read from Parquet, a catalog or JDBC, and the adapter from the
TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTION_SCHEMA = "date string, user_id bigint, session_id string, page_id bigint, action_time string, search_keyword string, click_category_id bigint, click_product_id bigint, order_category_ids string, order_product_ids string, pay_category_ids string, pay_product_ids string, city_id bigint"
USER_SCHEMA = "user_id bigint, username string, name string, age int, professional string, city string, sex string"
PRODUCT_SCHEMA = "product_id bigint, product_name string, extend_info string"


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, name: str) -> DataFrame:
    """A metastore table; needs a session with Hive support where the tables are Hive's."""
    return spark.table(name)


def jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A JDBC table; partition = (column, lowest, highest, number of readers) reads it in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, low, high, n = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n)
    return reader.load()


def task_param(spark: SparkSession, url: str, task_id: int, **options: str) -> str:
    """A task's JSON by its key; the filter runs in the database."""
    row = jdbc(spark, url, "task", **options).where(F.col("task_id") == int(task_id)).select("task_param").first()
    if row is None or row[0] is None:
        raise LookupError(f"no task {task_id}")
    return row[0]


def frame(spark: SparkSession, rows: list, schema: str, view: str | None = None) -> DataFrame:
    out = spark.createDataFrame(rows, schema)
    if view:
        out.createOrReplaceTempView(view)
    return out


def mock_actions(spark: SparkSession, sessions: int = 1000, users: int = 100, most: int = 40, seed: int = 1) -> DataFrame:
    """Synthetic actions in ACTION_SCHEMA, the same for the same seed; made where they are read. All clicks of a session are in one category."""
    base = spark.range(sessions).select(F.col("id").alias("s"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(most)).alias("n"))
    rows = base.select("s", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i"))

    def pick(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("s", "i", F.lit(seed * 31 + salt)), F.lit(n))

    kind, user = pick(4, 0), F.pmod(F.xxhash64("s", F.lit(seed)), F.lit(users))
    text = lambda n, salt: pick(n, salt).cast("string")
    hour, minute, second = (F.lpad(text(n, s), 2, "0") for n, s in ((23, 5), (60, 6), (60, 7)))
    when = lambda k, c: F.when(kind == k, c)
    return rows.select(
        F.lit("2024-01-01").alias("date"), user.alias("user_id"), F.md5(F.concat_ws("-", F.lit(seed), "s")).alias("session_id"), pick(10, 1).alias("page_id"),
        F.concat(F.lit("2024-01-01 "), hour, F.lit(":"), minute, F.lit(":"), second).alias("action_time"), when(0, F.concat(F.lit("kw"), text(10, 2))).alias("search_keyword"),
        when(1, F.pmod(F.xxhash64("s", F.lit(seed * 31 + 3)), F.lit(100))).alias("click_category_id"), when(1, pick(100, 4)).alias("click_product_id"), when(2, text(100, 8)).alias("order_category_ids"), when(2, text(100, 9)).alias("order_product_ids"),
        when(3, text(100, 10)).alias("pay_category_ids"), when(3, text(100, 11)).alias("pay_product_ids"), pick(10, 12).alias("city_id"),
    )


def mock_users(spark: SparkSession, users: int = 100) -> DataFrame:
    n = F.col("id").cast("string")
    return spark.range(users).select(F.col("id").alias("user_id"), F.concat(F.lit("user"), n).alias("username"), F.concat(F.lit("name"), n).alias("name"), F.pmod("id", F.lit(60)).cast("int").alias("age"), F.concat(F.lit("professional"), n).alias("professional"), F.concat(F.lit("city"), F.pmod("id", F.lit(10)).cast("string")).alias("city"), F.when(F.col("id") % 2 == 0, "male").otherwise("female").alias("sex"))


def mock_products(spark: SparkSession, products: int = 100) -> DataFrame:
    """Products of which some are a shop's own (product_status 0) and some others' (1), by hash."""
    n, status = F.col("id").cast("string"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("string")
    return spark.range(products).select(F.col("id").alias("product_id"), F.concat(F.lit("product"), n).alias("product_name"), F.concat(F.lit('{"product_status": '), status, F.lit("}")).alias("extend_info"))


#: Cities of each province in the synthetic ad log.
AD_CITIES = {"province0": ["city00", "city01"], "province1": ["city10", "city11"], "province2": ["city20", "city21"], "province3": ["city30", "city31"], "province4": ["city40", "city41"]}


def ad_log_lines(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    """A stream of synthetic ad log lines `epoch_ms province city user ad`, for trials without a broker."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    pick = lambda n, salt: F.pmod(F.xxhash64("value", F.lit(salt)), F.lit(n)).cast("string")
    places = F.array(*(F.concat_ws(" ", F.lit(p), F.lit(c)) for p, cs in AD_CITIES.items() for c in cs))
    place = F.get(places, F.pmod(F.xxhash64("value", F.lit(1)), F.size(places)).cast("int"))
    return rate.select(F.concat_ws(" ", F.unix_millis("timestamp").cast("string"), place, pick(1000, 3), pick(10, 4)).alias("value"))


def kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The log lines of a Kafka topic; needs Spark's Kafka package."""
    source = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic}).load()
    return source.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrived"))


# --- the behaviour model over the test tables -------------------------------------------------


def user_visit_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = parquet(spark, sf_dir, "events").withColumn("k", k)
    kind = lambda name, c: F.when(F.col("event_type") == name, c)
    k, text = F.col("k"), F.col("k").cast("string")
    pair = F.when(k % 2 == 1, text).otherwise(F.concat(text, F.lit(","), ((k + 1) % 100).cast("string")))
    product = F.col("event_id") % 200
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"), "user_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"), (k % 10).alias("page_id"), F.col("ts").alias("action_time"),
        kind("view", F.concat(F.lit("kw"), (k % 10).cast("string"))).alias("search_keyword"), kind("click", k).alias("click_category_id"), kind("click", product).alias("click_product_id"),
        kind("signup", pair).alias("order_category_ids"), kind("signup", product.cast("string")).alias("order_product_ids"), kind("purchase", pair).alias("pay_category_ids"), kind("purchase", product.cast("string")).alias("pay_product_ids"),
        (F.col("user_id") % 25).alias("city_id"), "event_id",
    )


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = parquet(spark, sf_dir, "customer"), parquet(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(key.alias("user_id"), F.concat(F.lit("user"), key.cast("string")).alias("username"), F.col("c_name").alias("name"), (18 + key % 43).cast("int").alias("age"), F.col("c_mktsegment").alias("professional"), F.col("n_name").alias("city"), F.when(key % 2 == 0, "male").otherwise("female").alias("sex"))


def city_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = parquet(spark, sf_dir, "nation"), parquet(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("bigint").alias("city_id"), F.col("n_name").alias("city_name"), F.col("r_name").alias("area"))


def product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return parquet(spark, sf_dir, "part").select(key.alias("product_id"), F.col("p_name").alias("product_name"), F.concat(F.lit('{"product_status": '), (key % 2).cast("string"), F.lit("}")).alias("extend_info"))


def ad_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, province, city, user_id, ad_id) of the click events."""
    e = parquet(spark, sf_dir, "events").where("event_type = 'click'").withColumn("city_id", F.col("user_id") % 25)
    ad = F.get_json_object("props", "$.k").cast("bigint") % 10
    return e.join(city_info(spark, sf_dir), "city_id").select(F.col("ts").cast("timestamp").alias("ts"), F.col("area").alias("province"), F.col("city_name").alias("city"), "user_id", ad.alias("ad_id"))
