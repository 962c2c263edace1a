"""The ad job over streams. What a batch needs to know of earlier ones is keyed state; what it writes is its own changes, once
under replay, to Parquet tables or to a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from behavex.operators import ads
from behavex.sources.sinks import ChangeTable, Database
from behavex.streaming import keyed

CLICK_SCHEMA = "ts timestamp, province string, city string, user_id bigint, ad_id bigint"
STAT = "date string, province string, city string, ad_id bigint, click_count bigint"
TOP = "date string, province string, ad_id bigint, click_count bigint"
DAILY = "date string, user_id bigint, ad_id bigint, click_count bigint"
TREND = "date string, hour string, minute string, ad_id bigint, click_count bigint"
LISTED = "user_id bigint"

#: Result tables: schema, keys, what a batch brings (add: values to be summed; replace: new values, 0 for none; groups: all rows of a
#: group; absent: rows that stay as they are).
TABLES = {
    "ad_user_click_count": (DAILY, ["date", "user_id", "ad_id"], "replace"),
    "ad_blacklist": (LISTED, ["user_id"], "absent"),
    "ad_stat": (STAT, ["date", "province", "city", "ad_id"], "add"),
    "ad_province_top3": (TOP, ["date", "province"], "groups"),
    "ad_click_trend": (TREND, ["date", "hour", "minute", "ad_id"], "add"),
}


def _start(df: DataFrame, path: str, mode: str, each, every: str | None) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_checkpoint").foreachBatch(each)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class ParquetResults:
    """The job's tables below a folder, each as the changes of its batches."""

    def __init__(self, spark: SparkSession, path: str, **how: str):
        self._tables = {}
        for name, (schema, keys, usual) in TABLES.items():
            way = how.get(name, usual)
            value = "click_count" if way in ("add", "replace") else None
            self._tables[name] = ChangeTable(spark, f"{path}/{name}", schema, keys, "sum" if way == "add" else "latest", value)

    def read(self, name: str, before: int | None = None) -> DataFrame:
        return self._tables[name].read(before)

    def put(self, name: str, df: DataFrame, batch: int) -> bool:
        return self._tables[name].publish(df, batch)


class DatabaseResults:
    """The job's tables in a database, merged a batch a transaction. `stream` names the job in the ledger of batches."""

    TYPES = {"string": "VARCHAR(128)", "bigint": "BIGINT"}

    def __init__(self, database: Database, stream: str = "ad_job", **how: str):
        self.database, self.stream, self.how = database, stream, {n: how.get(n, t[2]) for n, t in TABLES.items()}
        for name, (schema, keys, _) in TABLES.items():
            columns = dict(c.split() for c in schema.split(", "))
            all_keys = keys if self.how[name] != "groups" else [*keys, "ad_id"]
            database.ensure(name, {c: self.TYPES[t] for c, t in columns.items()}, all_keys)

    def read(self, name: str, before: int | None = None) -> DataFrame:
        return self.database.read(name)

    def put(self, name: str, df: DataFrame, batch: int) -> bool:
        return self.database.apply(df, name, TABLES[name][1], self.how[name], f"{self.stream}/{name}", batch)


def _with_state(spark: SparkSession, start) -> StreamingQuery:
    """Starts a query whose state is RocksDB's; the session's own choice of a state store is as it was. The other setting stays: by it a run to
    a log's end goes on until the timers that the last batch set off are done, with sources written in Python too."""
    spark.conf.set("spark.sql.streaming.triggerAvailableNowWrapper.enabled", "true")
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, keyed.PROVIDER)
    try:
        return start()
    finally:
        spark.conf.set(name, was) if was is not None else spark.conf.unset(name)


def ad_job(spark: SparkSession, clicks: DataFrame, path: str, least: int = 100, every: str | None = "5 seconds", lateness: str = "2 days", results: ParquetResults | DatabaseResults | None = None, listed: DataFrame | None = None, trend: bool = True) -> StreamingQuery:
    """The whole job as one stream. Clicks of users who are listed when a micro-batch begins are dropped; the rest feeds the
    users' daily counts, these the blacklist (which holds from the next batch on), and the running counts by day,
    province, city and ad, these each day's and province's top ads. The trend by minute counts all clicks, listed users' too.
    Counts of users and days are state, so that a batch reads and writes the keys that it has. Clicks later than `lateness` are not counted, and
    state of a day ends with it. listed are users known before the stream begins."""
    out = results or ParquetResults(spark, path)
    events = keyed.user_events(clicks, least, lateness, listed)

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            of = lambda kind: batch.where(F.col("kind") == kind)
            total = F.sum("n").alias("click_count")
            out.put("ad_user_click_count", of("daily").select("date", "user_id", "ad_id", F.col("n").alias("click_count")), n)
            out.put("ad_blacklist", of("listed").select("user_id"), n)
            counted = of("stat").groupBy("date", "province", "city", "ad_id").agg(total)
            out.put("ad_stat", counted, n)
            touched = counted.select("date", "province").distinct()  # days and provinces of one batch
            out.put("ad_province_top3", ads.province_top(out.read("ad_stat", before=n + 1).join(F.broadcast(touched), ["date", "province"], "left_semi")), n)
            if trend:
                hour, minute = F.substring("minute", 1, 2), F.substring("minute", 4, 2)
                out.put("ad_click_trend", of("trend").groupBy("date", hour.alias("hour"), minute.alias("minute"), "ad_id").agg(total), n)
        finally:
            batch.unpersist()

    return _with_state(spark, lambda: _start(events, f"{path}/ad_job", "update", each, every))


def hour_trend(spark: SparkSession, clicks: DataFrame, path: str, window: str = "60 minutes", every: str | None = "10 seconds", results: ParquetResults | DatabaseResults | None = None) -> StreamingQuery:
    """Clicks of each ad by minute over all clicks(ts, ad_id, arrived) that arrived within the last hour; minutes of which nothing
    is left in the window leave the table."""
    out = results or ParquetResults(spark, path, ad_click_trend="replace")

    def each(batch: DataFrame, n: int) -> None:
        by = [F.substring("minute", a, m).alias(c) for c, a, m in (("date", 1, 10), ("hour", 12, 2), ("minute", 15, 2))]
        last = batch.groupBy("minute", "ad_id").agg(F.max_by("n", "step").alias("click_count"))
        out.put("ad_click_trend", last.select(*by, "ad_id", "click_count"), n)

    return _with_state(spark, lambda: _start(keyed.hour_counts(clicks, window), f"{path}/trend_job", "update", each, every))


def unreadable(lines: DataFrame, path: str, every: str | None = "5 seconds") -> StreamingQuery:
    """Lines that can't be read, with what is wrong with them, to a folder of their own; each once (Spark's file sink keeps account)."""
    bad = ads.parsed(lines).where("problem is not null").select(*lines.columns, "problem")
    writer = bad.writeStream.format("parquet").option("path", f"{path}/unreadable").option("checkpointLocation", f"{path}/unreadable_job/_checkpoint").outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ad_log_job(spark: SparkSession, lines: DataFrame, path: str, least: int = 100, every: bool = True, lateness: str = "2 days", results=None, trend_results=None, listed: DataFrame | None = None, parts: tuple[str, ...] = ("ad", "trend", "unreadable")) -> list[StreamingQuery]:
    """The job from raw lines(value, arrived, ...): the ad job, the trend of the last hour, and the lines that can't be read, as streams side by side."""
    good = ads.parsed(lines).where("problem is null")
    started = {
        "ad": lambda: ad_job(spark, good, path, least, "5 seconds" if every else None, lateness, results, listed, trend=False),
        "trend": lambda: hour_trend(spark, good, path, every="10 seconds" if every else None, results=trend_results),
        "unreadable": lambda: unreadable(lines, path, "5 seconds" if every else None),
    }
    return [started[p]() for p in parts]


def running_stat(spark: SparkSession, clicks: DataFrame, path: str, lateness: str = "2 days", every: str | None = "5 seconds") -> StreamingQuery:
    """Running counts by day, province, city and ad (upsert-replace) and from them each day's and province's
    top ads (replaced by group). State older than the watermark goes; the tables keep it."""
    out = ParquetResults(spark, path, ad_stat="replace")
    day = F.window("ts", "1 day")
    counted = clicks.withWatermark("ts", lateness).groupBy(day, "province", "city", "ad_id").agg(F.count("*").alias("click_count"))
    counted = counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "province", "city", "ad_id", "click_count")

    def each(batch: DataFrame, n: int) -> None:
        out.put("ad_stat", batch, n)
        touched = batch.select("date", "province").distinct()
        out.put("ad_province_top3", ads.province_top(out.read("ad_stat", before=n + 1).join(touched, ["date", "province"], "left_semi")), n)

    return _start(counted, f"{path}/stat_query", "update", each, every)


def click_trend(spark: SparkSession, clicks: DataFrame, path: str, lateness: str = "60 minutes", every: str | None = "10 seconds") -> StreamingQuery:
    """Clicks of each ad by minute over all clicks (listed users too), upsert-replace. An event counts in its own
    minute while it is no later than the watermark allows."""
    out = ParquetResults(spark, path, ad_click_trend="replace")
    counted = clicks.withWatermark("ts", lateness).groupBy(F.window("ts", "1 minute"), "ad_id").agg(F.count("*").alias("click_count"))
    by = [F.date_format("window.start", f).alias(n) for n, f in (("date", "yyyy-MM-dd"), ("hour", "HH"), ("minute", "mm"))]
    counted = counted.select(*by, "ad_id", "click_count")

    def each(batch: DataFrame, n: int) -> None:
        out.put("ad_click_trend", batch, n)

    return _start(counted, f"{path}/trend_query", "update", each, every)
