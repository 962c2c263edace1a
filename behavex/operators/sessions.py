"""Session aggregates, filters, histograms and the stratified sample."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from behavex.functions.columns import date_hour, format_time, half_up
from behavex.functions.registry import concat_distinct
from behavex.params import TaskParams

#: (name, lowest, highest) of whole seconds; an action alone (0 s) is in none. These are fixed values.
VISIT_BUCKETS = [("1s_3s", 1, 3), ("4s_6s", 4, 6), ("7s_9s", 7, 9), ("10s_30s", 10, 30), ("30s_60s", 31, 60), ("1m_3m", 61, 180), ("3m_10m", 181, 600), ("10m_30m", 601, 1800), ("30m", 1801, None)]
#: The same of numbers of actions.
STEP_BUCKETS = [("1_3", 1, 3), ("4_6", 4, 6), ("7_9", 7, 9), ("10_30", 10, 30), ("30_60", 31, 60), ("60", 61, None)]


def in_dates(actions: DataFrame, params: TaskParams) -> DataFrame:
    """Inclusive range of date text; an absent bound is open. The comparison reaches the scan."""
    if params.startdate is not None:
        actions = actions.where(F.col("date") >= params.startdate)
    return actions if params.enddate is None else actions.where(F.col("date") <= params.enddate)


def aggregate(actions: DataFrame, users: DataFrame) -> DataFrame:
    """One row a session of a known user: times, length in seconds and actions, distinct keywords and clicked
    categories (sorted, comma-joined, null if none), and the user's attributes. One shuffle by session."""
    time = F.col("action_time")
    s = actions.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"), F.min(time).alias("t0"), F.max(time).alias("t1"), F.count("*").alias("step_length"),
        concat_distinct(F.when(F.col("search_keyword") != "", F.col("search_keyword"))).alias("search_keywords"), concat_distinct(F.col("click_category_id").cast("string")).alias("click_category_ids"),
    )
    length = F.expr("(unix_micros(cast(t1 as timestamp)) - unix_micros(cast(t0 as timestamp))) div 1000000")
    s = s.select("session_id", "user_id", format_time("t0").alias("start_time"), length.alias("visit_length"), "step_length", "search_keywords", "click_category_ids")
    return s.join(users.select("user_id", "age", "professional", "city", "sex"), "user_id")


def _within(c: Column, low: int | None, high: int | None) -> Column | None:
    """Only with both bounds; a missing value is out."""
    return None if low is None or high is None else F.coalesce(c.between(low, high), F.lit(False))


def _one_of(c: Column, values: list[str] | None) -> Column | None:
    return None if values is None else F.coalesce(c.isin(values), F.lit(False))


def _any_of(c: Column, values: list[str] | None) -> Column | None:
    return None if values is None else F.coalesce(F.arrays_overlap(F.split(c, ","), F.array(*map(F.lit, values))), F.lit(False))


def equals(c: Column, value: str | None) -> Column | None:
    return None if value is None else F.coalesce(c == value, F.lit(False))


def matching(sessions: DataFrame, p: TaskParams) -> DataFrame:
    """Sessions that pass every filter that is given, in one predicate."""
    parts = [
        _within(F.col("age"), p.startage, p.endage), _one_of(F.col("professional"), p.professional), _one_of(F.col("city"), p.city),
        equals(F.col("sex"), p.sex), _any_of(F.col("search_keywords"), p.keywords), _any_of(F.col("click_category_ids"), p.categoryIds),
    ]
    given = [x for x in parts if x is not None]
    return sessions.where(reduce(and_, given)) if given else sessions


def _bucket(c: Column, low: int, high: int | None) -> Column:
    return c >= low if high is None else c.between(low, high)


def histogram(sessions: DataFrame, visit: Column | None = None) -> DataFrame:
    """One row: sessions, and how many are in each visit and step bucket."""
    visit = F.col("visit_length") if visit is None else visit
    counts = [F.count_if(_bucket(visit, a, b)).alias(f"visit_{n}") for n, a, b in VISIT_BUCKETS]
    counts += [F.count_if(_bucket(F.col("step_length"), a, b)).alias(f"step_{n}") for n, a, b in STEP_BUCKETS]
    return sessions.agg(F.count("*").alias("session_count"), *counts)


def ratios(counts: DataFrame) -> DataFrame:
    """The histogram as shares of the sessions, to two decimals; 0 without sessions."""
    total = F.col("session_count")
    names = [c for c in counts.columns if c != "session_count"]
    return counts.select(total, *(F.coalesce(half_up(F.try_divide(F.col(c).cast("double"), total.cast("double"))), F.lit(0.0)).alias(f"{c}_ratio") for c in names))


def per_hour(sessions: DataFrame) -> DataFrame:
    """Sessions of each hour, and of its day."""
    key = date_hour(F.to_timestamp("start_time", "yyyy-MM-dd HH:mm:ss"))
    hours = sessions.groupBy(F.split(key, "_")[0].alias("date"), F.split(key, "_")[1].alias("hour")).agg(F.count("*").alias("sessions"))
    return hours.withColumn("day_sessions", F.sum("sessions").over(W.partitionBy("date")))


def stratified_sample(sessions: DataFrame, size: int = 100, order: Column | None = None, seed: int = 0) -> DataFrame:
    """About size sessions, shared evenly over days and within a day by hours' share of its sessions.

    Each day gets size div days; an hour gets the whole part of its share of that, at most its
    sessions. Which ones: the first by `order`, or by a seeded hash. The quota table has a row an hour and
    joins on (date, hour); the rank within an hour is what is limited, so no hour is collected."""
    key = date_hour(F.to_timestamp("start_time", "yyyy-MM-dd HH:mm:ss"))
    rows = sessions.withColumn("date", F.split(key, "_")[0]).withColumn("hour", F.split(key, "_")[1])
    hours = per_hour(sessions)
    days = hours.agg(F.countDistinct("date").alias("days"))
    daily = F.floor(F.lit(size) / F.greatest(F.col("days"), F.lit(1)))
    quota = F.least(F.floor(F.col("sessions").cast("double") / F.col("day_sessions").cast("double") * daily), F.col("sessions"))
    quotas = hours.join(F.broadcast(days)).select("date", "hour", quota.cast("bigint").alias("quota"))  # days is one row
    rank = F.row_number().over(W.partitionBy("date", "hour").orderBy(F.xxhash64("session_id", F.lit(seed)) if order is None else order, "session_id"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= size)  # no quota is larger, and so much is dropped before the shuffle
    return first.join(quotas, ["date", "hour"]).where(F.col("rank") <= F.col("quota")).select("session_id", "start_time", "search_keywords", "click_category_ids")


def detail(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """The actions of these sessions, once each, in the detail table's form."""
    out = actions.join(sessions.select("session_id"), "session_id", "left_semi")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("click_category_id", "click_product_id")]
    return out.select("user_id", "session_id", "page_id", format_time("action_time").alias("action_time"), "search_keyword", *zero, "order_category_ids", "order_product_ids", "pay_category_ids", "pay_product_ids")
