"""Session results that are kept up to date instead of recomputed: session states that merge, a histogram that takes back what a session
counted before, and samples by summaries of each hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from behavex.functions.columns import date_hour, format_time
from behavex.operators.sessions import STEP_BUCKETS, VISIT_BUCKETS
from behavex.sources.sinks import ChangeTable

STATE = "session_id string, user_id bigint, t0 timestamp, t1 timestamp, step_length bigint, keywords array<string>, categories array<bigint>"
_SESSION = ["session_id", "start_time", "search_keywords", "click_category_ids"]


def states(actions: DataFrame) -> DataFrame:
    """What is known of each session from some of its actions; states of the same session merge."""
    time = F.col("action_time").cast("timestamp")
    word = F.when(F.col("search_keyword") != "", F.col("search_keyword"))
    return actions.groupBy("session_id").agg(F.min("user_id").alias("user_id"), F.min(time).alias("t0"), F.max(time).alias("t1"), F.count("*").alias("step_length"), F.collect_set(word).alias("keywords"), F.collect_set("click_category_id").alias("categories"))


def merged(parts: DataFrame) -> DataFrame:
    """States of a session as one."""
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return parts.groupBy("session_id").agg(F.min("user_id").alias("user_id"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("step_length").alias("step_length"), union("keywords"), union("categories"))


def _length() -> Column:
    return F.expr("(unix_micros(t1) - unix_micros(t0)) div 1000000")


def _counted(known: DataFrame, weight: int, unit: int) -> DataFrame:
    """(name, sessions): what these sessions add to each bucket."""
    within = lambda c, a, b: c >= a if b is None else c.between(a, b)
    visit, step = F.floor(_length() / unit), F.col("step_length")
    names = [F.lit("session_count"), *(F.when(within(visit, a, b), f"visit_{n}") for n, a, b in VISIT_BUCKETS), *(F.when(within(step, a, b), f"step_{n}") for n, a, b in STEP_BUCKETS)]
    return known.select(F.explode(F.array_compact(F.array(*names))).alias("name"), F.lit(weight).cast("bigint").alias("sessions"))


class MaintainedSessions:
    """Sessions and their histogram below a folder. A batch of actions reads and writes only the sessions that it has; the histogram
    takes back what these counted before and adds what they count now. A batch that is run again changes nothing.
    unit: seconds of one step of the visit buckets."""

    def __init__(self, spark: SparkSession, path: str, unit: int = 1):
        self.unit = unit
        self._states = ChangeTable(spark, f"{path}/states", STATE, ["session_id"], "latest", None)
        self._counts = ChangeTable(spark, f"{path}/histogram", "name string, sessions bigint", ["name"], "sum", "sessions")

    def update(self, actions: DataFrame, batch: int) -> None:
        touched = states(actions)
        before = self._states.read(before=batch).join(touched.select("session_id"), "session_id", "left_semi")
        self._states.publish(merged(before.unionByName(touched)), batch)
        now = self._states.read(before=batch + 1).join(touched.select("session_id"), "session_id", "left_semi")
        change = _counted(now, 1, self.unit).unionByName(_counted(before, -1, self.unit))
        self._counts.publish(change.groupBy("name").agg(F.sum("sessions").alias("sessions")).where("sessions <> 0"), batch)

    def sessions(self, users: DataFrame) -> DataFrame:
        """As sessions.aggregate gives them for all actions so far."""
        listed = lambda c: F.nullif(F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ","), F.lit(""))
        out = self._states.read().select("session_id", "user_id", format_time("t0").alias("start_time"), _length().alias("visit_length"), "step_length", listed("keywords").alias("search_keywords"), listed("categories").alias("click_category_ids"))
        return out.join(users.select("user_id", "age", "professional", "city", "sex"), "user_id")

    def histogram(self) -> DataFrame:
        """As sessions.histogram gives it, of all sessions so far (of known users or not)."""
        names = ["session_count", *(f"visit_{n}" for n, _, _ in VISIT_BUCKETS), *(f"step_{n}" for n, _, _ in STEP_BUCKETS)]
        return self._counts.read().agg(*(F.coalesce(F.sum(F.when(F.col("name") == n, F.col("sessions"))), F.lit(0)).alias(n) for n in names))


def hour_summaries(sessions: DataFrame, size: int = 100, order: Column | None = None, seed: int = 0) -> DataFrame:
    """(date, hour, sessions, picks): of each hour how many sessions it has and the first `size` by `order` or a seeded hash. The limit within
    an hour is applied before the shuffle as well, so that no task sorts an hour's sessions as a whole."""
    key = F.split(date_hour(F.to_timestamp("start_time", "yyyy-MM-dd HH:mm:ss")), "_")
    by = F.xxhash64("session_id", F.lit(seed)) if order is None else order
    rows = sessions.select(key[0].alias("date"), key[1].alias("hour"), by.alias("o"), *_SESSION)
    rank = F.row_number().over(W.partitionBy("date", "hour").orderBy("o", "session_id"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= size).groupBy("date", "hour").agg(F.array_sort(F.collect_list(F.struct("o", *_SESSION))).alias("picks"))
    return rows.groupBy("date", "hour").agg(F.count("*").alias("sessions")).join(first, ["date", "hour"])


def merged_summaries(parts: DataFrame, size: int = 100) -> DataFrame:
    """Summaries of disjoint sets of sessions as those of all of them; what is merged is bounded by size for each part and hour."""
    picks = F.slice(F.array_sort(F.flatten(F.collect_list("picks"))), 1, size)
    return parts.groupBy("date", "hour").agg(F.sum("sessions").alias("sessions"), picks.alias("picks"))


def summary_sample(summaries: DataFrame, size: int = 100) -> DataFrame:
    """The sample that sessions.stratified_sample draws from the sessions themselves, of at most the size that the summaries were made for."""
    days = summaries.agg(F.countDistinct("date").alias("days"))
    daily = F.floor(F.lit(size) / F.greatest(F.col("days"), F.lit(1)))
    share = F.col("sessions").cast("double") / F.sum("sessions").over(W.partitionBy("date")).cast("double")
    quota = summaries.withColumn("share", share).join(F.broadcast(days)).withColumn("quota", F.least(F.floor(F.col("share") * daily), F.col("sessions")).cast("int"))  # days is one row
    return quota.where("quota > 0").select(F.explode(F.slice("picks", F.lit(1), F.col("quota"))).alias("x")).select(*(f"x.{c}" for c in _SESSION))
