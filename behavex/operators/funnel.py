"""Page transitions and one-step conversion rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from behavex.functions.columns import half_up


def transitions(actions: DataFrame) -> DataFrame:
    """How often one page follows another in a session, pages that are null left out. Equal times keep event order."""
    before = F.lag("page_id").over(W.partitionBy("session_id").orderBy("action_time", "event_id"))
    rows = actions.where("page_id is not null").select("session_id", "page_id", "action_time", "event_id")
    rows = rows.withColumn("before", before).where("before is not null")
    return rows.groupBy(F.concat_ws("_", F.col("before").cast("string"), F.col("page_id").cast("string")).alias("page_split")).agg(F.count("*").alias("pv"))


def convert_rates(actions: DataFrame, flow: list[int]) -> DataFrame:
    """(step, page_split, pv, rate) for each step of the flow: its hits over those of the step before, the first
    over the views of the flow's first page. A step without hits has 0, as has one after it."""
    spark = actions.sparkSession
    steps = spark.createDataFrame([(i + 1, f"{a}_{b}") for i, (a, b) in enumerate(zip(flow, flow[1:], strict=False))], "step int, page_split string")
    start = actions.agg(F.count_if(F.col("page_id") == flow[0]).alias("start_pv"))
    hits = transitions(actions).join(F.broadcast(steps), "page_split").select("step", "pv")  # a flow is a handful of steps
    rows = steps.join(hits, "step", "left").select("step", "page_split", F.coalesce("pv", F.lit(0)).alias("pv")).join(F.broadcast(start))
    # the flow has a handful of steps, so that one task orders them
    base = F.coalesce(F.lag("pv").over(W.orderBy("step")), F.col("start_pv"))
    rate = F.coalesce(half_up(F.try_divide(F.col("pv").cast("double"), base.cast("double")), any_size=True), F.lit(0.0))
    return rows.withColumn("rate", rate).select("step", "page_split", "pv", "rate")


def as_text(rates: DataFrame) -> DataFrame:
    """`a_b=r|b_c=r` in the flow's order."""
    parts = F.array_sort(F.collect_list(F.struct("step", F.concat(F.col("page_split"), F.lit("="), F.col("rate").cast("string")).alias("t"))))
    return rates.agg(F.array_join(F.transform(parts, lambda x: x["t"]), "|").alias("convert_rate"))
