"""Ad clicks: parsing, the blacklist, running counts, top ads and the click trend, as functions that
serve batches and micro-batches alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parsed(lines: DataFrame) -> DataFrame:
    """`epoch_ms province city user ad` lines, with their other columns: the fields, and what is wrong with a line (null: nothing)."""
    p = F.split(F.col("value"), " ")
    number = lambda i: F.get(p, F.lit(i)).try_cast("bigint")
    ms, user, ad = number(0), number(3), number(4)
    problem = F.when(F.col("value").isNull() | (F.size(p) < 5), "fields").when(ms.isNull(), "time").when(user.isNull(), "user").when(ad.isNull(), "ad")
    return lines.select("*", F.timestamp_millis(ms).alias("ts"), F.get(p, F.lit(1)).alias("province"), F.get(p, F.lit(2)).alias("city"), user.alias("user_id"), ad.alias("ad_id"), problem.alias("problem"))


def parse(lines: DataFrame) -> DataFrame:
    """The clicks of the lines that can be read."""
    return parsed(lines).where("problem is null").select("ts", "province", "city", "user_id", "ad_id")


def allowed(clicks: DataFrame, blacklist: DataFrame) -> DataFrame:
    return clicks.join(blacklist.select("user_id"), "user_id", "left_anti")


def user_daily(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"), "user_id", "ad_id").agg(F.count("*").alias("click_count"))


def offenders(daily: DataFrame, least: int = 100) -> DataFrame:
    """Users with so many clicks on one ad in a day."""
    return daily.where(F.col("click_count") >= least).select("user_id").distinct()


def stat(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"), "province", "city", "ad_id").agg(F.count("*").alias("click_count"))


def province_top(city_stat: DataFrame, n: int = 3) -> DataFrame:
    """The n most clicked ads of each province and day; ties to the smaller ad."""
    rows = city_stat.groupBy("date", "province", "ad_id").agg(F.sum("click_count").alias("click_count"))
    rank = F.row_number().over(W.partitionBy("date", "province").orderBy(F.desc("click_count"), "ad_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def trend(clicks: DataFrame) -> DataFrame:
    """Clicks of each ad by minute."""
    by = [F.date_format("ts", f).alias(n) for n, f in (("date", "yyyy-MM-dd"), ("hour", "HH"), ("minute", "mm"))]
    return clicks.groupBy(*by, "ad_id").agg(F.count("*").alias("click_count"))
