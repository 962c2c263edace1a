"""Category counts, top categories and their most active sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from behavex.functions.columns import ids_of


def counts(actions: DataFrame) -> DataFrame:
    """Clicks, orders and payments of each category that has any. One explode and one shuffle."""
    none = F.array().cast("array<bigint>")
    ids = {
        "click": F.when(F.col("click_category_id").isNotNull(), F.array("click_category_id")),
        "order": ids_of(F.col("order_category_ids")),
        "pay": ids_of(F.col("pay_category_ids")),
    }

    def tag(kind: str):
        return lambda x: F.struct(x.alias("category_id"), F.lit(kind).alias("kind"))

    tagged = F.concat(*(F.transform(F.coalesce(c, none), tag(k)) for k, c in ids.items()))
    rows = actions.select(F.explode(tagged).alias("x")).select("x.*")
    return rows.groupBy("category_id").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ids))


def top(category_counts: DataFrame, n: int = 10) -> DataFrame:
    """Most clicks, then orders, then payments, then the smaller id."""
    return category_counts.orderBy(F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), "category_id").limit(n)


def session_counts(actions: DataFrame) -> DataFrame:
    return actions.where("click_category_id is not null").groupBy(F.col("click_category_id").alias("category_id"), "session_id").agg(F.count("*").alias("click_count"))


def top_sessions(actions: DataFrame, top_categories: DataFrame, n: int = 10) -> DataFrame:
    """The n sessions with most clicks in each of a few categories (top's limit bounds what is broadcast)."""
    c = session_counts(actions).join(F.broadcast(top_categories.select("category_id")), "category_id")
    rank = F.row_number().over(W.partitionBy("category_id").orderBy(F.desc("click_count"), "session_id"))
    return c.withColumn("rank", rank).where(F.col("rank") <= n).select("category_id", "session_id", "click_count")
