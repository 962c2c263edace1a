"""Most clicked products of each area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from behavex.functions.columns import concat_long, json_field, salted, unsalted
from behavex.functions.registry import concat_distinct

#: Level of each area; any other is D. These are fixed values.
AREA_LEVELS = {"华北": "A级", "华东": "A级", "华中": "B级", "华南": "B级", "西北": "C级", "西南": "C级"}
OTHER_LEVEL = "D级"
OWN, THIRD = "自营商品", "第三方商品"


def clicks(actions: DataFrame) -> DataFrame:
    return actions.where("click_product_id is not null").select("city_id", F.col("click_product_id").alias("product_id"))


def with_city(clicked: DataFrame, cities: DataFrame) -> DataFrame:
    """The city table's size decides how it is joined: Spark broadcasts it below its threshold."""
    return clicked.join(cities, "city_id")


def area_clicks(clicked: DataFrame, cities: DataFrame) -> DataFrame:
    """Clicks of each product in each area, with the cities they came from."""
    rows = with_city(clicked, cities).groupBy("area", "product_id", "city_id", "city_name").agg(F.count("*").alias("n"))
    return rows.groupBy("area", "product_id").agg(F.sum("n").alias("click_count"), concat_distinct(concat_long(F.col("city_id"), F.col("city_name"), ":")).alias("city_infos"))


def with_product(area_counts: DataFrame, products: DataFrame) -> DataFrame:
    status = F.when(json_field(F.col("extend_info"), "product_status") == "0", OWN).otherwise(THIRD)
    return area_counts.join(products.select("product_id", "product_name", status.alias("product_status")), "product_id")


def level(area: Column, levels: dict[str, str], other: str = OTHER_LEVEL) -> Column:
    out = F
    for name, value in levels.items():
        out = out.when(area == name, value)
    return out.otherwise(other) if levels else F.lit(other)


def top_products(full: DataFrame, n: int = 3, levels: dict[str, str] | None = None) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("area").orderBy(F.desc("click_count"), "product_id"))
    out = full.withColumn("rank", rank).where(F.col("rank") <= n)
    return out.select("area", level(F.col("area"), AREA_LEVELS if levels is None else levels).alias("area_level"), "product_id", "city_infos", "click_count", "product_name", "product_status")


def salted_counts(clicked: DataFrame, cities: DataFrame, n: int = 10) -> DataFrame:
    """Area and product counts in two steps, for areas that hold most of the rows: first by a salted key."""
    rows = with_city(clicked, cities).withColumn("key", salted(F.concat_ws(":", "area", F.col("product_id").cast("string")), n, F.struct("city_id", "product_id")))
    part = rows.groupBy("key").agg(F.count("*").alias("n"))
    both = F.split(unsalted(F.col("key")), ":")
    return part.groupBy(both[0].alias("area"), both[1].cast("bigint").alias("product_id")).agg(F.sum("n").alias("click_count"))


def salted_join(large: DataFrame, small: DataFrame, key: str, n: int = 10, spread: Column | None = None) -> DataFrame:
    """An equality join whose hot keys are spread over n tasks: the large side gets a salt, the small one each."""
    salt = F.pmod(F.xxhash64(*(large.columns if spread is None else [spread])), F.lit(n)).cast("int")
    many = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return large.withColumn("_salt", salt).join(many, [key, "_salt"]).drop("_salt")


def heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> list:
    """The keys that have at least a share of the rows, at most 1 / share of them: candidates by Spark's frequent-item sketch (one pass
    whose state has 1 / share entries), then counted exactly."""
    found = df.where(F.col(key).isNotNull()).stat.freqItems([key], share).select(F.explode(f"{key}_freqItems").alias(key))
    counts = df.join(F.broadcast(found), key).groupBy(key).agg(F.count("*").alias("n"))  # 1 / share candidates at most
    total = df.count()
    return sorted(r[key] for r in counts.where(F.col("n") >= share * total).collect())


def split_join(large: DataFrame, small: DataFrame, key: str, share: float = 0.01, most_rows: int = 100_000) -> DataFrame:
    """An equality join that treats measured hot keys of the large side apart: their rows stay where they are and meet the small side's few rows
    by broadcast (by salts if these are many), all others are joined as Spark thinks best. Without hot keys it is a plain join."""
    hot = heavy_keys(large, key, share)
    if not hot:
        return large.join(small, key)
    is_hot = F.col(key).isin(hot)
    few = small.where(is_hot)
    fits = few.limit(most_rows + 1).count() <= most_rows
    hot_rows = large.where(is_hot).join(F.broadcast(few), key) if fits else salted_join(large.where(is_hot), few, key)
    return hot_rows.unionByName(large.where(~is_hot).join(small.where(~is_hot), key))
