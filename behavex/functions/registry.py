"""The functions that SQL text can use by name."""

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: SQL functions, which the optimizer sees through. get_json_object keeps its built-in meaning, and json_top_field takes a bare name.
_SQL = {
    "json_top_field(document STRING, name STRING)": "get_json_object(document, concat('$.', name))",
    "concat_long_string(a BIGINT, b STRING, separator STRING)": "concat(coalesce(cast(a AS STRING), 'null'), separator, coalesce(b, 'null'))",
    "random_prefix(value STRING, n INT)": "concat(cast(floor(rand() * n) AS STRING), '_', value)",
    "remove_random_prefix(value STRING)": "regexp_replace(value, '^[0-9]+_', '')",
    "concat_collected(collected ARRAY<STRING>)": "nullif(array_join(array_sort(array_distinct(collected)), ','), '')",
}


@F.pandas_udf(StringType())
def group_concat_distinct(values: pd.Series) -> str:
    """Distinct values in order, joined by commas; null where there are none. An aggregate in Python gets a
    group's rows in one task; where groups are hot, concat_collected(collect_set(x)) has partial sums."""
    return ",".join(sorted(set(values.dropna()), key=str.encode)) or None


def register(spark: SparkSession) -> None:
    """Registers the functions as temporary ones."""
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS STRING RETURN {body}")
    spark.sql("DROP TEMPORARY FUNCTION IF EXISTS group_concat_distinct")
    spark.udf.register("group_concat_distinct", group_concat_distinct)


def concat_distinct(c) -> F.Column:
    """Distinct values in order, joined by commas, as a built-in aggregate; null where there are none."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit(""))
