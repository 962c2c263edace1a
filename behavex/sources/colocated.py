"""Actions stored by date and, within a date, by session in buckets: what is grouped or joined by session reads them where they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def store(actions: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """Writes the actions as a table of the catalog, one file a date and bucket. The rows are dealt to tasks as to buckets."""
    dealt = actions.repartition(buckets, "session_id")
    dealt.write.mode("overwrite").format("parquet").partitionBy("date").bucketBy(buckets, "session_id").sortBy("session_id").option("path", path).saveAsTable(table)


def read(spark: SparkSession, table: str) -> DataFrame:
    """The table's actions. A range of dates leaves the other dates' files unread; a shuffle by session is not needed."""
    return spark.table(table)
