"""Co-located storage, maintained sessions, summaries, hot keys, and the aggregate in SQL text."""

import pytest
from pyspark.sql import functions as F

from behavex.functions import registry
from behavex.operators import maintained, products, sessions
from behavex.params import TaskParams
from behavex.sources import colocated, readers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def many_actions(spark, n=400, seed=3):
    a = readers.mock_actions(spark, sessions=n, users=30, most=9, seed=seed)
    day = F.concat(F.lit("2024-01-0"), (F.pmod(F.xxhash64("session_id"), F.lit(3)) + 1).cast("string"))
    return a.withColumn("date", day).withColumn("action_time", F.concat(day, F.substring("action_time", 11, 9)))


def shuffled_by_session(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning(session_id")


def test_stored_actions_are_not_shuffled(spark, tmp_path):
    """By date and session in buckets: the aggregate has no shuffle by session, joins with chosen sessions none of the actions."""
    a, users = many_actions(spark), readers.mock_users(spark, 30)
    name = "stored_actions"
    colocated.store(a, name, str(tmp_path / "t"), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so that no join is spared by the size of these tables
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored = sessions.in_dates(colocated.read(spark, name), TaskParams(startdate="2024-01-01", enddate="2024-01-02"))
        plain = sessions.in_dates(a, TaskParams(startdate="2024-01-01", enddate="2024-01-02"))
        steps = lambda x: x.groupBy("session_id").agg(F.count("*").alias("n"))
        assert shuffled_by_session(steps(stored)) == 0 and shuffled_by_session(steps(plain)) == 1
        chosen = sessions.aggregate(stored, users).where("step_length > 3").select("session_id")
        assert shuffled_by_session(stored.join(chosen, "session_id", "left_semi")) == 1  # the chosen sessions, after their join with users
        assert "date" in stored.inputFiles()[0] and len(stored.inputFiles()) <= 2 * 4
        assert rows(sessions.aggregate(stored, users)) == rows(sessions.aggregate(plain, users))
        assert rows(sessions.detail(stored, chosen)) == rows(sessions.detail(plain, chosen))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sql(f"DROP TABLE {name}")


def test_maintained_sessions_follow_the_batches(spark, tmp_path):
    a, users = many_actions(spark, 60), readers.mock_users(spark, 30)
    kept = maintained.MaintainedSessions(spark, str(tmp_path), unit=600)
    parts = [a.where(c) for c in ("date = '2024-01-01' and substring(action_time, 12, 2) < '12'", "date = '2024-01-01' and substring(action_time, 12, 2) >= '12'", "date > '2024-01-01'")]
    seen = a.limit(0)
    for i, part in enumerate(parts):
        kept.update(part, i)
        kept.update(part, i)  # again
        seen = seen.unionByName(part)
        assert rows(kept.sessions(users)) == rows(sessions.aggregate(seen, users))
        everyone = seen.select("user_id").distinct().select("user_id", F.lit(1).alias("age"), F.lit("").alias("professional"), F.lit("").alias("city"), F.lit("").alias("sex"))
        assert rows(kept.histogram()) == rows(sessions.histogram(sessions.aggregate(seen, everyone).withColumn("visit_length", F.expr("visit_length div 600"))))
    last = kept._states._folders(2)[-1]  # the third day's batch has written its own sessions only
    assert spark.read.parquet(f"{tmp_path}/states/{last}").count() == parts[2].select("session_id").distinct().count()


@pytest.mark.parametrize("size", [5, 40, 1000])
def test_summaries_merge(spark, size):
    s = sessions.aggregate(many_actions(spark), readers.mock_users(spark, 30))
    third = F.pmod(F.xxhash64("session_id", F.lit(5)), F.lit(3))
    parts = [maintained.hour_summaries(s.where(third == i), size) for i in range(3)]
    two = maintained.merged_summaries(parts[0].unionByName(parts[1]), size)
    whole = maintained.merged_summaries(two.unionByName(parts[2]), size)
    assert rows(maintained.summary_sample(whole, size)) == rows(sessions.stratified_sample(s, size)) == rows(maintained.summary_sample(maintained.hour_summaries(s, size), size))
    assert whole.agg(F.max(F.size("picks"))).first()[0] <= size
    none = maintained.hour_summaries(s.limit(0), size)
    assert maintained.summary_sample(none, size).count() == 0


def test_hot_keys_are_split(spark):
    """One key with half of the rows, one of a tenth, null keys, and keys without a partner."""
    large = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 10 == 1, 8).when(F.col("id") % 100 == 3, None).otherwise(F.col("id")).cast("long").alias("k"), "id")
    small = spark.range(0, 20_000, 3).select(F.col("id").alias("k"), F.lit("x").alias("v")).unionByName(spark.createDataFrame([(7, "y"), (8, "a"), (8, "b")], "k long, v string"))
    assert products.heavy_keys(large, "k", 0.05) == [7, 8] and products.heavy_keys(large, "k", 0.6) == []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        most = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        plain, split = large.join(small, "k"), products.split_join(large, small, "k", 0.05)
        assert rows(split) == rows(plain)
        assert rows(products.split_join(large, small, "k", 0.05, most_rows=1)) == rows(plain) == rows(products.split_join(large, small, "k", 0.9))
        assert most(plain) > 0.6 * plain.count() > 2 * 0.3 * plain.count() - 1 and most(split) < 0.35 * plain.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert products.split_join(large.limit(0), small, "k").count() == 0


def test_aggregate_in_sql_text(spark):
    registry.register(spark)
    registry.register(spark)  # again
    spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("a", None), ("b", None), ("c", "11:b"), ("c", "1:b"), ("d", "é"), ("d", "z")], "area string, x string").createOrReplaceTempView("aggregate_rows")
    got = spark.sql("SELECT area, group_concat_distinct(x) AS c FROM aggregate_rows GROUP BY area")
    assert rows(got) == [("a", "x,y"), ("b", None), ("c", "11:b,1:b"), ("d", "z,é")]


def test_each_filter_alone(spark):
    """sex, city and categories one by one, and all at once."""
    s = spark.createDataFrame([("s1", 1, "A", "male", "kw1", "1,11"), ("s2", 2, "B", "female", "kw2", "11"), ("s3", 3, None, None, None, None)], "session_id string, age int, city string, sex string, search_keywords string, click_category_ids string").withColumn("professional", F.lit("p"))
    keep = lambda text: [r.session_id for r in sessions.matching(s, TaskParams.parse(text)).orderBy("session_id").collect()]
    assert keep('{"sex":["male"]}') == ["s1"] and keep('{"sex":["female"]}') == ["s2"] and keep('{"sex":["other"]}') == []
    assert keep('{"city":["A,C"]}') == ["s1"] and keep('{"city":["A,B"]}') == ["s1", "s2"]
    assert keep('{"categoryIds":["1"]}') == ["s1"] and keep('{"categoryIds":["11"]}') == ["s1", "s2"]
    assert keep('{"sex":["male"],"city":["A"],"categoryIds":["1"],"keywords":["kw1"],"startage":["1"],"endage":["2"]}') == ["s1"]


def test_mock_sessions_keep_a_category(spark):
    a = readers.mock_actions(spark, sessions=200)
    per = a.where("click_category_id is not null").groupBy("session_id").agg(F.countDistinct("click_category_id").alias("n"), F.countDistinct("click_product_id").alias("m"))
    assert per.agg(F.max("n"), F.max("m") > 1).first() == (1, True)
