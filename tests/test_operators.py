import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from behavex.functions import columns as C
from behavex.functions import registry
from behavex.operators import ads, categories, funnel, products, sessions
from behavex.params import Settings, TaskParams, task_arguments
from behavex.plans import run
from behavex.sources import readers, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def actions(spark, data):
    """data: (user, session, page, time, keyword, category, orders, pays)."""
    made = [(t[:10], u, s, p, t, k, c, c, o, o, y, y, 1, i) for i, (u, s, p, t, k, c, o, y) in enumerate(data)]
    df = spark.createDataFrame(made, readers.ACTION_SCHEMA + ", event_id bigint")
    return df.withColumn("action_time", F.to_timestamp("action_time"))


USERS = [(1, "u1", "n1", 30, "p1", "c1", "male"), (2, "u2", "n2", 50, "p2", "c2", "female")]


def test_params():
    p = TaskParams.parse('{"startage":["20","30"],"sex":[],"keywords":["a,b"],"other":["x"],"city":null}')
    assert (p.startage, p.sex, p.keywords, p.city) == (20, None, ["a", "b"], None)
    with pytest.raises(ValueError):
        TaskParams.parse(None)


def test_session_aggregate_and_filters(spark):
    a = actions(spark, [
        (1, "s1", 1, "2024-01-01 10:00:00", "k=1|x", 11, None, None), (1, "s1", 2, "2024-01-01 10:00:31", None, 1, None, None), (1, "s1", 2, "2024-01-01 10:00:31", "", 1, None, None),
        (2, "s2", 1, "2024-01-01 11:00:00", None, None, None, None), (9, "s9", 1, "2024-01-01 11:00:00", "kw", None, None, None),
    ])
    s = sessions.aggregate(a, spark.createDataFrame(USERS, readers.USER_SCHEMA))
    got = {r.session_id: r for r in s.collect()}
    assert set(got) == {"s1", "s2"}  # the session of an unknown user is none
    assert (got["s1"].visit_length, got["s1"].step_length, got["s1"].search_keywords, got["s1"].click_category_ids) == (31, 3, "k=1|x", "1,11")
    keep = lambda text: [r.session_id for r in sessions.matching(s, TaskParams.parse(text)).collect()]
    assert sorted(keep('{"startage":["40"]}')) == ["s1", "s2"]  # one bound alone filters nothing
    assert keep('{"startage":["40"],"endage":["60"]}') == ["s2"]
    assert keep('{"categoryIds":["1"]}') == ["s1"]
    assert keep('{"keywords":["kw"]}') == []
    assert keep('{"professional":["p2,p3"]}') == ["s2"]


def test_histogram_borders(spark):
    visits = [0, 1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61, 180, 181, 600, 601, 1800, 1801]
    steps = [1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61]
    df = spark.createDataFrame([(v, steps[i % len(steps)]) for i, v in enumerate(visits)], "visit_length long, step_length long")
    h = sessions.histogram(df).first().asDict()
    assert [h[f"visit_{n}"] for n, _, _ in sessions.VISIT_BUCKETS] == [2, 2, 2, 2, 2, 2, 2, 2, 1]
    assert h["session_count"] == len(visits) and sum(v for k, v in h.items() if k.startswith("step_")) == len(visits)
    r = sessions.ratios(sessions.histogram(df.limit(0))).first()
    assert r["visit_1s_3s_ratio"] == 0.0


def test_sample_quota(spark):
    df = spark.createDataFrame([(f"s{i}", f"2024-01-01 {10 if i < 29 else 11}:00:00", "", "") for i in range(50)], "session_id string, start_time string, search_keywords string, click_category_ids string")
    got = sessions.stratified_sample(df, 100).collect()
    assert len(got) == 29 + 21 and len({r.session_id for r in got}) == 50
    assert sessions.stratified_sample(df, 10).count() == 5 + 4
    assert sessions.stratified_sample(df.limit(0)).count() == 0


def test_categories(spark):
    a = actions(spark, [(1, "s1", 1, "2024-01-01 10:00:00", None, 1, "", "2,,x"), (1, "s2", 1, "2024-01-01 10:00:00", None, 1, "1,2", None), (1, "s2", 1, "2024-01-01 10:00:01", None, 11, None, None)])
    c = categories.counts(a)
    assert rows(c) == [(1, 2, 1, 0), (2, 0, 1, 1), (11, 1, 0, 0)]
    assert [r.category_id for r in categories.top(c, 2).collect()] == [1, 11]
    assert rows(categories.top_sessions(a, categories.top(c), 1)) == [(1, "s1", 1), (11, "s2", 1)]


def test_funnel(spark):
    a = actions(spark, [(1, "s", p, f"2024-01-01 10:00:0{i}", None, None, None, None) for i, p in enumerate([1, None, 2, 1, 2, 3])])
    r = {x.page_split: (x.pv, x.rate) for x in funnel.convert_rates(a, [1, 2, 3, 4, 5]).collect()}
    assert r == {"1_2": (2, 1.0), "2_3": (1, 0.5), "3_4": (0, 0.0), "4_5": (0, 0.0)}
    assert funnel.as_text(funnel.convert_rates(a, [1, 2, 3])).first()[0] == "1_2=1.0|2_3=0.5"


def test_products(spark):
    clicks = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (11, 6), (9, 6)], "city_id long, product_id long")
    cities = spark.createDataFrame([(1, "a", "华东"), (11, "a", "华东"), (2, "b", "X")], "city_id long, city_name string, area string")
    items = spark.createDataFrame([(5, "five", '{"product_status": 0}'), (6, "six", "{bad")], readers.PRODUCT_SCHEMA)
    area = products.area_clicks(clicks, cities)
    got = rows(products.top_products(products.with_product(area, items)))
    assert got == sorted([("X", "D级", 5, "2:b", 1, "five", "自营商品"), ("华东", "A级", 5, "1:a", 2, "five", "自营商品"), ("华东", "A级", 6, "11:a", 1, "six", "第三方商品")])
    assert rows(products.salted_counts(clicks, cities)) == rows(area.select("area", "product_id", "click_count"))
    plain = clicks.join(cities, "city_id").select("city_id", "product_id", "area")
    assert rows(products.salted_join(clicks, cities, "city_id", 3).select("city_id", "product_id", "area")) == rows(plain)


def test_ads_and_merges(spark):
    lines = spark.createDataFrame([("1704103200000 A a 1 2",), ("x A a 1 2",), ("1704103200000 A",), (None,)], "value string")
    clicks = ads.parse(lines)
    assert rows(ads.user_daily(clicks)) == [("2024-01-01", 1, 2, 1)]
    assert ads.offenders(ads.user_daily(clicks), 1).count() == 1
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    new = spark.createDataFrame([("b", 5), ("c", 7)], "k string, n long")
    assert rows(sinks.merge_add(old, new, ["k"], "n")) == [("a", 1), ("b", 7), ("c", 7)]
    assert rows(sinks.merge_replace(old, new, ["k"])) == [("a", 1), ("b", 5), ("c", 7)]


def test_versioned_table_ignores_replay(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"), "n long")
    assert t.publish(spark.range(3).select(F.col("id").alias("n")), 0)
    assert not t.publish(spark.range(9).select(F.col("id").alias("n")), 0)
    assert t.read().count() == 3 and t.publish(spark.range(5).select(F.col("id").alias("n")), 1) and t.read().count() == 5
    assert t.read(before=1).count() == 3 and t.read(before=0).count() == 0


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    """Both are past the first look when they commit: one wins, and the other's rows are nowhere."""
    a, b = (sinks.VersionedTable(spark, str(tmp_path / "t"), "n long") for _ in range(2))
    monkeypatch.setattr(b, "_versions", list)
    assert a.publish(spark.range(3).select(F.col("id").alias("n")), 0)
    assert not b.publish(spark.range(9).select(F.col("id").alias("n")), 0)
    assert a.read().count() == 3 and len(list((tmp_path / "t").glob("rows-*"))) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(1, 60)), min_size=1, max_size=40))
def test_half_up_is_exact(spark, pairs):
    df = spark.createDataFrame([(n / d,) for n, d in pairs], "x double")
    for x, y in df.select("x", C.half_up(F.col("x"), any_size=True)).collect():
        assert y == float(Decimal(x).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


def test_half_up_of_every_size(spark):
    big = [(sign * (2.0**p + d),) for p in range(-3, 56) for d in (0.0, 0.005, 0.125, 0.375, 0.994999, 1 / 3) for sign in (1, -1)]
    df = spark.createDataFrame([*big, (0.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    for x, y, small in df.select("x", C.half_up(F.col("x"), any_size=True), C.half_up(F.col("x"))).collect():
        want = None if x is None or x != x or abs(x) == float("inf") else float(Decimal(x).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))
        assert y == want and small == (want if want is not None and 0 <= x < 8 else None)


def test_record_functions(spark):
    df = spark.createDataFrame([("a=1|b=|c=x=y|a=2",)], "r string")
    r = df.select(C.field_of(F.col("r"), "a"), C.field_of(F.col("r"), "b"), C.field_of(F.col("r"), "c"), C.with_field(F.col("r"), "b", "9")).first()
    assert tuple(r) == ("1", None, None, "a=1|b=9|c=x=y|a=2")


def test_mock_data_is_seeded(spark):
    a = readers.mock_actions(spark, 20)
    assert a.count() == readers.mock_actions(spark, 20).count() and a.columns == [x.split()[0] for x in readers.ACTION_SCHEMA.split(", ")]


def test_mock_products_and_ad_log(spark):
    assert {r.extend_info for r in readers.mock_products(spark, 50).collect()} == {'{"product_status": 0}', '{"product_status": 1}'}
    assert readers.ad_log_lines(spark).isStreaming and len({c for cs in readers.AD_CITIES.values() for c in cs}) == 10


def test_settings(tmp_path):
    (tmp_path / "s.properties").write_text("# comment\n! another\na = 1\nb=x=y\nflag=TRUE\nbad=one\nempty=\n")
    got = Settings.load(str(tmp_path / "s.properties"))
    assert (got.text("a"), got.text("b"), got.text("none"), got.text("empty")) == ("1", "x=y", None, "")
    assert (got.integer("a"), got.integer("bad"), got.integer("none")) == (1, 0, 0)
    assert (got.flag("flag"), got.flag("a"), got.flag("none")) == (True, False, False)


def test_task_arguments():
    assert task_arguments(["7"]) == 7 and task_arguments([], 3) == 3
    with pytest.raises(ValueError):
        task_arguments([])


def test_today(spark):
    before = datetime.datetime.now(datetime.UTC).date()
    day, last = spark.range(1).select(C.today(), C.yesterday()).first()
    assert day in {str(before), str(before + datetime.timedelta(1))} and str(datetime.date.fromisoformat(day) - datetime.timedelta(1)) == last


def test_registered_functions(spark):
    registry.register(spark)
    long = spark.sql("SELECT concat_long_string(a, b, ':') AS c, json_top_field('{\"x\": {\"y\": 1}}', 'x') AS j, json_top_field('{bad', 'x') AS n FROM VALUES (9007199254740993L, 'v'), (NULL, NULL) AS t(a, b)")
    assert rows(long) == [("9007199254740993:v", '{"y":1}', None), ("null:null", '{"y":1}', None)]
    one = spark.sql("SELECT random_prefix('a_b', 5) AS p, remove_random_prefix('3_4_x') AS r, concat_collected(array('b', 'a', 'b', NULL)) AS g, concat_collected(array()) AS e").first()
    assert one.p[0] in "01234" and one.p[1:] == "_a_b" and (one.r, one.g, one.e) == ("4_x", "a,b", None)


def test_job_command_line(spark, tmp_path):
    """A task looked up in the database, its job run over Parquet tables, results with its id in the database and in a folder."""
    url, driver = f"jdbc:derby:memory:{tmp_path.name};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    tasks = spark.createDataFrame([(4, '{"targetpageflow":["1,2,3"]}'), (5, None)], "task_id long, task_param string")
    sinks.to_jdbc(tasks.coalesce(1), url, "task", driver=driver)
    assert readers.task_param(spark, url, 4, driver=driver) == '{"targetpageflow":["1,2,3"]}'
    for missing in (5, 6):
        with pytest.raises(LookupError):
            readers.task_param(spark, url, missing, driver=driver)
    data = f"{tmp_path}/data"
    a = actions(spark, [(1, "s", p, f"2024-01-01 10:00:0{i}", "kw", 1, "1,2", None) for i, p in enumerate([1, 2, 1, 2, 3])])
    a.write.parquet(f"{data}/user_visit_action.parquet")
    spark.createDataFrame(USERS, readers.USER_SCHEMA).write.parquet(f"{data}/user_info.parquet")
    spark.createDataFrame([(1, "a", "华东")], "city_id long, city_name string, area string").write.parquet(f"{data}/city_info.parquet")
    readers.mock_products(spark).write.parquet(f"{data}/product_info.parquet")
    settings = tmp_path / "job.properties"
    settings.write_text(f"jdbc.url={url}\njdbc.driver={driver}\ndata.path={data}\ntask.page=4\n")
    run.main(["page", "--settings", str(settings)])
    got = readers.jdbc(spark, url, "page_convert_rate", driver=driver)
    assert rows(got) == [(4, "1_2=1.0|2_3=0.5")]
    settings.write_text(settings.read_text() + f"output.path={tmp_path}/out\n")
    run.main(["area", "9", "--settings", str(settings), "--params", "{}"])
    assert {r.task_id for r in spark.read.parquet(f"{tmp_path}/out/area_top3_product").collect()} == {9}
    found = run.run(spark, "session", 8, Settings.load(str(settings)), "{}")
    assert set(found) == {"session_aggr_stat", "session_random_extract", "session_detail", "top10_category", "top10_category_session", "top10_session_detail"}
    assert all(spark.read.parquet(f"{tmp_path}/out/{n}").columns[0] == "task_id" for n in found) and found["session_aggr_stat"].first().session_count == 1


def test_dated_table(spark, tmp_path):
    """A batch writes the dates that it touches; old versions and forgotten dates go, replays change nothing."""
    t = sinks.DatedTable(spark, str(tmp_path / "t"), "date string, n long", days=3)
    make = lambda *x: spark.createDataFrame(list(x), "date string, n long")
    assert t.publish(make(("2024-01-01", 1), ("2024-01-02", 2)), 0, ["2024-01-01", "2024-01-02"])
    assert t.publish(make(("2024-01-02", 5), ("2024-01-03", 3)), 1, ["2024-01-02", "2024-01-03"])
    assert not t.publish(make(("2024-01-02", 9)), 1, ["2024-01-02"])
    assert rows(t.read()) == [("2024-01-01", 1), ("2024-01-02", 5), ("2024-01-03", 3)]
    assert rows(t.read(before=1)) == [("2024-01-01", 1), ("2024-01-02", 2)] and rows(t.read(dates=["2024-01-03"])) == [("2024-01-03", 3)]
    assert t.publish(make(("2024-01-04", 4)), 2, ["2024-01-04"]) and t.publish(make(), 3, ["2024-01-02"])
    assert rows(t.read()) == [("2024-01-03", 3), ("2024-01-04", 4)] and t._versions() == [2, 3]
    files = [p for p in (tmp_path / "t").glob("rows-*/part=*")]
    assert len(files) == 3  # of the two versions kept: the second batch's two dates, and the third's
