"""Every query of the engine over the test tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from behavex.functions import columns as C
from behavex.functions import registry
from behavex.functions.registry import concat_distinct
from behavex.operators import ads, categories, funnel, maintained, products, sessions
from behavex.params import TaskParams
from behavex.sources import click_log, colocated, readers, sinks
from behavex.sources.files import shared_folder
from behavex.streaming import ad_stream

TASK = '{"startdate":["2024-01-05"],"enddate":["2024-01-25"],"startage":["20"],"endage":["50"],"professional":["BUILDING,MACHINERY,AUTOMOBILE"],"keywords":["kw1,kw2,kw3,kw4,kw5"]}'
#: Every filter at once.
TASK_ALL = '{"startdate":["2024-01-05"],"enddate":["2024-01-25"],"startage":["18"],"endage":["60"],"professional":["BUILDING,MACHINERY,AUTOMOBILE,FURNITURE"],"city":["%s"],"sex":["male"],"keywords":["kw0,kw1,kw2,kw3,kw4,kw5,kw6,kw7"],"categoryIds":["%s"]}' % (",".join(f"NATION_{i}" for i in range(18)), ",".join(str(i) for i in range(80)))
FLOW = [1, 2, 3, 4, 5]
LEVELS = {"AFRICA": "A级", "AMERICA": "A级", "ASIA": "B级", "EUROPE": "C级"}
LEAST_CLICKS = 2

actions, users, cities, items = readers.user_visit_action, readers.user_info, readers.city_info, readers.product_info


def _dated(s: SparkSession, d: str) -> DataFrame:
    return sessions.in_dates(actions(s, d), TaskParams.parse(TASK))


def _aggregate(s: SparkSession, d: str) -> DataFrame:
    return sessions.aggregate(_dated(s, d), users(s, d))


def _chosen(s: SparkSession, d: str) -> DataFrame:
    return sessions.matching(_aggregate(s, d), TaskParams.parse(TASK))


def _mine(s: SparkSession, d: str) -> DataFrame:
    return _dated(s, d).join(_chosen(s, d).select("session_id"), "session_id", "left_semi")


def _squeezed(df: DataFrame) -> DataFrame:
    """Lengths in tens of minutes, so that the test tables reach the short buckets."""
    return df.withColumn("visit_length", F.expr("visit_length div 600"))


def _top(s: SparkSession, d: str) -> DataFrame:
    return categories.top(categories.counts(_mine(s, d)))


def _best(s: SparkSession, d: str) -> DataFrame:
    return categories.top_sessions(_mine(s, d), _top(s, d))


def _best_detail(s: SparkSession, d: str) -> DataFrame:
    best = _best(s, d)
    return best.select("session_id").join(sessions.detail(_dated(s, d), best), "session_id")


def _sample(s: SparkSession, d: str) -> DataFrame:
    return sessions.stratified_sample(_chosen(s, d), order=F.md5("session_id"))


def _area(s: SparkSession, d: str) -> DataFrame:
    return products.area_clicks(products.clicks(_dated(s, d)), cities(s, d))


def _listed(s: SparkSession, d: str) -> DataFrame:
    return ads.offenders(ads.user_daily(readers.ad_clicks(s, d)), LEAST_CLICKS)


def _good(s: SparkSession, d: str) -> DataFrame:
    return ads.allowed(readers.ad_clicks(s, d), _listed(s, d))


def _json(s: SparkSession, d: str) -> DataFrame:
    e = readers.parquet(s, d, "events")
    return e.select("event_id", C.json_field(F.col("props"), "k").alias("k"), C.json_field(F.col("props"), "none").alias("missing"), C.first_param(F.lit(TASK), "startage").alias("startage"))


def _concat_long(s: SparkSession, d: str) -> DataFrame:
    c = cities(s, d)
    one = C.concat_long(F.col("city_id"), F.col("city_name"), ":")
    return c.groupBy("area").agg(concat_distinct(one).alias("city_infos"))


def _strings(s: SparkSession, d: str) -> DataFrame:
    a = actions(s, d)
    record = F.concat(F.lit("a="), F.coalesce("search_keyword", F.lit("")), F.lit("|b="), F.col("page_id").cast("string"))
    return a.select(
        "event_id", C.is_empty(F.col("search_keyword")).alias("empty"), C.trim_comma(F.concat(F.lit(","), F.coalesce("order_category_ids", F.lit("")), F.lit(","))).alias("trimmed"), C.two_digits(F.col("page_id").cast("string")).alias("two"),
        C.field_of(record, "a").alias("a"), C.field_of(record, "b").alias("b"), C.with_field(record, "b", "x").alias("changed"), F.array_join(F.transform(C.ids_of(F.col("pay_category_ids")), lambda x: x.cast("string")), ";").alias("pay_ids"),
        C.unsalted(C.salted(F.col("session_id"), 7, F.col("event_id"))).alias("unsalted"),
    )


def _dates(s: SparkSession, d: str) -> DataFrame:
    e = readers.parquet(s, d, "events")
    text, noon = C.format_time(F.col("ts")), F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" 12:00:00"))
    return e.select("event_id", text.alias("time"), C.date_hour(F.col("ts")).alias("date_hour"), C.date_key(F.col("ts")).alias("date_key"), C.minute_key(F.col("ts")).alias("minute_key"), C.before(text, noon).alias("morning"), C.after(text, noon).alias("later"), C.seconds_between(text, noon).alias("from_noon"), F.date_format(C.parse_date_key(C.date_key(F.col("ts"))), "yyyy-MM-dd").alias("day"))


def _half_up(s: SparkSession, d: str) -> DataFrame:
    li = readers.parquet(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") / F.col("l_quantity")).alias("x"))
    return li.select("l_orderkey", "l_linenumber", C.half_up(F.col("x")).alias("rounded"))


def _salted_join(s: SparkSession, d: str) -> DataFrame:
    a = products.clicks(_dated(s, d)).withColumnRenamed("product_id", "p")
    return products.salted_join(a, cities(s, d), "city_id", spread=F.col("p")).groupBy("area").agg(F.count("*").alias("clicks"))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _jdbc(s: SparkSession, d: str) -> DataFrame:
    """Through a database in the driver's memory: a table written and read over JDBC."""
    url, driver = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    sinks.to_jdbc(cities(s, d).coalesce(1), url, "city_info", driver=driver)
    return readers.jdbc(s, url, "city_info", driver=driver)


def _merge(kind: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        day = F.dayofmonth("ts")
        clicks = readers.ad_clicks(s, d)
        if kind == "add":
            old, new = ads.user_daily(clicks.where(day <= 15)), ads.user_daily(clicks.where(day > 10))
            return sinks.merge_add(old, new, ["date", "user_id", "ad_id"], "click_count")
        old, new = ads.stat(clicks.where(day <= 15)), ads.stat(clicks.where((day > 10) & (F.hour("ts") < 12)))
        if kind == "replace":
            return sinks.merge_replace(old, new, ["date", "province", "city", "ad_id"])
        return sinks.replace_groups(ads.province_top(old), ads.province_top(new), ["date", "province"])

    return run


#: The stream's micro-batches: every day's clicks are spread over all three, so that each key crosses batches.
PARTS = ("hour(ts) < 8", "hour(ts) BETWEEN 8 AND 15", "hour(ts) > 15")


def _click_files(s: SparkSession, d: str, path: str) -> DataFrame:
    """The clicks as a stream of three files."""
    clicks = readers.ad_clicks(s, d)
    for i, part in enumerate(PARTS):
        clicks.where(part).coalesce(1).write.mode("append").parquet(f"{path}/in/part={i}")
    return s.readStream.schema(ad_stream.CLICK_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def _stream(kind: str):
    """The streaming job over the clicks as three files, run to their end."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = _scratch(s, f"stream-{kind}")
        source = _click_files(s, d, path)
        tables = ad_stream.ParquetResults(s, path, ad_stat="replace" if kind == "state" else "add", ad_click_trend="replace" if kind == "window" else "add")
        if kind == "state":
            ad_stream.running_stat(s, source, path, lateness="40 days", every=None).awaitTermination()
            return tables.read("ad_stat")
        if kind == "window":
            ad_stream.click_trend(s, source, path, lateness="40 days", every=None).awaitTermination()
            return tables.read("ad_click_trend")
        ad_stream.ad_job(s, source, path, least=LEAST_CLICKS, every=None, lateness="40 days").awaitTermination()
        return tables.read(kind)

    return run


#: When the lines of each part arrive in the log: all clicks of a part at one moment, the moments more than an hour apart from first to last.
ARRIVALS = (1_704_000_005_000, 1_704_002_405_000, 1_704_004_805_000)


def _log_lines(s: SparkSession, d: str, part: str) -> DataFrame:
    """A part's clicks as raw lines; each error event is a line that can't be read."""
    word = lambda c: F.translate(c, " ", "_")
    good = readers.ad_clicks(s, d).where(part).select(F.concat_ws(" ", F.unix_millis("ts").cast("string"), word("province"), word("city"), F.col("user_id").cast("string"), F.col("ad_id").cast("string")).alias("value"))
    bad = readers.parquet(s, d, "events").where("event_type = 'error'").where(part).select(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("now asia japan u1 "), F.col("event_id").cast("string"))).alias("value"))
    return good.unionByName(bad)


def _lines(kind: str, name: str):
    """The job over the raw-line log: lines are appended three times, and each time the job goes on from its checkpoint to the log's end."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = _scratch(s, f"lines-{kind}")
        click_log.register(s)
        results = ad_stream.ParquetResults(s, path, **({"ad_click_trend": "replace"} if kind == "trend" else {}))
        for i, part in enumerate(PARTS):
            click_log.append(_log_lines(s, d, part), f"{path}/log", ARRIVALS[i], partitions=2)
            lines = s.readStream.format("click_log").load(f"{path}/log")
            for q in ad_stream.ad_log_job(s, lines, path, LEAST_CLICKS, every=False, lateness="40 days", results=results, trend_results=results, parts=(kind,)):
                q.awaitTermination()
        return results.read(name) if kind != "unreadable" else s.read.parquet(f"{path}/unreadable").select("value", "problem", "arrived")

    return run


def _database(name: str):
    """The streaming job with its results in a database (in the driver's memory here): each batch is staged and merged in a transaction."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = _scratch(s, f"database-{name}")
        database = sinks.Database(s, f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver")
        results = ad_stream.DatabaseResults(database)
        ad_stream.ad_job(s, _click_files(s, d, path), path, least=LEAST_CLICKS, every=None, lateness="40 days", results=results).awaitTermination()
        return results.read(name)

    return run


def _relative_days(s: SparkSession, d: str) -> DataFrame:
    """The events of the last days, as of the day after the last event."""
    e = readers.parquet(s, d, "events").select("event_id", F.to_date("ts").alias("day"))
    now = F.date_add(F.max("day").over(W.partitionBy()), 1)
    apart = F.date_diff(C.parse_day(C.today()), C.parse_day(C.yesterday()))
    return e.withColumn("ago", F.date_diff(now, "day")).withColumn("yesterday", F.col("ago") == apart).where("ago <= 7")


def _sql_functions(s: SparkSession, d: str) -> DataFrame:
    """The registered functions, from SQL text."""
    registry.register(s)
    view = f"cities_{uuid.uuid4().hex}"
    cities(s, d).createOrReplaceTempView(view)
    out = s.sql(f"""SELECT area, concat_collected(collect_set(concat_long_string(city_id + 9007199254740993, city_name, ':'))) AS city_infos, min(json_top_field(concat('{{"id": ', city_id, '}}'), 'id')) AS least,
        max(remove_random_prefix(salted)) AS last, bool_and(salted RLIKE '^[0-9]_') AS prefixed
        FROM (SELECT *, random_prefix(city_name, 10) AS salted FROM {view}) GROUP BY area""")
    s.catalog.dropTempView(view)  # the plan has it
    return out


def _sql_aggregate(s: SparkSession, d: str) -> DataFrame:
    """The registered aggregate over the clicks of each area, from SQL text."""
    registry.register(s)
    view = f"clicks_{uuid.uuid4().hex}"
    products.with_city(products.clicks(_dated(s, d)), cities(s, d)).createOrReplaceTempView(view)
    out = s.sql(f"SELECT area, product_id, group_concat_distinct(concat_long_string(city_id, city_name, ':')) AS city_infos FROM {view} GROUP BY area, product_id")
    s.catalog.dropTempView(view)
    return out


def _colocated(s: SparkSession, d: str) -> DataFrame:
    """Sessions of actions that are stored by date and session."""
    name = f"actions_{uuid.uuid4().hex}"
    colocated.store(actions(s, d), name, f"{_scratch(s, 'actions')}", buckets=8)
    return sessions.aggregate(sessions.in_dates(colocated.read(s, name), TaskParams.parse(TASK)), users(s, d))


def _maintained(kind: str):
    """Sessions kept up to date over three batches, each of which has actions of nearly every session."""

    def run(s: SparkSession, d: str) -> DataFrame:
        kept = maintained.MaintainedSessions(s, _scratch(s, "maintained"), unit=600)
        for i, part in enumerate(PARTS):
            kept.update(_dated(s, d).where(part.replace("ts", "action_time")), i)
        return kept.sessions(users(s, d)) if kind == "sessions" else kept.histogram()

    return run


def _summary_sample(s: SparkSession, d: str) -> DataFrame:
    """The stratified sample from summaries of two halves of the sessions."""
    chosen, half = _chosen(s, d), F.pmod(F.xxhash64("session_id"), F.lit(2))
    parts = [maintained.hour_summaries(chosen.where(half == i), order=F.md5("session_id")) for i in (0, 1)]
    return maintained.summary_sample(maintained.merged_summaries(parts[0].unionByName(parts[1])))


def _split_join(s: SparkSession, d: str) -> DataFrame:
    return products.split_join(products.clicks(_dated(s, d)), cities(s, d), "city_id", share=0.04).groupBy("area").agg(F.count("*").alias("clicks"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    return sessions.ratios(sessions.histogram(_squeezed(_chosen(s, d))))


QUERIES = {
    "scan_date_range": lambda s, d: _dated(s, d).select("date", "user_id", "session_id", "page_id", C.format_time(F.col("action_time")).alias("action_time"), "search_keyword", "click_category_id", "click_product_id", "order_category_ids", "order_product_ids", "pay_category_ids", "pay_product_ids", "city_id"),
    "scan_clicks": lambda s, d: products.clicks(_dated(s, d)),
    "user_info": users,
    "city_info": cities,
    "product_info": items,
    "session_aggregate": _aggregate,
    "session_filter": _chosen,
    "session_detail_semi": lambda s, d: sessions.detail(_dated(s, d), _chosen(s, d)),
    "visit_step_histogram": lambda s, d: sessions.histogram(_squeezed(_chosen(s, d))),
    "session_ratio_stats": flagship,
    "sessions_per_hour": lambda s, d: sessions.per_hour(_chosen(s, d)),
    "stratified_sample": _sample,
    "sample_detail": lambda s, d: sessions.detail(_dated(s, d), _sample(s, d)),
    "category_counts": lambda s, d: categories.counts(_mine(s, d)),
    "top10_categories": _top,
    "category_session_counts": lambda s, d: categories.session_counts(_mine(s, d)),
    "top10_category_sessions": _best,
    "top10_session_detail": _best_detail,
    "page_transitions": lambda s, d: funnel.transitions(_dated(s, d)),
    "page_convert_rates": lambda s, d: funnel.convert_rates(_dated(s, d), FLOW),
    "page_convert_string": lambda s, d: funnel.as_text(funnel.convert_rates(_dated(s, d), FLOW)),
    "area_product_clicks": _area,
    "area_top3_products": lambda s, d: products.top_products(products.with_product(_area(s, d), items(s, d)), levels=LEVELS),
    "salted_join": _salted_join,
    "salted_agg": lambda s, d: products.salted_counts(products.clicks(_dated(s, d)), cities(s, d)),
    "json_field": _json,
    "concat_long_string": _concat_long,
    "string_helpers": _strings,
    "date_helpers": _dates,
    "exact_half_up": _half_up,
    "ad_user_daily_clicks": lambda s, d: ads.user_daily(readers.ad_clicks(s, d)),
    "ad_blacklist": _listed,
    "ad_filtered_events": lambda s, d: _good(s, d).select(C.format_time(F.col("ts")).alias("time"), "province", "city", "user_id", "ad_id"),
    "ad_stat_running": lambda s, d: ads.stat(_good(s, d)),
    "ad_province_top3": lambda s, d: ads.province_top(ads.stat(_good(s, d))),
    "ad_click_trend": lambda s, d: ads.trend(readers.ad_clicks(s, d)),
    "stream_ad_stat": _stream("ad_stat"),
    "stream_ad_province_top3": _stream("ad_province_top3"),
    "stream_ad_click_trend": _stream("ad_click_trend"),
    "stream_ad_blacklist": _stream("ad_blacklist"),
    "stream_ad_user_daily": _stream("ad_user_click_count"),
    "stream_running_stat": _stream("state"),
    "stream_windowed_trend": _stream("window"),
    "lines_ad_stat": _lines("ad", "ad_stat"),
    "lines_ad_blacklist": _lines("ad", "ad_blacklist"),
    "lines_hour_trend": _lines("trend", "ad_click_trend"),
    "lines_unreadable": _lines("unreadable", ""),
    "database_ad_stat": _database("ad_stat"),
    "database_ad_province_top3": _database("ad_province_top3"),
    "database_ad_user_daily": _database("ad_user_click_count"),
    "relative_days": _relative_days,
    "sql_functions": _sql_functions,
    "sql_aggregate": _sql_aggregate,
    "colocated_sessions": _colocated,
    "maintained_sessions": _maintained("sessions"),
    "maintained_histogram": _maintained("histogram"),
    "summary_sample": _summary_sample,
    "split_join": _split_join,
    "session_filter_all": lambda s, d: sessions.matching(_aggregate(s, d), TaskParams.parse(TASK_ALL)),
    "jdbc_roundtrip": _jdbc,
    "upsert_add": _merge("add"),
    "upsert_replace": _merge("replace"),
    "replace_by_key": _merge("groups"),
}

_P, _A = TaskParams.parse(TASK), TaskParams.parse(TASK_ALL)
_DAY = "strftime(ts, '%Y-%m-%d') AS date, user_id, ad_id, count(*) AS click_count"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

_HIST = "count(*) AS session_count, " + ", ".join(f"count(*) FILTER ({c} {f'>= {a}' if b is None else f'BETWEEN {a} AND {b}'}) AS {p}_{n}" for p, c, bs in (("visit", "visit_length // 600", sessions.VISIT_BUCKETS), ("step", "step_length", sessions.STEP_BUCKETS)) for n, a, b in bs)

#: Common table expressions by name, each with the names it stands on.
_CTE: dict[str, tuple[list[str], str]] = {
    "uva": ([], """SELECT strftime(ts, '%Y-%m-%d') AS date, user_id, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id, k % 10 AS page_id, ts, event_id,
        CASE WHEN event_type = 'view' THEN 'kw' || CAST(k % 10 AS VARCHAR) END AS search_keyword, CASE WHEN event_type = 'click' THEN k END AS click_category_id, CASE WHEN event_type = 'click' THEN event_id % 200 END AS click_product_id,
        CASE WHEN event_type = 'signup' THEN pair END AS order_category_ids, CASE WHEN event_type = 'signup' THEN CAST(event_id % 200 AS VARCHAR) END AS order_product_ids,
        CASE WHEN event_type = 'purchase' THEN pair END AS pay_category_ids, CASE WHEN event_type = 'purchase' THEN CAST(event_id % 200 AS VARCHAR) END AS pay_product_ids, user_id % 25 AS city_id
        FROM (SELECT *, CASE WHEN k % 2 = 1 THEN CAST(k AS VARCHAR) ELSE CAST(k AS VARCHAR) || ',' || CAST((k + 1) % 100 AS VARCHAR) END AS pair FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""),
    "dated": (["uva"], f"SELECT * FROM uva WHERE date >= '{_P.startdate}' AND date <= '{_P.enddate}'"),
    "users": ([], "SELECT c_custkey AS user_id, 'user' || CAST(c_custkey AS VARCHAR) AS username, c_name AS name, CAST(18 + c_custkey % 43 AS INTEGER) AS age, c_mktsegment AS professional, n_name AS city, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "cities": ([], "SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS city_name, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "items": ([], """SELECT p_partkey AS product_id, p_name AS product_name, '{"product_status": ' || CAST(p_partkey % 2 AS VARCHAR) || '}' AS extend_info FROM part"""),
    "agg": (["dated", "users"], """SELECT s.*, age, professional, city, sex FROM (SELECT session_id, min(user_id) AS user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_time, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS visit_length, count(*) AS step_length,
        string_agg(DISTINCT search_keyword, ',' ORDER BY search_keyword) AS search_keywords, string_agg(DISTINCT CAST(click_category_id AS VARCHAR), ',' ORDER BY CAST(click_category_id AS VARCHAR)) AS click_category_ids FROM dated GROUP BY session_id) s JOIN users USING (user_id)"""),
    "chosen": (["agg"], f"SELECT * FROM agg WHERE age BETWEEN {_P.startage} AND {_P.endage} AND list_contains({_list(_P.professional)}, professional) AND coalesce(list_has_any(string_split(search_keywords, ','), {_list(_P.keywords)}), false)"),
    "hist": (["chosen"], f"SELECT {_HIST} FROM chosen"),
    "hours": (["chosen"], "SELECT date, hour, count(*) AS sessions, CAST(sum(count(*)) OVER (PARTITION BY date) AS BIGINT) AS day_sessions FROM (SELECT start_time[1:10] AS date, start_time[12:13] AS hour FROM chosen) GROUP BY date, hour"),
    "sample": (["chosen", "hours"], """SELECT session_id, start_time, search_keywords, click_category_ids FROM (
        SELECT c.*, least(floor(CAST(sessions AS DOUBLE) / CAST(day_sessions AS DOUBLE) * (SELECT floor(100 / greatest(count(DISTINCT date), 1)) FROM hours)), sessions) AS quota, row_number() OVER (PARTITION BY date, hour ORDER BY md5(session_id), session_id) AS r
        FROM chosen c JOIN hours h ON start_time[1:10] = date AND start_time[12:13] = hour) WHERE r <= quota"""),
    "mine": (["dated", "chosen"], "SELECT * FROM dated WHERE session_id IN (SELECT session_id FROM chosen)"),
    "cats": (["mine"], """SELECT category_id, count(*) FILTER (kind = 'c') AS click_count, count(*) FILTER (kind = 'o') AS order_count, count(*) FILTER (kind = 'p') AS pay_count FROM (
        SELECT click_category_id AS category_id, 'c' AS kind FROM mine WHERE click_category_id IS NOT NULL UNION ALL SELECT CAST(unnest(string_split(order_category_ids, ',')) AS BIGINT), 'o' FROM mine UNION ALL SELECT CAST(unnest(string_split(pay_category_ids, ',')) AS BIGINT), 'p' FROM mine) GROUP BY category_id"""),
    "topcats": (["cats"], "SELECT * FROM cats ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id LIMIT 10"),
    "sesscats": (["mine"], "SELECT click_category_id AS category_id, session_id, count(*) AS click_count FROM mine WHERE click_category_id IS NOT NULL GROUP BY ALL"),
    "best": (["sesscats", "topcats"], "SELECT category_id, session_id, click_count FROM (SELECT s.*, row_number() OVER (PARTITION BY category_id ORDER BY click_count DESC, session_id) AS r FROM sesscats s WHERE category_id IN (SELECT category_id FROM topcats)) WHERE r <= 10"),
    "detail": (["dated"], "SELECT user_id, session_id, page_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS action_time, search_keyword, coalesce(click_category_id, 0) AS click_category_id, coalesce(click_product_id, 0) AS click_product_id, order_category_ids, order_product_ids, pay_category_ids, pay_product_ids FROM dated"),
    "trans": (["dated"], "SELECT CAST(b AS VARCHAR) || '_' || CAST(page_id AS VARCHAR) AS page_split, count(*) AS pv FROM (SELECT page_id, lag(page_id) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS b FROM dated) WHERE b IS NOT NULL GROUP BY ALL"),
    "rates": (["trans", "dated"], f"""SELECT step, page_split, pv, coalesce({{half}}, 0.0) AS rate FROM (SELECT *, CASE WHEN base > 0 THEN CAST(pv AS DOUBLE) / CAST(base AS DOUBLE) END AS x FROM (SELECT step, page_split, coalesce(pv, 0) AS pv, coalesce(lag(coalesce(pv, 0)) OVER (ORDER BY step), (SELECT count(*) FROM dated WHERE page_id = {FLOW[0]})) AS base
        FROM (VALUES {', '.join(f"({i + 1}, '{a}_{b}')" for i, (a, b) in enumerate(zip(FLOW, FLOW[1:], strict=False)))}) t(step, page_split) LEFT JOIN trans USING (page_split)))"""),
    "area": (["dated", "cities"], "SELECT area, click_product_id AS product_id, count(*) AS click_count, string_agg(DISTINCT CAST(city_id AS VARCHAR) || ':' || city_name, ',' ORDER BY CAST(city_id AS VARCHAR) || ':' || city_name) AS city_infos FROM dated JOIN cities USING (city_id) WHERE click_product_id IS NOT NULL GROUP BY ALL"),
    "ad": (["cities"], "SELECT ts, area AS province, city_name AS city, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS ad_id FROM events JOIN cities ON city_id = user_id % 25 WHERE event_type = 'click'"),
    "daily": (["ad"], "SELECT strftime(ts, '%Y-%m-%d') AS date, user_id, ad_id, count(*) AS click_count FROM ad GROUP BY ALL"),
    "listed": (["daily"], f"SELECT DISTINCT user_id FROM daily WHERE click_count >= {LEAST_CLICKS}"),
    # batch by batch: who is listed, and what passes
    "d0": (["ad"], f"SELECT {_DAY} FROM ad WHERE {PARTS[0]} GROUP BY ALL"),
    "l0": (["d0"], f"SELECT DISTINCT user_id FROM d0 WHERE click_count >= {LEAST_CLICKS}"),
    "g1": (["ad", "l0"], f"SELECT * FROM ad WHERE {PARTS[1]} AND user_id NOT IN (SELECT user_id FROM l0)"),
    "d1": (["d0", "g1"], f"SELECT date, user_id, ad_id, CAST(sum(click_count) AS BIGINT) AS click_count FROM (SELECT * FROM d0 UNION ALL SELECT {_DAY} FROM g1 GROUP BY ALL) GROUP BY ALL"),
    "l1": (["d1", "l0"], f"SELECT user_id FROM l0 UNION SELECT user_id FROM d1 WHERE click_count >= {LEAST_CLICKS}"),
    "g2": (["ad", "l1"], f"SELECT * FROM ad WHERE {PARTS[2]} AND user_id NOT IN (SELECT user_id FROM l1)"),
    "d2": (["d1", "g2"], f"SELECT date, user_id, ad_id, CAST(sum(click_count) AS BIGINT) AS click_count FROM (SELECT * FROM d1 UNION ALL SELECT {_DAY} FROM g2 GROUP BY ALL) GROUP BY ALL"),
    "l2": (["d2", "l1"], f"SELECT user_id FROM l1 UNION SELECT user_id FROM d2 WHERE click_count >= {LEAST_CLICKS}"),
    "passed": (["ad", "g1", "g2"], f"SELECT * FROM ad WHERE {PARTS[0]} UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2"),
    "good": (["ad", "listed"], "SELECT * FROM ad WHERE user_id NOT IN (SELECT user_id FROM listed)"),
}
_HALF = "CAST((CAST(x * 1152921504606846976::DOUBLE AS BIGINT)::HUGEINT * 100 + 576460752303423488::HUGEINT) // 1152921504606846976::HUGEINT AS DOUBLE) / 100"
_STAT = "SELECT strftime(ts, '%Y-%m-%d') AS date, province, city, ad_id, count(*) AS click_count FROM {t} GROUP BY ALL"
_TOP = "SELECT date, province, ad_id, click_count FROM (SELECT *, row_number() OVER (PARTITION BY date, province ORDER BY click_count DESC, ad_id) AS r FROM (SELECT strftime(ts, '%Y-%m-%d') AS date, province, ad_id, count(*) AS click_count FROM {t} GROUP BY ALL)) WHERE r <= 3"
_TREND_OF = "SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, strftime(ts, '%M') AS minute, ad_id, count(*) AS click_count FROM {t} GROUP BY ALL"
_TREND = _TREND_OF.format(t="ad")
_OLD, _NEW = "(SELECT * FROM ad WHERE day(ts) <= 15)", "(SELECT * FROM ad WHERE day(ts) > 10 AND hour(ts) < 12)"


def _sql(body: str, *names: str) -> str:
    order: list[str] = []

    def need(n: str) -> None:
        for x in _CTE[n][0]:
            need(x)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    ctes = ", ".join(f"{n} AS ({_CTE[n][1].replace('{half}', _HALF)})" for n in order)
    return f"WITH {ctes} {body}" if ctes else body


_NAMES = [f"{p}_{n}" for p, bs in (("visit", sessions.VISIT_BUCKETS), ("step", sessions.STEP_BUCKETS)) for n, _, _ in bs]
_RATIO = ", ".join("coalesce(" + _HALF.replace("x *", f"(CAST({n} AS DOUBLE) / nullif(session_count, 0)) *") + f", 0.0) AS {n}_ratio" for n in _NAMES)

ORACLE = {
    "scan_date_range": _sql("SELECT date, user_id, session_id, page_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS action_time, search_keyword, click_category_id, click_product_id, order_category_ids, order_product_ids, pay_category_ids, pay_product_ids, city_id FROM dated", "dated"),
    "scan_clicks": _sql("SELECT city_id, click_product_id AS product_id FROM dated WHERE click_product_id IS NOT NULL", "dated"),
    "user_info": _sql("SELECT * FROM users", "users"),
    "city_info": _sql("SELECT * FROM cities", "cities"),
    "product_info": _sql("SELECT * FROM items", "items"),
    "session_aggregate": _sql("SELECT * FROM agg", "agg"),
    "session_filter": _sql("SELECT * FROM chosen", "chosen"),
    "session_detail_semi": _sql("SELECT * FROM detail WHERE session_id IN (SELECT session_id FROM chosen)", "detail", "chosen"),
    "visit_step_histogram": _sql("SELECT * FROM hist", "hist"),
    "session_ratio_stats": _sql(f"SELECT session_count, {_RATIO} FROM hist", "hist"),
    "sessions_per_hour": _sql("SELECT * FROM hours", "hours"),
    "stratified_sample": _sql("SELECT * FROM sample", "sample"),
    "sample_detail": _sql("SELECT * FROM detail WHERE session_id IN (SELECT session_id FROM sample)", "detail", "sample"),
    "category_counts": _sql("SELECT * FROM cats", "cats"),
    "top10_categories": _sql("SELECT * FROM topcats", "topcats"),
    "category_session_counts": _sql("SELECT * FROM sesscats", "sesscats"),
    "top10_category_sessions": _sql("SELECT * FROM best", "best"),
    "top10_session_detail": _sql("SELECT d.* FROM best JOIN detail d USING (session_id)", "best", "detail"),
    "page_transitions": _sql("SELECT * FROM trans", "trans"),
    "page_convert_rates": _sql("SELECT * FROM rates", "rates"),
    "page_convert_string": _sql("SELECT string_agg(page_split || '=' || CAST(rate AS VARCHAR), '|' ORDER BY step) AS convert_rate FROM rates", "rates"),
    "area_product_clicks": _sql("SELECT * FROM area", "area"),
    "area_top3_products": _sql("""SELECT area, CASE """ + " ".join(f"WHEN area = '{a}' THEN '{v}'" for a, v in LEVELS.items()) + f""" ELSE '{products.OTHER_LEVEL}' END AS area_level, product_id, city_infos, click_count, product_name, product_status FROM (
        SELECT *, row_number() OVER (PARTITION BY area ORDER BY click_count DESC, product_id) AS r, CASE WHEN json_extract_string(extend_info, '$.product_status') = '0' THEN '{products.OWN}' ELSE '{products.THIRD}' END AS product_status FROM area JOIN items USING (product_id)) WHERE r <= 3""", "area", "items"),
    "salted_join": _sql("SELECT area, count(*) AS clicks FROM dated JOIN cities USING (city_id) WHERE click_product_id IS NOT NULL GROUP BY area", "dated", "cities"),
    "salted_agg": _sql("SELECT area, product_id, click_count FROM area", "area"),
    "json_field": "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS missing, '20' AS startage FROM events",
    "concat_long_string": _sql("SELECT area, string_agg(DISTINCT CAST(city_id AS VARCHAR) || ':' || city_name, ',' ORDER BY CAST(city_id AS VARCHAR) || ':' || city_name) AS city_infos FROM cities GROUP BY area", "cities"),
    "string_helpers": _sql("""SELECT event_id, search_keyword IS NULL OR search_keyword = '' AS empty, CASE WHEN order_category_ids IS NULL THEN '' ELSE order_category_ids END AS trimmed, '0' || CAST(page_id AS VARCHAR) AS two, nullif(search_keyword, '') AS a, CAST(page_id AS VARCHAR) AS b,
        'a=' || coalesce(search_keyword, '') || '|b=x' AS changed, replace(pay_category_ids, ',', ';') AS pay_ids, session_id AS unsalted FROM uva""", "uva"),
    "date_helpers": """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, strftime(ts, '%Y-%m-%d_%H') AS date_hour, strftime(ts, '%Y%m%d') AS date_key, strftime(ts, '%Y%m%d%H%M') AS minute_key, date_trunc('second', ts) < noon AS morning, date_trunc('second', ts) > noon AS later,
        CAST(epoch(date_trunc('second', ts)) - epoch(noon) AS BIGINT) AS from_noon, strftime(ts, '%Y-%m-%d') AS day FROM (SELECT *, date_trunc('day', ts) + INTERVAL 12 HOUR AS noon FROM events)""",
    "exact_half_up": f"SELECT l_orderkey, l_linenumber, {_HALF} AS rounded FROM (SELECT l_orderkey, l_linenumber, l_linenumber / l_quantity AS x FROM lineitem)",
    "ad_user_daily_clicks": _sql("SELECT * FROM daily", "daily"),
    "ad_blacklist": _sql("SELECT * FROM listed", "listed"),
    "ad_filtered_events": _sql("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, province, city, user_id, ad_id FROM good", "good"),
    "ad_stat_running": _sql(_STAT.format(t="good"), "good"),
    "ad_province_top3": _sql(_TOP.format(t="good"), "good"),
    "ad_click_trend": _sql(_TREND, "ad"),
    "stream_ad_stat": _sql(_STAT.format(t="passed"), "passed"),
    "stream_ad_province_top3": _sql(_TOP.format(t="passed"), "passed"),
    "stream_ad_click_trend": _sql(_TREND, "ad"),
    "stream_ad_blacklist": _sql("SELECT * FROM l2", "l2"),
    "stream_ad_user_daily": _sql("SELECT * FROM d2", "d2"),
    "stream_running_stat": _sql(_STAT.format(t="ad"), "ad"),
    "stream_windowed_trend": _sql(_TREND, "ad"),
    "lines_ad_stat": _sql(f"SELECT date, replace(province, ' ', '_') AS province, replace(city, ' ', '_') AS city, ad_id, click_count FROM ({_STAT.format(t='passed')})", "passed"),
    "lines_ad_blacklist": _sql("SELECT * FROM l2", "l2"),
    "lines_hour_trend": _sql(f"{_TREND_OF.format(t=f'ad WHERE NOT ({PARTS[0]})')}", "ad"),
    "lines_unreadable": f"""SELECT CASE WHEN event_id % 2 = 0 THEN 'broken ' || event_id ELSE 'now asia japan u1 ' || event_id END AS value, CASE WHEN event_id % 2 = 0 THEN 'fields' ELSE 'time' END AS problem,
        make_timestamp(CASE WHEN {PARTS[0]} THEN {ARRIVALS[0]} WHEN {PARTS[1]} THEN {ARRIVALS[1]} ELSE {ARRIVALS[2]} END * 1000) AS arrived FROM events WHERE event_type = 'error'""",
    "database_ad_stat": _sql(_STAT.format(t="passed"), "passed"),
    "database_ad_province_top3": _sql(_TOP.format(t="passed"), "passed"),
    "database_ad_user_daily": _sql("SELECT * FROM d2", "d2"),
    "relative_days": """SELECT event_id, day, ago, ago = 1 AS yesterday FROM (SELECT event_id, CAST(ts AS DATE) AS day, CAST(date_diff('day', CAST(ts AS DATE), CAST(max(ts) OVER () AS DATE) + 1) AS INTEGER) AS ago FROM events) WHERE ago <= 7""",
    "sql_functions": _sql("""SELECT area, string_agg(DISTINCT CAST(city_id + 9007199254740993 AS VARCHAR) || ':' || city_name, ',' ORDER BY CAST(city_id + 9007199254740993 AS VARCHAR) || ':' || city_name) AS city_infos, min(CAST(city_id AS VARCHAR)) AS least, max(city_name) AS last, true AS prefixed FROM cities GROUP BY area""", "cities"),
    "sql_aggregate": _sql("SELECT area, product_id, city_infos FROM area", "area"),
    "colocated_sessions": _sql("SELECT * FROM agg", "agg"),
    "maintained_sessions": _sql("SELECT * FROM agg", "agg"),
    "maintained_histogram": _sql(f"SELECT {_HIST} FROM (SELECT count(*) AS step_length, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS visit_length FROM dated GROUP BY session_id)", "dated"),
    "summary_sample": _sql("SELECT * FROM sample", "sample"),
    "split_join": _sql("SELECT area, count(*) AS clicks FROM dated JOIN cities USING (city_id) WHERE click_product_id IS NOT NULL GROUP BY area", "dated", "cities"),
    "session_filter_all": _sql(f"""SELECT * FROM agg WHERE age BETWEEN {_A.startage} AND {_A.endage} AND list_contains({_list(_A.professional)}, professional) AND list_contains({_list(_A.city)}, city) AND sex = '{_A.sex}'
        AND coalesce(list_has_any(string_split(search_keywords, ','), {_list(_A.keywords)}), false) AND coalesce(list_has_any(string_split(click_category_ids, ','), {_list(_A.categoryIds)}), false)""", "agg"),
    "jdbc_roundtrip": _sql("SELECT city_id AS city_id, city_name, area FROM cities", "cities"),
    "upsert_add": _sql("SELECT date, user_id, ad_id, CAST(sum(n) AS BIGINT) AS click_count FROM (SELECT strftime(ts, '%Y-%m-%d') AS date, user_id, ad_id, (day(ts) <= 15)::INT + (day(ts) > 10)::INT AS n FROM ad) GROUP BY date, user_id, ad_id", "ad"),
    "upsert_replace": _sql("SELECT * FROM n UNION ALL SELECT * FROM o WHERE (date, province, city, ad_id) NOT IN (SELECT (date, province, city, ad_id) FROM n)", "ad").replace(" SELECT * FROM n UNION", f", o AS ({_STAT.format(t=_OLD)}), n AS ({_STAT.format(t=_NEW)}) SELECT * FROM n UNION", 1),
    "replace_by_key": _sql("SELECT * FROM n UNION ALL SELECT * FROM o WHERE (date, province) NOT IN (SELECT (date, province) FROM n)", "ad").replace(" SELECT * FROM n UNION", f", o AS ({_TOP.format(t=_OLD)}), n AS ({_TOP.format(t=_NEW)}) SELECT * FROM n UNION", 1),
}
