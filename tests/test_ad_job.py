"""The ad job from raw lines: the log's source, keyed state and its end, the hour's window, database merges that crash, jobs that run twice."""

import pytest
from pyspark.sql import functions as F

from behavex.operators import ads
from behavex.params import Settings
from behavex.plans import run
from behavex.sources import click_log, sinks
from behavex.streaming import ad_stream

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def write(folder, partition, ms, data: bytes, mode="wb"):
    path = folder / partition
    path.mkdir(parents=True, exist_ok=True)
    with open(path / f"{ms}.log", mode) as f:
        f.write(data)


# --- the source ---------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [1, 3, 7, 64, 1 << 20])
def test_pieces_have_every_line_once(tmp_path, piece):
    lines = ["a", "", "longer line of text", "ü" * 40, "x\r", "last"]
    data = "\n".join(lines).encode() + b"\n"
    write(tmp_path, "p", 1000, data)
    write(tmp_path, "p", 20000, b"second\n")  # by number, not by name
    write(tmp_path, "q", 1000, b"other\nnot whole")
    (tmp_path / "p" / "readme.txt").write_text("not the log's")
    log = click_log.Log(str(tmp_path), piece, 1 << 40)
    end = log.latest({})
    assert end == {"p": ["20000.log", 7], "q": ["1000.log", 6]}
    got = [r for p in log.pieces({}, end) for r in log.lines(p)]
    assert [r[4] for r in got if r[0] == "p"] == [x.rstrip("\r") for x in lines] + ["second"]
    assert [r[4] for r in got if r[0] == "q"] == ["other"]
    assert len({r[:3] for r in got}) == len(got)


def test_offsets_end_with_lines_and_go_on(tmp_path):
    write(tmp_path, "p", 1, b"one\ntwo\nthr")
    log = click_log.Log(str(tmp_path), 100, 1 << 40)
    first = log.latest({})
    assert first == {"p": ["1.log", 8]} and log.latest(first) == first
    write(tmp_path, "p", 1, b"ee\n", "ab")
    write(tmp_path, "p", 2, b"four\n")
    second = log.latest(first)
    read = lambda a, b: [r[4] for p in log.pieces(a, b) for r in log.lines(p)]
    assert read({}, first) == ["one", "two"] and read(first, second) == ["three", "four"]
    assert read({}, first) == ["one", "two"]  # a batch is read again as it was
    small = click_log.Log(str(tmp_path), 100, 5)
    at, seen = {}, []
    while (now := small.latest(at)) != at:
        seen.append(read(at, now))
        at = now
    assert [x for s in seen for x in s] == ["one", "two", "three", "four"] and len(seen) >= 3


def test_log_as_a_table(spark, tmp_path):
    click_log.register(spark)
    click_log.append(spark.createDataFrame([(str(i),) for i in range(50)], "value string"), f"{tmp_path}/log", 1_704_000_000_000, partitions=3)
    got = spark.read.format("click_log").option("piece", 16).load(f"{tmp_path}/log")
    assert sorted(int(r.value) for r in got.collect()) == list(range(50))
    assert got.select("partition").distinct().count() == 3 and got.select(F.unix_millis("arrived")).distinct().collect()[0][0] == 1_704_000_000_000
    assert spark.read.format("click_log").load(f"{tmp_path}/nothing").count() == 0
    with pytest.raises(FileExistsError):
        click_log.append(spark.createDataFrame([("x",)], "value string"), f"{tmp_path}/log", 1_704_000_000_000)


def test_what_is_wrong_with_a_line(spark):
    values = ["1704067200000 p c 1 2", "1704067200000 p c 1 2 more", "x p c 1 2", "1704067200000 p c u 2", "1704067200000 p c 1 a", "1704067200000 p c 1", "", None]
    got = ads.parsed(spark.createDataFrame([(v,) for v in values], "value string")).select("value", "problem").collect()
    assert [r.problem for r in got] == [None, None, "time", "user", "ad", "fields", "fields", "fields"]


# --- keyed state ----------------------------------------------------------------------------------


def line(day, hour, user, ad, place="p c"):
    return f"{(int(day) * 24 + hour) * 3_600_000} {place} {user} {ad}"


def go_on(spark, path, batch, **options):
    """Appends a batch's lines to the log and runs the job to its end."""
    log = path / "log"
    n = len(list(log.glob("p/*.log")))
    write(log, "p", 10_000 * (n + 1), "".join(f"{x}\n" for x in batch).encode())
    lines = spark.readStream.format("click_log").load(str(log))
    for q in ad_stream.ad_log_job(spark, lines, str(path), every=False, **options):
        q.awaitTermination()
        assert q.exception() is None
    return q


def test_listed_once_and_counts_follow_the_batch(spark, tmp_path):
    """A user is listed when it reaches the threshold, clicks of that batch still count and later ones do not; what a batch writes is its own keys."""
    click_log.register(spark)
    out = ad_stream.ParquetResults(spark, str(tmp_path))
    go = lambda batch: go_on(spark, tmp_path, batch, least=3, results=out, lateness="2 days", parts=("ad",), listed=spark.createDataFrame([(99,)], "user_id long"))
    go([line(10, 1, 1, 5)] * 2 + [line(10, 2, 2, 5), line(10, 2, 99, 5), "junk"])
    assert rows(out.read("ad_user_click_count")) == [("1970-01-11", 1, 5, 2), ("1970-01-11", 2, 5, 1)] and out.read("ad_blacklist").count() == 0
    go([line(10, 3, 1, 5)] * 2)
    assert rows(out.read("ad_blacklist")) == [(1,)]
    go([line(10, 4, 1, 5), line(10, 4, 3, 7)])
    assert rows(out.read("ad_user_click_count")) == [("1970-01-11", 1, 5, 4), ("1970-01-11", 2, 5, 1), ("1970-01-11", 3, 7, 1)]
    assert rows(out.read("ad_stat")) == [("1970-01-11", "p", "c", 5, 5), ("1970-01-11", "p", "c", 7, 1)]
    assert rows(out.read("ad_province_top3")) == [("1970-01-11", "p", 5, 5), ("1970-01-11", "p", 7, 1)]
    table = out._tables["ad_user_click_count"]
    last = table._folders(table._versions()[-1])
    written = sorted(spark.read.parquet(f"{tmp_path}/ad_user_click_count/{f}").count() for f in last)
    assert written[-1] <= 2 and sum(written) == 4  # 2, 1 and 1 keys in the three batches


def test_state_of_a_day_ends_with_the_watermark(spark, tmp_path):
    click_log.register(spark)
    out = ad_stream.ParquetResults(spark, str(tmp_path))
    go = lambda batch: go_on(spark, tmp_path, batch, least=100, results=out, lateness="1 hour", parts=("ad",))

    def held():
        state = spark.read.format("statestore").option("stateVarName", "counts").load(f"{tmp_path}/ad_job/_checkpoint")
        return state.count()

    go([line(10, 1, u, 1) for u in range(5)])
    assert held() == 5
    go([line(11, 5, 50, 1)])  # the watermark goes past the first day, whose five counts go
    assert held() == 1
    go([line(10, 2, 0, 1)])  # too late
    assert {r.click_count for r in out.read("ad_user_click_count").where("user_id = 0").collect()} == {1}


def test_hour_window_slides(spark, tmp_path):
    click_log.register(spark)
    out = ad_stream.ParquetResults(spark, str(tmp_path), ad_click_trend="replace")
    minute, log = 60_000, tmp_path / "log"
    arrivals = {0: [line(1, 0, 1, 1), line(1, 0, 2, 1)], 30: [line(1, 0, 1, 1), line(1, 1, 1, 2)], 70: [line(1, 1, 1, 2)], 75: [line(1, 0, 3, 9)], 200: [line(1, 3, 1, 1)]}
    want = {0: {1: 2}, 30: {1: 3, 2: 1}, 70: {1: 1, 2: 2}, 75: {1: 1, 2: 2, 9: 1}, 200: {1: 1}}
    for at, batch in arrivals.items():
        write(log, "p", 5000 + at * minute, "".join(f"{x}\n" for x in batch).encode())
        lines = spark.readStream.format("click_log").load(str(log))
        ad_stream.ad_log_job(spark, lines, str(tmp_path), every=False, trend_results=out, parts=("trend",))[0].awaitTermination()
        assert {r.ad_id: r.click_count for r in out.read("ad_click_trend").collect()} == want[at], at


# --- tables of changes, and a database -----------------------------------------------------------------


def test_change_table(spark, tmp_path):
    make = lambda *x: spark.createDataFrame(list(x), "k long, g long, click_count long")
    add = sinks.ChangeTable(spark, f"{tmp_path}/add", "k bigint, g bigint, click_count bigint", ["k", "g"], "sum", fold=3)
    new = sinks.ChangeTable(spark, f"{tmp_path}/new", "k bigint, g bigint, click_count bigint", ["k", "g"], "latest", fold=3)
    group = sinks.ChangeTable(spark, f"{tmp_path}/group", "k bigint, g bigint, click_count bigint", ["g"], "latest", None, fold=3)
    batches = [[(1, 1, 5), (2, 1, 1)], [(1, 1, 2)], [(3, 2, 4)], [(1, 1, 0), (4, 2, 1)], [(2, 1, 7)]]
    for n, b in enumerate(batches):
        for t in (add, new, group):
            assert t.publish(make(*b), n) and not t.publish(make(*b), n)
    assert rows(add.read()) == [(1, 1, 7), (2, 1, 8), (3, 2, 4), (4, 2, 1)] and rows(add.read(before=4)) == [(1, 1, 7), (2, 1, 1), (3, 2, 4), (4, 2, 1)]
    assert rows(new.read()) == [(2, 1, 7), (3, 2, 4), (4, 2, 1)]
    assert rows(group.read()) == [(2, 1, 7), (4, 2, 1)]
    assert len(list((tmp_path / "add").glob("rows-*"))) <= 3 and len(add._folders(4)) <= 3


def database(spark, tmp_path):
    return sinks.Database(spark, f"jdbc:derby:memory:{tmp_path.name};create=true", DERBY)


@pytest.mark.parametrize("how, want", [("add", [(1, 1, 12), (2, 1, 1), (3, 2, 4)]), ("replace", [(1, 1, 7), (2, 1, 1), (3, 2, 4)]), ("groups", [(1, 1, 7), (3, 2, 4)]), ("absent", [(1, 1, 5), (2, 1, 1), (3, 2, 4)])])
def test_database_merges_once(spark, tmp_path, how, want):
    """A batch that dies between its two steps, or is run again, has its rows once; a failed merge leaves nothing."""
    db = database(spark, tmp_path)
    db.ensure("t", {"k": "BIGINT", "g": "BIGINT", "click_count": "BIGINT"}, ["k"])
    make = lambda *x: spark.createDataFrame(list(x), "k long, g long, click_count long")
    keys = ["g"] if how == "groups" else ["k", "g"]
    assert db.apply(make((1, 1, 5), (2, 1, 1)), "t", keys, how, "s", 0)
    db.stage(make((1, 1, 99), (9, 9, 9)), "t")  # dies here: staged, but not merged
    second = make((1, 1, 7), (3, 2, 4))
    with pytest.raises(Exception, match="(?i)not exist|syntax"):
        db.stage(second, "t")
        real, db._q = db._q, lambda n: real("no_such_column" if n == "click_count" else n)
        try:
            db.merge("t", second.columns, keys, how, "s", 1)
        finally:
            db._q = real
    assert rows(db.read("t")) == [(1, 1, 5), (2, 1, 1)] and not db.committed("s", 1)
    assert db.apply(second, "t", keys, how, "s", 1)
    assert rows(db.read("t")) == want
    assert not db.apply(second, "t", keys, how, "s", 1) and not db.merge("t", second.columns, keys, how, "s", 1)
    assert rows(db.read("t")) == want and db.apply(second.limit(0), "t", keys, how, "s", 2)
    assert rows(db.read("t")) == want


def test_ad_command_line_into_a_database(spark, tmp_path):
    """From raw lines to the database's tables by the command line, twice; a user on the list before the stream begins has no clicks."""
    db = database(spark, tmp_path)
    ad_stream.DatabaseResults(db)
    db.execute("INSERT INTO ad_blacklist VALUES (42)")
    settings = tmp_path / "ad.properties"
    settings.write_text(f"jdbc.url={db.url}\njdbc.driver={DERBY}\nad.log={tmp_path}/log\nad.path={tmp_path}/ad\nad.least=2\n")
    write(tmp_path / "log", "p", 1000, "".join(f"{x}\n" for x in [line(10, 1, 1, 5), line(10, 1, 1, 5), line(10, 2, 42, 5), "junk"]).encode())
    run.main(["ad", "--once", "--settings", str(settings)])
    write(tmp_path / "log", "p", 2000, f"{line(10, 3, 1, 5)}\n{line(10, 3, 7, 5)}\n".encode())
    run.main(["ad", "--once", "--settings", str(settings)])
    assert rows(db.read("ad_blacklist")) == [(1,), (42,)]
    assert rows(db.read("ad_stat")) == [("1970-01-11", "p", "c", 5, 3)] and rows(db.read("ad_province_top3")) == [("1970-01-11", "p", 5, 3)]
    assert rows(db.read("ad_user_click_count")) == [("1970-01-11", 1, 5, 2), ("1970-01-11", 7, 5, 1)]
    assert rows(db.read("ad_click_trend")) == [("1970-01-11", "01", "00", 5, 2), ("1970-01-11", "02", "00", 5, 1), ("1970-01-11", "03", "00", 5, 2)]
    assert [(r.value, r.problem) for r in spark.read.parquet(f"{tmp_path}/ad/unreadable").collect()] == [("junk", "fields")]


def test_results_are_published_once(spark, tmp_path):
    make = lambda *x: spark.createDataFrame(list(x), "task_id long, n long")
    path, db = f"{tmp_path}/out", database(spark, tmp_path)
    rule = {"no negative": "min(n) >= 0", "some": "count(*) > 0"}
    for publish, read in ((lambda *a: sinks.publish_task(a[0], path, *a[1:]), lambda: spark.read.parquet(path).select("task_id", "n")), (lambda *a: db.publish_task(a[0], "r", *a[1:]), lambda: db.read("r").select("task_id", "n"))):
        for _ in range(2):
            publish(make((1, 5), (1, 6)), 1, rule)
        publish(make((2, 7)), 2, rule)
        for bad in (make((1, -1)), make()):
            with pytest.raises(sinks.AuditError):
                publish(bad, 1, rule)
        assert rows(read()) == [(1, 5), (1, 6), (2, 7)]
        publish(make((1, 8)), 1, rule)
        assert rows(read()) == [(1, 8), (2, 7)]


def test_partitioned_jdbc_read(spark, tmp_path):
    from behavex.sources import readers

    db = database(spark, tmp_path)
    sinks.to_jdbc(spark.range(1000).select(F.col("id").alias("k")), db.url, "many", driver=DERBY)
    df = readers.jdbc(spark, db.url, "many", partition=("k", 0, 1000, 4), driver=DERBY)
    assert df.rdd.getNumPartitions() == 4 and sorted(r.k for r in df.collect()) == list(range(1000))


def test_ad_settings_default(spark, tmp_path):
    assert Settings({}).integer("ad.least") == 0 and run.database(Settings({})) == {}
