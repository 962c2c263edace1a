"""The jobs' command line: python -m behavex.plans.run JOB TASK_ID --settings FILE.

JOB is session, page, area or ad. The task's parameters come from the database's task table (or --params), the inputs from Parquet tables
of a folder or from the catalog, and each result table goes with its task_id to the database or to a folder: written aside, audited, and put in the
place of an earlier run's rows, so that a job that runs twice has its rows once. The ad job needs no task: it reads raw lines as a stream, until
it is stopped or, with --once, to their end. Settings:

    jdbc.url, jdbc.driver, jdbc.user, jdbc.password   the database
    data.path       folder of user_visit_action, user_info, city_info and product_info; without it they are catalog tables
    output.path     folder for the results; without it they go to the database
    task.session, task.page, task.area                the task to run if the command line names none
    ad.log          folder of the raw-line log; without it kafka.servers and kafka.topic name the source
    ad.path         folder for the stream's checkpoints, lines that can't be read and, without a database, results
    ad.least        clicks of a user on an ad in a day that put it on the blacklist (100)
    ad.lateness     how late a click may be to count (2 days)
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from behavex.params import Settings, TaskParams, task_arguments
from behavex.plans import jobs
from behavex.sources import click_log, readers, sinks
from behavex.streaming import ad_stream

JOBS: dict[str, Callable[[Callable[[str], DataFrame], TaskParams], dict[str, DataFrame]]] = {
    "session": lambda t, p: jobs.session_job(t("user_visit_action"), t("user_info"), p),
    "page": lambda t, p: jobs.page_job(t("user_visit_action"), p),
    "area": lambda t, p: jobs.area_job(t("user_visit_action"), t("city_info"), t("product_info"), p),
}


#: What has to hold of a result table before it is published.
AUDITS = {
    "session_aggr_stat": {"one row": "count(*) = 1", "no negative count": "min(session_count) >= 0"},
    "session_random_extract": {"sessions are distinct": "count(*) = count(DISTINCT session_id)"},
    "top10_category": {"ten at most": "count(*) <= 10", "categories are distinct": "count(*) = count(DISTINCT category_id)"},
    "page_convert_rate": {"one row": "count(*) = 1"},
    "area_top3_product": {"products are known": "count_if(area IS NULL OR product_id IS NULL) = 0"},
}


def database(settings: Settings) -> dict[str, str]:
    """The connection's options that are set."""
    return {k: v for k in ("url", "driver", "user", "password") if (v := settings.text(f"jdbc.{k}")) is not None}


def run(spark: SparkSession, job: str, task_id: int, settings: Settings, params: str | None = None) -> dict[str, DataFrame]:
    """Runs a job and publishes its result tables, each with its task's id, in the place of an earlier run's rows; a table that fails its audit is not published."""
    options = database(settings)
    text = params if params is not None else readers.task_param(spark, options["url"], task_id, **{k: v for k, v in options.items() if k != "url"})
    folder, out = settings.text("data.path"), settings.text("output.path")
    table = (lambda name: readers.parquet(spark, folder, name)) if folder else (lambda name: readers.catalog(spark, name))
    results = JOBS[job](table, TaskParams.parse(text))
    for name, df in results.items():
        results[name] = df = df.select(F.lit(task_id).cast("bigint").alias("task_id"), *df.columns)
        if out:
            sinks.publish_task(df, f"{out}/{name}", task_id, AUDITS.get(name))
        else:
            sinks.Database(spark, **options).publish_task(df, name, task_id, AUDITS.get(name))
    return results


def run_ad(spark: SparkSession, settings: Settings, once: bool = False) -> list[StreamingQuery]:
    """Starts the ad job from raw lines; the caller waits for the streams."""
    options, path, log = database(settings), settings.text("ad.path"), settings.text("ad.log")
    if log:
        click_log.register(spark)
        lines = spark.readStream.format("click_log").load(log)
    else:
        lines = readers.kafka(spark, settings.text("kafka.servers"), settings.text("kafka.topic"))
    if options:
        store = sinks.Database(spark, **options)
        results, trend = ad_stream.DatabaseResults(store), ad_stream.DatabaseResults(store, ad_click_trend="replace")
    else:
        results, trend = ad_stream.ParquetResults(spark, path), ad_stream.ParquetResults(spark, path, ad_click_trend="replace")
    listed = results.read("ad_blacklist")
    return ad_stream.ad_log_job(spark, lines, path, settings.integer("ad.least") or 100, every=not once, lateness=settings.text("ad.lateness") or "2 days", results=results, trend_results=trend, listed=listed)


def main(args: list[str]) -> None:
    parser = argparse.ArgumentParser(description="Runs a job for a task.")
    parser.add_argument("job", choices=sorted([*JOBS, "ad"]))
    parser.add_argument("--settings", required=True)
    parser.add_argument("--params", help="the task's JSON, instead of the database's")
    parser.add_argument("--once", action="store_true", help="ad: stop at the end of the lines that are there")
    given, rest = parser.parse_known_args(args)
    settings = Settings.load(given.settings)
    if given.job == "ad":
        for query in run_ad(SparkSession.builder.appName("ad").getOrCreate(), settings, given.once):
            query.awaitTermination()
        return
    default = settings.integer(f"task.{given.job}") if settings.text(f"task.{given.job}") is not None else None
    run(SparkSession.builder.appName(given.job).getOrCreate(), given.job, task_arguments(rest, default), settings, given.params)


if __name__ == "__main__":
    main(sys.argv[1:])
