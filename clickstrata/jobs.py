"""The four jobs: parameters of a task, tables in, results stored under the task's id.

Each job takes its input tables and a folder, writes its result tables there through the sinks, and returns
their paths by name. Running a task again replaces its results. ``Input`` finds tables by name, and the actions with the
task's first and last day, by which the scan is cut; so a job runs on the catalog, on synthetic views or on what a test
hands it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .operators import funnel, product, session
from .plans.params import TaskParams, find_task
from .sources import sinks, tables
from .sources.folders import new_folder
from .streaming import ads as stream_ads

Input = Callable[..., DataFrame]


def _store(out: str, task_id: int, results: dict[str, DataFrame]) -> dict[str, str]:
    paths = {name: f"{out}/{name}" for name in results}
    for name, df in results.items():
        sinks.append(df, paths[name], task_id)
    return paths


def _actions(source: Input, p: TaskParams) -> DataFrame:
    return tables.date_range(source("user_visit_action", p.start_date, p.end_date), p.start_date, p.end_date)


def store_counted(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``kept`` as a table in the shared folder, and the row of counters that writing it left. Tasks that are run again count once."""
    spark, path, counters = kept.sparkSession, new_folder(kept.sparkSession, "kept"), Observation()
    session.counted(kept, counters).write.parquet(path)
    row = spark.createDataFrame([tuple(counters.get[c] for c in session.COUNTERS)], ", ".join(f"{c} long" for c in session.COUNTERS))
    return spark.read.schema(kept.schema).parquet(path), row


def session_job(source: Input, tasks: DataFrame, task_id: int, out: str, sample: int = 1000) -> dict[str, str]:
    """Distribution, sample, top categories and their top sessions of the sessions that match the task.

    ``session_detail`` gets the actions of the sampled sessions and those of the top sessions (a session that is on
    top in two categories, or sampled too, is there once for each). The kept actions are read many times: persisted.
    The pass that stores the kept sessions counts them by length on its way, so the distribution reads nothing again.
    """
    p = find_task(tasks, task_id)
    actions = _actions(source, p)
    kept, counters = store_counted(session.keep(session.full_info(session.roll_up(actions), source("user_info")), p))
    own = session.of_sessions(actions, kept).persist()
    sampled = session.random_extract(kept, sample)
    top = session.top_categories(own)
    top_sessions = session.top_sessions(own, top)
    detail = (
        session.detail(session.of_sessions(own, sampled))
        .unionByName(session.top_session_detail(own, top_sessions).drop("category_id"))
    )
    paths = _store(
        out,
        task_id,
        {
            "session_aggr_stat": session.aggr_stat_of(counters),
            "session_random_extract": sampled,
            "session_detail": detail,
            "top10_category": top,
            "top10_session": top_sessions,
        },
    )
    own.unpersist()
    return paths


def page_job(source: Input, tasks: DataFrame, task_id: int, out: str) -> dict[str, str]:
    """Conversion along the task's flow of pages, as one string."""
    p = find_task(tasks, task_id)
    rates = funnel.convert_rate(_actions(source, p), p.page_flow)
    return _store(out, task_id, {"page_convert_rate": funnel.convert_rate_string(rates)})


def product_job(source: Input, tasks: DataFrame, task_id: int, out: str) -> dict[str, str]:
    """The most clicked products of each area."""
    p = find_task(tasks, task_id)
    counts = product.area_count(product.click_basic(_actions(source, p), source("city_info")))
    return _store(out, task_id, {"area_top3_product": product.area_top(product.full_product(counts, source("product_info")))})


def ad_job(lines: DataFrame, out: str, checkpoint: str, threshold: int = 100, available_now: bool = False) -> StreamingQuery:
    """The ad stream from log lines (``value``): see streaming.ads.job()."""
    return stream_ads.job(tables.parse_ad_log(lines), stream_ads.Tables(out), checkpoint, threshold, available_now=available_now)


def results(spark, path: str) -> DataFrame:
    """A stored result table with its ``task_id``."""
    return spark.read.parquet(path).withColumn("task_id", F.col("task_id").cast("long"))
