"""Ad clicks as Structured Streaming queries; each ends in foreachBatch, so a repeated batch replaces itself.

Input streams have ts (timestamp), province, city, user_id, ad_id. Result tables are merged on read (sources.changes): a
batch writes what it changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ads
from ..sources.changes import Changes


USER_KEYS = ("date", "user_id", "ad_id")
STAT_KEYS = ("date", "province", "city", "ad_id")
TREND_KEYS = ("date", "hour", "minute", "ad_id")
_USER = "date string, user_id long, ad_id long, click_count long"
_STAT = "date string, province string, city string, ad_id long, click_count long"
_TREND = "date string, hour string, minute string, ad_id long, click_count long"


def user_counts(path: str) -> Changes:
    """Clicks a day, user and ad: batches add."""
    return Changes(path, USER_KEYS, _USER)


def listed_users(path: str) -> Changes:
    """Users by the batch that listed them."""
    return Changes(path, ("user_id",), "user_id long, listed boolean", "newest", by=None)


def stats(path: str, merge: str = "sum") -> Changes:
    return Changes(path, STAT_KEYS, _STAT, merge)


def tops(path: str) -> Changes:
    """A province's top ads of a day, each time as a whole."""
    return Changes(path, ("date", "province"), "date string, province string, ad_id long, click_count long", "group")


def trend(path: str, merge: str = "sum") -> Changes:
    return Changes(path, TREND_KEYS, _TREND, merge)


def _start(df: DataFrame, each, checkpoint: str, available_now: bool, mode: str = "update", every: str = "5 seconds") -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def ad_stat(log: DataFrame, path: str, checkpoint: str, available_now: bool = False, watermark: str | None = "2 days") -> StreamingQuery:
    """Running totals by day, place and ad. State goes once a day is older than the watermark; without one it stays."""
    late = log.withWatermark("ts", watermark) if watermark else log
    by = late.groupBy(F.window("ts", "1 day").alias("w"), "province", "city", "ad_id").count()
    flat = by.select(F.date_format("w.start", "yyyy-MM-dd").alias("date"), "province", "city", "ad_id", F.col("count").alias("click_count"))
    return _start(flat, lambda df, i: stats(path, "newest").add(df, i), checkpoint, available_now)


def click_trend(log: DataFrame, path: str, checkpoint: str, available_now: bool = False, watermark: str | None = "2 hours") -> StreamingQuery:
    """Clicks a minute and ad, of all users."""
    late = log.withWatermark("ts", watermark) if watermark else log
    by = late.groupBy(F.window("ts", "1 minute").alias("w"), "ad_id").count()
    part = lambda f, name: F.date_format("w.start", f).alias(name)
    flat = by.select(part("yyyy-MM-dd", "date"), part("HH", "hour"), part("mm", "minute"), "ad_id", F.col("count").alias("click_count"))
    return _start(flat, lambda df, i: trend(path, "newest").add(df, i), checkpoint, available_now)


def hour_windows(log: DataFrame, watermark: str | None = "1 hour", span: int = 3600, slide: int = 10) -> DataFrame:
    """The trend of the sliding hour: clicks a minute and ad in each window of ``span`` seconds that ends on a multiple of ``slide``.

    A window's clicks of one minute depend on that minute only: they change where a pane of ``slide`` seconds comes in at
    the window's end, or goes out at its beginning. So a minute's state is its panes' counts (a click is counted once, not
    once a window), and a minute gives rows (window_from, window_to, minute, ad_id, click_count): all windows that end from
    ``window_from`` to ``window_to`` have so many clicks. Windows without clicks have no row. A stream gives a minute's rows
    once the watermark has passed it; rows that come later are dropped, as Spark counts them.
    """
    if 60 % slide or span % 60:
        raise ValueError("panes must fill a minute, and minutes the window")
    panes = 60 // slide
    pane = (F.second("ts") / slide).cast("int")
    late = log.withWatermark("ts", watermark) if watermark else log
    counts = [F.count_if(pane == i).alias(f"p{i}") for i in range(panes)]
    by = late.groupBy(F.window("ts", "1 minute").alias("w"), "ad_id").agg(*counts)
    step = lambda i: F.timestamp_seconds(F.unix_seconds("w.start") + i)
    total = lambda some: sum((F.col(f"p{i}") for i in some), F.lit(0).cast("long"))
    row = lambda a, b, some: F.struct(step(a).alias("window_from"), step(b).alias("window_to"), total(some).alias("click_count"))
    # in come the panes one by one, all of them stay for the rest of the span, then out they go
    rows = [row(slide * (i + 1), slide * (i + 1), range(i + 1)) for i in range(panes - 1)]
    rows.append(row(60, span, range(panes)))
    rows += [row(span + slide * (i + 1), span + slide * (i + 1), range(i + 1, panes)) for i in range(panes - 1)]
    flat = by.select(F.col("w.start").alias("minute"), "ad_id", F.inline(F.array(*rows)))
    return flat.where("click_count > 0").select("window_from", "window_to", "minute", "ad_id", "click_count")


def window_at(windows: DataFrame, end) -> DataFrame:
    """minute, ad_id, click_count of the one window that ends at ``end`` (a column or a time)."""
    end = F.lit(end).cast("timestamp") if isinstance(end, str) else end
    return windows.where((F.col("window_from") <= end) & (end <= F.col("window_to"))).select("minute", "ad_id", "click_count")


@dataclass(frozen=True)
class Tables:
    """Where the job keeps its results."""

    base: str

    def __getattr__(self, name: str) -> str:
        return f"{self.base}/{name}"


def black_users(spark, path: str, before: int | None = None) -> DataFrame:
    """The users listed so far, read anew at each call; with ``before`` by earlier batches only."""
    return listed_users(path).read(spark, before).select("user_id")


def _count_users(good: DataFrame, batch_id: int, path: str, blacklist_path: str, threshold: int) -> None:
    """Adds a batch's clicks to the users' counts and lists those that reach the threshold by it."""
    counts, table = ads.user_click_count(good), user_counts(path)
    table.add(counts, batch_id)
    changed = table.rows(good.sparkSession, batch_id + 1, batch_id - 1).select(*USER_KEYS)
    totals = table.read(good.sparkSession, batch_id + 1).join(changed, list(USER_KEYS), "left_semi")
    listed_users(blacklist_path).add(ads.blacklist(totals, threshold).withColumn("listed", F.lit(True)), batch_id)


def filtered(log: DataFrame, path: str, blacklist_path: str, checkpoint: str, threshold: int = 100, available_now: bool = False) -> StreamingQuery:
    """Running counts a day, user and ad, of users not on the list, which each batch reads anew and then extends.

    Order within a batch: drop listed users' clicks, add the rest to the day counts, list users that reach the
    threshold. A user listed by a batch is filtered from the next one on.
    """

    def each(df: DataFrame, i: int) -> None:
        _count_users(ads.without(df, black_users(df.sparkSession, blacklist_path, i)), i, path, blacklist_path, threshold)

    return _start(log, each, checkpoint, available_now, "append")


def job(log: DataFrame, out: Tables, checkpoint: str, threshold: int = 100, top: int = 3, available_now: bool = False) -> StreamingQuery:
    """The whole ad job on one stream: user counts, list of users, totals and top ads over the filtered log, trend over the raw one."""

    def each(df: DataFrame, i: int) -> None:
        df = df.persist()
        good = ads.without(df, black_users(df.sparkSession, out.ad_blacklist, i)).persist()
        _count_users(good, i, out.ad_user_click_count, out.ad_blacklist, threshold)
        totals, places = stats(out.ad_stat), ["date", "province"]
        totals.add(ads.stat(good), i)
        changed = totals.rows(df.sparkSession, i + 1, i - 1).select(*places).distinct().persist()
        days = [r[0] for r in changed.select("date").distinct().collect()]  # days of one batch
        whole = totals.read(df.sparkSession, i + 1, days).join(changed, places, "left_semi")
        tops(out.ad_province_top3).add(ads.province_top(whole, top), i)
        trend(out.ad_click_trend).add(ads.click_trend(df), i)
        changed.unpersist()
        good.unpersist()
        df.unpersist()

    return _start(log, each, checkpoint, available_now, "append")


def results(spark, out: Tables, name: str) -> DataFrame:
    """A result table of the job, merged."""
    table = {
        "ad_user_click_count": user_counts,
        "ad_blacklist": listed_users,
        "ad_stat": stats,
        "ad_province_top3": tops,
        "ad_click_trend": trend,
    }[name](getattr(out, name))
    return table.read(spark).drop("listed")


def filtered_by(log: DataFrame, black: DataFrame) -> DataFrame:
    """Clicks of users that are not on a stored list, as an anti join in the stream's own plan.

    The list's files are those that ``black`` found when the query started: a longer list is seen from the next start on.
    Where each batch must see the newest list, filtered() reads it by batch.
    """
    return log.join(black.select("user_id").distinct(), "user_id", "left_anti")


def run(query: StreamingQuery, seconds: int | None = None) -> bool:
    """Waits for the query's end, at most so long, then stops it; whether it ended by itself. Its failure is raised."""
    try:
        return query.awaitTermination(seconds) if seconds else query.awaitTermination() is None
    finally:
        query.stop()
