"""Keyed streaming state: running totals that expire, and users that are listed once.

State is kept by key in the RocksDB state store, which spills to disk and is checkpointed by its changes. Such queries run
in a session of their own (``stateful``), as the store is chosen by the session. Clicks are counted within each batch of
a task before they are dealt to their keys, so a key that has most of the clicks costs its task a row a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def stateful(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose streams keep their state in RocksDB; the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def combined(clicks: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ts (the latest) and n: clicks of a task counted by key, batch of rows by batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(list(keys)).aggregate([("ts", "max"), ([], "count_all")])
            yield from table.select([*keys, "ts_max", "count_all"]).rename_columns([*keys, "ts", "n"]).to_batches()

    types = dict(clicks.dtypes)
    return clicks.select(*keys, "ts").mapInArrow(count, ", ".join(f"{k} {types[k]}" for k in keys) + ", ts timestamp, n long")


class Totals(StatefulProcessor):
    """A value a key; it expires so long after its last change."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.total = handle.getValueState("total", "n long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total = sum(r.n for r in rows) + (self.total.get()[0] if self.total.exists() else 0)
        self.total.update((total,))
        yield Row(date=key[0], province=key[1], city=key[2], ad_id=key[3], click_count=total)

    def close(self) -> None:
        pass


STAT = "date string, province string, city string, ad_id long, click_count long"


def running_totals(log: DataFrame, ttl_ms: int = 2 * DAY_MS) -> DataFrame:
    """Clicks so far by day, place and ad, a row for each key that a batch changes; ``log`` is of a stateful() session.

    A key without clicks for ``ttl_ms`` of processing time leaves the state; clicks of it after that count from one again.
    """
    keys = ("date", "province", "city", "ad_id")
    counted = combined(log.withColumn("date", F.date_format("ts", "yyyy-MM-dd")), *keys)
    return counted.groupBy(*keys).transformWithState(Totals(ttl_ms), STAT, "Update", "ProcessingTime")


class Listing(StatefulProcessor):
    """A user's clicks by day and ad; the first batch in which one of them reaches the threshold lists the user.

    The state of a listed user is the one flag. Days that the watermark has passed go by a user's one timer, that of the
    first day held. Calls to the state cost the most: counts of a user that a batch lists are not stored at all.
    """

    def __init__(self, threshold: int, keep_ms: int):
        self.threshold, self.keep_ms = threshold, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.user = handle.getValueState("user", "listed boolean, timer long")  # none: nothing is held of the user
        self.counts = handle.getMapState("counts", "day long, ad_id long", "n long")

    def _end(self, day: int) -> int:
        return (day + 1) * DAY_MS + self.keep_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        user = self.user.get()
        if user and user[0]:
            return
        more: dict[tuple[int, int], int] = {}
        for r in rows:
            more[(r.day, r.ad_id)] = more.get((r.day, r.ad_id), 0) + r.n
        if user:
            for (day, ad_id), (n,) in self.counts.iterator():
                if (day, ad_id) in more:
                    more[(day, ad_id)] += n
        reached = min(((*k, n) for k, n in more.items() if n >= self.threshold), default=None)
        if reached:
            if user:
                self.counts.clear()
                self.handle.deleteTimer(user[1])
            self.user.update((True, None))
            day, ad_id, n = reached
            yield Row(user_id=key[0], day=day, ad_id=ad_id, click_count=n)
            return
        for k, n in more.items():
            self.counts.updateValue(k, (n,))
        first = self._end(min(day for day, _ in more))
        if not user or first < user[1]:
            if user:
                self.handle.deleteTimer(user[1])
            self.handle.registerTimer(first)
            self.user.update((False, first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, days = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), set()
        for day, ad_id in list(self.counts.keys()):
            if self._end(day) <= now:
                self.counts.removeKey((day, ad_id))
            else:
                days.add(day)
        if days:
            self.handle.registerTimer(self._end(min(days)))
            self.user.update((False, self._end(min(days))))
        else:
            self.user.clear()
        yield from ()

    def close(self) -> None:
        pass


LISTED = "user_id long, date string, ad_id long, click_count long"


def listed_once(log: DataFrame, threshold: int = 100, watermark: str = "1 day", keep_ms: int = 0) -> DataFrame:
    """user_id with the day and ad (the first of them) that reached the threshold: one row a user, in the batch that lists it.

    A listed user's later clicks count for nothing. ``log`` is of a stateful() session. Days are those of UTC, as the
    timers are; a day's counts go ``keep_ms`` after the watermark has passed its end, and rows behind the watermark are late.
    """
    day = F.floor(F.unix_millis("ts") / DAY_MS).cast("long")
    counted = combined(log.withColumn("day", day), "user_id", "day", "ad_id").withWatermark("ts", watermark)
    found = counted.groupBy("user_id").transformWithState(Listing(threshold, keep_ms), "user_id long, day long, ad_id long, click_count long", "Append", "EventTime")
    return found.select("user_id", F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("date"), "ad_id", "click_count")


def batch_by_batch(df: DataFrame, each, checkpoint: str, mode: str, one: bool = True) -> StreamingQuery:
    """Starts a stream that takes what is there and ends; ``one``: as one batch, whatever the timers say."""
    writer = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if one else writer.trigger(availableNow=True)).start()
