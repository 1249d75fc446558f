"""Tables merged on read, keyed state, sliding windows and the life of streams."""

import datetime
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from clickstrata.sources.changes import Changes
from clickstrata.streaming import ads, lifecycle, state

DAY = "date string, ad_id long, click_count long"
T = datetime.datetime


def changes(path, merge="sum"):
    keys = ("date",) if merge == "group" else ("date", "ad_id")
    return Changes(str(path), keys, DAY, merge)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), DAY)


def held(table, spark, **kw):
    return {(r.date, r.ad_id): r.click_count for r in table.read(spark, **kw).collect()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_batch_writes_its_own_keys_only(spark, tmp_path):
    table = changes(tmp_path / "t")
    table.add(spark.range(200_000).select(F.lit("2024-01-01").alias("date"), F.col("id").alias("ad_id"), (F.col("id") * 7919).alias("click_count")), 0)
    table.add(frame(spark, ("2024-01-01", 5, 1)), 1)
    assert size(tmp_path / "t/batch_id=1") * 100 < size(tmp_path / "t/batch_id=0")
    assert held(table, spark)[("2024-01-01", 5)] == 5 * 7919 + 1 and table.read(spark).count() == 200_000


def test_a_broken_batch_is_not_read_and_its_next_try_counts_once(spark, tmp_path):
    table = changes(tmp_path / "t")
    table.add(frame(spark, ("2024-01-01", 1, 5), ("2024-01-02", 1, 1)), 0)
    table.add(frame(spark, ("2024-01-02", 1, 2)), 1)
    os.remove(tmp_path / "t/batch_id=1/_SUCCESS")  # broken off: files are there, the mark is not
    assert held(table, spark) == {("2024-01-01", 1): 5, ("2024-01-02", 1): 1}
    for _ in range(2):
        table.add(frame(spark, ("2024-01-02", 1, 2), ("2024-01-02", 2, 7)), 1)
        assert held(table, spark) == {("2024-01-01", 1): 5, ("2024-01-02", 1): 3, ("2024-01-02", 2): 7}
    assert held(table, spark, before=1) == {("2024-01-01", 1): 5, ("2024-01-02", 1): 1}
    assert held(table, spark, days=["2024-01-01"]) == {("2024-01-01", 1): 5}


@pytest.mark.parametrize("merge", ["sum", "newest", "group"])
def test_compaction_changes_no_result(spark, tmp_path, merge):
    table, plain = changes(tmp_path / "t", merge), changes(tmp_path / "p", merge)
    for i in range(8):
        batch = frame(spark, (f"2024-01-0{1 + i % 3}", i % 2, i + 1), (f"2024-01-0{1 + i % 3}", 9, 1))
        table.add(batch, i, every=3)
        plain.add(batch, i, every=100)
        rows = lambda t: sorted(map(tuple, t.read(spark).collect()))
        assert rows(table) == rows(plain)
    names = os.listdir(tmp_path / "t")
    assert "batch_id=0" not in names and {"batch_id=6", "batch_id=7"} <= set(names) and os.listdir(tmp_path / "t/_base") != []
    shutil.copytree(tmp_path / "t/_base/to=5", tmp_path / "t/_base/to=7")
    os.remove(tmp_path / "t/_base/to=7/_SUCCESS")  # a compaction that was broken off
    assert rows(table) == rows(plain)
    table.compact(spark, 7)
    table.compact(spark, 7)
    assert rows(table) == rows(plain)


def clicks(spark, *rows):
    """(time, user, ad) as an ad log."""
    return spark.createDataFrame([(t, "p", "c", u, a) for t, u, a in rows], "ts timestamp, province string, city string, user_id long, ad_id long")


def stream(session, df, path):
    df.write.mode("append").parquet(path)
    return session.readStream.schema(df.schema).parquet(path)


def totals_run(spark, base, df, ttl_ms):
    own = state.stateful(spark)
    table = ads.stats(f"{base}/out", "newest")
    log = stream(own, df, f"{base}/in")
    state.batch_by_batch(state.running_totals(log, ttl_ms), lambda d, i: table.write(d, i), f"{base}/cp", "update").awaitTermination()
    return {(r.date, r.ad_id): r.click_count for r in table.read(spark).collect()}


def test_running_totals_survive_restarts_and_replays(spark, tmp_path):
    day, base = T(2024, 1, 1, 12), str(tmp_path)
    totals_run(spark, base, clicks(spark, (day, 1, 1), (day, 2, 1), (day, 2, 2)), state.DAY_MS)
    want = {("2024-01-01", 1): 4, ("2024-01-01", 2): 1, ("2024-01-02", 1): 1}
    assert totals_run(spark, base, clicks(spark, *[(day, 1, 1)] * 2, (T(2024, 1, 2), 1, 1)), state.DAY_MS) == want
    commits = sorted(f for f in os.listdir(f"{base}/cp/commits") if f.isdigit())
    for name in (commits[-1], f".{commits[-1]}.crc"):
        os.remove(f"{base}/cp/commits/{name}")  # the last batch did not end: it is repeated
    assert totals_run(spark, base, clicks(spark, (day, 1, 3)).limit(0), state.DAY_MS) == want
    assert "RocksDB" not in str(spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none"))


def test_a_total_expires(spark, tmp_path):
    day, base = T(2024, 1, 1, 12), str(tmp_path)
    totals_run(spark, base, clicks(spark, (day, 1, 1), (day, 2, 1)), 1)
    time.sleep(1.1)
    assert totals_run(spark, base, clicks(spark, (day, 1, 1)), 1) == {("2024-01-01", 1): 1}  # counted from one again


def listed_run(spark, base, df, watermark="1 day"):
    own = state.stateful(spark)
    events = state.listed_once(stream(own, df, f"{base}/in"), 3, watermark)
    each = lambda d, i: d.write.mode("overwrite").parquet(f"{base}/out/batch_id={i}")
    state.batch_by_batch(events, each, f"{base}/cp", "append", False).awaitTermination()
    rows = spark.read.schema(f"{state.LISTED}, batch_id long").parquet(f"{base}/out").collect()
    return sorted((r.user_id, r.date, r.ad_id, r.click_count) for r in rows)


def test_a_user_is_listed_once_and_a_replay_adds_nothing(spark, tmp_path):
    base, noon = str(tmp_path), T(2024, 1, 1, 12)
    first = clicks(spark, *[(noon, 7, 2)] * 3, *[(noon, 7, 1)] * 4, *[(noon, 8, 1)] * 2)
    assert listed_run(spark, base, first) == [(7, "2024-01-01", 1, 4)]
    second = clicks(spark, *[(noon, 7, 1)] * 9, (noon, 8, 1), (T(2024, 1, 2), 9, 1))
    want = [(7, "2024-01-01", 1, 4), (8, "2024-01-01", 1, 3)]
    assert listed_run(spark, base, second) == want
    for name in os.listdir(f"{base}/cp/commits"):
        if name.strip(".").split(".")[0] != "0" and name[-1].isdigit() or name.endswith(".crc") and not name.startswith(".0"):
            os.remove(f"{base}/cp/commits/{name}")  # all batches but the first are repeated
    assert listed_run(spark, base, first.limit(0)) == want


def test_the_state_of_a_day_goes_by_its_timer(spark, tmp_path):
    base, own = str(tmp_path), state.stateful(spark)
    listed_run(spark, base, clicks(spark, (T(2024, 1, 1, 12), 1, 1), (T(2024, 1, 1, 12), 2, 1)), "1 hour")
    listed_run(spark, base, clicks(spark, (T(2024, 1, 3, 12), 1, 1)), "1 hour")
    listed_run(spark, base, clicks(spark, (T(2024, 1, 3, 12), 3, 1)), "1 hour")
    counts = own.read.format("statestore").option("stateVarName", "counts").load(f"{base}/cp").collect()
    days = {r.asDict(True)["user_map_key"]["day"] for r in counts} if counts and "user_map_key" in counts[0].asDict() else {r.asDict(True)["map_key"]["day"] for r in counts}
    assert days == {19725}  # 3 January 2024


def test_sliding_hour(spark, tmp_path):
    base, at = str(tmp_path), lambda h, m, s=0: T(2024, 1, 1, h, m, s)

    def run(*rows):
        windows = ads.hour_windows(stream(spark, clicks(spark, *rows), f"{base}/in"), "10 minutes")
        writer = windows.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
        writer.option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{base}/out")

    run((at(10, 0, 5), 1, 1), (at(10, 0, 15), 2, 1), (at(10, 0, 59), 3, 1), (at(10, 1), 4, 1), (at(10, 0, 30), 1, 2))
    run((at(13, 0), 1, 9))
    found = run((at(10, 0, 40), 9, 1), (at(16, 0), 1, 9))  # the first of them is late: behind the watermark
    seen = lambda t: sorted((r.minute, r.ad_id, r.click_count) for r in ads.window_at(found, t).collect())
    assert seen("2024-01-01 10:00:10") == [(at(10, 0), 1, 1)]
    assert seen("2024-01-01 10:00:40") == [(at(10, 0), 1, 2), (at(10, 0), 2, 1)]
    assert seen("2024-01-01 10:30:00") == seen("2024-01-01 11:00:00") == [(at(10, 0), 1, 3), (at(10, 0), 2, 1), (at(10, 1), 1, 1)]
    assert seen("2024-01-01 11:00:10") == [(at(10, 0), 1, 2), (at(10, 0), 2, 1), (at(10, 1), 1, 1)]
    assert seen("2024-01-01 11:01:00") == [(at(10, 1), 1, 1)] and seen("2024-01-01 11:01:10") == []
    assert found.where("minute < '2024-01-01 10:01:00' AND ad_id = 1").count() <= 11  # rows a minute, not a window


def test_a_longer_list_is_seen_by_the_next_start(spark, tmp_path):
    base, noon = str(tmp_path), T(2024, 1, 1, 12)
    black = lambda *users: spark.createDataFrame([(u,) for u in users], "user_id long").write.mode("append").parquet(f"{base}/black")
    black(1)

    def run(log):
        writer = ads.filtered_by(log, spark.read.parquet(f"{base}/black")).writeStream.format("parquet").option("path", f"{base}/out")
        return writer.option("checkpointLocation", f"{base}/cp").start()

    query = run(stream(spark, clicks(spark, (noon, 1, 1), (noon, 2, 1)), f"{base}/in"))
    query.processAllAvailable()
    black(2)
    clicks(spark, (noon, 2, 2), (noon, 3, 2)).write.mode("append").parquet(f"{base}/in")
    query.processAllAvailable()
    query.stop()
    query = run(stream(spark, clicks(spark, (noon, 2, 3), (noon, 3, 3)), f"{base}/in"))
    query.processAllAvailable()
    query.stop()
    assert sorted((r.ad_id, r.user_id) for r in spark.read.parquet(f"{base}/out").collect()) == [(1, 2), (2, 2), (2, 3), (3, 3)]


def test_a_stop_in_mid_stream_loses_and_doubles_nothing(spark, tmp_path):
    base, noon = str(tmp_path), T(2024, 1, 1, 12)
    for i in range(6):
        clicks(spark, *[(noon, 10 * i + k, i) for k in range(4)]).coalesce(1).write.mode("append").parquet(f"{base}/in")
    schema, progress = clicks(spark, (noon, 1, 1)).schema, lifecycle.Progress()
    spark.streams.addListener(progress)

    def start(slow):
        def each(df, i):
            df.write.mode("overwrite").parquet(f"{base}/out/batch_id={i}")
            if i == 1 and slow:
                open(f"{base}/stop", "w").close()
            time.sleep(0.5 if slow else 0)

        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        return log.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()

    try:
        assert lifecycle.run_until_marked(start(True), spark, f"{base}/stop") is False
        done = len(os.listdir(f"{base}/out"))
        assert 2 <= done < 6
        os.remove(f"{base}/stop")
        assert lifecycle.run_until_marked(start(False), spark, f"{base}/stop") is True
        rows = sorted(r.user_id for r in spark.read.parquet(f"{base}/out").collect())
        assert rows == sorted(10 * i + k for i in range(6) for k in range(4))
        for _ in range(50):
            table = progress.table(spark)
            if table.agg(F.sum("rows")).first()[0] == 24:
                break
            time.sleep(0.1)
        assert table.select("batch_id").distinct().count() == 6 and table.where("duration_ms > 0").count() >= 6
    finally:
        spark.streams.removeListener(progress)
