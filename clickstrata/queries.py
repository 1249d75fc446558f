"""The registered queries and, for each, independent SQL over the same stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs
from .functions import scalars as fn
from .functions import sql as sql_functions
from .operators import ads, funnel, product, session
from .plans.config import Config, settings
from .plans.params import TaskParams, task_rows
from .sources import sinks, tables
from .sources.folders import new_folder
from .streaming import ads as stream_ads
from .streaming import state as stream_state

PARAMS = TaskParams(
    start_date="2024-01-03",
    end_date="2024-01-28",
    start_age=20,
    end_age=60,
    professionals=("AUTOMOBILE", "BUILDING", "MACHINERY"),
    category_ids=(1, 2, 3, 5, 7, 11),
)
ALL_PARAMS = TaskParams(
    start_age=19,
    end_age=65,
    professionals=("AUTOMOBILE", "BUILDING", "MACHINERY"),
    cities=tuple(f"city{i}" for i in range(0, 25, 2)),
    sex="male",
    keywords=("kw1", "kw3", "kw5", "kw7"),
    category_ids=(1, 2, 3, 5, 7, 11),
)
FLOW = (1, 2, 3, 4)
#: A stored task, as the jobs find it.
TASKS = [
    (1, "sessions", '{"startAge":["20"],"endAge":["60"],"professionals":["AUTOMOBILE,BUILDING,MACHINERY"],"categoryIds":["1,2,3,5,7,11"]}'),
    (2, "pages", '{"pageFlow":["1,2,3,4"]}'),
    (3, "products", '{"startDate":["2024-01-01"],"endDate":["2024-01-30"]}'),
    (4, "days", '{"startDate":["2024-01-03"],"endDate":["2024-01-28"],"sex":["male"],"cities":["city1,city2"],"keywords":["kw1"]}'),
]
PROPERTIES = """
# a job's settings
local = true
task.id.sessions = 1
kafka.topics: ads
blacklist.threshold = 3
"""
#: Ends of the first and the second batch of the replayed ad log.
BATCH_ENDS = ("2024-01-10 12:00:00", "2024-01-20 12:00:00")
THRESHOLD = 3
SAMPLE = 1000


def _utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def _actions(spark, d) -> DataFrame:
    _utc(spark)
    return tables.user_visit_action(spark, d)


def _ranged(spark, d) -> DataFrame:
    """The days of the parameters, cut in the scan."""
    _utc(spark)
    return tables.user_visit_action(spark, d, PARAMS.start_date, PARAMS.end_date)


def _full(spark, d) -> DataFrame:
    return session.full_info(session.roll_up(_actions(spark, d)), tables.user_info(spark, d))


def _kept(spark, d) -> DataFrame:
    return session.keep(_full(spark, d), PARAMS)


def _kept_actions(spark, d) -> DataFrame:
    return session.of_sessions(_actions(spark, d), _kept(spark, d))


def _log(spark, d) -> DataFrame:
    _utc(spark)
    return tables.ad_log(spark, d)


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("start_time", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss")) if "start_time" in df.columns else df


def _area_full(spark, d) -> DataFrame:
    clicks = product.click_basic(_actions(spark, d), tables.city_info(spark, d))
    return product.full_product(product.area_count(clicks), tables.product_info(spark, d))


def _black(spark, d) -> DataFrame:
    return ads.blacklist(ads.user_click_count(_log(spark, d)), THRESHOLD)


def _streamed(spark, d, start, table) -> DataFrame:
    """Runs a stream over the ad log, stored as three files in no order of time, to its end; then its table."""
    base = new_folder(spark, "behaviour")
    log = _log(spark, d)
    log.repartitionByRange(3, "ts").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    query = start(stream, f"{base}/out", f"{base}/checkpoint", True, None)  # a replay of stored rows has no late ones
    query.awaitTermination()
    return table(f"{base}/out", "newest").read(spark)


def _parts(log: DataFrame) -> list[DataFrame]:
    """The ad log as three batches in order of time."""
    ends, out = [None, *BATCH_ENDS, None], []
    for low, high in zip(ends, ends[1:]):
        part = log if low is None else log.where(F.col("ts") >= F.lit(low).cast("timestamp"))
        out.append(part if high is None else part.where(F.col("ts") < F.lit(high).cast("timestamp")))
    return out


def _by_batch(log: DataFrame, write, start) -> str:
    """The three batches of a log come in one after the other: each is written as many files, then the stream runs to its end, on one checkpoint. The folder."""
    base = new_folder(log.sparkSession, "behaviour")
    for part in _parts(log):
        write(part, f"{base}/in")
        start(f"{base}/in", base).awaitTermination()
    return base


def _append_lines(part: DataFrame, path: str) -> None:
    tables.ad_log_lines(part).write.mode("append").text(path)


def _append_rows(part: DataFrame, path: str) -> None:
    part.write.mode("append").parquet(path)


def _ad_job(spark, d, table: str) -> DataFrame:
    """One result table of the ad job after its three batches."""
    start = lambda path, base: jobs.ad_job(tables.text_lines(spark, path, None), f"{base}/out", f"{base}/checkpoint", THRESHOLD, True)
    base = _by_batch(_log(spark, d), _append_lines, start)
    return stream_ads.results(spark, stream_ads.Tables(f"{base}/out"), table)


def _stored_stream(spark, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def _running_totals(spark, d) -> DataFrame:
    """Totals from keyed state after three batches: a key's last row."""
    log = _log(spark, d)
    own = stream_state.stateful(spark)

    def start(path, base):
        totals = stream_state.running_totals(_stored_stream(own, path, log.schema))
        each = lambda df, i: stream_ads.stats(f"{base}/out", "newest").write(df, i)
        return stream_state.batch_by_batch(totals, each, f"{base}/checkpoint", "update")

    return stream_ads.stats(f"{_by_batch(log, _append_rows, start)}/out", "newest").read(spark)


def _listed_once(spark, d) -> DataFrame:
    """The events of users that are listed, from keyed state."""
    log = _log(spark, d)
    own = stream_state.stateful(spark)

    def start(path, base):
        events = stream_state.listed_once(_stored_stream(own, path, log.schema), THRESHOLD)
        each = lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out/batch_id={i}")
        return stream_state.batch_by_batch(events, each, f"{base}/checkpoint", "append", False)

    base = _by_batch(log, _append_rows, start)
    return spark.read.schema(f"{stream_state.LISTED}, batch_id long").parquet(f"{base}/out").drop("batch_id")


def _hour_windows(spark, d) -> DataFrame:
    """The trend of the sliding hour after three batches; a last, empty minute far ahead closes all windows."""
    log = _log(spark, d)

    def start(path, base):
        windows = stream_ads.hour_windows(_stored_stream(spark, path, log.schema), "1 hour")
        writer = windows.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
        return writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

    base = _by_batch(log, _append_rows, start)
    closing = log.agg(F.max("ts").alias("ts")).select(
        (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), *[F.lit(None).cast(t).alias(c) for c, t in log.dtypes if c != "ts"]
    )
    closing.where("ts IS NOT NULL").write.mode("append").parquet(f"{base}/in")
    start(f"{base}/in", base).awaitTermination()
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    found = spark.read.schema("window_from timestamp, window_to timestamp, minute timestamp, ad_id long, click_count long").parquet(f"{base}/out")
    return found.select(shown("window_from"), shown("window_to"), shown("minute"), "ad_id", "click_count")


def _anti_joined(spark, d) -> DataFrame:
    """The stream without the users of a stored list, joined in the stream's own plan."""
    log, black = _log(spark, d), f"{new_folder(spark, 'behaviour')}/black"
    _black(spark, d).write.parquet(black)

    def start(path, base):
        good = stream_ads.filtered_by(_stored_stream(spark, path, log.schema), spark.read.parquet(black))
        writer = good.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
        return writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

    found = spark.read.schema(log.schema).parquet(f"{_by_batch(log, _append_rows, start)}/out")
    return found.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


_AD_TABLES = ("ad_user_click_count", "ad_blacklist", "ad_stat", "ad_province_top3", "ad_click_trend")


def _parsed_stream(spark, d) -> DataFrame:
    """The log read back by the line parser in a stream."""

    def start(path, base):
        writer = tables.parse_ad_log(tables.text_lines(spark, path, None)).writeStream.format("parquet").option("path", f"{base}/out")
        return writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

    base = _by_batch(_log(spark, d), _append_lines, start)
    return spark.read.parquet(f"{base}/out").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def _tasks(spark) -> DataFrame:
    return spark.createDataFrame(TASKS, "task_id long, task_name string, task_param string")


def _job(job, name: str):
    """A stored result table of a job run on the views."""

    def run(spark, d) -> DataFrame:
        _utc(spark)
        number = {"session_job": 1, "page_job": 2, "product_job": 3}[job.__name__]
        source = lambda table, *days: tables.source(spark, table, d, Config.parse(PROPERTIES), *days)
        return jobs.results(spark, job(source, _tasks(spark), number, new_folder(spark, "behaviour"))[name])

    return run


def _jdbc(spark, d, name: str, df: DataFrame) -> DataFrame:
    """``df`` written to a database and read back; the bundled one lives in this process' memory."""
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex}"
    sinks.jdbc(df, f"{url};create=true", name)
    return tables.jdbc(spark, url, name).select(*[F.col(c.upper()).alias(c) for c in df.columns])


def _derived_tasks(spark, d) -> DataFrame:
    """A task a nation: its city, ages, days and more, as stored JSON."""
    n, text = F.col("n_nationkey"), lambda c: F.array(c.cast("string"))
    day = lambda k: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int")), "yyyy-MM-dd")
    cities = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("city"), ((n + 7 * i) % 25).cast("string"))), ",")
    pairs = [
        ("startDate", F.when(n % 3 != 0, text(day(n % 8)))),
        ("endDate", F.when(n % 4 != 0, text(day(n % 9 + 15)))),
        ("startAge", F.when(n % 2 == 0, text(n + 18))),
        ("endAge", text(n + 40)),
        ("cities", F.when(n % 5 != 0, text(cities))),
        ("sex", F.when(n % 5 == 1, text(F.lit("male")))),
        ("professionals", F.when(n % 5 == 0, text(F.lit("BUILDING,MACHINERY")))),
        ("keywords", F.when(n % 6 == 2, text(F.lit("kw1,kw2,kw3")))),
        ("categoryIds", F.when(n % 7 == 3, text(F.concat_ws(",", n % 20, (n + 3) % 20, (n + 5) % 20)))),
    ]
    given = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs])), lambda k, v: v.isNotNull())
    return tables.stored(spark, d, "nation").select(n.cast("long").alias("task_id"), F.to_json(given).alias("task_param"))


def _task_params(spark, d) -> DataFrame:
    """The tasks' JSON as columns, read in the plan."""
    joined = lambda c: F.array_join(c, ",").alias(c)
    rows = task_rows(_derived_tasks(spark, d))
    return rows.select("task_id", "start_date", "end_date", "start_age", "end_age", joined("professionals"), joined("cities"), "task_sex", joined("task_keywords"), joined("category_ids"))


def _config(spark, d) -> DataFrame:
    """Settings from stored lines, some of them comments, blank, or set twice: the last one counts."""
    n, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    lines = F.array(
        F.concat(F.lit("# "), name, F.lit("=comment")),
        F.concat(F.lit("  city."), n, F.lit(".name = first")),
        F.lit(""),
        F.concat(F.lit("city."), n, F.lit(".name: "), name, F.lit(" = "), n, F.lit(" ")),
        F.concat(F.lit("region."), n, F.lit("="), F.col("n_regionkey").cast("string")),
    )
    rows = tables.stored(spark, d, "nation").select((F.col("n_nationkey") * 10).alias("base"), F.posexplode(lines).alias("k", "value"))
    return settings(rows.select("value", (F.col("base") + F.col("k")).alias("at")))


def _tasks_sessions(spark, d) -> DataFrame:
    return session.keep_by_task(_actions(spark, d), tables.user_info(spark, d), task_rows(_derived_tasks(spark, d)))


def _catalog_actions(spark, d, name: str) -> DataFrame:
    """The actions as a table of the catalog, partitioned by date, in place of the one that an earlier run saved under its name."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return tables.save_table(spark, _actions(spark, d), name)


def weekend_clicks(actions: DataFrame) -> DataFrame:
    """Clicks of each day of a weekend: the days are a table of their own, by which the scan is pruned while the query runs."""
    days = actions.select("date").distinct().select("date", F.dayofweek(F.col("date").cast("date")).alias("weekday"))
    return actions.where("click_product_id IS NOT NULL").join(F.broadcast(days.where("weekday IN (1, 7)")), "date").groupBy("date").agg(F.count("*").alias("clicks"))


def _area_sql(spark, d) -> DataFrame:
    _utc(spark)
    tables.register_views(spark, d, ("user_visit_action", "city_info", "product_info"))
    sql_functions.register(spark)
    return product.area_top_sql(spark, "2024-01-01", "2024-01-30")


def _sketch_skew(spark, d) -> DataFrame:
    facts, side = _actions(spark, d).select("event_id", "user_id", "page_id"), tables.user_info(spark, d).select("user_id", "age", "sex")
    return session.sketch_skew_join(facts, side, "user_id", "event_id").select("event_id", "user_id", "page_id", "age", "sex")


def _view_sql(spark, d) -> DataFrame:
    _utc(spark)
    tables.register_views(spark, d)
    return spark.sql(
        "SELECT c.area, u.sex, count(*) AS clicks FROM user_visit_action a JOIN user_info u ON u.user_id = a.user_id JOIN city_info c ON c.city_id = a.city_id WHERE a.click_product_id IS NOT NULL GROUP BY c.area, u.sex"
    )


def _compared(spark, d) -> DataFrame:
    t, noon = F.col("action_time"), F.lit("2024-01-15 12:00:00").cast("timestamp")
    return (
        _actions(spark, d)
        .select(
            "event_id",
            fn.before(t, noon).alias("is_before"),
            fn.after(t, noon).alias("is_after"),
            fn.format_date(t).alias("day"),
            (fn.today() > fn.yesterday()).alias("later"),
            F.date_diff(fn.today().cast("date"), fn.yesterday().cast("date")).alias("apart"),
        )
    )


def _scalars(spark, d) -> DataFrame:
    s = F.concat(
        F.lit("sid="),
        F.col("session_id"),
        F.lit("|page="),
        F.col("page_id").cast("string"),
        F.lit("|kw="),
        F.coalesce("search_keyword", F.lit("")),
    )
    return _actions(spark, d).select("event_id", s.alias("kv"))


def _long_delimiter(spark, d) -> DataFrame:
    kv = _scalars(spark, d).select("event_id", F.replace("kv", F.lit("|"), F.lit("||")).alias("kv"))
    return kv.select(
        "event_id",
        fn.concat_kv_get(F.col("kv"), "page", "||").alias("page"),
        fn.concat_kv_set(F.col("kv"), "page", "99", "||").alias("kv"),
    )


def _split_skew(spark, d) -> DataFrame:
    facts, side = _actions(spark, d).select("event_id", "user_id", "page_id"), tables.user_info(spark, d).select("user_id", "age", "sex")
    return session.split_skew_join(facts, side, "user_id", "event_id", 3).select("event_id", "user_id", "page_id", "age", "sex")


def _skewed(spark, d) -> DataFrame:
    joined = session.skew_join(
        _actions(spark, d).select("event_id", "user_id", "page_id"),
        tables.user_info(spark, d).select("user_id", "age", "sex"),
        "user_id",
        "event_id",
    )
    return joined.select("event_id", "user_id", "page_id", "age", "sex")


def _strings(spark, d) -> DataFrame:
    c = F.concat(F.lit(","), F.coalesce("order_category_ids", F.lit("")), F.lit(","))
    salted = fn.random_prefix(F.col("session_id"), 10, F.col("event_id"))
    return (
        _actions(spark, d)
        .select(
            "event_id",
            fn.is_empty(F.col("search_keyword")).alias("no_keyword"),
            fn.trim_comma(c).alias("trimmed"),
            fn.fill_with_zero(F.col("page_id").cast("string")).alias("page"),
            fn.concat_long_string(F.col("city_id"), ":", F.col("session_id")).alias("city_session"),
            fn.remove_random_prefix(salted).alias("unsalted"),
        )
    )


def _dates(spark, d) -> DataFrame:
    t = F.col("action_time")
    return (
        _actions(spark, d)
        .select(
            "event_id",
            fn.date_hour(t).alias("date_hour"),
            fn.minute_key(t).alias("minute_key"),
            fn.format_date_key(t).alias("date_key"),
            F.date_format(fn.parse_date_key(fn.format_date_key(t)), "yyyy-MM-dd").alias("parsed_date"),
            fn.format_time(fn.parse_time(fn.format_time(t))).alias("time"),
            fn.parse_time(F.lit("no time")).isNull().alias("bad_time"),
            fn.seconds_between(t, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("seconds"),
        )
    )


def _top(spark, d) -> DataFrame:
    return session.top_categories(_kept_actions(spark, d))


def _top_sessions(spark, d) -> DataFrame:
    own = _kept_actions(spark, d)
    return session.top_sessions(own, session.top_categories(own))


def _top_detail(spark, d) -> DataFrame:
    """One plan for the kept actions, so that their shuffles are done once."""
    own = _kept_actions(spark, d)
    return session.top_session_detail(own, session.top_sessions(own, session.top_categories(own)))


def queries() -> dict:
    a, log = _actions, _log
    return {
        "area_top3_product": lambda s, d: product.area_top(_area_full(s, d)),
        "area_product_click_count": lambda s, d: product.area_count(product.click_basic(a(s, d), tables.city_info(s, d))),
        "click_product_basic": lambda s, d: product.click_basic(a(s, d), tables.city_info(s, d)),
        "full_product_info": _area_full,
        "action_date_range": lambda s, d: tables.date_range(_ranged(s, d), PARAMS.start_date, PARAMS.end_date).select("date", "event_id", "user_id", "session_id", "page_id", "search_keyword", "click_category_id", "order_category_ids", "pay_category_ids", "city_id", F.date_format("action_time", "yyyy-MM-dd HH:mm:ss").alias("action_time")),
        "session_aggr": lambda s, d: _shown(session.roll_up(a(s, d))),
        "session_full_info": lambda s, d: _shown(_full(s, d)),
        "session_filter": lambda s, d: _shown(_kept(s, d)),
        "session_visit_buckets": lambda s, d: session.visit_buckets(_kept(s, d)),
        "session_step_buckets": lambda s, d: session.step_buckets(_kept(s, d)),
        "session_aggr_stat": lambda s, d: session.aggr_stat(_kept(s, d)),
        "session_hour_count": lambda s, d: session.hour_count(_full(s, d)),
        "session_random_extract": lambda s, d: session.random_extract(session.roll_up(a(s, d)), SAMPLE),
        "session_detail": lambda s, d: session.detail(session.of_sessions(a(s, d), session.random_extract(session.roll_up(a(s, d)), SAMPLE))),
        "category_universe": lambda s, d: session.category_universe(_kept_actions(s, d)),
        "category_click_count": lambda s, d: session.category_count(_kept_actions(s, d), "click"),
        "category_order_count": lambda s, d: session.category_count(_kept_actions(s, d), "order"),
        "category_pay_count": lambda s, d: session.category_count(_kept_actions(s, d), "pay"),
        "top10_category": _top,
        "session_category_count": lambda s, d: session.session_category_count(_kept_actions(s, d)),
        "top10_session": _top_sessions,
        "top10_session_detail": _top_detail,
        "page_split_pv": lambda s, d: funnel.split_pv(a(s, d), FLOW),
        "start_page_pv": lambda s, d: funnel.start_pv(a(s, d), FLOW),
        "page_convert_rate": lambda s, d: funnel.convert_rate(a(s, d), FLOW),
        "page_convert_rate_string": lambda s, d: funnel.convert_rate_string(funnel.convert_rate(a(s, d), FLOW)),
        "salted_category_count": lambda s, d: session.salted_category_count(a(s, d)),
        "skew_join": _skewed,
        "ad_user_click_count": lambda s, d: ads.user_click_count(log(s, d)),
        "ad_blacklist": _black,
        "ad_filtered": lambda s, d: ads.without(log(s, d), _black(s, d)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
        "ad_stat": lambda s, d: ads.stat(ads.without(log(s, d), _black(s, d))),
        "ad_province_top3": lambda s, d: ads.province_top(ads.stat(ads.without(log(s, d), _black(s, d)))),
        "ad_click_trend": lambda s, d: ads.click_trend(log(s, d)),
        "ad_trend_last_hour": lambda s, d: ads.last_hour(log(s, d)),
        "concat_kv_get": lambda s, d: _scalars(s, d).select("event_id", fn.concat_kv_get(F.col("kv"), "page").alias("page"), fn.concat_kv_get(F.col("kv"), "kw").alias("kw")),
        "concat_kv_set": lambda s, d: _scalars(s, d).select("event_id", fn.concat_kv_set(F.col("kv"), "page", "99").alias("kv")),
        "date_functions": _dates,
        "string_functions": _strings,
        "concat_kv_long_delimiter": _long_delimiter,
        "date_comparisons": _compared,
        "session_filter_all": lambda s, d: _shown(session.keep(_full(s, d), ALL_PARAMS)),
        "session_full_info_map_side": lambda s, d: _shown(session.full_info(session.roll_up(a(s, d)), tables.user_info(s, d), 64 << 20)),
        "hottest_user": lambda s, d: session.hottest(a(s, d), "user_id", 3),
        "bernoulli_sample": lambda s, d: session.bernoulli_sample(a(s, d).select("event_id", "user_id", "session_id"), "event_id", 0.3),
        "skew_join_split": _split_skew,
        "jdbc_city_info": lambda s, d: _jdbc(s, d, "city_info", tables.city_info(s, d)),
        "catalog_user_info": lambda s, d: tables.source(s, "user_info", d, Config.parse(PROPERTIES)).select("user_id", "age", "professional", "city", "sex"),
        "temp_view_sql": _view_sql,
        "task_params": _task_params,
        "job_config": _config,
        "tasks_sessions": _tasks_sessions,
        "catalog_action_range": lambda s, d: tables.date_range(_catalog_actions(s, d, "actions_of_a_range"), PARAMS.start_date, PARAMS.end_date).select("date", "event_id", "user_id", "session_id", "page_id", "city_id"),
        "catalog_weekend_clicks": lambda s, d: weekend_clicks(_catalog_actions(s, d, "actions_of_weekends")),
        "area_top3_product_sql": _area_sql,
        "skew_join_sketch": _sketch_skew,
        "stream_running_totals": _running_totals,
        "stream_listed_once": _listed_once,
        "stream_hour_windows": _hour_windows,
        "stream_anti_join": _anti_joined,
        "console_top10_category": lambda s, d: sinks.console(_top(s, d), 10),
        "ad_log_lines": lambda s, d: tables.ad_log_lines(log(s, d)),
        "ad_log_parsed": lambda s, d: tables.parse_ad_log(tables.ad_log_lines(log(s, d))).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
        "stream_ad_log_parsed": _parsed_stream,
        **{f"job_{name}": _job(jobs.session_job, name) for name in ("session_aggr_stat", "session_random_extract", "session_detail", "top10_category", "top10_session")},
        "job_page_convert_rate": _job(jobs.page_job, "page_convert_rate"),
        "job_area_top3_product": _job(jobs.product_job, "area_top3_product"),
        **{f"job_{name}": (lambda s, d, name=name: _ad_job(s, d, name)) for name in _AD_TABLES},
        "stream_ad_stat": lambda s, d: _streamed(s, d, stream_ads.ad_stat, stream_ads.stats),
        "stream_ad_click_trend": lambda s, d: _streamed(s, d, stream_ads.click_trend, stream_ads.trend),
    }


# --- SQL -----------------------------------------------------------------------------------------

_BASE = """WITH e AS (
 SELECT event_id, ts, user_id, event_type, cast(json_extract_string(props, '$.k') AS bigint) AS k,
  epoch_us(ts) // 1000000 - 1704067200 AS s,
  CASE user_id % 3 WHEN 0 THEN 86400 WHEN 1 THEN 864000 ELSE 2592000 END AS p
 FROM events),
uva AS (
 SELECT strftime(ts, '%Y-%m-%d') AS date, user_id, user_id || '_' || (s // p) AS session_id, event_id % 10 AS page_id,
  1704067200 + (s // p) * p + (user_id % 23) * 3600 + (s % p) // (p // 2160) AS secs,
  CASE WHEN event_type = 'view' THEN 'kw' || (k % 10) END AS search_keyword,
  CASE WHEN event_type = 'click' THEN k % 20 END AS click_category_id,
  CASE WHEN event_type = 'click' THEN k END AS click_product_id,
  CASE WHEN event_type = 'purchase' THEN (k % 20) || ',' || ((k + 7) % 20) END AS order_category_ids,
  CASE WHEN event_type = 'purchase' THEN k || '' END AS order_product_ids,
  CASE WHEN event_type = 'signup' THEN (k % 20) || '' END AS pay_category_ids,
  CASE WHEN event_type = 'signup' THEN k || '' END AS pay_product_ids,
  user_id % 26 AS city_id, event_id
 FROM e),
act AS (SELECT *, strftime(make_timestamp(secs * 1000000), '%Y-%m-%d %H:%M:%S') AS action_time FROM uva),
users AS (SELECT c_custkey AS user_id, 18 + c_custkey % 50 AS age, c_mktsegment AS professional, 'city' || c_nationkey AS city,
  CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS sex FROM customer WHERE c_custkey % 10 <> 7),
cities AS (SELECT cast(n_nationkey AS bigint) AS city_id, n_name AS city_name, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey),
log AS (SELECT ts, area AS province, city_name AS city, user_id, k % 5 AS ad_id FROM e JOIN cities ON user_id % 25 = city_id),
sess AS (SELECT session_id, min(user_id) AS user_id,
  coalesce(string_agg(DISTINCT search_keyword, ',' ORDER BY search_keyword), '') AS search_keywords,
  coalesce(array_to_string(list_sort(list(DISTINCT click_category_id) FILTER (click_category_id IS NOT NULL)), ','), '') AS click_category_ids,
  min(action_time) AS start_time, max(secs) - min(secs) AS visit_length, count(*) AS step_length FROM act GROUP BY session_id),
full_s AS (SELECT sess.*, age, professional, city, sex FROM sess JOIN users USING (user_id)),
kept AS (SELECT * FROM full_s WHERE age BETWEEN 20 AND 60 AND professional IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')
  AND len(list_intersect(string_split(click_category_ids, ','), ['1', '2', '3', '5', '7', '11'])) > 0),
ka AS (SELECT * FROM act WHERE session_id IN (SELECT session_id FROM kept)),
cats AS (
 SELECT click_category_id AS category_id, 'click' AS kind FROM ka WHERE click_category_id IS NOT NULL
 UNION ALL SELECT cast(unnest(string_split(order_category_ids, ',')) AS bigint), 'order' FROM ka WHERE order_category_ids IS NOT NULL
 UNION ALL SELECT cast(unnest(string_split(pay_category_ids, ',')) AS bigint), 'pay' FROM ka WHERE pay_category_ids IS NOT NULL),
top10 AS (SELECT category_id, count(*) FILTER (kind = 'click') AS click_count, count(*) FILTER (kind = 'order') AS order_count,
  count(*) FILTER (kind = 'pay') AS pay_count FROM cats GROUP BY category_id ORDER BY 2 DESC, 3 DESC, 4 DESC, 1 LIMIT 10),
scc AS (SELECT click_category_id AS category_id, session_id, count(*) AS click_count FROM ka WHERE click_category_id IS NOT NULL GROUP BY 1, 2),
ts10 AS (SELECT category_id, session_id, click_count FROM scc JOIN (SELECT category_id FROM top10) USING (category_id)
  QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY click_count DESC, session_id) <= 10),
hours AS (SELECT substr(start_time, 1, 10) AS date, substr(start_time, 12, 2) AS hour, count(*) AS sessions FROM sess GROUP BY 1, 2),
quota AS (SELECT date, hour, least(sessions, (sessions * (1000 // (SELECT count(DISTINCT date) FROM hours))) // cast(sum(sessions) OVER (PARTITION BY date) AS bigint)) AS quota FROM hours),
sampled AS (SELECT session_id, start_time, search_keywords, click_category_ids FROM (
  SELECT *, row_number() OVER (PARTITION BY substr(start_time, 1, 13) ORDER BY md5(session_id), session_id) AS rn FROM sess) x
  JOIN quota ON quota.date = substr(start_time, 1, 10) AND quota.hour = substr(start_time, 12, 2) WHERE rn <= quota),
moves AS (SELECT lag(page_id) OVER (PARTITION BY session_id ORDER BY secs, event_id) || '_' || page_id AS split FROM act),
flow(step, split) AS (VALUES (1, '1_2'), (2, '2_3'), (3, '3_4')),
pvs AS (SELECT step, flow.split, count(moves.split) AS pv FROM flow LEFT JOIN moves ON flow.split = moves.split GROUP BY 1, 2),
spv AS (SELECT count(*) AS start_pv FROM act WHERE page_id = 1),
rates AS (SELECT step, split, CASE WHEN b <> 0 THEN cast((200 * pv + b) // (2 * b) AS double) / 100 END AS rate FROM (
  SELECT *, coalesce(lag(pv) OVER (ORDER BY step), (SELECT start_pv FROM spv)) AS b FROM pvs) y),
clicks AS (SELECT act.city_id, city_name, area, click_product_id AS product_id FROM act JOIN cities USING (city_id) WHERE click_product_id IS NOT NULL),
areas AS (SELECT area, product_id, count(*) AS click_count, string_agg(DISTINCT city_id || ':' || city_name, ',' ORDER BY city_id || ':' || city_name) AS city_infos FROM clicks GROUP BY 1, 2),
fullp AS (SELECT areas.*, p_name AS product_name, CASE WHEN p_size % 2 = 0 THEN '自营商品' ELSE '第三方商品' END AS product_status FROM areas JOIN part ON p_partkey = product_id),
ucc AS (SELECT strftime(ts, '%Y-%m-%d') AS date, user_id, ad_id, count(*) AS click_count FROM log GROUP BY 1, 2, 3),
black AS (SELECT DISTINCT user_id FROM ucc WHERE click_count >= 3),
good AS (SELECT * FROM log WHERE user_id NOT IN (SELECT user_id FROM black)),
stat AS (SELECT strftime(ts, '%Y-%m-%d') AS date, province, city, ad_id, count(*) AS click_count FROM good GROUP BY 1, 2, 3, 4),
trend AS (SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, strftime(ts, '%M') AS minute, ad_id, count(*) AS click_count FROM log GROUP BY 1, 2, 3, 4),
kv AS (SELECT event_id, 'sid=' || session_id || '|page=' || page_id || '|kw=' || coalesce(search_keyword, '') AS kv FROM act)
"""
#: The jobs' own tables: sessions without a range of days; the ad log in batches, each without the users that earlier ones list.
_JOBS = """,
jhours AS (SELECT substr(start_time, 1, 10) AS date, substr(start_time, 12, 2) AS hour, count(*) AS sessions FROM kept GROUP BY 1, 2),
jquota AS (SELECT date, hour, least(sessions, (sessions * (1000 // (SELECT count(DISTINCT date) FROM jhours))) // cast(sum(sessions) OVER (PARTITION BY date) AS bigint)) AS quota FROM jhours),
jsampled AS (SELECT session_id, start_time, search_keywords, click_category_ids FROM (
  SELECT *, row_number() OVER (PARTITION BY substr(start_time, 1, 13) ORDER BY md5(session_id), session_id) AS rn FROM kept) x
  JOIN jquota ON jquota.date = substr(start_time, 1, 10) AND jquota.hour = substr(start_time, 12, 2) WHERE rn <= quota),
named AS (SELECT ts, replace(province, ' ', '_') AS province, replace(city, ' ', '_') AS city, user_id, ad_id, strftime(ts, '%Y-%m-%d') AS date,
  CASE WHEN ts < TIMESTAMP '2024-01-10 12:00:00' THEN 0 WHEN ts < TIMESTAMP '2024-01-20 12:00:00' THEN 1 ELSE 2 END AS batch FROM log),
black0 AS (SELECT DISTINCT user_id FROM (SELECT date, user_id, ad_id FROM named WHERE batch = 0 GROUP BY ALL HAVING count(*) >= 3)),
good1 AS (SELECT * FROM named WHERE batch = 0 OR batch = 1 AND user_id NOT IN (SELECT user_id FROM black0)),
black1 AS (SELECT DISTINCT user_id FROM (SELECT date, user_id, ad_id FROM good1 GROUP BY ALL HAVING count(*) >= 3)),
good2 AS (SELECT * FROM good1 UNION ALL SELECT * FROM named WHERE batch = 2 AND user_id NOT IN (SELECT user_id FROM black1)),
jstat AS (SELECT date, province, city, ad_id, count(*) AS click_count FROM good2 GROUP BY ALL)
"""
_DETAIL = "event_id, user_id, session_id, page_id, action_time, search_keyword, coalesce(click_category_id, -1) AS click_category_id, coalesce(click_product_id, -1) AS click_product_id, order_category_ids, order_product_ids, pay_category_ids, pay_product_ids"


def _buckets(column: str, buckets: dict, ratio: bool = False) -> str:
    n = lambda low, high: f"count(*) FILTER ({column} >= {low}" + (f" AND {column} <= {high})" if high else ")")
    shown = (
        lambda c: f"CASE WHEN count(*) <> 0 THEN cast((200 * {c} + count(*)) // (2 * count(*)) AS double) / 100 END"
    ) if ratio else (lambda c: c)
    return ", ".join(f"{shown(n(*b))} AS {name}" for name, b in buckets.items())


#: A task a nation; dates, ages and lists as the stored JSON gives them.
_TASKS_SQL = """, tasks AS (SELECT cast(n_nationkey AS BIGINT) AS task_id,
    CASE WHEN n_nationkey % 3 <> 0 THEN strftime(DATE '2024-01-01' + cast(n_nationkey % 8 AS INTEGER), '%Y-%m-%d') END AS start_date,
    CASE WHEN n_nationkey % 4 <> 0 THEN strftime(DATE '2024-01-16' + cast(n_nationkey % 9 AS INTEGER), '%Y-%m-%d') END AS end_date,
    CASE WHEN n_nationkey % 2 = 0 THEN cast(n_nationkey + 18 AS INTEGER) END AS start_age, cast(n_nationkey + 40 AS INTEGER) AS end_age,
    CASE WHEN n_nationkey % 5 = 0 THEN 'BUILDING,MACHINERY' END AS professionals,
    CASE WHEN n_nationkey % 5 <> 0 THEN 'city' || n_nationkey || ',city' || ((n_nationkey + 7) % 25) || ',city' || ((n_nationkey + 14) % 25) END AS cities,
    CASE WHEN n_nationkey % 5 = 1 THEN 'male' END AS task_sex, CASE WHEN n_nationkey % 6 = 2 THEN 'kw1,kw2,kw3' END AS task_keywords,
    CASE WHEN n_nationkey % 7 = 3 THEN (n_nationkey % 20) || ',' || ((n_nationkey + 3) % 20) || ',' || ((n_nationkey + 5) % 20) END AS category_ids FROM nation)"""


def oracle_sql() -> dict[str, str]:
    visit, step = session.VISIT, session.STEP
    own = {
        "area_top3_product": "SELECT area, CASE WHEN area IN ('AFRICA', 'AMERICA') THEN 'A级' WHEN area = 'ASIA' THEN 'B级' WHEN area = 'EUROPE' THEN 'C级' ELSE 'D级' END AS area_level, product_id, click_count, city_infos, product_name, product_status FROM fullp QUALIFY row_number() OVER (PARTITION BY area ORDER BY click_count DESC, product_id) <= 3",
        "area_product_click_count": "SELECT * FROM areas",
        "click_product_basic": "SELECT * FROM clicks",
        "full_product_info": "SELECT * FROM fullp",
        "action_date_range": "SELECT date, event_id, user_id, session_id, page_id, search_keyword, click_category_id, order_category_ids, pay_category_ids, city_id, action_time FROM act WHERE date BETWEEN '2024-01-03' AND '2024-01-28'",
        "session_aggr": "SELECT * FROM sess",
        "session_full_info": "SELECT * FROM full_s",
        "session_filter": "SELECT * FROM kept",
        "session_visit_buckets": f"SELECT count(*) AS session_count, {_buckets('visit_length', visit)} FROM kept",
        "session_step_buckets": f"SELECT count(*) AS session_count, {_buckets('step_length', step)} FROM kept",
        "session_aggr_stat": f"SELECT count(*) AS session_count, {_buckets('visit_length', visit, True)}, {_buckets('step_length', step, True)} FROM kept",
        "session_hour_count": "SELECT substr(start_time, 1, 10) AS date, substr(start_time, 12, 2) AS hour, count(*) AS sessions FROM full_s GROUP BY 1, 2",
        "session_random_extract": "SELECT * FROM sampled",
        "session_detail": f"SELECT {_DETAIL} FROM act WHERE session_id IN (SELECT session_id FROM sampled)",
        "category_universe": "SELECT DISTINCT category_id FROM cats",
        **{f"category_{k}_count": f"SELECT category_id, count(*) AS {k}_count FROM cats WHERE kind = '{k}' GROUP BY 1" for k in ("click", "order", "pay")},
        "top10_category": "SELECT * FROM top10",
        "session_category_count": "SELECT * FROM scc",
        "top10_session": "SELECT * FROM ts10",
        "top10_session_detail": f"SELECT category_id, d.* FROM (SELECT {_DETAIL} FROM ka) d JOIN (SELECT session_id, category_id FROM ts10) t USING (session_id)",
        "page_split_pv": "SELECT * FROM pvs",
        "start_page_pv": "SELECT * FROM spv",
        "page_convert_rate": "SELECT * FROM rates",
        "page_convert_rate_string": "SELECT string_agg(split || '=' || coalesce(printf('%.2f', rate), 'null'), '|' ORDER BY step) AS convert_rate FROM rates",
        "salted_category_count": "SELECT click_category_id AS category_id, count(*) AS click_count FROM act WHERE click_category_id IS NOT NULL GROUP BY 1",
        "skew_join": "SELECT event_id, user_id, page_id, age, sex FROM act JOIN users USING (user_id)",
        "ad_user_click_count": "SELECT * FROM ucc",
        "ad_blacklist": "SELECT * FROM black",
        "ad_filtered": "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, province, city, user_id, ad_id FROM good",
        "ad_stat": "SELECT * FROM stat",
        "ad_province_top3": "SELECT date, province, ad_id, cast(sum(click_count) AS bigint) AS click_count FROM stat GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY date, province ORDER BY sum(click_count) DESC, ad_id) <= 3",
        "ad_click_trend": "SELECT * FROM trend",
        "ad_trend_last_hour": "SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, strftime(ts, '%M') AS minute, ad_id, count(*) AS click_count FROM log WHERE date_trunc('minute', ts) > (SELECT max(date_trunc('minute', ts)) FROM log) - INTERVAL 60 MINUTE GROUP BY 1, 2, 3, 4",
        "concat_kv_get": "SELECT event_id, nullif(regexp_extract(kv, '(^|\\|)page=([^=|]+)', 2), '') AS page, nullif(regexp_extract(kv, '(^|\\|)kw=([^=|]+)', 2), '') AS kw FROM kv",
        "concat_kv_set": "SELECT event_id, regexp_replace(kv, '\\|page=[^|]*', '|page=99') AS kv FROM kv",
        "date_functions": "SELECT event_id, replace(substr(action_time, 1, 13), ' ', '_') AS date_hour, strftime(make_timestamp(secs * 1000000), '%Y%m%d%H%M') AS minute_key, strftime(make_timestamp(secs * 1000000), '%Y%m%d') AS date_key, substr(action_time, 1, 10) AS parsed_date, action_time AS time, true AS bad_time, secs - 1704067200 AS seconds FROM act",
        "string_functions": "SELECT event_id, search_keyword IS NULL AS no_keyword, coalesce(order_category_ids, '') AS trimmed, lpad(page_id || '', 2, '0') AS page, city_id || ':' || session_id AS city_session, session_id AS unsalted FROM act",
        "concat_kv_long_delimiter": "SELECT event_id, regexp_extract(kv, 'page=([^|]+)', 1) AS page, replace(regexp_replace(kv, '\\|page=[^|]*', '|page=99'), '|', '||') AS kv FROM kv",
        "date_comparisons": "SELECT event_id, secs < 1705320000 AS is_before, secs > 1705320000 AS is_after, substr(action_time, 1, 10) AS day, true AS later, 1::INTEGER AS apart FROM act",
        "session_filter_all": "SELECT * FROM full_s WHERE age BETWEEN 19 AND 65 AND professional IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') AND cast(substr(city, 5) AS int) % 2 = 0 AND sex = 'male' AND len(list_intersect(string_split(search_keywords, ','), ['kw1', 'kw3', 'kw5', 'kw7'])) > 0 AND len(list_intersect(string_split(click_category_ids, ','), ['1', '2', '3', '5', '7', '11'])) > 0",
        "session_full_info_map_side": "SELECT * FROM full_s",
        "hottest_user": "SELECT user_id, count(*) AS rows FROM act GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
        "bernoulli_sample": "SELECT event_id, user_id, session_id FROM act WHERE cast('0x' || substr(md5('41_' || event_id), 1, 8) AS bigint) < cast(floor(0.3 * 4294967296) AS bigint)",
        "skew_join_split": "SELECT event_id, user_id, page_id, age, sex FROM act JOIN users USING (user_id)",
        "jdbc_city_info": "SELECT * FROM cities",
        "catalog_user_info": "SELECT user_id, age, professional, city, sex FROM users",
        "temp_view_sql": "SELECT area, sex, count(*) AS clicks FROM clicks_of JOIN users USING (user_id) GROUP BY ALL".replace("clicks_of", "(SELECT user_id, area FROM act JOIN cities USING (city_id) WHERE click_product_id IS NOT NULL)"),
        "task_params": f"{_TASKS_SQL} SELECT task_id, start_date, end_date, start_age, end_age, professionals, cities, task_sex, task_keywords, category_ids FROM tasks",
        "job_config": "SELECT 'city.' || n_nationkey || '.name' AS key, n_name || ' = ' || n_nationkey AS value FROM nation UNION ALL SELECT 'region.' || n_nationkey, n_regionkey || '' FROM nation",
        "tasks_sessions": f"""{_TASKS_SQL} SELECT task_id, session_id FROM (
            SELECT task_id, session_id, min(act.user_id) AS user_id, list(DISTINCT search_keyword) FILTER (search_keyword IS NOT NULL) AS kws, list(DISTINCT click_category_id || '') FILTER (click_category_id IS NOT NULL) AS cats
            FROM act JOIN tasks ON act.date >= coalesce(start_date, '') AND act.date <= coalesce(end_date, '9') GROUP BY ALL) s JOIN users USING (user_id) JOIN tasks t USING (task_id)
            WHERE (start_age IS NULL OR age >= start_age) AND age <= end_age AND (cities IS NULL OR list_contains(string_split(cities, ','), city)) AND (task_sex IS NULL OR sex = task_sex)
            AND (professionals IS NULL OR list_contains(string_split(professionals, ','), professional)) AND (task_keywords IS NULL OR len(list_intersect(kws, string_split(task_keywords, ','))) > 0)
            AND (category_ids IS NULL OR len(list_intersect(cats, string_split(category_ids, ','))) > 0)""",
        "catalog_action_range": "SELECT date, event_id, user_id, session_id, page_id, city_id FROM act WHERE date BETWEEN '2024-01-03' AND '2024-01-28'",
        "catalog_weekend_clicks": "SELECT date, count(*) AS clicks FROM act WHERE click_product_id IS NOT NULL AND dayofweek(date::DATE) IN (0, 6) GROUP BY date",
        "skew_join_sketch": "SELECT event_id, user_id, page_id, age, sex FROM act JOIN users USING (user_id)",
        "stream_running_totals": "SELECT strftime(ts, '%Y-%m-%d') AS date, province, city, ad_id, count(*) AS click_count FROM log GROUP BY 1, 2, 3, 4",
        "stream_listed_once": """, reached AS (SELECT *, sum(n) OVER (PARTITION BY user_id, date, ad_id ORDER BY batch) AS click_count FROM (SELECT user_id, date, ad_id, batch, count(*) AS n FROM good2 GROUP BY ALL))
            SELECT user_id, date, ad_id, cast(click_count AS BIGINT) AS click_count FROM reached WHERE click_count >= 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY batch, date, ad_id) = 1""",
        "stream_hour_windows": """, ends AS (SELECT DISTINCT epoch_us(date_trunc('minute', ts)) // 1000000 AS m, ad_id FROM log), steps AS (SELECT m, ad_id, unnest(range(m + 10, m + 3661, 10)) AS w FROM ends),
            counts AS (SELECT s.m, s.ad_id, s.w, count(*) AS n FROM steps s JOIN log l ON l.ad_id = s.ad_id AND epoch_us(date_trunc('minute', l.ts)) // 1000000 = s.m AND epoch_us(l.ts) >= (s.w - 3600) * 1000000 AND epoch_us(l.ts) < s.w * 1000000 GROUP BY ALL),
            marks AS (SELECT *, CASE WHEN w = m + 60 OR w <= m + 50 OR w > m + 3600 THEN 1 ELSE 0 END AS new FROM counts), runs AS (SELECT *, sum(new) OVER (PARTITION BY m, ad_id ORDER BY w) AS k FROM marks)
            SELECT strftime(make_timestamp(min(w) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_from, strftime(make_timestamp(max(w) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_to, strftime(make_timestamp(m * 1000000), '%Y-%m-%d %H:%M:%S') AS minute, ad_id, n AS click_count FROM runs GROUP BY m, ad_id, n, k""",
        "stream_anti_join": "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, province, city, user_id, ad_id FROM good",
        "console_top10_category": "SELECT * FROM top10",
        "ad_log_lines": "SELECT (epoch_us(ts) // 1000) || ' ' || province || ' ' || city || ' ' || user_id || ' ' || ad_id AS value FROM named",
        "ad_log_parsed": "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, province, city, user_id, ad_id FROM named",
        "stream_ad_log_parsed": "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, province, city, user_id, ad_id FROM named",
        "job_session_aggr_stat": f"SELECT count(*) AS session_count, {_buckets('visit_length', visit, True)}, {_buckets('step_length', step, True)}, 1::BIGINT AS task_id FROM kept",
        "job_session_random_extract": "SELECT *, 1::BIGINT AS task_id FROM jsampled",
        "job_session_detail": f"SELECT {_DETAIL}, 1::BIGINT AS task_id FROM act WHERE session_id IN (SELECT session_id FROM jsampled) UNION ALL SELECT d.*, 1 FROM (SELECT {_DETAIL} FROM ka) d JOIN (SELECT session_id FROM ts10) t USING (session_id)",
        "job_top10_category": "SELECT *, 1::BIGINT AS task_id FROM top10",
        "job_top10_session": "SELECT *, 1::BIGINT AS task_id FROM ts10",
        "job_page_convert_rate": "SELECT string_agg(split || '=' || coalesce(printf('%.2f', rate), 'null'), '|' ORDER BY step) AS convert_rate, 2::BIGINT AS task_id FROM rates",
        "job_area_top3_product": "SELECT area, CASE WHEN area IN ('AFRICA', 'AMERICA') THEN 'A级' WHEN area = 'ASIA' THEN 'B级' WHEN area = 'EUROPE' THEN 'C级' ELSE 'D级' END AS area_level, product_id, click_count, city_infos, product_name, product_status, 3::BIGINT AS task_id FROM fullp QUALIFY row_number() OVER (PARTITION BY area ORDER BY click_count DESC, product_id) <= 3",
        "job_ad_user_click_count": "SELECT date, user_id, ad_id, count(*) AS click_count FROM good2 GROUP BY ALL",
        "job_ad_blacklist": "SELECT DISTINCT user_id FROM (SELECT date, user_id, ad_id FROM good2 GROUP BY ALL HAVING count(*) >= 3)",
        "job_ad_stat": "SELECT * FROM jstat",
        "job_ad_province_top3": "SELECT date, province, ad_id, cast(sum(click_count) AS bigint) AS click_count FROM jstat GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY date, province ORDER BY sum(click_count) DESC, ad_id) <= 3",
        "job_ad_click_trend": "SELECT * FROM trend",
        "stream_ad_stat": "SELECT strftime(ts, '%Y-%m-%d') AS date, province, city, ad_id, count(*) AS click_count FROM log GROUP BY 1, 2, 3, 4",
        "stream_ad_click_trend": "SELECT * FROM trend",
    }
    own["area_top3_product_sql"] = own["area_top3_product"]
    return {name: f"{_BASE}{_JOBS}\n{sql}" for name, sql in own.items()}
