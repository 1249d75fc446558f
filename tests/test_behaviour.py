import duckdb
import pytest
from pyspark.sql import functions as F

from clickstrata import queries as behaviour
from clickstrata.functions import scalars as fn
from clickstrata.operators import funnel, session
from clickstrata.plans.params import TaskParams, find_task
from clickstrata.sources import sinks, tables
from clickstrata.streaming import ads as stream_ads

SF = "/root/testdata/sf0.001"
QUERIES = ["area_top3_product", "session_filter", "session_aggr_stat", "session_random_extract", "top10_session_detail", "page_convert_rate", "skew_join", "ad_province_top3", "ad_trend_last_hour", "concat_kv_set", "stream_ad_stat", "stream_ad_click_trend", "session_filter_all", "skew_join_split", "jdbc_city_info", "temp_view_sql", "task_params", "bernoulli_sample", "job_session_detail", "job_ad_province_top3", "job_ad_blacklist", "job_config", "job_session_aggr_stat", "tasks_sessions", "catalog_action_range", "catalog_weekend_clicks", "area_top3_product_sql", "skew_join_sketch", "stream_running_totals", "stream_listed_once", "stream_hour_windows", "stream_anti_join"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "customer", "part", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    got = behaviour.queries()[name](spark, SF)
    cols = sorted(got.columns)
    result = duck.execute(behaviour.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in result.fetchall())


def test_every_query_has_sql():
    assert set(behaviour.queries()) == set(behaviour.oracle_sql())


def test_bucket_bounds(spark):
    edges = [0, 1, 3, 4, 30, 31, 60, 61, 180, 181, 600, 601, 1800, 1801]
    df = spark.createDataFrame([(x, x) for x in edges], "visit_length long, step_length long")
    assert session.visit_buckets(df).first().asDict() == {"session_count": 14, "visit_1s_3s": 2, "visit_4s_6s": 1, "visit_7s_9s": 0, "visit_10s_30s": 1, "visit_30s_60s": 2, "visit_1m_3m": 2, "visit_3m_10m": 2, "visit_10m_30m": 2, "visit_30m": 1}


def test_filter_takes_whole_values_and_open_bounds(spark):
    df = spark.createDataFrame([(1, 30, "10,21", "kw1"), (2, None, "1", "kw10"), (3, 50, None, None)], "id long, age int, click_category_ids string, search_keywords string")
    ids = lambda p: {r.id for r in session.keep(df, p).collect()}
    assert ids(TaskParams()) == {1, 2, 3} and ids(TaskParams(category_ids=(1,))) == {2} and ids(TaskParams(keywords=("kw1",))) == {1} and ids(TaskParams(start_age=31)) == {3}


def test_ratio_rounds_exact_halves_up(spark):
    df = spark.createDataFrame([(3, 200), (29, 200), (1, 8), (1, 0)], "n long, d long")
    assert [r[0] for r in df.select(fn.ratio2(F.col("n"), F.col("d"))).collect()] == [0.02, 0.15, 0.13, None]


def test_flow_edges(spark):
    df = spark.createDataFrame([("s", 1, 1, 1), ("s", 2, 2, 2), ("s", 1, 3, 3)], "session_id string, page_id long, action_time long, event_id long")
    assert [tuple(r) for r in funnel.convert_rate(df, (1, 2, 3)).orderBy("step").collect()] == [(1, "1_2", 0.5), (2, "2_3", 0.0)]
    assert funnel.convert_rate(df, (1,)).count() == 0


def test_tasks(spark):
    df = spark.createDataFrame([(1, '{"startAge":["20"],"cities":["a,b"]}')], "task_id long, task_param string")
    assert find_task(df, 1) == TaskParams(start_age=20, cities=("a", "b"))
    with pytest.raises(LookupError):
        find_task(df, 2)


def test_blacklist_works_from_the_next_batch(spark, tmp_path):
    line = "1704067200000 p c {} 1"
    for i, users in enumerate(([7, 7, 7, 8], [7, 8], [8])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{i}.txt").write_text("\n".join([*(line.format(u) for u in users), "bad line"]))
        log = tables.parse_ad_log(tables.text_lines(spark, str(tmp_path / "in"), 10))
        stream_ads.filtered(log, str(tmp_path / "out"), str(tmp_path / "black"), str(tmp_path / "cp"), 3, True).awaitTermination()
    assert {r.user_id for r in spark.read.parquet(str(tmp_path / "black")).collect()} == {7, 8}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("user_id").agg(F.sum("click_count")).collect()} == {(7, 3), (8, 3)}


def test_a_job_run_again_replaces_its_results(spark, tmp_path):
    from clickstrata import jobs
    from clickstrata.plans.config import Config

    source = lambda name, *days: tables.source(spark, name, SF, Config.parse("local=yes"), *days)
    tasks = spark.createDataFrame(behaviour.TASKS, "task_id long, task_name string, task_param string")
    for _ in range(2):
        paths = jobs.page_job(source, tasks, 2, str(tmp_path))
    assert jobs.results(spark, paths["page_convert_rate"]).count() == 1
    with pytest.raises(LookupError):
        jobs.product_job(source, tasks, 99, str(tmp_path))


def test_settings():
    from clickstrata.plans.config import Config
    from clickstrata.plans.params import task_id

    c = Config.parse("# x\na = 1\nb: yes\n\na=2")
    assert c.integer("a") == 2 and c.boolean("b") and c.text("none", "d") == "d" and task_id(["7"]) == 7
    for fails in (lambda: c.text("none"), lambda: c.boolean("a2", None), lambda: Config.parse("a=maybe").boolean("a")):
        with pytest.raises((KeyError, ValueError)):
            fails()


def test_long_delimiters_and_blank_ids(spark):
    df = spark.createDataFrame([("a=1||b=2|3||c=",)], "kv string")
    assert df.select(fn.concat_kv_get(F.col("kv"), "b", "||"), fn.concat_kv_get(F.col("kv"), "c", "||"), fn.concat_kv_set(F.col("kv"), "a", "9", "||")).first()[:] == ("2|3", None, "a=9||b=2|3||c=")


def test_broadcast_only_under_the_given_size(spark):
    facts, side = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).withColumnRenamed("id", "k")
    plan = lambda n: session.map_side_join(facts, side, "k", n)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(1 << 20) and "SortMergeJoin" in plan(10)


def test_bad_log_lines_are_dropped(spark):
    lines = ["1704067200000 p c 7 1", "x p c 7 1", "1704067200000 p c", "", "1704067200000 p c seven 1"]
    assert tables.parse_ad_log(spark.createDataFrame([(x,) for x in lines], "value string")).count() == 1


def test_synthetic_views_only_where_settings_say_local(spark):
    from pyspark.errors import AnalysisException

    from clickstrata.plans.config import Config

    spark.catalog.dropTempView("product_info")
    with pytest.raises(AnalysisException):
        tables.source(spark, "product_info", SF, Config.parse("local=false"))
    assert tables.source(spark, "product_info", SF, Config.parse("local=true")).count() == 200


def test_kafka_source_asks_for_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        tables.kafka_lines(spark, "localhost:1", "ads")


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    from clickstrata.sources import folders

    class Context:
        master, applicationId = "yarn", "x"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError):
        folders.shared_dir(Session())


def test_a_database_in_the_driver_needs_no_executor(spark, monkeypatch):
    """Executors do not see it: the rows go through the driver, and what is read back is a table in the shared folder."""
    monkeypatch.setattr(tables, "FETCHED", 3)
    url = "jdbc:derby:memory:apart"
    rows = [(i, f"n{i}" if i % 4 else None, i / 2) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, name string, half double").repartition(3)
    for mode, times in (("append", 1), ("append", 2), ("ignore", 2), ("overwrite", 1)):
        sinks.jdbc(df, f"{url};create=true", "t", mode)
        got = tables.jdbc(spark, url, "t")
        assert "JDBCRelation" not in got._jdf.queryExecution().toString()
        assert sorted(map(tuple, got.collect())) == sorted(rows * times)
    sinks.jdbc(df.limit(0), f"{url};create=true", "no_rows")
    assert tables.jdbc(spark, url, "no_rows").collect() == []
    assert not tables.in_process("jdbc:derby://host/db") and not tables.in_process("jdbc:postgresql://host/db")


def test_executors_write_and_read_a_database_that_they_reach(spark, monkeypatch):
    """In local mode executors are threads of the driver's process, so they do reach its Derby: the path for servers, run in one process."""
    for module in (tables, sinks):
        monkeypatch.setattr(module, "in_process", lambda url: False)
    url = "jdbc:derby:memory:reached"
    df = spark.createDataFrame([(i, f"n{i}" if i % 4 else None) for i in range(40)], "id long, name string").repartition(4)
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        sinks.jdbc(df, f"{url};create=true", "t", mode, batchsize="7")
        got = tables.jdbc(spark, url, "t", partitionColumn="id", lowerBound="0", upperBound="40", numPartitions="4", fetchsize="5")
        assert "JDBCRelation" in got._jdf.queryExecution().toString() and got.rdd.getNumPartitions() == 4
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, list(map(tuple, df.collect())) * times))
    ranged = tables.jdbc(spark, url, "t").where("id >= 30").select("name")
    assert "GreaterThanOrEqual(id,30)" in ranged._jdf.queryExecution().executedPlan().toString().replace("ID", "id") and ranged.count() == 10
