"""What the plans must look like, and what counters, sketches, tasks and SQL functions give on small tables."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from clickstrata import queries as behaviour
from clickstrata.functions import sql as sql_functions
from clickstrata.operators import session
from clickstrata.plans.config import Config, settings
from clickstrata.plans.params import task_rows

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sql_functions_are_inlined(spark):
    df = behaviour.queries()["area_top3_product_sql"](spark, SF)
    assert "Python" not in plan(df) and "UDF" not in plan(df)
    sql_functions.register(spark)
    row = spark.sql(
        "SELECT concat_long_string(7, ':', 'x') a, concat_long_string(NULL, ':', 'x') b, group_concat_distinct(array('b', 'a', 'b')) c, get_json_int('{\"k\": 3}', 'k') d,"
        " get_json_int('{\"k\": \"no\"}', 'k') e, get_json_int('none', 'k') f, remove_random_prefix(random_prefix('1_x', 10, 5)) g, random_prefix('x', 10, 5) = random_prefix('x', 10, 5) h"
    ).first()
    assert tuple(row) == ("7:x", None, "a,b", 3, None, None, "1_x", True)


def test_a_stored_table_is_pruned(spark):
    ranged = plan(behaviour.queries()["catalog_action_range"](spark, SF))
    assert "PartitionFilters: [isnotnull(date" in ranged and ">= 2024-01-03" in ranged
    weekends = behaviour.queries()["catalog_weekend_clicks"](spark, SF)
    assert "dynamicpruning" in plan(weekends)
    size = spark.sql("DESCRIBE EXTENDED actions_of_weekends").where("col_name = 'Statistics'").first()[1]
    assert "1000 rows" in size


def test_a_jobs_days_cut_the_scan(spark):
    from clickstrata import jobs
    from clickstrata.plans.params import TaskParams

    source = lambda name, *days: behaviour.tables.source(spark, name, SF, Config.parse("local=yes"), *days)
    actions = jobs._actions(source, TaskParams(start_date="2024-01-03", end_date="2024-01-05"))
    assert "GreaterThanOrEqual(ts,2024-01-03" in plan(actions) and "LessThan(ts,2024-01-06" in plan(actions)
    assert {r.date for r in actions.select("date").distinct().collect()} == {"2024-01-03", "2024-01-04", "2024-01-05"}


def test_today(spark):
    import datetime

    from clickstrata.functions import scalars as fn

    before = datetime.datetime.now(datetime.timezone.utc).date()
    got = spark.range(1).select(fn.today(), fn.yesterday()).first()
    after = datetime.datetime.now(datetime.timezone.utc).date()
    days = [str(d) for d in (before, after)]
    assert got[0] in days and got[1] in [str(d - datetime.timedelta(1)) for d in (before, after)]


def test_a_sketch_finds_hot_keys_and_the_join_salts_them_by_size(spark):
    key = F.when(F.col("id") % 2 == 0, -1).when(F.col("id") % 20 == 1, -2).otherwise(F.col("id"))
    facts = spark.range(20_000).select(F.col("id").alias("row"), key.cast("long").alias("k"))
    facts = facts.unionByName(spark.range(5).select((F.col("id") - 100).alias("row"), F.lit(None).cast("long").alias("k")))
    shares = {r.k: r.share for r in session.hot_keys(facts, "k").collect()}
    assert abs(shares[-1] - 0.5) < 0.01 and abs(shares[-2] - 0.05) < 0.01 and len(shares) == 2
    side = facts.select("k").distinct().withColumn("v", F.col("k") * 2)
    got = session.sketch_skew_join(facts, side, "k", "row")
    assert got.columns == ["k", "row", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, facts.join(side, "k").collect()))


def test_tasks_in_one_pass(spark):
    tasks = spark.createDataFrame(
        [
            (1, '{"startAge":["20"],"cities":["a,b"],"startDate":["2024-01-02"]}'),
            (2, '{"keywords":["kw1"],"categoryIds":[""],"sex":[]}'),
            (3, "no json"),
            (4, None),
            (5, '{"endDate":["2023-01-01"]}'),
            (6, '{"categoryIds":["1,21"],"professionals":[",,"]}'),
        ],
        "task_id long, task_param string",
    )
    rows = {r.task_id: r for r in task_rows(tasks).collect()}
    assert rows[1].start_age == 20 and rows[1].cities == ["a", "b"] and rows[2].category_ids is None and rows[6].professionals is None and rows[3].end_date is None
    actions = spark.createDataFrame(
        [("s1", "2024-01-01", 1, "kw1", 1), ("s1", "2024-01-03", 1, "kw10", None), ("s2", "2024-01-01", 2, "kw1", 10), ("s3", "2024-01-02", 3, None, 21), ("s9", "2024-01-02", 9, None, 1)],
        "session_id string, date string, user_id long, search_keyword string, click_category_id long",
    )
    users = spark.createDataFrame([(1, 30, "x", "a", "male"), (2, 40, "x", "b", None), (3, None, None, "c", "female")], "user_id long, age int, professional string, city string, sex string")
    got = {}
    for r in session.keep_by_task(actions, users, task_rows(tasks)).collect():
        got.setdefault(r.task_id, set()).add(r.session_id)
    everyone = {"s1", "s2", "s3"}
    assert got == {1: {"s1"}, 2: {"s1", "s2"}, 3: everyone, 4: everyone, 6: {"s1", "s3"}}


def test_settings_from_lines(spark):
    text = "# x\na = 1\n! y\nb: yes = no\n\n  a=2 \nalone"
    lines = spark.createDataFrame([(x, i) for i, x in enumerate(text.splitlines())], "value string, at int")
    assert {r.key: r.value for r in settings(lines).collect()} == Config.parse(text).values


def test_counters_of_the_pass_that_stores(spark):
    from clickstrata import jobs

    kept = spark.range(100).select(F.col("id").alias("visit_length"), (F.col("id") + 1).alias("step_length"))
    stored, counters = jobs.store_counted(kept)
    assert stored.count() == 100 and session.aggr_stat_of(counters).collect() == session.aggr_stat(kept).collect()
    assert jobs.store_counted(kept.limit(0))[1].first()[0] == 0


RETRIED = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from clickstrata import jobs

@F.udf("long")
def fails_once(x):
    marker = {marker!r} + str(x // 50)
    if x % 50 == 49 and not os.path.exists(marker):
        open(marker, "w").close()
        raise ValueError("the first try of this task")
    return x

kept = spark.range(0, 200, 1, 4).select(fails_once("id").alias("visit_length"), F.col("id").alias("step_length"))
stored, counters = jobs.store_counted(kept)
print("COUNTED", stored.count(), counters.first()[0])
"""


def test_a_task_that_is_run_again_counts_once(tmp_path):
    code = RETRIED.format(root=str(Path(__file__).resolve().parent.parent), marker=str(tmp_path / "m"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "COUNTED 200 200" in done.stdout, done.stderr[-2000:]
    assert len(list(tmp_path.iterdir())) == 4
