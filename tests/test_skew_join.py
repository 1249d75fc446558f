from pyspark.sql import functions as F

from clickstrata.operators import session


def test_the_copied_side_is_never_broadcast(spark):
    facts = spark.range(200).select(F.col("id").alias("row"), (F.col("id") % 7).alias("k"))
    side = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for got in (session.skew_join(facts, side, "k", "row"), session.split_skew_join(facts, side, "k", "row", 2)):
        assert sorted(map(tuple, got.select("k", "row", "v").collect())) == sorted(map(tuple, facts.join(side, "k").select("k", "row", "v").collect()))
    plan = session.skew_join(facts, side, "k", "row")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
