from clickstrata.llm import quality


def test_a_pass_of_the_quality_rules_measures_each_text_once(spark, tmp_path):
    rows = [(i, " ".join(f"w{i * k % 97}" for k in range(70)) if i % 3 else None, "en", f"s{i % 2}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "d"))
    kept = quality.clean(spark.read.parquet(str(tmp_path / "d")))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.count("FileScan") > 0  # a second one is a second Python worker in every task
    assert {r.doc_id for r in kept.collect()} <= {i for i in range(30) if i % 3}
