"""One-step page conversion along a flow of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ratio2


def flow_splits(df: DataFrame, flow: tuple[int, ...]) -> DataFrame:
    """step, split of the flow: as many rows as it has steps; none for a flow of one page."""
    rows = [(i + 1, f"{a}_{b}") for i, (a, b) in enumerate(zip(flow, flow[1:]))]
    return df.sparkSession.createDataFrame(rows, "step int, split string")


def split_pv(actions: DataFrame, flow: tuple[int, ...]) -> DataFrame:
    """step, split, pv: how often a session went from one page straight to the next; 0 where never."""
    steps = flow_splits(actions, flow)
    by = Window.partitionBy("session_id").orderBy("action_time", "event_id")
    seen = (
        actions.select("session_id", "page_id", "action_time", "event_id")
        .withColumn("before", F.lag("page_id").over(by))
        .where("before IS NOT NULL")
    )
    counted = (
        seen.select(F.concat_ws("_", "before", "page_id").alias("split"))
        .where(F.col("split").isin([f"{a}_{b}" for a, b in zip(flow, flow[1:])]))
        .groupBy("split")
        .agg(F.count("*").alias("pv"))
    )
    return steps.join(F.broadcast(counted), "split", "left").select("step", "split", F.coalesce("pv", F.lit(0)).alias("pv"))


def start_pv(actions: DataFrame, flow: tuple[int, ...]) -> DataFrame:
    return actions.where(F.col("page_id") == flow[0]).agg(F.count("*").alias("start_pv"))


def convert_rate(actions: DataFrame, flow: tuple[int, ...]) -> DataFrame:
    """step, split, rate: pv over the step before, the first over the start page's; null over zero."""
    pv = split_pv(actions, flow).crossJoin(F.broadcast(start_pv(actions, flow)))  # one row
    before = F.coalesce(F.lag("pv").over(Window.orderBy("step")), F.col("start_pv"))  # a row a step
    return pv.select("step", "split", ratio2(F.col("pv"), before).alias("rate"))


def convert_rate_string(rates: DataFrame) -> DataFrame:
    """``a_b=rate|...`` in the flow's order."""
    entries = F.array_sort(
        F.collect_list(
            F.struct("step", F.concat_ws("=", "split", F.coalesce(F.format_string("%.2f", "rate"), F.lit("null"))).alias("entry"))
        )
    )
    return rates.agg(F.array_join(F.transform(entries, lambda e: e["entry"]), "|").alias("convert_rate"))
