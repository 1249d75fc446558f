"""Ad clicks in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def day(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.date_format("ts", "yyyy-MM-dd"))


def user_click_count(log: DataFrame) -> DataFrame:
    return day(log).groupBy("date", "user_id", "ad_id").agg(F.count("*").alias("click_count"))


def blacklist(counts: DataFrame, threshold: int = 100) -> DataFrame:
    """Users with so many clicks on one ad in one day (inclusive)."""
    return counts.where(F.col("click_count") >= threshold).select("user_id").distinct()


def without(log: DataFrame, black: DataFrame) -> DataFrame:
    return log.join(black, "user_id", "left_anti")


def stat(log: DataFrame) -> DataFrame:
    return day(log).groupBy("date", "province", "city", "ad_id").agg(F.count("*").alias("click_count"))


def province_top(stats: DataFrame, k: int = 3) -> DataFrame:
    by = stats.groupBy("date", "province", "ad_id").agg(F.sum("click_count").alias("click_count"))
    return (
        by.withColumn("rn", F.row_number().over(Window.partitionBy("date", "province").orderBy(F.desc("click_count"), "ad_id")))
        .where(F.col("rn") <= k)
        .drop("rn")
    )


def click_trend(log: DataFrame) -> DataFrame:
    """Clicks a minute and ad, of all users."""
    part = lambda f, name: F.date_format("ts", f).alias(name)
    return log.groupBy(part("yyyy-MM-dd", "date"), part("HH", "hour"), part("mm", "minute"), "ad_id").agg(F.count("*").alias("click_count"))


def last_hour(log: DataFrame) -> DataFrame:
    """The trend of the last 60 minutes up to the newest one."""
    minute = F.date_trunc("minute", "ts")
    newest = log.agg(F.max(minute).alias("newest"))  # one row
    return click_trend(log.crossJoin(F.broadcast(newest)).where(minute > F.col("newest") - F.expr("INTERVAL 60 MINUTES")).drop("newest"))
