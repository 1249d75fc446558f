"""The most clicked products of each area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import concat_long_string, group_concat_distinct, json_int_field

#: Areas of the first levels; others have the last one.
LEVELS = {"A级": ("AFRICA", "AMERICA"), "B级": ("ASIA",), "C级": ("EUROPE",)}
LAST_LEVEL = "D级"
OWN, OTHER = "自营商品", "第三方商品"  # fixed values


def click_basic(actions: DataFrame, cities: DataFrame) -> DataFrame:
    """city_id, city_name, area, product_id of clicks in known cities."""
    clicks = actions.where("click_product_id IS NOT NULL").select("city_id", F.col("click_product_id").alias("product_id"))
    return clicks.join(cities, "city_id").select("city_id", "city_name", "area", "product_id")


def area_count(clicks: DataFrame) -> DataFrame:
    infos = group_concat_distinct(concat_long_string(F.col("city_id"), ":", F.col("city_name")))
    return clicks.groupBy("area", "product_id").agg(F.count("*").alias("click_count"), infos.alias("city_infos"))


def full_product(counts: DataFrame, products: DataFrame) -> DataFrame:
    status = F.when(json_int_field(F.col("extend_info"), "product_status") == 0, OWN).otherwise(OTHER)
    return (
        counts.join(products, "product_id")
        .select("area", "product_id", "click_count", "city_infos", "product_name", status.alias("product_status"))
    )


def area_top(full: DataFrame, k: int = 3, levels: dict | None = None) -> DataFrame:
    level = F.lit(LAST_LEVEL)
    for name, areas in reversed((levels or LEVELS).items()):
        level = F.when(F.col("area").isin(*areas), name).otherwise(level)
    ranked = full.withColumn("rn", F.row_number().over(Window.partitionBy("area").orderBy(F.desc("click_count"), "product_id")))
    return (
        ranked.where(F.col("rn") <= k)
        .select("area", level.alias("area_level"), "product_id", "click_count", "city_infos", "product_name", "product_status")
    )


#: The whole job as SQL over the views user_visit_action, city_info and product_info, by the functions of functions.sql.
AREA_TOP = """
WITH clicks AS (
    SELECT a.city_id, c.city_name, c.area, a.click_product_id AS product_id
    FROM user_visit_action a JOIN city_info c ON c.city_id = a.city_id
    WHERE a.click_product_id IS NOT NULL AND a.date BETWEEN :start AND :end
), salted AS (
    SELECT random_prefix(concat_ws('_', area, product_id), 10, city_id) AS salted, area, product_id, count(*) AS n,
        collect_set(concat_long_string(city_id, ':', city_name)) AS cities
    FROM clicks GROUP BY ALL
), counted AS (
    SELECT remove_random_prefix(salted) AS key, area, product_id, sum(n) AS click_count, group_concat_distinct(flatten(collect_list(cities))) AS city_infos
    FROM salted GROUP BY ALL
), told AS (
    SELECT c.area, c.product_id, c.click_count, c.city_infos, p.product_name, IF(get_json_int(p.extend_info, 'product_status') = 0, '自营商品', '第三方商品') AS product_status,
        row_number() OVER (PARTITION BY c.area ORDER BY c.click_count DESC, c.product_id) AS rn
    FROM counted c JOIN product_info p ON p.product_id = c.product_id
)
SELECT area, CASE WHEN area IN ('AFRICA', 'AMERICA') THEN 'A级' WHEN area = 'ASIA' THEN 'B级' WHEN area = 'EUROPE' THEN 'C级' ELSE 'D级' END AS area_level,
    product_id, click_count, city_infos, product_name, product_status
FROM told WHERE rn <= 3
"""


def area_top_sql(spark, start: str, end: str) -> DataFrame:
    """AREA_TOP for a range of days; the session has its views and functions."""
    return spark.sql(AREA_TOP, {"start": start, "end": end})
