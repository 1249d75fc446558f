"""The string functions by name for SQL texts: SQL-bodied functions of the session, which the optimizer inlines.

An aggregate cannot be the body of such a function, so ``group_concat_distinct`` takes what ``collect_set`` or
``collect_list`` has gathered. Null arguments give null, as in Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "concat_long_string": ("number BIGINT, separator STRING, text STRING", "STRING", "concat(cast(number AS STRING), separator, text)"),
    "group_concat_distinct": ("texts ARRAY<STRING>", "STRING", "array_join(array_sort(array_distinct(texts)), ',')"),
    "get_json_int": ("json STRING, field STRING", "INT", "try_cast(get_json_object(json, concat('$.', field)) AS INT)"),
    "random_prefix": ("text STRING, salts INT, seed BIGINT", "STRING", "concat(cast(pmod(xxhash64(seed), salts) AS STRING), '_', text)"),
    "remove_random_prefix": ("text STRING", "STRING", "regexp_replace(text, '^[0-9]+_', '')"),
}


def register(spark: SparkSession) -> None:
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
