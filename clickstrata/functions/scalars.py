"""Scalar and aggregate helpers, all built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio2(n: Column, d: Column) -> Column:
    """n / d to two decimals, half up, in exact integer arithmetic; null for a zero denominator."""
    return F.when(d != 0, F.call_function("div", F.lit(200) * n + d, F.lit(2) * d).cast("double") / F.lit(100.0))


def div(a: Column, b: Column) -> Column:
    """Whole division of integers."""
    return F.call_function("div", a, b)


def is_empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def trim_comma(c: Column) -> Column:
    """One comma off each end."""
    return F.regexp_replace(c, "^,|,$", "")


def fill_with_zero(c: Column) -> Column:
    """To width two; longer strings are null."""
    return F.when(F.length(c) <= 2, F.lpad(c, 2, "0"))


def concat_kv_get(c: Column, field: str, delimiter: str = "|") -> Column:
    """The value of ``field`` in ``k=v|k=v``; null where the value is empty or holds another ``=``."""
    parts = F.filter(
        F.split(c, _quoted(delimiter)),
        lambda p: (F.size(F.split(p, "=")) == 2) & (F.get(F.split(p, "="), 0) == field) & (F.get(F.split(p, "="), 1) != ""),
    )
    return F.get(F.split(F.get(parts, 0), "="), 1)


def concat_kv_set(c: Column, field: str, value: str, delimiter: str = "|") -> Column:
    """``field`` replaced in every pair that names it; the other pairs stay."""
    named = lambda p: F.get(F.split(p, "="), 0) == field
    return F.array_join(
        F.transform(F.split(c, _quoted(delimiter)), lambda p: F.when(named(p), F.lit(f"{field}={value}")).otherwise(p)),
        delimiter,
    )


def concat_long_string(number: Column, sep: str, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(sep), text)


def group_concat_distinct(c: Column, sep: str = ",") -> Column:
    """Distinct non-null values, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def json_int_field(c: Column, field: str) -> Column:
    return F.get_json_object(c, f"$.{field}").try_cast("int")


def random_prefix(c: Column, n: int, *seed: Column) -> Column:
    """A reproducible salt in front of ``c``: the hash of the seed columns, so retries agree."""
    return F.concat(F.pmod(F.xxhash64(*seed), F.lit(n)).cast("string"), F.lit("_"), c)


def remove_random_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^[0-9]+_", "")


def date_hour(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH")


def minute_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")


def format_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def format_date_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def parse_date_key(c: Column) -> Column:
    return F.to_date(c, "yyyyMMdd")


def format_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def parse_time(c: Column) -> Column:
    """Null for what is no time."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))


def today() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def yesterday() -> Column:
    return F.date_format(F.date_sub(F.current_date(), 1), "yyyy-MM-dd")


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))


def before(a: Column, b: Column) -> Column:
    return a < b


def after(a: Column, b: Column) -> Column:
    return a > b


def _quoted(delimiter: str) -> str:
    """The delimiter as a pattern that means just it."""
    return "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
