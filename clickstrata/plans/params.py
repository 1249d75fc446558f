"""Task parameters."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Config


@dataclass(frozen=True)
class TaskParams:
    """Any of them may be missing; lists are tuples."""

    start_date: str | None = None
    end_date: str | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    sex: str | None = None
    keywords: tuple[str, ...] = ()
    category_ids: tuple[int, ...] = ()
    page_flow: tuple[int, ...] = ()

    @classmethod
    def from_json(cls, text: str) -> TaskParams:
        """From a JSON object whose values are arrays; the first element counts, lists in it are comma-separated."""
        raw = json.loads(text)
        one = lambda key: (raw.get(key) or [None])[0]
        many = lambda key, kind=str: tuple(kind(x) for x in str(one(key)).split(",") if x) if one(key) not in (None, "") else ()
        number = lambda key: int(one(key)) if one(key) not in (None, "") else None
        return cls(
            one("startDate"),
            one("endDate"),
            number("startAge"),
            number("endAge"),
            many("professionals"),
            many("cities"),
            one("sex"),
            many("keywords"),
            many("categoryIds", int),
            many("pageFlow", int),
        )


def task_id(arguments: list[str], config: Config | None = None, kind: str = "") -> int:
    """The first argument, or the setting ``task.id.<kind>``; none of them is an error."""
    if arguments:
        return int(arguments[0])
    if config is None:
        raise LookupError("no task id given")
    return config.integer(f"task.id.{kind}")


def find_task(tasks: DataFrame, task_id: int) -> TaskParams:
    """The parameters of one task; an unknown id is an error."""
    found = tasks.where(F.col("task_id") == task_id).select("task_param").head(1)
    if not found:
        raise LookupError(f"no task {task_id}")
    return TaskParams.from_json(found[0][0])


def task_rows(tasks: DataFrame) -> DataFrame:
    """Tasks (task_id, task_param) with their parameters as columns; what is missing or empty is null, lists are arrays of texts.

    The JSON is read in the plan. A parameter that is no JSON object of arrays gives a task without conditions.
    """
    given = F.from_json("task_param", "map<string,array<string>>")
    one = lambda key: F.nullif(F.get(F.try_element_at(given, F.lit(key)), 0), F.lit(""))
    parts = lambda key: F.filter(F.split(one(key), ","), lambda x: x != "")
    many = lambda key: F.when(F.size(parts(key)) > 0, parts(key))
    return tasks.select(
        "task_id",
        one("startDate").alias("start_date"),
        one("endDate").alias("end_date"),
        one("startAge").try_cast("int").alias("start_age"),
        one("endAge").try_cast("int").alias("end_age"),
        many("professionals").alias("professionals"),
        many("cities").alias("cities"),
        one("sex").alias("task_sex"),
        many("keywords").alias("task_keywords"),
        many("categoryIds").alias("category_ids"),
    )
