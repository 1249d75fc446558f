"""Job configuration: typed settings from a properties text, over defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings under this prefix in the session's configuration win over the properties text.
PREFIX = "spark.clickstrata."
TRUE, FALSE = ("true", "yes", "1"), ("false", "no", "0")


@dataclass(frozen=True)
class Config:
    """Keys and values as text; the getters convert and fail loudly on what does not fit."""

    values: dict[str, str]

    @classmethod
    def parse(cls, text: str) -> Config:
        """``key=value`` or ``key: value`` lines; ``#`` and ``!`` begin comments, the last of equal keys counts."""
        values = {}
        for line in text.splitlines():
            line = line.strip()
            if line and line[0] not in "#!":
                at = min((i for i in (line.find("="), line.find(":")) if i >= 0), default=len(line))
                values[line[:at].strip()] = line[at + 1 :].strip()
        return cls(values)

    @classmethod
    def of_session(cls, spark: SparkSession, text: str = "") -> Config:
        own = {k[len(PREFIX) :]: v for k, v in spark.conf.getAll.items() if k.startswith(PREFIX)}
        return cls(cls.parse(text).values | own)

    def text(self, key: str, default: str | None = None) -> str:
        found = self.values.get(key, default)
        if found is None:
            raise KeyError(f"no setting {key}")
        return found

    def integer(self, key: str, default: int | None = None) -> int:
        return int(self.text(key, None if default is None else str(default)))

    def boolean(self, key: str, default: bool | None = None) -> bool:
        found = self.text(key, None if default is None else str(default)).lower()
        if found not in TRUE + FALSE:
            raise ValueError(f"{key} is neither true nor false: {found}")
        return found in TRUE


def settings(lines: DataFrame) -> DataFrame:
    """key, value of stored lines (``value``, and ``at``, their order), as Config.parse() reads them: settings that are too many for the driver."""
    line = F.trim("value")
    parsed = lines.where((line != "") & ~F.substring(line, 1, 1).isin("#", "!")).select(
        F.trim(F.regexp_extract(line, "^([^=:]*)", 1)).alias("key"),
        F.trim(F.regexp_extract(line, "^[^=:]*[=:](.*)$", 1)).alias("value"),
        "at",
    )
    return parsed.groupBy("key").agg(F.max_by("value", "at").alias("value"))
