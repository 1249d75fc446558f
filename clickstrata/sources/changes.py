"""Tables that batches change without rewriting what they hold: a batch writes its changes, a reader merges them.

``<path>/batch_id=<n>`` holds the changes of one batch, and nothing of others; a repeated batch replaces just that folder.
A compaction folds the batches up to a number into ``<path>/_base/to=<n>``, by date. A folder counts once Spark has marked
it as whole (``_SUCCESS``), so what a batch left when it was broken off is not read, and the batch's next try replaces it.
Folded folders stay until the next compaction, for readers that have already listed them.

What a batch writes follows its own keys, not what the table holds; what a read costs is bounded by compactions.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = 50  # batches between compactions


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the whole folders ``<prefix><n>`` in ``path``, in order."""
    folder, files = _files(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    found = sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())
    success = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [n for n in found if files.exists(success(f"{path}/{prefix}{n}/_SUCCESS"))]


def _delete(spark: SparkSession, path: str) -> None:
    folder, files = _files(spark, path)
    files.delete(folder, True)


@dataclass(frozen=True)
class Changes:
    """``merge``: ``sum`` adds the values of a key; ``newest`` takes a key's last ones; ``group`` takes all rows of the last batch that wrote a key."""

    path: str
    keys: tuple[str, ...]
    schema: str  # of all columns, as DDL
    merge: str = "sum"
    by: str | None = "date"  # what compacted rows are partitioned by

    def _columns(self, spark: SparkSession) -> list[str]:
        return spark.createDataFrame([], self.schema).columns

    def write(self, df: DataFrame, batch_id: int) -> None:
        """The batch's changes, in place of those that an earlier try of it wrote."""
        df.select(*self._columns(df.sparkSession)).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def rows(self, spark: SparkSession, before: int | None = None, after: int | None = None) -> DataFrame:
        """Unmerged rows with ``batch_id``, of batches under ``before``; with ``after`` those that are not folded up to there."""
        columns, parts = self._columns(spark), []
        bases = [n for n in _numbers(spark, f"{self.path}/_base", "to=") if before is None or n < before] if after is None else []
        low = bases[-1] if bases else (-1 if after is None else after)
        if bases:
            base = spark.read.schema(self.schema).parquet(f"{self.path}/_base/to={low}")
            parts.append(base.select(*columns, F.lit(low).cast("long").alias("batch_id")))
        batches = [n for n in _numbers(spark, self.path, "batch_id=") if n > low and (before is None or n < before)]
        if batches:
            read = spark.read.schema(f"{self.schema}, batch_id long").option("basePath", self.path)
            parts.append(read.parquet(*[f"{self.path}/batch_id={n}" for n in batches]).select(*columns, "batch_id"))
        if not parts:
            return spark.createDataFrame([], f"{self.schema}, batch_id long")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def merged(self, rows: DataFrame) -> DataFrame:
        values = [c for c in self._columns(rows.sparkSession) if c not in self.keys]
        if self.merge == "sum":
            return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in values])
        if self.merge == "newest":
            last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values, "batch_id"), "batch_id").alias("__last"))
            return last.select(*self.keys, *[F.col(f"__last.{c}").alias(c) for c in values])
        if self.merge != "group":
            raise ValueError(f"no way to merge by {self.merge}")
        last = rows.groupBy(*self.keys).agg(F.max("batch_id").alias("batch_id"))
        return rows.join(last, [*self.keys, "batch_id"]).select(*self._columns(rows.sparkSession))

    def read(self, spark: SparkSession, before: int | None = None, days: Iterable[str] | None = None) -> DataFrame:
        """The table as batches under ``before`` left it (None: now); with ``days`` those only, pruned in the scan."""
        rows = self.rows(spark, before)
        return self.merged(rows if days is None else rows.where(F.col(self.by).isin(*days)))

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Folds the batches up to a number that will not be repeated any more. Run again, it changes nothing."""
        bases = _numbers(spark, f"{self.path}/_base", "to=")
        if bases and bases[-1] >= upto:
            return
        folded = self.read(spark, upto + 1)
        writer = folded.repartition(self.by).write.mode("overwrite").partitionBy(self.by) if self.by else folded.write.mode("overwrite")
        writer.parquet(f"{self.path}/_base/to={upto}")
        if bases:  # what the last compaction folded, and all bases before it
            for n in [n for n in _numbers(spark, self.path, "batch_id=") if n <= bases[-1]]:
                _delete(spark, f"{self.path}/batch_id={n}")
            for n in bases[:-1]:
                _delete(spark, f"{self.path}/_base/to={n}")

    def add(self, df: DataFrame, batch_id: int, every: int = EVERY) -> None:
        """write(), and now and then a compaction of the batches before."""
        self.write(df, batch_id)
        if batch_id and batch_id % every == 0:
            self.compact(df.sparkSession, batch_id - 1)
