"""Spark plumbing shared by the operators: table access, shared intermediate tables, text batches."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.folders import new_folder


@functools.lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def tidy() -> None:
    """Gives a Python worker's free memory back to the machine: idle workers live on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Has Python workers take so many rows at a time, so that long texts do not fill them.

    Spark reads this from the session when a query runs and takes it nowhere else; a session's own value is left alone.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":  # Spark's default
        df.sparkSession.conf.set(name, rows)
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores behind it that no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    The table cuts the lineage: a lost executor costs the tasks that were running on it, never the
    stages before, and the reader knows the table's true size when it plans joins.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in buckets of ``key``: later joins and groups by it move no row of it."""
    spark = df.sparkSession
    name = f"stage_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", new_folder(spark)).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay until the application ends
    return found


def forget(df: DataFrame) -> None:
    """Deletes an intermediate table that nothing reads any more: what was made of it is written itself."""
    files = df.inputFiles()
    if not files:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
    if folder.getName().startswith("stage-"):
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def sliced(texts: Iterable[str | None], limit: int = 1 << 18) -> Iterator[list[str]]:
    """Consecutive runs of texts (null: empty) of about ``limit`` characters; one longer text is a run of its own."""
    run: list[str] = []
    held = 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if run and held + len(text) > limit:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run
