"""Tables: stored files, catalog, JDBC, streams; and the views over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import Config
from .folders import new_folder

FETCHED = 10_000  # rows that the driver holds of a database in its process


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def save_table(spark: SparkSession, df: DataFrame, name: str, by: str = "date") -> DataFrame:
    """``df`` as a table of the catalog, partitioned by ``by`` and with statistics, which joins and pruning use; its files are in the shared folder."""
    df.repartition(by).write.mode("overwrite").option("path", new_folder(spark, "table")).partitionBy(by).saveAsTable(name)
    columns = ", ".join(c for c, t in df.dtypes if c != by and t in ("bigint", "int", "double", "string"))
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {columns}")
    return spark.table(name)


def in_process(url: str) -> bool:
    """Whether the database is embedded Derby: it lives in the process that opened it, the driver, and executors cannot reach it."""
    return url.startswith("jdbc:derby:") and not url.startswith("jdbc:derby://")


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Read by the executors; from a database in this process, copied to the shared folder by the driver, a batch at a time."""
    found = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return _copied(found, url, table) if in_process(url) else found


def _copied(found: DataFrame, url: str, table: str) -> DataFrame:
    spark, path = found.sparkSession, new_folder(found.sparkSession, "jdbc")
    jvm, schema = spark._jvm, found._jdf.schema()
    spark.createDataFrame([], found.schema).write.parquet(path)
    connection = jvm.java.sql.DriverManager.getConnection(url)
    try:
        rows = connection.createStatement().executeQuery(f"SELECT * FROM {table}")
        utils = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils
        batches = utils.resultSetToRows(rows, schema).grouped(FETCHED)
        while batches.hasNext():
            batch = jvm.scala.jdk.javaapi.CollectionConverters.asJava(batches.next())
            spark._jsparkSession.createDataFrame(batch, schema).write().mode("append").parquet(path)
    finally:
        connection.close()
    return spark.read.schema(found.schema).parquet(path)


def kafka_lines(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """The ad log topic as a stream of ``value`` strings; needs Spark's Kafka package."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )


def text_lines(spark: SparkSession, path: str, files_per_batch: int | None = 1) -> DataFrame:
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else spark.readStream
    return reader.text(path)


def parse_ad_log(lines: DataFrame) -> DataFrame:
    """ts, province, city, user_id, ad_id from ``epochms province city userid adid``; lines that do not fit are dropped."""
    part = lambda i: F.get(F.split("value", " "), i)
    parsed = lines.select(
        F.timestamp_millis(part(0).try_cast("long")).alias("ts"),
        part(1).alias("province"),
        part(2).alias("city"),
        part(3).try_cast("long").alias("user_id"),
        part(4).try_cast("long").alias("ad_id"),
    )
    return parsed.where("ts IS NOT NULL AND user_id IS NOT NULL AND ad_id IS NOT NULL")


def date_range(df: DataFrame, start: str | None, end: str | None, column: str = "date") -> DataFrame:
    """Both ends inclusive; a missing end is open."""
    if start:
        df = df.where(F.col(column) >= start)
    if end:
        df = df.where(F.col(column) <= end)
    return df


VIEWS = ("user_visit_action", "user_info", "product_info", "city_info", "ad_log")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = VIEWS, days: tuple = ()) -> None:
    """The views over the synthetic tables, as temporary views of the session; ``days``: first and last of the actions."""
    for name in names:
        globals()[name](spark, sf_dir, *(days if name == "user_visit_action" else ())).createOrReplaceTempView(name)


def source(spark: SparkSession, name: str, sf_dir: str, config: Config, *days: str | None) -> DataFrame:
    """A table of the catalog, or, where the setting ``local`` says so, the synthetic view of its name, of the ``days`` asked for."""
    if config.boolean("local", False):
        register_views(spark, sf_dir, (name,), days)
    return catalog(spark, name)


def ad_log_lines(log: DataFrame) -> DataFrame:
    """An ad log as lines ``epochms province city userid adid``; blanks inside names become underscores."""
    word = lambda c: F.translate(c, " ", "_")
    return log.select(F.concat_ws(" ", F.unix_millis("ts"), word("province"), word("city"), "user_id", "ad_id").alias("value"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def user_visit_action(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The click log: one row an action. Days outside ``start`` to ``end`` (inclusive) are left out in the scan."""
    whole = lambda a, b: F.call_function("div", a, b)
    kind = lambda name, value: F.when(F.col("event_type") == name, value)
    k, s, p = F.col("k"), F.col("s"), F.col("p")
    events = stored(spark, sf_dir, "events")
    if start:
        events = events.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        events = events.where(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    e = events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        _k().alias("k"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(1704067200)).alias("s"),
    )
    e = e.withColumn("p", F.when(F.col("user_id") % 3 == 0, 86400).when(F.col("user_id") % 3 == 1, 864000).otherwise(2592000).cast("long"))
    at = F.lit(1704067200) + whole(s, p) * p + (F.col("user_id") % 23) * 3600 + whole(s % p, whole(p, F.lit(2160)))
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        "user_id",
        F.concat_ws("_", F.col("user_id").cast("string"), whole(s, p).cast("string")).alias("session_id"),
        (F.col("event_id") % 10).alias("page_id"),
        F.timestamp_seconds(at).alias("action_time"),
        kind("view", F.concat(F.lit("kw"), (k % 10).cast("string"))).alias("search_keyword"),
        kind("click", k % 20).alias("click_category_id"),
        kind("click", k).alias("click_product_id"),
        kind("purchase", F.concat_ws(",", (k % 20).cast("string"), ((k + 7) % 20).cast("string"))).alias("order_category_ids"),
        kind("purchase", k.cast("string")).alias("order_product_ids"),
        kind("signup", (k % 20).cast("string")).alias("pay_category_ids"),
        kind("signup", k.cast("string")).alias("pay_product_ids"),
        (F.col("user_id") % 26).alias("city_id"),
        "event_id",
    )


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stored(spark, sf_dir, "customer").where("c_custkey % 10 <> 7")
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        (F.lit(18) + F.col("c_custkey") % 50).cast("int").alias("age"),
        F.col("c_mktsegment").alias("professional"),
        F.concat(F.lit("city"), F.col("c_nationkey").cast("string")).alias("city"),
        F.when(F.col("c_custkey") % 2 == 0, "female").otherwise("male").alias("sex"),
    )


def product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.concat(F.lit('{"product_status":'), (F.col("p_size") % 2).cast("string"), F.lit("}"))
    return (
        stored(spark, sf_dir, "part")
        .select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), status.alias("extend_info"))
    )


def city_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = stored(spark, sf_dir, "nation"), stored(spark, sf_dir, "region")
    return (
        n.join(r, n.n_regionkey == r.r_regionkey)
        .select(F.col("n_nationkey").cast("long").alias("city_id"), F.col("n_name").alias("city_name"), F.col("r_name").alias("area"))
    )


def ad_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = (
        stored(spark, sf_dir, "events")
        .select(F.col("ts").cast("timestamp").alias("ts"), "user_id", (_k() % 5).alias("ad_id"), (F.col("user_id") % 25).alias("city_id"))
    )
    return (
        e.join(city_info(spark, sf_dir), "city_id")
        .select("ts", F.col("area").alias("province"), F.col("city_name").alias("city"), "user_id", "ad_id")
    )
