"""Sessions: roll-up, filter, distributions, sample, top categories and their top sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import div, group_concat_distinct, ratio2, seconds_between
from ..plans.params import TaskParams

#: Upper bounds, inclusive, of each bucket; the next one begins one above. Fixed values.
VISIT = {
    "visit_1s_3s": (1, 3),
    "visit_4s_6s": (4, 6),
    "visit_7s_9s": (7, 9),
    "visit_10s_30s": (10, 30),
    "visit_30s_60s": (31, 60),
    "visit_1m_3m": (61, 180),
    "visit_3m_10m": (181, 600),
    "visit_10m_30m": (601, 1800),
    "visit_30m": (1801, None),
}
STEP = {"step_1_3": (1, 3), "step_4_6": (4, 6), "step_7_9": (7, 9), "step_10_30": (10, 30), "step_30_60": (31, 60), "step_60": (61, None)}


def roll_up(actions: DataFrame) -> DataFrame:
    """One row a session; one shuffle, with partial aggregation."""
    return actions.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"),
        group_concat_distinct(F.col("search_keyword")).alias("search_keywords"),
        F.array_join(F.transform(F.array_sort(F.collect_set("click_category_id")), lambda x: x.cast("string")), ",").alias("click_category_ids"),
        F.min("action_time").alias("start_time"),
        seconds_between(F.max("action_time"), F.min("action_time")).alias("visit_length"),
        F.count("*").alias("step_length"),
    )


def full_info(sessions: DataFrame, users: DataFrame, map_side_bytes: int | None = None) -> DataFrame:
    """Inner: sessions of unknown users drop out.

    Spark broadcasts the users only under its size threshold; ``map_side_bytes`` asks for it up to that size.
    """
    users = users.select("user_id", "age", "professional", "city", "sex")
    return map_side_join(sessions, users, "user_id", map_side_bytes) if map_side_bytes else sessions.join(users, "user_id")


def map_side_join(facts: DataFrame, side: DataFrame, key: str, most_bytes: int) -> DataFrame:
    """An inner join that broadcasts ``side`` while its rows times their usual width are at most ``most_bytes``, else a shuffled one.

    The planner's own size is that of the compressed files, a fraction of what a broadcast takes.
    """
    size = side.count() * side._jdf.schema().defaultSize()
    return facts.join(F.broadcast(side) if size <= most_bytes else side.hint("shuffle_merge"), key)


def hottest(df: DataFrame, key: str, k: int = 1) -> DataFrame:
    """The ``k`` most frequent keys with their rows; ties go to the lesser key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), key).limit(k)


def bernoulli_sample(df: DataFrame, key: str, share: float, seed: int = 41) -> DataFrame:
    """Each row with probability ``share``, by a hash of its key and the seed: partitioning and retries change nothing."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.where(hashed < int(share * (1 << 32)))


def matches(p: TaskParams) -> Column:
    """All given predicates; a null value fails a predicate that is given."""
    test = F.lit(True)
    if p.start_age is not None:
        test &= F.col("age") >= p.start_age
    if p.end_age is not None:
        test &= F.col("age") <= p.end_age
    if p.professionals:
        test &= F.col("professional").isin(*p.professionals)
    if p.cities:
        test &= F.col("city").isin(*p.cities)
    if p.sex:
        test &= F.col("sex") == p.sex
    for column, wanted in (("search_keywords", p.keywords), ("click_category_ids", p.category_ids)):
        if wanted:
            test &= F.arrays_overlap(F.split(column, ","), F.array(*[F.lit(str(x)) for x in wanted]))
    return F.coalesce(test, F.lit(False))


def keep(sessions: DataFrame, p: TaskParams) -> DataFrame:
    return sessions.where(matches(p))


def _counts(column: str, buckets: dict) -> list[Column]:
    c = F.col(column)
    return [F.count_if((c >= low) & (c <= high) if high else c >= low).alias(name) for name, (low, high) in buckets.items()]


def visit_buckets(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("session_count"), *_counts("visit_length", VISIT))


def step_buckets(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("session_count"), *_counts("step_length", STEP))


def aggr_stat(sessions: DataFrame) -> DataFrame:
    """Session count and the ratio of each bucket, in one pass."""
    return aggr_stat_of(sessions.agg(F.count("*").alias("session_count"), *_counts("visit_length", VISIT), *_counts("step_length", STEP)))


#: What the pass that keeps sessions counts on its way.
COUNTERS = ("session_count", *VISIT, *STEP)


def counted(sessions: DataFrame, observation) -> DataFrame:
    """``sessions`` as they are; the pass that reads them leaves the counters of aggr_stat() in ``observation``."""
    return sessions.observe(observation, F.count(F.lit(1)).alias("session_count"), *_counts("visit_length", VISIT), *_counts("step_length", STEP))


def aggr_stat_of(counters: DataFrame) -> DataFrame:
    """aggr_stat() from a row of COUNTERS."""
    return counters.select("session_count", *[ratio2(F.col(c), F.col("session_count")).alias(c) for c in (*VISIT, *STEP)])


def hour_count(sessions: DataFrame) -> DataFrame:
    return (
        sessions.groupBy(F.date_format("start_time", "yyyy-MM-dd").alias("date"), F.date_format("start_time", "HH").alias("hour"))
        .agg(F.count("*").alias("sessions"))
    )


def random_extract(sessions: DataFrame, total: int = 1000, parts: int = 16) -> DataFrame:
    """A sample proportional to each day's hours: total div days a day, shared by hour, rounded down; reproducible by md5 of the id."""
    hours = hour_count(sessions)
    days = hours.agg(F.countDistinct("date").alias("n_days"))  # one row
    of_day = F.sum("sessions").over(Window.partitionBy("date"))
    quota = (
        hours.withColumn("of_day", of_day)
        .crossJoin(F.broadcast(days))
        .withColumn("quota", F.least("sessions", div(F.col("sessions") * div(F.lit(total), F.col("n_days")), F.col("of_day"))))
    )
    timed = sessions.select(
        "session_id",
        "start_time",
        "search_keywords",
        "click_category_ids",
        F.date_format("start_time", "yyyy-MM-dd").alias("date"),
        F.date_format("start_time", "HH").alias("hour"),
    )
    # ranked by part of an hour first: what the second ranking sees of an hour is at most its quota from each part
    part = F.pmod(F.xxhash64("session_id"), F.lit(parts))
    order = [F.md5("session_id"), F.col("session_id")]
    quotas = quota.where("quota > 0").select("date", "hour", "quota")  # a row an hour
    first = (
        timed.join(F.broadcast(quotas), ["date", "hour"])
        .withColumn("rn", F.row_number().over(Window.partitionBy("date", "hour", part).orderBy(*order)))
        .where("rn <= quota")
    )
    ranked = first.withColumn("rn", F.row_number().over(Window.partitionBy("date", "hour").orderBy(*order)))
    return (
        ranked.where("rn <= quota")
        .select(
            "session_id",
            F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
            "search_keywords",
            "click_category_ids",
        )
    )


def of_sessions(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Actions of the given sessions."""
    return actions.join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def detail(actions: DataFrame) -> DataFrame:
    missing = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return actions.select(
        "event_id",
        "user_id",
        "session_id",
        "page_id",
        F.date_format("action_time", "yyyy-MM-dd HH:mm:ss").alias("action_time"),
        "search_keyword",
        missing("click_category_id"),
        missing("click_product_id"),
        "order_category_ids",
        "order_product_ids",
        "pay_category_ids",
        "pay_product_ids",
    )


def category_events(actions: DataFrame) -> DataFrame:
    """category_id, kind: one row for each category clicked, ordered or paid."""
    listed = lambda column, kind: F.transform(
        F.coalesce(F.split(column, ","), F.array().cast("array<string>")),
        lambda x: F.struct(x.try_cast("long").alias("category_id"), F.lit(kind).alias("kind")),
    )
    clicked = (
        F.when(
            F.col("click_category_id").isNotNull(),
            F.array(F.struct(F.col("click_category_id").alias("category_id"), F.lit("click").alias("kind"))),
        )
        .otherwise(F.array().cast("array<struct<category_id:bigint,kind:string>>"))
    )
    return (
        actions.select(F.inline(F.concat(clicked, listed("order_category_ids", "order"), listed("pay_category_ids", "pay"))))
        .where("category_id IS NOT NULL")
    )


def category_universe(actions: DataFrame) -> DataFrame:
    return category_events(actions).select("category_id").distinct()


def category_count(actions: DataFrame, kind: str) -> DataFrame:
    return category_events(actions).where(F.col("kind") == kind).groupBy("category_id").agg(F.count("*").alias(f"{kind}_count"))


def top_categories(actions: DataFrame, k: int = 10) -> DataFrame:
    """By clicks, orders, payments, then least id: one scan and one aggregate instead of three left joins."""
    counted = (
        category_events(actions)
        .groupBy("category_id")
        .agg(*[F.count_if(F.col("kind") == kind).alias(f"{kind}_count") for kind in ("click", "order", "pay")])
    )
    return counted.orderBy(F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), "category_id").limit(k)


def session_category_count(actions: DataFrame) -> DataFrame:
    return (
        actions.where("click_category_id IS NOT NULL")
        .groupBy(F.col("click_category_id").alias("category_id"), "session_id")
        .agg(F.count("*").alias("click_count"))
    )


def top_sessions(actions: DataFrame, categories: DataFrame, k: int = 10) -> DataFrame:
    """The k sessions with most clicks of each top category; ``categories`` has k rows."""
    ranked = (
        session_category_count(actions)
        .join(F.broadcast(categories.select("category_id")), "category_id")
        .withColumn("rn", F.row_number().over(Window.partitionBy("category_id").orderBy(F.desc("click_count"), "session_id")))
    )
    return ranked.where(F.col("rn") <= k).select("category_id", "session_id", "click_count")


def top_session_detail(actions: DataFrame, top: DataFrame) -> DataFrame:
    """A session in two categories is there twice."""
    return detail(actions).join(top.select("session_id", "category_id"), "session_id")


def salted_category_count(actions: DataFrame, salts: int = 10) -> DataFrame:
    """Clicks a category in two steps, for hot categories: by salt, then over salts."""
    clicks = (
        actions.where("click_category_id IS NOT NULL")
        .select(F.col("click_category_id").alias("category_id"), F.pmod(F.xxhash64("event_id"), F.lit(salts)).alias("salt"))
    )
    return clicks.groupBy("category_id", "salt").agg(F.count("*").alias("n")).groupBy("category_id").agg(F.sum("n").alias("click_count"))


def skew_join(facts: DataFrame, side: DataFrame, key: str, row_id: str, salts: int = 10) -> DataFrame:
    """An inner join with each fact in one of ``salts`` parts and each side row in all of them once.

    Spark sizes the copied side as if it were not copied; merged, it is sorted in parts that spill, and never broadcast.
    """
    left = facts.withColumn("__salt", F.pmod(F.xxhash64(row_id), F.lit(salts)))
    right = side.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right.hint("merge"), [key, "__salt"]).drop("__salt")


def split_skew_join(facts: DataFrame, side: DataFrame, key: str, row_id: str, hot: int = 1, salts: int = 10) -> DataFrame:
    """An inner join in two branches: rows of the ``hot`` most frequent keys are salted, the others joined plainly; then their union."""
    keys = hottest(facts, key, hot).select(key)  # so many rows
    often = skew_join(facts.join(F.broadcast(keys), key, "left_semi"), side.join(F.broadcast(keys), key, "left_semi"), key, row_id, salts)
    return facts.join(F.broadcast(keys), key, "left_anti").join(side, key).unionByName(often)


def hot_keys(df: DataFrame, key: str, k: int = 20, share: float = 0.02, tracked: int = 1000) -> DataFrame:
    """``key``, ``share``: the at most ``k`` keys that hold about ``share`` of the rows or more, from one pass.

    The counts are those of a mergeable sketch of ``tracked`` items, too high by rows / tracked or so at most; a key of
    that share is never missed while the share is above that error.
    """
    total = df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k({key}, {k}, {tracked})").alias("top"))
    found = total.select("n", F.explode("top").alias("t")).select(F.col("t.item").alias(key), (F.col("t.count") / F.col("n")).alias("share"))
    return found.where(F.col("share") >= share)


def sketch_skew_join(facts: DataFrame, side: DataFrame, key: str, row_id: str, k: int = 20, share: float = 0.02) -> DataFrame:
    """An inner join in which a key has as many salts as it holds ``share``s of the facts; the other keys have one.

    One sketch of the facts, and one join; the table of hot keys has ``k`` rows at most. Null keys join nothing.
    """
    hot = hot_keys(facts, key, k, share).select(F.col(key).alias("__hot"), F.ceil(F.col("share") / share).cast("long").alias("__salts"))
    salts = F.coalesce("__salts", F.lit(1).cast("long"))
    left = facts.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64(row_id), salts)).drop("__hot", "__salts")
    right = side.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("__hot", "__salts")
    return left.join(right, [key, "__salt"]).drop("__salt")


def keep_by_task(actions: DataFrame, users: DataFrame, tasks: DataFrame) -> DataFrame:
    """task_id, session_id of the sessions that match each task, all tasks in one pass over the actions.

    ``tasks`` as from params.task_rows(). Actions are rolled up by session and day once; a task takes the days of its
    range, so what is copied for a task is a session's day, not its actions.
    """
    days = actions.groupBy("session_id", "date").agg(
        F.min("user_id").alias("user_id"),
        F.collect_set("search_keyword").alias("keywords"),
        F.collect_set(F.col("click_category_id").cast("string")).alias("categories"),
    )
    span = actions.agg(F.min("date").alias("first"), F.max("date").alias("last"))  # one row
    low, high = F.greatest("start_date", "first").cast("date"), F.least("end_date", "last").cast("date")  # an open end is null, and skipped
    ranges = tasks.crossJoin(F.broadcast(span)).where(low <= high)
    by_day = ranges.select(*tasks.columns, F.explode(F.sequence(low, high)).alias("date")).withColumn("date", F.col("date").cast("string"))
    own = by_day.select("task_id", "date").join(days, "date").groupBy("task_id", "session_id")
    rolled = own.agg(
        F.min("user_id").alias("user_id"),
        F.array_distinct(F.flatten(F.collect_list("keywords"))).alias("keywords"),
        F.array_distinct(F.flatten(F.collect_list("categories"))).alias("categories"),
    )
    known = users.select("user_id", "age", "professional", "city", "sex")
    asked = rolled.join(known, "user_id").join(tasks, "task_id")
    any_of = lambda wanted, test: F.col(wanted).isNull() | test
    good = (
        any_of("start_age", F.col("age") >= F.col("start_age"))
        & any_of("end_age", F.col("age") <= F.col("end_age"))
        & any_of("professionals", F.array_contains("professionals", F.col("professional")))
        & any_of("cities", F.array_contains("cities", F.col("city")))
        & any_of("task_sex", F.col("sex") == F.col("task_sex"))
        & any_of("task_keywords", F.arrays_overlap("keywords", "task_keywords"))
        & any_of("category_ids", F.arrays_overlap("categories", "category_ids"))
    )
    return asked.where(good).select("task_id", "session_id")
