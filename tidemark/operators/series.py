"""Series coverage, spans, catalogues and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import bucket, day_number, with_halo


def series_coverage(df: DataFrame, key: str, day: str, value: str, reason: str | None = None) -> DataFrame:
    """A10: per series, and in total (key null): cells, populated, missing, the missing ones before the first, between,
    after the last value or in a series without any, valid date range, and cells of an error reason. Zero is a value."""
    has = F.col(value).isNotNull()
    edges = df.groupBy(key).agg(F.min(F.when(has, F.col(day))).alias("_f"), F.max(F.when(has, F.col(day))).alias("_l"))
    rows = df.join(edges.withColumnRenamed(key, "_key"), df[key].eqNullSafe(F.col("_key")))
    gone = ~has
    count = lambda c: F.count(F.when(c, 1))
    aggs = [
        F.count("*").alias("cells"), count(has).alias("populated"), count(gone).alias("missing"),
        count(gone & (F.col(day) < F.col("_f"))).alias("before_first"), count(gone & (F.col(day) > F.col("_f")) & (F.col(day) < F.col("_l"))).alias("interior"),
        count(gone & (F.col(day) > F.col("_l"))).alias("after_last"), count(gone & F.col("_f").isNull()).alias("all_missing"),
        F.min(F.when(has, F.col(day))).alias("first_valid"), F.max(F.when(has, F.col(day))).alias("last_valid"),
        (count(F.col(reason).contains("error")) if reason else F.lit(0).cast("long")).alias("errors"),
    ]
    return rows.rollup(key).agg(F.grouping(key).alias("is_total"), *aggs)


def metric_coverage(observations: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Number of observations and gaps per metric and frequency."""
    both = observations.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("g")).unionByName(gaps.select(*keys, F.lit(0).alias("o"), F.lit(1).alias("g")))
    return both.groupBy(*keys).agg(F.sum("o").alias("observations"), F.sum("g").alias("gaps"))


def source_inventory(df: DataFrame, key: str, context: list[str], form: str, concept: str, end: str) -> DataFrame:
    """Per issuer: records, records of periodic forms, contexts (null-safe), sorted concepts, range of ends."""
    return df.groupBy(key).agg(
        F.count("*").alias("records"), F.count(F.when(F.col(form).rlike(r"^(10-K|10-Q|20-F|40-F)"), 1)).alias("periodic"),
        F.count_distinct(F.struct(*context)).alias("contexts"), F.array_sort(F.collect_set(concept)).alias("concepts"), F.min(end).alias("first_end"), F.max(end).alias("last_end"),
    )


def severity_summary(df: DataFrame, keys: list[str], severity: str, order: list[str]) -> DataFrame:
    """Per key the number of findings of each severity in ``order`` (worst first) and the worst one."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(severity))
    counts = [F.count(F.when(F.col(severity) == s, 1)).alias(f"n_{s.lower()}") for s in order]
    return df.groupBy(*keys).agg(*counts, F.min_by(severity, F.when(rank > 0, rank)).alias("worst"))


def spans(df: DataFrame, keys: list[str], order: str, day: str, block: int = 1 << 20) -> DataFrame:
    """Runs of consecutive rows (in ``order``) of equal keys: offset of the first row, rows, date range and
    whether dates never fall. ``order`` numbers the stored rows from 0.

    Runs are found within blocks of ``order``, so a key that holds most rows is many tasks' work; then only runs that
    touch an edge of their block are joined to those of the next one.
    """
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    rows = rows.withColumns({"_new": F.coalesce(F.lag(order).over(w) + 1 != F.col(order), F.lit(True)).cast("int"), "_up": F.coalesce(F.lag(day).over(w) <= F.col(day), F.lit(True))})
    rows = rows.withColumn("_run", F.sum("_new").over(w)).withColumn("_up", F.col("_up") | (F.col("_new") == 1))
    runs = rows.groupBy(*keys, "_block", "_run").agg(
        F.min(order).alias("offset"), F.count("*").alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.min("_up").alias("monotonic"), F.min_by(day, order).alias("_head"), F.max_by(day, order).alias("_tail"),
    )
    edge = (F.col("offset") % block == 0) | ((F.col("offset") + F.col("rows")) % block == 0)
    e = Window.partitionBy(*keys).orderBy("offset")
    touch = F.coalesce(F.lag(F.col("offset") + F.col("rows")).over(e) == F.col("offset"), F.lit(False))
    ends = runs.where(edge).withColumns({"_on": touch, "_up": F.col("monotonic") & (~touch | (F.lag("_tail").over(e) <= F.col("_head")))})
    ends = ends.withColumn("_g", F.sum((~F.col("_on")).cast("int")).over(e))
    joined = ends.groupBy(*keys, "_g").agg(F.min("offset").alias("offset"), F.sum("rows").alias("rows"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.min("_up").alias("monotonic"))
    cols = [*keys, "offset", "rows", "first_day", "last_day", "monotonic"]
    return runs.where(~edge).select(*cols).unionByName(joined.select(*cols))


def catalogue(df: DataFrame, key: str, day: str, alias: str) -> DataFrame:
    """Per key: rows, date range, sorted aliases and a shard, the first two hex digits of the key's hash."""
    got = df.groupBy(key).agg(F.count("*").alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.array_sort(F.collect_set(alias)).alias("aliases"))
    return got.withColumn("shard", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2))


def merge_or_conflict(df: DataFrame, keys: list[str], values: list[str], source: str) -> tuple[DataFrame, DataFrame]:
    """(merged, gaps). Rows of a key with equal values become one with all sources, sorted; keys whose rows differ
    are gaps CONFLICTING_VALUES with the number of variants."""
    # both results take the same aggregates, and no distinct count, so that they share one shuffle
    got = df.groupBy(*keys).agg(F.array_distinct(F.collect_set(F.struct(*values))).alias("_all"), F.array_sort(F.collect_set(source)).alias("sources"))
    got = got.select(*keys, F.size("_all").cast("long").alias("variants"), F.array_min("_all").alias("_v"), "sources")
    merged = got.where("variants = 1").select(*keys, "_v.*", "sources")
    return merged, got.where("variants > 1").select(*keys, "variants", "sources", F.lit("CONFLICTING_VALUES").alias("reason"))


def evidence_by_year(df: DataFrame, day: str, tag: str, classes: dict[str, list[str]]) -> DataFrame:
    """Per year the number of rows whose tag is of each class."""
    return df.groupBy(F.year(day).alias("year")).agg(*[F.count(F.when(F.col(tag).isin(tags), 1)).alias(name) for name, tags in classes.items()])


def inventory_ledger(objects: DataFrame, registered: DataFrame, path: str) -> DataFrame:
    """Per namespace and role: objects, unregistered objects, and registered paths that are absent."""
    from tidemark.functions.values import path_role

    a = objects.select(path).distinct().withColumn("_o", F.lit(1))
    b = registered.select(path).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, path, "full").withColumn("_p", path_role(F.col(path)))
    return both.groupBy(F.col("_p.namespace").alias("namespace"), F.col("_p.role").alias("role")).agg(F.count("_o").alias("objects"), F.count(F.when(F.col("_r").isNull(), 1)).alias("unregistered"), F.count(F.when(F.col("_o").isNull(), 1)).alias("absent"))


def lookback(df: DataFrame, keys: list[str], n: int, order: str, periods: bool = False) -> DataFrame:
    """The last ``n`` rows of each key, or the rows of its last ``n`` distinct periods."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    rank = F.dense_rank() if periods else F.row_number()
    return df.withColumn("_rk", rank.over(w)).where(F.col("_rk") <= n).drop("_rk")


def contiguous(df: DataFrame, keys: list[str], start: str, end: str, days: int = 1461) -> DataFrame:
    """Rows with ``touches``: whether a row starts the day after the one before it ends. Keys are scanned in blocks of
    ``days`` of the end, each with the last row before it."""
    laid = with_halo(df, keys, [end, start], 2, bucket(day_number(F.col(end)), days))
    w = Window.partitionBy(*keys, "_block").orderBy(end, start)
    rows = laid.withColumn("touches", F.coalesce(F.lag(F.date_add(end, 1)).over(w) == F.col(start), F.lit(False)))
    return rows.where("_own").select(*df.columns, "touches")
