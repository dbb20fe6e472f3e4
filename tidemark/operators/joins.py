"""Joins over entities, validity intervals and dates. Every range join keeps an equality key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ranges


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> list[Column]:
    return [a[k].eqNullSafe(b[k]) for k in keys]


def left_with_coverage(anchor: DataFrame, facts: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Every anchor row with its facts, if any; record_status and value_status say which is absent."""
    marked = facts.withColumn("_there", F.lit(True))
    out = anchor.join(marked, key, "left")
    record = F.when(F.col("_there"), "PRESENT").otherwise("NO_ELIGIBLE_RECORD")
    val = F.when(F.col("_there").isNull(), "NOT_APPLICABLE").when(F.col(value).isNull(), "NULL_IN_SOURCE").otherwise("PRESENT")
    return out.withColumns({"record_status": record, "value_status": val}).drop("_there")


def joined_counts(anchor: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Number of facts per key of the anchor that has any. Facts are counted before the join."""
    return anchor.select(key).join(facts.groupBy(key).agg(F.count("*").alias("n")), key)


def interval_join(points: DataFrame, intervals: DataFrame, key: str, day: str, start: str, end: str, label: str) -> DataFrame:
    """Each point with the label whose interval (both ends in, null ends open) holds its day: the label if it is
    the only one, else null, with status FOUND, AMBIGUOUS or NONE. Points are told apart by all their columns; repeated
    points come back once with ``points`` counting them.

    Intervals are cut into ranges of days of 4^n (``ranges.py``) and each different day of a key looks up the ranges that
    hold it, of which each has one row, so points and intervals of a key are not paired. A null day is only in intervals
    open at both ends; null keys and labels match nothing. Neither side is broadcast: Spark takes a row that stands for
    twelve ranges for one.
    """
    cols = points.columns
    p = points.groupBy(*cols).agg(F.count("*").alias("points"))
    i = intervals.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(label).alias("_l"))
    i = ranges.cut(i.where("_k is not null and _l is not null"), F.col("_s"), F.col("_e"))
    i = i.groupBy("_k", "_r").agg(F.min("_l").alias("_low"), F.max("_l").alias("_high"))
    asked = points.where(F.col(key).isNotNull()).select(F.col(key).alias("_p"), F.col(day).alias("_d")).distinct()
    hits = asked.withColumn("_in", F.explode(ranges.holding(F.col("_d")))).hint("merge").join(i, (F.col("_p") == F.col("_k")) & (F.col("_in") == F.col("_r")))
    hits = hits.groupBy("_p", "_d").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    got = p.join(hits, F.col(key).eqNullSafe(F.col("_p")) & F.col(day).eqNullSafe(F.col("_d")), "left")
    one = F.col("_low") == F.col("_high")
    status = F.when(F.col("_low").isNull(), "NONE").when(one, "FOUND").otherwise("AMBIGUOUS")
    return got.select(*cols, "points", F.when(one, F.col("_low")).alias(label), status.alias("status"))


def resolve(intervals: DataFrame, symbol: str, entity: str, as_of, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Per symbol the entity valid at ``as_of``, with status FOUND, AMBIGUOUS or NONE."""
    on = (F.col(start).isNull() | (F.col(start) <= as_of)) & (F.col(end).isNull() | (F.col(end) >= as_of))
    got = intervals.groupBy(symbol).agg(F.count_distinct(F.when(on, F.col(entity))).alias("_n"), F.min(F.when(on, F.col(entity))).alias("_e"))
    status = F.when(F.col("_n") == 0, "NONE").when(F.col("_n") == 1, "FOUND").otherwise("AMBIGUOUS")
    return got.select(symbol, F.when(F.col("_n") == 1, F.col("_e")).alias(entity), status.alias("status"))


def resolve_bitemporal(links: DataFrame, requests: DataFrame, request_id: str, namespace: str = "namespace", identifier: str = "identifier", on: str = "on", as_of: str = "as_of") -> DataFrame:
    """(request, entity_id, status, entities) by valid time (half open) and by what was known at ``as_of``. A null
    start is open; a null end is open only if valid_to_kind is ``source_open_end``.

    Validity is looked up by ranges of days as in ``interval_join``; of a range each entity has one row, with the instant
    at which it was first known, so what is read beyond the answer are entities that weren't known yet. ``on`` and the
    bounds are dates. Requests of equal contents are looked up once.
    """
    l = links.where(F.col("valid_to").isNotNull() | (F.col("valid_to_kind") == "source_open_end"))  # noqa: E741
    l = l.select(F.col(namespace).alias("_ns"), F.col(identifier).alias("_i"), "valid_from", "valid_to", "known_at", "entity_id").dropna(subset=["_ns", "_i", "known_at", "entity_id"])  # noqa: E741
    l = ranges.cut(l, F.col("valid_from"), F.date_sub("valid_to", 1)).groupBy("_ns", "_i", "_r", "entity_id").agg(F.min("known_at").alias("_known"))  # noqa: E741
    asks = [namespace, identifier, on, as_of]
    asked = requests.select(*[F.col(c).alias(f"_q{n}") for n, c in enumerate(asks)]).distinct()
    hit = (F.col("_q0") == F.col("_ns")) & (F.col("_q1") == F.col("_i")) & (F.col("_in") == F.col("_r")) & (F.col("_known") <= F.col("_q3"))
    found = asked.withColumn("_in", F.explode(ranges.holding(F.col("_q2")))).hint("merge").join(l, hit).groupBy("_q0", "_q1", "_q2", "_q3").agg(F.collect_set("entity_id").alias("_e"))
    same = [F.col(c).eqNullSafe(F.col(f"_q{n}")) for n, c in enumerate(asks)]
    got = requests.join(found, same, "left").groupBy(request_id).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_e")))).alias("entities"))
    n = F.size("entities")
    return got.select(request_id, F.when(n == 1, F.col("entities")[0]).alias("entity_id"), F.when(n == 0, "NONE").when(n == 1, "FOUND").otherwise("AMBIGUOUS").alias("status"), "entities")


def resolve_point(anchors: DataFrame, requests: DataFrame, symbol: str, day: str, entity: str) -> DataFrame:
    """Requests with the entity that has the symbol on exactly that day; nothing is inferred between days."""
    known = anchors.groupBy(symbol, day).agg(F.count_distinct(entity).alias("_n"), F.min(entity).alias("_e"))
    out = requests.join(known, [symbol, day], "left")
    status = F.when(F.col("_n").isNull() | (F.col("_n") == 0), "NONE").when(F.col("_n") == 1, "FOUND").otherwise("AMBIGUOUS")
    return out.withColumns({entity: F.when(F.col("_n") == 1, F.col("_e")), "status": status}).drop("_n", "_e")


def point_join(candidates: DataFrame, stages: list[tuple[str, DataFrame, list[str], str]]) -> DataFrame:
    """Candidates joined with one table after another on exact keys. A stage is (name, table, keys, column); the
    first stage whose column is absent gives ``reason`` NO_<NAME>, null for complete rows. Tables have one row a key."""
    out, reason = candidates, None
    for name, table, keys, col in stages:
        out = out.join(table, keys, "left")
        reason = (F if reason is None else reason).when(F.col(col).isNull(), f"NO_{name.upper()}")
    return out.withColumn("reason", reason)


def point_screen(candidates: DataFrame, stages: list[tuple[str, DataFrame, list[str], str]], ranges: dict[str, tuple]) -> tuple[DataFrame, DataFrame]:
    """J7 as a screen: (matches, rejected). Candidates are joined as by ``point_join``; of complete ones those within
    every inclusive range match, the others are rejected as OUTSIDE_<COLUMN>, the first that fails. A null is outside."""
    out = point_join(candidates, stages)
    why = F.col("reason")
    for col, (low, high) in reversed(ranges.items()):
        why = F.coalesce(F.col("reason"), F.when(~F.coalesce(F.col(col).between(F.lit(low), F.lit(high)), F.lit(False)), f"OUTSIDE_{col.upper()}"), why)
    out = out.withColumn("reason", why)
    return out.where("reason is null").drop("reason"), out.where("reason is not null")


def asof_latest(df: DataFrame, keys: list[str], ts: str, cutoff) -> DataFrame:
    """Per key the newest row not after the cutoff. Rows of one instant are told apart by their other columns."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(ts, *[c for c in rest if c != ts])
    got = df.where(F.col(ts) <= cutoff).groupBy(*keys).agg(F.max(order).alias("_r"))
    return got.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, bucket: str = "day") -> DataFrame:
    """J8 row by row: ``value`` of the newest right row at or before each left row, null if there is none.

    Rows are laid in one order per key and time ``bucket`` (a unit of date_trunc), so a key that holds most rows is many
    tasks' work; what a bucket ends with is carried on over the buckets of a key, one row each. Of right rows at one
    instant the greatest value counts; null values are passed over. Null keys match nothing; repeated rows stay repeated.
    """
    kind = right.schema[value].dataType
    out = f"asof_{value}"
    b = right.where(F.col(value).isNotNull()).groupBy(*keys, ts).agg(F.max(value).alias("_v"))
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(kind)})
    both = a.unionByName(b.withColumn("_side", F.lit(0)), allowMissingColumns=True).withColumn("_b", F.date_trunc(bucket, ts))
    w = Window.partitionBy(*keys, "_b").orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_own", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    ends = both.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(ts))).alias("_end"))
    order = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias("_k" + k) for k in keys], F.col("_b").alias("_cb"), F.last("_end", ignorenulls=True).over(order).alias("_before"))
    on = [inside[k] == F.col("_k" + k) for k in keys] + [inside["_b"] == F.col("_cb")]
    return inside.join(carried, on, "left").select(*left.columns, F.coalesce("_own", "_before").alias(out))


def prior_year(df: DataFrame, keys: list[str], start: str = "period_start", end: str = "period_end", value: str = "value") -> DataFrame:
    """Rows with the value of the one period that ends 350 to 378 days earlier and is as long within 8 days; status
    FOUND, NONE or AMBIGUOUS. Repeated rows come back once; a prior period that has two rows is AMBIGUOUS.

    Periods meet in buckets of their end (29 days wide) and length (17 days), two of each for a row that asks, so the
    periods of a key are not all paired.
    """
    length = lambda s, e: F.datediff(F.col(e), F.col(s)).cast("long")
    day = ranges.day_number(F.col(end))
    p = df.groupBy(*[F.col(k).alias("_" + k) for k in keys], F.col(start).alias("_s"), F.col(end).alias("_e")).agg(F.count("*").alias("_c"), F.max(value).alias("_v"))
    p = p.withColumns({"_pb": ranges.bucket(ranges.day_number(F.col("_e")), 29), "_pl": ranges.bucket(length("_s", "_e"), 17)})
    asked = df.select(*keys, start, end, value).distinct().withColumn("_b", F.explode_outer(ranges.buckets(day - 378, day - 350, 29)))
    asked = asked.withColumn("_l", F.explode_outer(ranges.buckets(length(start, end) - 8, length(start, end) + 8, 17)))
    on = [F.col(k) == F.col("_" + k) for k in keys] + [F.col("_b") == F.col("_pb"), F.col("_l") == F.col("_pl")]
    on += [F.datediff(F.col(end), F.col("_e")).between(350, 378), F.abs(length(start, end) - length("_s", "_e")) <= 8]
    got = asked.join(p, on, "left").groupBy(*keys, start, end, value).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_n"), F.max("_v").alias("_p"))
    return got.select(*keys, start, end, value, F.when(F.col("_n") == 1, F.col("_p")).alias("prior_value"), F.when(F.col("_n") == 0, "NONE").when(F.col("_n") == 1, "FOUND").otherwise("AMBIGUOUS").alias("status"))


def prior_year_exact(df: DataFrame, keys: list[str], start: str = "period_start", end: str = "period_end", value: str = "value") -> DataFrame:
    """Rows with the value of the same calendar dates a year before; a 29 February has none. One row a period."""
    back = lambda c: F.when(~((F.month(c) == 2) & (F.dayofmonth(c) == 29)), F.add_months(c, -12))
    p = df.select(*[F.col(k).alias("_" + k) for k in keys], F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(value).alias("prior_value"))
    a = df.withColumns({"_ps": back(F.col(start)), "_pe": back(F.col(end))})
    on = [F.col(k) == F.col("_" + k) for k in keys] + [F.col("_pe") == F.col("_e"), F.col("_ps").eqNullSafe(F.col("_s"))]
    return a.join(p, on, "left").select(*df.columns, "prior_value")


def missing_keys(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Keys of the first table that the second lacks, once each."""
    return wanted.select(key).distinct().join(there.select(key), key, "left_anti")


def lineage(results: DataFrame, sources: DataFrame, result_id: str, ids: str, source_id: str) -> tuple[DataFrame, DataFrame]:
    """(result rows with the source rows they cite, citations that no source row answers)."""
    cited = results.select(result_id, F.explode(ids).alias(source_id))
    return cited.join(sources, source_id), cited.join(sources.select(source_id), source_id, "left_anti")


def _settled(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the checkpoint folder of the session and read back, so that rounds don't pile up in
    the plan and what is small is known to be. Where spark.checkpoint.dir is unset, local mode takes a temporary folder;
    elsewhere that is an error."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-lineage-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base}/lineage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lineage_tree(results: DataFrame, cites: DataFrame, sources: DataFrame, result_id: str, source_id: str) -> tuple[DataFrame, DataFrame]:
    """J13 over any number of levels: (nodes, roots).

    ``cites`` (result_id, source_id) are the direct citations of results and of what they cite in turn; ``sources`` has
    the stored ids. ``nodes``: each different id that a result rests on, with its least distance ``depth`` and ``kind``:
    DERIVED if it cites others, else SOURCE or, if it isn't stored, MISSING. ``roots``: every result with the number of
    its ``sources`` and ``missing`` ids, its ``depth`` and ``state``: CYCLE if it rests on something that rests on itself,
    NO_SOURCES if it cites nothing, INCOMPLETE, or COMPLETE. Nulls and repeated citations count for nothing.

    Citations are first dealt to levels: a round strikes those whose source cites nothing that is still open, until none
    falls; what is left leads into a cycle. All citations of one id fall in the same round, and after those it makes
    itself. So what is left is followed by a fixpoint, a round a step, and then each level, the last struck first, is
    joined once with what has been reached.
    """
    e = cites.select(F.col(result_id).alias("_up"), F.col(source_id).alias("_down")).dropna()
    roots = results.select(F.col(result_id).alias("_root")).dropna().distinct()
    stored = sources.select(F.col(source_id).alias("_down"), F.lit(True).alias("_stored")).dropna().distinct()
    open_, levels = e, []
    while True:
        ups = open_.select(F.col("_up").alias("_down"), F.lit(True).alias("_open")).distinct()
        dealt = open_.join(ups, "_down", "left")  # the leaves are held against what is stored in the same shuffle
        dealt = _settled(dealt if levels else dealt.join(stored, "_down", "left"))
        open_, struck = dealt.where("_open").select("_up", "_down"), dealt.where("_open is null").drop("_open")
        if struck.isEmpty():
            break
        levels.append(struck)
    new = seen = _settled(roots.join(open_, F.col("_root") == F.col("_up")).select("_root", F.col("_down").alias("_node"), F.lit(1).alias("depth")).distinct())
    depth = 1
    while not new.isEmpty():
        depth += 1
        step = new.join(open_, F.col("_node") == F.col("_up")).select("_root", F.col("_down").alias("_node")).distinct()
        new = _settled(step.join(seen, ["_root", "_node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(new)
    reached = lambda level, *more: (
        seen.where("_root <> _node").unionByName(roots.select("_root", F.col("_root").alias("_node"), F.lit(0).alias("depth")))
        .join(level, F.col("_node") == F.col("_up")).groupBy("_root", F.col("_down").alias("_node")).agg((F.min("depth") + 1).alias("depth"), *more)
    )
    for level in reversed(levels[1:]):
        seen = seen.unionByName(_settled(reached(level)))
    nodes = seen.withColumn("kind", F.lit("DERIVED"))
    if levels:
        leaves = reached(levels[0], F.max("_stored").alias("_stored"))
        nodes = nodes.unionByName(leaves.select("_root", "_node", "depth", F.when(F.col("_stored"), "SOURCE").otherwise("MISSING").alias("kind")))
    sums = nodes.groupBy("_root").agg(F.count(F.when(F.col("kind") == "SOURCE", 1)).alias("sources"), F.count(F.when(F.col("kind") == "MISSING", 1)).alias("missing"), F.max("depth").alias("depth"))
    cyclic = open_.select(F.col("_up").alias("_root"), F.lit(True).alias("_cycle")).distinct()
    state = F.when(F.col("_cycle"), "CYCLE").when(F.col("depth").isNull(), "NO_SOURCES").when(F.col("missing") > 0, "INCOMPLETE").otherwise("COMPLETE")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = roots.join(sums, "_root", "left").join(cyclic, "_root", "left").select(F.col("_root").alias(result_id), none("sources"), none("missing"), none("depth"), state.alias("state"))
    return nodes.select(F.col("_root").alias(result_id), F.col("_node").alias(source_id), "depth", "kind"), out


def altered_sources(claimed: DataFrame, stored: DataFrame, source_id: str, fields: list[str]) -> DataFrame:
    """Claimed source records held against the stored ones, field by field: (source_id, reason, fields). A record is
    NOT_STORED, or DIFFERS in the named fields, nulls told from values; one that equals a stored record of its id is
    left out. Of several stored records of an id one must agree; the fields are those that differ from every one."""
    c = claimed.select(F.col(source_id).alias("_id"), F.struct(*fields).alias("_c")).distinct()
    s = stored.groupBy(source_id).agg(F.collect_set(F.struct(*fields)).alias("_s"))
    got = c.join(s, F.col("_id") == F.col(source_id), "left").where("_s is null or not exists(_s, x -> x <=> _c)")
    differs = lambda f: F.forall("_s", lambda x: ~x[f].eqNullSafe(F.col(f"_c.{f}")))
    off = F.array_compact(F.array(*[F.when(differs(f), f) for f in fields]))
    return got.select(F.col("_id").alias(source_id), F.when(F.col("_s").isNull(), "NOT_STORED").otherwise("DIFFERS").alias("reason"), F.coalesce(off, F.array().cast("array<string>")).alias("fields"))


def evidence_index(df: DataFrame, ids: str) -> DataFrame:
    """(shard, source_id, rest): one row for each cited id, sharded by the first two hex digits of its hash."""
    return df.withColumn("source_id", F.explode(ids)).drop(ids).withColumn("shard", F.substring(F.sha2("source_id", 256), 1, 2))


def evidence(index: DataFrame, wanted: DataFrame, observation_id: str) -> DataFrame:
    """Index rows of the wanted source ids, each observation once."""
    # distinct by the join's own keys: one shuffle does for both
    asked = wanted.select(F.substring(F.sha2("source_id", 256), 1, 2).alias("shard"), "source_id").distinct()
    return index.join(asked, ["shard", "source_id"], "left_semi").dropDuplicates([observation_id])
