"""Choosing the revision that was known at an instant.

Availability is filtered before anything is ranked; what can't be chosen becomes a row with a reason. Context keys are
compared null-safely by grouping on them. The pairs these functions return are lazy: nothing runs until used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import numbered

CONTEXT = ["cik", "metric", "concept", "period_start", "period_end"]


def available_as_of(df: DataFrame, as_of, *times: str) -> DataFrame:
    """Rows available at ``as_of`` by the first non-null of ``times``; rows without any are left out."""
    return df.where(F.coalesce(*(times or ("available_at",))) <= as_of)


def top1(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_revision(df: DataFrame, keys: list[str], order: list[str], as_of=None, available: str = "available_at") -> DataFrame:
    """Per context the row with the greatest ``order`` columns among those available at ``as_of``.

    The choice is one ``max_by`` over a struct: it is combined before the shuffle, so a hot context costs each task one
    row, and nothing is sorted.
    """
    rows = df if as_of is None else available_as_of(df, as_of, available)
    rest = [c for c in df.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def select_or_conflict(df: DataFrame, keys: list[str], as_of=None, value: str = "value", available: str = "available_at", ident: str = "id") -> tuple[DataFrame, DataFrame]:
    """R2: (selected, gaps). All rows at a context's latest instant must agree on the value; selected carries the
    smallest id and all agreeing ids, sorted; contexts that disagree are gaps CONFLICTING_SOURCE_VALUES. A null value
    agrees only with nulls; rows without availability are left out.

    The rows are read once: what each instant holds is combined before the shuffle, then the latest instant is taken.
    """
    rows = df.where(F.col(available).isNotNull()) if as_of is None else available_as_of(df, as_of, available)
    # one set of pairs is all that is shuffled; the rest is read off the latest one
    at = rows.groupBy(*keys, available).agg(F.collect_set(F.struct(F.col(ident).alias("i"), F.col(value).alias("v"))).alias("_set"))
    last = at.groupBy(*keys).agg(F.max_by("_set", available).alias("_set"), F.max(available).alias(available))
    named = F.filter("_set", lambda x: x["i"].isNotNull())
    least = F.array_min(named)
    conflict = F.size(F.array_distinct(F.transform("_set", lambda x: x["v"]))) > 1
    agreed = last.select(*keys, available, least["v"].alias(value), least["i"].alias(ident), F.array_sort(F.array_distinct(F.transform(named, lambda x: x["i"]))).alias("source_ids"), conflict.alias("_conflict"))
    gaps = agreed.where("_conflict").select(*keys, available, F.lit("CONFLICTING_SOURCE_VALUES").alias("reason"))
    return agreed.where("not _conflict").drop("_conflict"), gaps


def block_by_rejected(selected: DataFrame, rejected: DataFrame, keys: list[str], available: str = "available_at") -> tuple[DataFrame, DataFrame]:
    """(kept, gaps). A rejected row of the same context at or after the selected one voids it; there is no fallback
    to an older value. Gaps carry BLOCKED_BY_NEWER_INVALID."""
    last = rejected.groupBy(*keys).agg(F.max(available).alias("_bad")).select(*[F.col(k).alias("_" + k) for k in keys], "_bad")
    joined = selected.join(last, [selected[k].eqNullSafe(last["_" + k]) for k in keys], "left")
    hit = F.coalesce(F.col("_bad") >= F.col(available), F.lit(False))
    return joined.where(~hit).select(*selected.columns), joined.where(hit).select(*keys, F.col("_bad").alias(available), F.lit("BLOCKED_BY_NEWER_INVALID").alias("reason"))


def ambiguity(df: DataFrame, keys: list[str], fields: list[str], available: str = "available_at") -> DataFrame:
    """(keys, available_at, reason): instants at which a context has rows that differ in ``fields``, and contexts
    of several revisions of which some have no availability."""
    kinds = df.groupBy(*keys, available).agg(F.count_distinct(F.struct(*fields)).alias("n"))
    same = kinds.where(F.col(available).isNotNull() & (F.col("n") > 1)).select(*keys, available, F.lit("AMBIGUOUS_REVISION").alias("reason"))
    unknown = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count(available).alias("m")).where("n > 1 and m < n")
    return same.unionByName(unknown.select(*keys, F.lit(None).cast(df.schema[available].dataType).alias(available), F.lit("UNKNOWN_AVAILABILITY").alias("reason")))


def pick_by_priority(df: DataFrame, keys: list[str], priority: str, filed: str, accession: str, concept: str = "concept") -> DataFrame:
    """Per key the row of the best (lowest) concept priority, then latest filing; ``superseded`` lists the other
    concepts, sorted."""
    first = [filed, accession]
    rest = [c for c in df.columns if c not in [*keys, *first]]
    order, others = F.struct((-F.col(priority)).alias("_p"), *first), F.struct(*rest).alias("_o")
    maps = any("map<" in df.schema[c].dataType.simpleString() for c in rest)  # maps have no order, so their rows go beside it
    row = F.struct(order.alias("_k"), others)
    best = df.groupBy(*keys).agg((F.max_by(row, order) if maps else F.max(row)).alias("_r"), F.collect_set(concept).alias("_all"))
    out = best.select(*keys, *[F.col(f"_r._k.{c}" if c in first else f"_r._o.{c}").alias(c) for c in df.columns if c not in keys], "_all")
    return out.withColumn("superseded", F.array_sort(F.array_except("_all", F.array(F.col(concept))))).drop("_all")


def merge_concepts(df: DataFrame, keys: list[str], priority: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(merged, gaps). Concepts that agree on a period's value give the preferred one; if they don't, the period is
    a gap AMBIGUOUS_CONCEPTS."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), priority).alias("_r"), F.coalesce(F.min(value) != F.max(value), F.lit(False)).alias("_x"))
    merged = got.where("not _x").select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return merged, got.where("_x").select(*keys, F.lit("AMBIGUOUS_CONCEPTS").alias("reason"))


def void_overlaps(df: DataFrame, keys: list[str], start: str = "period_start", end: str = "period_end", ids: str = "source_ids") -> tuple[DataFrame, DataFrame]:
    """(kept, gaps). Rows of one key and end with different starts are all void, and so is every row that cites
    one of their ids."""
    groups = df.groupBy(*keys, end).agg((F.count_distinct(start) > 1).alias("_void")).where("_void")
    on = [df[k].eqNullSafe(groups[k]) for k in [*keys, end]]
    void = df.join(groups, on, "left_semi")
    bad = void.select(F.explode(ids).alias("_i")).distinct()
    cite = df.select(*keys, start, end, F.explode(ids).alias("_i")).join(bad, "_i", "left_semi").select(*keys, start, end).distinct()
    kept = df.join(cite, [df[k].eqNullSafe(cite[k]) for k in [*keys, start, end]], "left_anti")
    return kept, cite.withColumn("reason", F.lit("OVERLAPPING_CONTEXTS"))


def revisions(df: DataFrame, keys: list[str], available: str = "available_at", ident: str = "id", block: str = "year") -> DataFrame:
    """All revisions of each context with their number in order of availability. Numbered in blocks of time (a unit
    of date_trunc), so a context of very many revisions is several tasks' work; rows without availability come first."""
    return numbered(df, keys, [available, ident], F.date_trunc(block, available), "revision")


def dated_observations(df: DataFrame, keys: list[str], on, limit: int = 12, end: str = "period_end", filed: str = "filed", accession: str = "accession") -> DataFrame:
    """Per key the latest ``limit`` instants not after ``on``: by end, filing, accession. limit 1 is the latest."""
    rows = df.where((F.col(end) <= on) & (F.col(filed) <= on))
    w = Window.partitionBy(*keys).orderBy(F.col(end).desc(), F.col(filed).desc(), F.col(accession).desc())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def select_release(releases: DataFrame, dataset: str, as_of, published: str = "published_at", ident: str = "release_id") -> DataFrame:
    """Per dataset the one release published last at or before ``as_of``; a dataset without one has a null
    release and status NO_RELEASE_AS_OF."""
    ok = F.col(published) <= as_of
    got = releases.groupBy(dataset).agg(F.max_by(F.when(ok, F.col(ident)), F.when(ok, F.struct(published, ident))).alias(ident), F.max(F.when(ok, F.col(published))).alias(published))
    return got.withColumn("status", F.when(F.col(ident).isNull(), "NO_RELEASE_AS_OF").otherwise("SELECTED"))


#: The forms whose contexts are evidence of a fiscal year.
ANNUAL_FORMS = ("10-K", "10-K/A")


def infer_long_quarters(df: DataFrame, keys: list[str], start: str = "period_start", end: str = "period_end", available: str = "available_at", form: str | None = "form") -> DataFrame:
    """Quarters of 106 to 120 days for which the calendar gives evidence: cumulative contexts of one start whose
    ends, with the start, cut a reported year (330 to 380 days) into four quarters of 75 to 120 days each. The year must be
    a context of an annual form (column ``form``; None: of any form); the others may be of any.

    Returns keys, q_start, q_end and evidence_at, the earliest instant at which all of the evidence was there.
    """
    contexts = lambda t: t.select(*keys, start, end, available).groupBy(*keys, start, end).agg(F.min(available).alias("a"))
    c, years = contexts(df), contexts(df.where(F.col(form).isin(*ANNUAL_FORMS)) if form else df)
    days = lambda e, s: F.datediff(F.col(e), F.col(s)) + 1
    step = lambda n: (years if n == 4 else c).select(*[F.col(k).alias(f"{k}{n}") for k in keys], F.col(start).alias(f"s{n}"), F.col(end).alias(f"e{n}"), F.col("a").alias(f"a{n}"))
    out = step(1).where(days("e1", "s1").between(75, 120))
    for n in (2, 3, 4):
        t = step(n)
        same = [F.col(f"{k}{n}").eqNullSafe(F.col(f"{k}1")) for k in keys]
        out = out.join(t, [*same, F.col(f"s{n}") == F.col("s1"), F.datediff(F.col(f"e{n}"), F.col(f"e{n - 1}")).between(75, 120)])
    out = out.where(days("e4", "s1").between(330, 380))
    quarter = F.explode(F.array(*[F.struct((F.col("s1") if n == 1 else F.date_add(F.col(f"e{n - 1}"), 1)).alias("q_start"), F.col(f"e{n}").alias("q_end")) for n in (1, 2, 3, 4)]))
    out = out.select(*[F.col(f"{k}1").alias(k) for k in keys], quarter.alias("q"), F.greatest("a1", "a2", "a3", "a4").alias("at"))
    out = out.select(*keys, "q.q_start", "q.q_end", "at").where(F.datediff("q_end", "q_start") + 1 > 105)
    return out.groupBy(*keys, "q_start", "q_end").agg(F.min("at").alias("evidence_at"))


def match_fiscal_period(df: DataFrame, key: str, end: str = "period_end", fp: str = "fp") -> DataFrame:
    """Rows with ``year_end_month`` (the most common end month of FY rows of the key, the smallest of ties) and
    ``label``: FY<year> or Q<n> <year> counted from that month; null if the key has no FY row."""
    fy = df.where(F.col(fp) == "FY").groupBy(key, F.month(end).alias("m")).agg(F.count("*").alias("n"))
    best = fy.groupBy(key).agg(F.max_by("m", F.struct("n", (-F.col("m")).alias("x"))).alias("year_end_month"))
    out = df.join(best, key, "left")
    after = F.pmod(F.month(end) - F.col("year_end_month"), F.lit(12))
    year = F.year(end) + F.when(F.month(end) > F.col("year_end_month"), 1).otherwise(0)
    q = F.when(after == 0, 4).otherwise(F.ceil(after / 3)).cast("int")
    label = F.when(F.col(fp) == "FY", F.concat(F.lit("FY"), year.cast("string"))).otherwise(F.concat(F.lit("Q"), q.cast("string"), F.lit(" "), year.cast("string")))
    return out.withColumn("label", F.when(F.col("year_end_month").isNotNull(), label))


def leakage(df: DataFrame, as_of, available: str = "available_at", inputs: str | None = None) -> DataFrame:
    """Rows that look ahead: available after ``as_of``, without availability, or before one of their inputs."""
    bad = F.when(F.col(available).isNull(), "NO_AVAILABILITY").when(F.col(available) > as_of, "AFTER_CUTOFF")
    if inputs:
        bad = bad.when(F.exists(inputs, lambda x: x > F.col(available)), "BEFORE_INPUT")
    return df.withColumn("violation", bad).where("violation is not null")
