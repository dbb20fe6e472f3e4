"""Screens, rankings, paging and cross-sections."""

from __future__ import annotations

import hashlib
import json
import os.path
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import exact

OPS = {"eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "between": lambda c, v: c.between(F.lit(v[0]), F.lit(v[1]))}


def screen(df: DataFrame, filters: list[tuple], sorts: list[tuple[str, str]] = (), limit: int | None = None) -> DataFrame:
    """Rows that pass every (column, op, value[, unit column, unit]); null and wrong-unit values never pass."""
    tests = []
    for col, op, value, *unit in filters:
        t = F.coalesce(OPS[op](F.col(col), value), F.lit(False))
        tests.append(t & F.coalesce(F.col(unit[0]) == unit[1], F.lit(False)) if unit else t)
    out = df.where(reduce(and_, tests)) if tests else df
    return sort_limit(out, sorts, limit) if sorts or limit else out


def sort_limit(df: DataFrame, sorts: list[tuple[str, str]], n: int | None = None) -> DataFrame:
    """By several keys, nulls last whichever way a key goes; the first ``n``."""
    order = [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in sorts]
    out = df.orderBy(*order) if order else df
    return out if n is None else out.limit(n)


def top_k(df: DataFrame, by: str, ties: str, k: int) -> DataFrame:
    """T4: the ``k`` rows greatest by a column, ties in ascending order of another."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(ties)).limit(k)


def between_dates(df: DataFrame, day: str, first, last) -> DataFrame:
    """Rows of a date range, both ends in."""
    return df.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def any_all_filter(df: DataFrame, any_of: dict[str, list] | None = None, all_of: dict[str, list] | None = None, equal: dict | None = None) -> DataFrame:
    """Rows whose array columns share a value with every ``any_of`` list, hold every ``all_of`` list, and whose
    columns equal ``equal``."""
    out = df
    for c, v in (any_of or {}).items():
        out = out.where(F.arrays_overlap(c, F.array(*map(F.lit, v))))
    for c, v in (all_of or {}).items():
        out = out.where(F.size(F.array_except(F.array(*map(F.lit, v)), c)) == 0)
    for c, v in (equal or {}).items():
        out = out.where(F.col(c).eqNullSafe(F.lit(v)))
    return out


def search(df: DataFrame, query: str, ident: str, name: str, aliases: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose id, name or aliases contain the text, whatever the case; exact ids first, then by id."""
    q = query.lower()
    hit = F.lower(F.col(ident).cast("string")).contains(q) | F.lower(name).contains(q)
    if aliases:
        hit |= F.exists(aliases, lambda a: F.lower(a).contains(q))
    out = df.where(hit).withColumn("exact", F.lower(F.col(ident).cast("string")) == q).orderBy(F.col("exact").desc(), ident)
    return out if limit is None else out.limit(limit)


def rank_screen(df: DataFrame, ident: str, value: str, low=None, high=None, descending: bool = True, reason: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked, missing). Values within the inclusive bounds, numbered by value and then id in the same direction,
    with matches and universe size; rows without a value are apart with their reason.

    Ranks come from a distributed sort: rows are numbered within value ranges, to which the sizes of the ranges before
    are added, so no task sees all rows.
    """
    ok = F.col(value).isNotNull()
    if low is not None:
        ok &= F.col(value) >= low
    if high is not None:
        ok &= F.col(value) <= high
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    good = df.where(ok)
    sizes = df.agg(F.count(F.when(ok, 1)).alias("matches"), F.count("*").alias("universe"))
    ranked = numbered(good, [way(value), way(ident)], value, ident, descending).join(F.broadcast(sizes))  # one row
    why = F.coalesce(F.col(reason), F.lit("NO_VALUE")) if reason else F.lit("NO_VALUE")
    return ranked, df.where(F.col(value).isNull()).select(ident, why.alias("reason"))


def numbered(df: DataFrame, order: list, by: str, ident: str, descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Rows with ``rank`` in a total order by ``by`` and then ``ident``, nulls of ``by`` last.

    Ranges of values at approximate quantiles are numbered apart and shifted by the sizes of those before. A value that
    fills whole ranges is split again, at quantiles of ``ident``. There are four ranges a shuffle partition unless
    ``ranges`` says otherwise.
    """
    n = ranges or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(by).cast("double")
    cuts = df.select(F.percentile_approx(v, [i / n for i in range(1, n)], 40 * n)).first()[0] or [] if n > 1 else []
    hot = sorted({c for c in cuts if cuts.count(c) > 1})  # at most one for each two ranges
    cuts = sorted(set(cuts))
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="_v", outputCol="_place", handleInvalid="keep").transform(df.withColumn("_v", v))
    place = F.when(F.col("_v").isNotNull(), F.col("_place").cast("int"))  # cuts not above the value
    rows = rows.withColumns({"_part": F.coalesce(-place if descending else place, F.lit(len(splits))), "_sub": F.lit(0)}).drop("_v", "_place")
    if hot:
        text = F.col(ident).cast("string")
        ends = df.where(v.isin(hot)).agg(F.min(text), F.max(text)).first()
        same = len(os.path.commonprefix([ends[0] or "", ends[1] or ""])) if isinstance(df.schema[ident].dataType, T.StringType) else None
        # ids as numbers: themselves, or the seven bytes after what all of them begin with
        num = F.col(ident).cast("double") if same is None else F.conv(F.rpad(F.hex(F.substring(F.encode(text.substr(F.lit(same + 1), F.lit(7)), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("double")
        found = df.where(v.isin(hot)).groupBy(v.alias("_hot")).agg(F.percentile_approx(num, [i / n for i in range(1, n)], 40 * n).alias("_cuts"))
        rows = rows.withColumns({"_num": num, "_v": v}).join(F.broadcast(found), F.col("_v") == F.col("_hot"), "left")  # a row a hot value
        sub = F.coalesce(F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col("_num"))), F.lit(0))
        rows = rows.withColumn("_sub", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(-sub if descending else sub)).drop("_num", "_v", "_hot", "_cuts")
        # a hot value begins its range; the greater values in it become one of their own
        rows = rows.withColumn("_part", F.col("_part") * 2 + F.when(v.isin(hot), 0).otherwise(-1 if descending else 1))
    sizes = rows.groupBy("_part", "_sub").agg(F.count("*").alias("_n"))  # a row a range
    w = Window.partitionBy(F.lit(0)).orderBy("_part", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", "_sub", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", "_sub").orderBy(*order)
    ranked = rows.withColumn("_rn", F.row_number().over(inside)).join(F.broadcast(before), ["_part", "_sub"])
    return ranked.withColumn("rank", (F.col("_before") + F.col("_rn")).cast("long")).drop("_part", "_sub", "_rn", "_before")


def fingerprint(params: dict, release: str) -> str:
    """What a page token is bound to: the query's parameters and the release."""
    return hashlib.sha256(json.dumps([params, release], sort_keys=True, default=str).encode()).hexdigest()


def page(df: DataFrame, order: str, limit: int, after=None, token: str | None = None, params: dict | None = None, release: str = "") -> DataFrame:
    """The ``limit`` rows after a key, by keyset: no offset is counted, so page n costs what page 1 does.

    Rows carry ``token``, the fingerprint of parameters and release; a page asked for with another one is refused.
    """
    mine = fingerprint(params or {}, release)
    if token is not None and token != mine:
        raise ValueError("the page token belongs to another query or release")
    rows = df if after is None else df.where(F.col(order) > F.lit(after))
    return rows.orderBy(order).limit(limit).withColumn("token", F.lit(mine))


def cross_section(obs: DataFrame, key: str, metrics: list[str], metric: str = "metric", value: str = "value", end: str = "period_end", quarantine: DataFrame | None = None) -> DataFrame:
    """Per key a map of each metric's latest value and a map of what is missing to its reason: NO_OBSERVATION,
    NULL_VALUE or, for (key, metric) rows of ``quarantine``, QUARANTINED."""
    last = obs.where(F.col(metric).isin(metrics)).groupBy(key, metric).agg(F.max_by(value, end).alias("_v"))
    wanted = obs.select(key).distinct().withColumn(metric, F.explode(F.array(*map(F.lit, metrics))))
    rows = wanted.join(last.withColumn("_there", F.lit(True)), [key, metric], "left")
    if quarantine is not None:
        rows = rows.join(quarantine.select(key, metric).distinct().withColumn("_q", F.lit(True)), [key, metric], "left")
    else:
        rows = rows.withColumn("_q", F.lit(None).cast("boolean"))
    why = F.when(F.col("_q"), "QUARANTINED").when(F.col("_there").isNull(), "NO_OBSERVATION").when(F.col("_v").isNull(), "NULL_VALUE")
    rows = rows.withColumn("_why", why)
    pack = lambda ok, c: F.map_from_entries(F.array_sort(F.collect_list(F.when(ok, F.struct(F.col(metric), F.col(c))))))
    return rows.groupBy(key).agg(pack(F.col("_why").isNull(), "_v").alias("metrics"), pack(F.col("_why").isNotNull(), "_why").alias("missing"))


def cross_section_with_price(obs: DataFrame, bars: DataFrame, key: str, as_of, metrics: list[str], day: str = "session_date", close: str = "close", metric: str = "metric", value: str = "value", end: str = "period_end") -> DataFrame:
    """Per key one column for each metric's latest value up to a date, and last price and its day."""
    long = obs.where(F.col(metric).isin(metrics)).select(key, F.col(metric).alias("_m"), F.col(value).cast("double").alias("_v"), F.col(end).cast("date").alias("_d"))
    long = long.unionByName(bars.select(key, F.lit("price").alias("_m"), F.col(close).cast("double").alias("_v"), F.col(day).cast("date").alias("_d"))).where(F.col("_d") <= as_of)
    is_ = lambda m: F.col("_m") == m
    aggs = [F.max_by(F.when(is_(m), F.col("_v")), F.when(is_(m), F.struct("_d", "_v"))).alias(m) for m in [*metrics, "price"]]
    return long.groupBy(key).agg(*aggs, F.max(F.when(is_("price"), F.col("_d"))).alias("price_day"))


def align_peers(obs: DataFrame, ids: list[str], keys: list[str], ident: str = "cik", value: str = "value") -> DataFrame:
    """A row for each identical (metric, frequency, period, unit) key, a column for each entity, the entities that
    are missing, the difference of each from the first, and reason AMBIGUOUS where an entity has several values."""
    mine = obs.where(F.col(ident).isin(ids))
    col = lambda i: F.max(F.when(F.col(ident) == i, F.col(value)))
    n = lambda i: F.count_distinct(F.when(F.col(ident) == i, F.col(value)))
    got = mine.groupBy(*keys).agg(*[col(i).alias(f"v_{i}") for i in ids], F.collect_set(ident).alias("_has"), F.greatest(*[n(i) for i in ids], F.lit(0)).alias("_n"))
    first = F.col(f"v_{ids[0]}")
    diffs = [exact.minus(F.col(f"v_{i}"), first).alias(f"diff_{i}") for i in ids[1:]]
    return got.select(*keys, *[f"v_{i}" for i in ids], *diffs, F.array_sort(F.array_except(F.array(*map(F.lit, ids)), "_has")).alias("missing"), F.when(F.col("_n") > 1, "AMBIGUOUS").alias("reason"))


def compare(obs: DataFrame, ids: list[str], metric_name: str, n: int, ident: str = "cik", metric: str = "metric", end: str = "period_end") -> DataFrame:
    """The last ``n`` rows of one metric for each of several entities."""
    from tidemark.operators.series import lookback

    return lookback(obs.where(F.col(ident).isin(ids) & (F.col(metric) == metric_name)), [ident], n, end)


def filter_index(df: DataFrame, ident: str, scalars: list[str], arrays: list[str]) -> DataFrame:
    """(filter, value, id) for every filter bucket a row is in; rows in none are in filter ``remainder``."""
    def cell(name, value):
        return F.struct(F.lit(name).alias("filter"), value.cast("string").alias("value"))

    def each(name):
        return F.transform(F.coalesce(name, F.array().cast(df.schema[name].dataType)), lambda v: cell(name, v))

    one, many = [F.array(cell(c, F.col(c))) for c in scalars], [each(c) for c in arrays]
    cells = F.filter(F.concat(*one, *many), lambda x: x["value"].isNotNull())
    cells = F.when(F.size(cells) == 0, F.array(F.struct(F.lit("remainder").alias("filter"), F.lit("").alias("value")))).otherwise(cells)
    return df.select(ident, F.explode(F.array_distinct(cells)).alias("_c")).select("_c.filter", "_c.value", ident)


def combined_screen(prices: DataFrame, facts: DataFrame, key: str, day: str, price: str, value: str, price_range: tuple, value_range: tuple, certified: str) -> DataFrame:
    """Keys whose fundamental and price both lie within inclusive ranges on one date; certified facts only."""
    a = prices.where(F.col(price).between(*map(F.lit, price_range)))
    b = facts.where(F.col(certified) & F.col(value).between(*map(F.lit, value_range)))
    return a.join(b, [key, day])


def sector(df: DataFrame, codes: DataFrame, code: str, group: str = "group", absent: str = "ABSENT") -> DataFrame:
    """Rows with their group by code; rows without a code are in the absent group, and unmapped codes carry reason
    UNMAPPED_CODE. The code table has one row a code."""
    out = df.join(codes, code, "left")
    reason = F.when(F.col(code).isNotNull() & F.col(group).isNull(), "UNMAPPED_CODE")
    return out.withColumns({"reason": reason, group: F.coalesce(F.col(group), F.when(F.col(code).isNull(), absent))})


def actions(df: DataFrame, refs: list[str], first, last, as_of, kinds: list[str] | None = None, refs_col: str = "refs", day: str = "effective", kind: str = "kind") -> DataFrame:
    """Corporate actions of any of the references within a date range, ANNOUNCED if effective after ``as_of``,
    else EFFECTIVE."""
    out = df.where(F.arrays_overlap(refs_col, F.array(*map(F.lit, refs))) & F.col(day).between(first, last))
    if kinds:
        out = out.where(F.col(kind).isin(kinds))
    return out.withColumn("status", F.when(F.col(day) > as_of, "ANNOUNCED").otherwise("EFFECTIVE"))


def readiness_summary(df: DataFrame, status: str, missing: str) -> tuple[DataFrame, DataFrame]:
    """(status, count, percent of all) and (code, count) of the missing inputs."""
    counts = df.groupBy(status).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_t"))
    states = counts.join(F.broadcast(total)).select(status, "n", F.round(F.col("n") * 100 / F.col("_t"), 4).alias("percent"))  # one row
    return states, df.select(F.explode(missing).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def top_missing(df: DataFrame, ident: str, missing: str, k: int = 20) -> DataFrame:
    """The codes that block most ids, ties by code, and how many ids each blocks alone (``unlocks``)."""
    each = df.select(ident, F.explode(F.array_distinct(missing)).alias("code"), (F.size(F.array_distinct(missing)) == 1).alias("alone"))
    got = each.groupBy("code").agg(F.count_distinct(ident).alias("ids"), F.count_distinct(F.when(F.col("alone"), F.col(ident))).alias("unlocks"))
    return top_k(got, "ids", "code", k)


def union_sources(tables: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """All rows of several tables with the name of the one each comes from."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(source, F.lit(n)) for n, t in tables.items()])


def set_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, state) with state added (only in b), removed (only in a) or common; null keys are one key."""
    both = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    got = both.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return got.select(key, F.when(F.col("_a") == 0, "added").when(F.col("_b") == 0, "removed").otherwise("common").alias("state"))


def filter_sets(df: DataFrame, ident: str, filters: dict[str, list], content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(ids in any value of each filter and in every filter, ids that occur with differing content)."""
    conflicts = df.groupBy(ident).agg(F.count_distinct(F.struct(*content)).alias("n")).where("n > 1").select(ident)
    tests = [F.max(F.coalesce(F.col(c).isin(v), F.lit(False))).alias(f"_{i}") for i, (c, v) in enumerate(filters.items())]
    got = df.groupBy(ident).agg(*tests)
    return got.where(reduce(and_, [F.col(f"_{i}") for i in range(len(filters))])).select(ident), conflicts
