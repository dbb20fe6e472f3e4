"""Comparing and reconciling releases row by row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import rows_digest, same_keys

#: Finding code -> severity.
SEVERITY = {
    "FIELD_LOST": "WARNING", "FIELD_GAINED": "INFO",
    "CONTRACT_UNIT_VIOLATION": "FAIL", "UNIT_CORRECTED": "INFO", "UNIT_CHANGED": "WARNING",
    "PROHIBITED_BASIS_SUBSTITUTION": "FAIL", "BASIS_SUBSTITUTION_UNSUPPORTED": "FAIL", "CONCEPT_PRIORITY_DEMOTED": "WARNING", "CONCEPT_CHANGED": "INFO",
    "IMMATERIAL_VALUE_DRIFT": "INFO", "SUSPECTED_UNCONVERTED_SCALE": "FAIL", "RESTATEMENT_WITH_NEW_FILING": "INFO", "FILING_REGRESSION_EARLIER_ACCESSION": "FAIL",
    "VALUE_CHANGED_WITH_SOURCE_REVISION": "WARNING", "VALUE_CHANGED_WITHOUT_SOURCE_REVISION": "FAIL", "SIGN_CONVENTION_VIOLATION": "FAIL", "VALUE_LOST_WITH_USABLE_STATE": "FAIL",
    "AVAILABILITY_CUTOFF_INCONSISTENT": "FAIL", "FILING_DATE_INCONSISTENT": "FAIL", "FUTURE_AVAILABILITY_UNSUPPORTED": "FAIL",
    "EVIDENCE_CONFLICT_INTRODUCED": "FAIL", "SOURCE_BLOCKED": "FAIL", "UNIT_MISMATCH_INTRODUCED": "FAIL", "OBSERVATION_NO_LONGER_CONFORMS": "WARNING", "OBSERVATION_LOST": "WARNING",
    "POINT_IN_TIME_ELIGIBILITY_LOST": "WARNING", "PERIOD_ALIGNMENT_LOST": "WARNING", "VALIDATION_DOWNGRADE": "WARNING", "STATE_REGRESSION": "WARNING", "STATE_IMPROVED": "INFO", "STATE_CHANGED": "INFO",
}
#: The rank of a field's state and the code of a fall to it.
STATE_RANK = {
    "PASS": 5, "PASS_DERIVED": 4, "SOURCE_VALIDATED": 3, "SOURCE_UNVALIDATED": 2, "NOT_PIT_ELIGIBLE": 1, "PERIOD_MISMATCH": 1,
    "MISSING_OBSERVATION": 0, "NOT_CONFORMING": 0, "UNIT_MISMATCH": 0, "CONFLICT": 0, "BLOCKED": 0,
}
FALLS = {
    "CONFLICT": "EVIDENCE_CONFLICT_INTRODUCED", "BLOCKED": "SOURCE_BLOCKED", "UNIT_MISMATCH": "UNIT_MISMATCH_INTRODUCED", "NOT_CONFORMING": "OBSERVATION_NO_LONGER_CONFORMS",
    "MISSING_OBSERVATION": "OBSERVATION_LOST", "NOT_PIT_ELIGIBLE": "POINT_IN_TIME_ELIGIBILITY_LOST", "PERIOD_MISMATCH": "PERIOD_ALIGNMENT_LOST", "SOURCE_UNVALIDATED": "VALIDATION_DOWNGRADE",
}
USABLE = ["PASS", "PASS_DERIVED", "SOURCE_VALIDATED", "SOURCE_UNVALIDATED"]
DRIFT_SHARE, DRIFT_AMOUNT, SCALES = 0.0005, 1_000_000, (1e3, 1e6, 1e9)  # fixed values
REPORT_COLUMNS = ["value", "unit", "concept", "accession", "filed", "available_at", "source_object", "state"]


def _lookup(pairs: dict, key: Column, default=None) -> Column:
    found = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def diff_reports(base: DataFrame, cand: DataFrame, keys: list[str], field: str | None = None, contract: DataFrame | None = None, as_of=None, positive: tuple[str, ...] = ("revenue", "depreciation_amortization", "capital_expenditure"), base_state: bool = False) -> DataFrame:
    """(keys, code, severity, base_value, candidate_value): every finding about a field of two reports, which have
    ``keys`` and REPORT_COLUMNS, one row a key. Unchanged fields give no row.

    ``contract`` is a small table (field, unit, concepts, prohibited): the field's unit, its concepts from best to worst,
    and those that would change what it measures. ``field`` names the key column it is joined on. ``as_of`` is the
    candidate report's own instant. With ``base_state`` the rows also have the state of the base's field.

    A changed value is drift if it is within a million or 0.05 %; else a shift by 10^3, 10^6 or 10^9 in one unit; else,
    under another accession, a restatement if that was filed later and a regression if not; else it is explained by
    another source object or not at all.
    """
    a = base.select(*[F.col(k).alias("a_" + k) for k in keys], *[F.col(c).alias("a_" + c) for c in REPORT_COLUMNS], F.lit(True).alias("in_a"))
    b = cand.select(*[F.col(k).alias("b_" + k) for k in keys], *[F.col(c).alias("b_" + c) for c in REPORT_COLUMNS], F.lit(True).alias("in_b"))
    both = a.join(b, same_keys(base, cand, keys, "a_", "b_"), "full")
    name = F.coalesce("a_" + field, "b_" + field) if field else F.lit(None).cast("string")
    if contract is not None:
        rules = contract.select(F.col("field").alias("_f"), F.col("unit").alias("_unit"), F.col("concepts").alias("_concepts"), F.col("prohibited").alias("_prohibited"))
        both = both.withColumn("_name", name).join(F.broadcast(rules), F.col("_name") == F.col("_f"), "left")  # a row a field of the contract
    else:
        none = F.lit(None)
        both = both.withColumns({"_name": name, "_unit": none.cast("string"), "_concepts": none.cast("array<string>"), "_prohibited": none.cast("array<string>")})
    old, new = (lambda c: F.col("a_" + c)), (lambda c: F.col("b_" + c))
    p, q = old("value"), new("value")
    x, y = p.cast("double"), q.cast("double")
    there = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    usable = new("state").isin(USABLE)
    lost = (new("state") == "MISSING_OBSERVATION") & new("concept").isNull()
    moved = lambda c: there & ~F.coalesce(lost, F.lit(False)) & ~old(c).eqNullSafe(new(c))
    unit = F.when(F.col("_unit").isNotNull() & ~new("unit").eqNullSafe(F.col("_unit")), "CONTRACT_UNIT_VIOLATION").when(F.col("_unit").isNotNull() & ~old("unit").eqNullSafe(F.col("_unit")), "UNIT_CORRECTED").otherwise("UNIT_CHANGED")
    place = lambda c: F.nullif(F.array_position("_concepts", c), F.lit(0))
    basis = (
        F.when(F.array_contains("_prohibited", new("concept")), "PROHIBITED_BASIS_SUBSTITUTION")
        .when((F.col("_concepts").isNull() | place(new("concept")).isNull()) & usable, "BASIS_SUBSTITUTION_UNSUPPORTED" if contract is not None else "CONCEPT_CHANGED")
        .when(place(new("concept")) > place(old("concept")), "CONCEPT_PRIORITY_DEMOTED")
        .otherwise("CONCEPT_CHANGED")
    )
    same = F.coalesce(old("accession") == new("accession"), F.lit(False))
    other = F.coalesce(old("accession") != new("accession"), F.lit(False))
    later = F.coalesce(new("filed") > old("filed"), new("available_at") >= old("available_at"), F.lit(False))
    ratio = F.abs(y) / F.abs(x)
    shift = (x != 0) & (y != 0) & old("unit").eqNullSafe(new("unit")) & reduce(or_, [(F.abs(ratio - s) <= 1e-4 * s) | (F.abs(ratio - 1 / s) <= 1e-4 / s) for s in SCALES])
    revised = F.coalesce(old("source_object") != new("source_object"), F.lit(False))
    changed = there & (p != q)
    kind = (
        F.when((F.abs(y - x) <= DRIFT_AMOUNT) | (F.abs(y - x) <= DRIFT_SHARE * F.abs(x)), "IMMATERIAL_VALUE_DRIFT")
        .when(F.when(x != 0, shift), "SUSPECTED_UNCONVERTED_SCALE")
        .when(other & later, "RESTATEMENT_WITH_NEW_FILING")
        .when(other, "FILING_REGRESSION_EARLIER_ACCESSION")
        .when(same & revised, "VALUE_CHANGED_WITH_SOURCE_REVISION")
        .otherwise("VALUE_CHANGED_WITHOUT_SOURCE_REVISION")
    )
    before, after = (_lookup(STATE_RANK, side("state"), 0) for side in (old, new))
    state = F.when(after < before, _lookup(FALLS, new("state"), "STATE_REGRESSION")).when(after > before, "STATE_IMPROVED").otherwise("STATE_CHANGED")
    codes = F.array_compact(F.array(
        F.when(F.col("in_b").isNull(), "FIELD_LOST"), F.when(F.col("in_a").isNull(), "FIELD_GAINED"), F.when(moved("unit"), unit), F.when(moved("concept"), basis), F.when(changed, kind),
        F.when(there & (p > 0) & (q < 0) & F.col("_name").isin(*positive), "SIGN_CONVENTION_VIOLATION"), F.when(there & p.isNotNull() & q.isNull() & usable, "VALUE_LOST_WITH_USABLE_STATE"),
        F.when(there & same & (new("available_at") < old("available_at")), "AVAILABILITY_CUTOFF_INCONSISTENT"), F.when(there & same & (new("filed") != old("filed")), "FILING_DATE_INCONSISTENT"),
        F.when(F.lit(as_of is not None) & there & usable & (new("available_at") > as_of if as_of is not None else F.lit(False)), "FUTURE_AVAILABILITY_UNSUPPORTED"),
        F.when(there & ~old("state").eqNullSafe(new("state")), state),
    ))
    out = both.select(*[F.coalesce("a_" + k, "b_" + k).alias(k) for k in keys], F.explode(codes).alias("code"), p.alias("base_value"), q.alias("candidate_value"), *([old("state").alias("base_state")] if base_state else []))
    return out.withColumn("severity", _lookup(SEVERITY, F.col("code")))


#: The rank of a company's overall state.
OVERALL_RANK = {"SOURCE_VALIDATED": 4, "SOURCE_PARTIALLY_VALIDATED": 3, "SOURCE_UNVALIDATED": 2, "MISSING_OBSERVATION": 1, "BLOCKED": 0, "CONFLICT": 0}


def overall_moves(base: DataFrame, cand: DataFrame, key: str, state: str = "overall") -> DataFrame:
    """(key, code, severity) for companies whose overall state moved, or that one report lacks. One row a key."""
    b = cand.select(F.col(key).alias("_k"), F.col(state).alias("_s"))
    both = base.select(key, F.col(state).alias("_o")).join(b, F.col(key) == F.col("_k"), "full")
    before, after = _lookup(OVERALL_RANK, F.col("_o"), 2), _lookup(OVERALL_RANK, F.col("_s"), 2)
    code = F.when(F.col("_k").isNull(), "COMPANY_DROPPED").when(F.col(key).isNull(), "COMPANY_ADDED").when(after < before, "COMPANY_OVERALL_DOWNGRADE").when(after > before, "COMPANY_OVERALL_UPGRADE").otherwise("COMPANY_OVERALL_CHANGED")
    rows = both.where(~(F.col("_o").eqNullSafe(F.col("_s")) & F.col("_k").isNotNull() & F.col(key).isNotNull())).select(F.coalesce(key, "_k").alias(key), code.alias("code"))
    return rows.withColumn("severity", F.when(F.col("code").isin("COMPANY_DROPPED", "COMPANY_OVERALL_DOWNGRADE"), "WARNING").otherwise("INFO"))


def report_findings(base: DataFrame, cand: DataFrame) -> DataFrame:
    """(code, severity) about two reports as a whole, each one row of mode, contract and as_of: MODE_MISMATCH,
    CONTRACT_SCHEMA_MISMATCH (both FAIL) and AS_OF_REGRESSION (WARNING)."""
    a, b = (t.agg(*[F.first(c).alias(n + c) for c in ("mode", "contract", "as_of")]) for t, n in ((base, "a_"), (cand, "b_")))
    both = a.crossJoin(b)  # aggregates: one row each
    cells = [F.when(~F.col("a_mode").eqNullSafe(F.col("b_mode")), "MODE_MISMATCH"), F.when(~F.col("a_contract").eqNullSafe(F.col("b_contract")), "CONTRACT_SCHEMA_MISMATCH"), F.when(F.col("b_as_of") < F.col("a_as_of"), "AS_OF_REGRESSION")]
    return both.select(F.explode(F.array_compact(F.array(*cells))).alias("code")).withColumn("severity", F.when(F.col("code") == "AS_OF_REGRESSION", "WARNING").otherwise("FAIL"))


def diff_coverage(base: DataFrame, cand: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per key the sorted items (periods, fields, blockers) lost and added; keys without either are left out."""
    pack = lambda t, n: t.groupBy(*keys).agg(F.collect_set(item).alias(n)).withColumnsRenamed({k: n + k for k in keys})
    both = pack(base, "_a").join(pack(cand, "_b"), [F.col("_a" + k).eqNullSafe(F.col("_b" + k)) for k in keys], "full")
    a, b = (F.coalesce(c, F.array().cast(f"array<{base.schema[item].dataType.simpleString()}>")) for c in ("_a", "_b"))
    out = both.select(*[F.coalesce("_a" + k, "_b" + k).alias(k) for k in keys], F.array_sort(F.array_except(a, b)).alias("lost"), F.array_sort(F.array_except(b, a)).alias("added"))
    return out.where("size(lost) > 0 or size(added) > 0")


def identity_conflicts(df: DataFrame, ident: str, entity: str) -> DataFrame:
    """D3: (kind, key, n): ids with several entities and entities with several ids."""
    one = lambda k, v, name: df.groupBy(F.col(k).cast("string").alias("key")).agg(F.count_distinct(v).alias("n")).where("n > 1").select(F.lit(name).alias("kind"), "key", "n")
    return one(ident, entity, "ID_TO_ENTITIES").unionByName(one(entity, ident, "ENTITY_TO_IDS"))


def corroboration_check(primary: DataFrame, secondary: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Keys with INDEPENDENT, NOT_INDEPENDENT (the very same stored object) or UNCORROBORATED. One row a key."""
    s = secondary.select(*[F.col(k).alias("_" + k) for k in keys], F.col(source).alias("_s"))
    out = primary.join(s, same_keys(primary, secondary, keys, "", "_"), "left")
    state = F.when(F.col("_s").isNull(), "UNCORROBORATED").when(F.col("_s") == F.col(source), "NOT_INDEPENDENT").otherwise("INDEPENDENT")
    return out.select(*keys, state.alias("state"))


def reconcile(old: DataFrame, new: DataFrame, ident: str, context: list[str], value: str) -> DataFrame:
    """(kind, key): ids ADDED and REMOVED and contexts whose set of values CHANGED (those in both snapshots).

    Both snapshots are read once each and nothing is joined. Each different value of a context is marked with the
    snapshots that hold it (an id is a key without values), then each key takes the marks of its values; one shuffle does
    for both. No sets are built: the values of a context pass through one task, but aren't held in memory as one row.
    Null ids are no ids.
    """
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in context])
    side = lambda t, n: t.select(F.col(ident).cast("string").alias("_id"), key.alias("_c"), F.col(value).alias("_v"), F.lit(n).alias("_s"))
    both = side(old, 1).unionByName(side(new, 2))
    cells = F.array(F.struct(F.lit(True).alias("is_id"), F.col("_id").alias("key"), F.lit(None).cast(old.schema[value].dataType).alias("v")), F.struct(F.lit(False).alias("is_id"), F.col("_c").alias("key"), F.col("_v").alias("v")))
    rows = both.select("_s", F.explode(cells).alias("_x")).select("_s", "_x.*").where("key is not null")
    held = rows.repartition("is_id", "key").groupBy("is_id", "key", "v").agg(F.bit_or("_s").alias("_s"))  # 1, 2 or 3: both
    got = held.groupBy("is_id", "key").agg(F.bit_or("_s").alias("_s"), F.max(F.col("v").isNotNull() & (F.col("_s") != 3)).alias("_off"))
    kind = F.when(F.col("is_id"), F.when(F.col("_s") == 2, "ADDED").when(F.col("_s") == 1, "REMOVED")).when((F.col("_s") == 3) & F.col("_off"), "CHANGED")
    return got.select(kind.alias("kind"), "key").where("kind is not null")


def replace_snapshot(prev: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of ``new`` take its rows in full, all others keep theirs; rows of one key are never mixed. A null key is a
    key like any other."""
    keys = new.select(F.col(key).alias("_new")).distinct()
    return prev.join(keys, F.col(key).eqNullSafe(F.col("_new")), "left_anti").select(*new.columns).unionByName(new)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of which the tables hold different numbers, with ``surplus`` (positive: more in the first)."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_n")).unionByName(b.select(*cols, F.lit(-1).alias("_n")))
    return both.groupBy(*cols).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")


def group_digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per group its rows and an order-free digest: equal groups have equal digests."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), rows_digest(rest).alias("digest"))


def reproduce_check(old_result: DataFrame, new_result: DataFrame, content: list[str], keys: list[str], metric: str) -> DataFrame:
    """What keeps a historical result from being reproduced: (kind, detail) rows CONTENT_LOST and CONTENT_NEW by
    content, not id, and COVERAGE_SHRANK for keys that lost a metric. No rows: reproduced.

    Both results are read once each: a row counts for its content, as a digest of 32 bytes, and for its keys and metric.
    """
    digest = F.unhex(F.sha2(F.to_json(F.struct(*sorted(content)), {"ignoreNullFields": "false"}), 256))
    own, items = [f"_k{n}" for n in range(len(keys))], [*keys, metric]
    names = [*own, "_m"]

    def side(t, n):
        kinds = [t.schema[c].dataType for c in items]
        by_content = F.struct(digest.alias("_sig"), *[F.lit(None).cast(k).alias(c) for c, k in zip(names, kinds, strict=True)])
        by_keys = F.struct(F.lit(None).cast("binary").alias("_sig"), *[F.col(i).alias(c) for c, i in zip(names, items, strict=True)])
        return t.select(F.explode(F.array(by_content, by_keys)).alias("_x"), F.lit(n).alias("_n")).select("_x.*", "_n").where("_sig is not null or _m is not null")

    got = side(old_result, 1).unionByName(side(new_result, -1)).groupBy("_sig", *names).agg(F.sum("_n").alias("_surplus"), F.min("_n").alias("_least"))
    kind = F.when(F.col("_sig").isNull(), F.when(F.col("_least") == 1, "COVERAGE_SHRANK")).when(F.col("_surplus") > 0, "CONTENT_LOST").when(F.col("_surplus") < 0, "CONTENT_NEW")
    rows = got.select(kind.alias("kind"), "_sig", *own).where("kind is not null").distinct()
    return rows.select("kind", F.when(F.col("_sig").isNull(), F.concat_ws("|", *own)).otherwise(F.lower(F.hex("_sig"))).alias("detail"))


def gate(checks: DataFrame, name: str, passed: str) -> tuple[DataFrame, DataFrame]:
    """(decision, failed): one row (promote, checks, failed) that promotes if there are checks and all passed, and
    a row for each name that did not; a null result did not pass."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    n, bad = F.count("*"), F.count(F.when(~ok, 1))
    return checks.agg(((n > 0) & (bad == 0)).alias("promote"), n.alias("checks"), bad.alias("failed")), checks.where(~ok).select(name).distinct()


def reconcile_inventory(declared: DataFrame, actual: DataFrame, path: str, size: str) -> DataFrame:
    """(path, state): MATCH, SIZE_MISMATCH, MISSING (declared only), UNREGISTERED (there only) or UNRESOLVED (no
    declared size)."""
    a = declared.select(F.col(path).alias("_a"), F.col(size).alias("_s"))
    b = actual.select(F.col(path).alias("_b"), F.col(size).alias("_t"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    state = F.when(F.col("_b").isNull(), "MISSING").when(F.col("_a").isNull(), "UNREGISTERED").when(F.col("_s").isNull(), "UNRESOLVED").when(F.col("_s") != F.col("_t"), "SIZE_MISMATCH").otherwise("MATCH")
    return both.select(F.coalesce("_a", "_b").alias(path), state.alias("state"))


def count_parity(raw: DataFrame, norm: DataFrame, keys: list[str]) -> DataFrame:
    """Keys for which the number of raw and normalised rows differ."""
    n = lambda t, c: t.groupBy(*keys).agg(F.count("*").alias(c)).withColumnsRenamed({k: c + k for k in keys})
    both = n(raw, "raw_rows").join(n(norm, "norm_rows"), [F.col("raw_rows" + k).eqNullSafe(F.col("norm_rows" + k)) for k in keys], "full")
    x, y = F.coalesce("raw_rows", F.lit(0)), F.coalesce("norm_rows", F.lit(0))
    return both.where(x != y).select(*[F.coalesce("raw_rows" + k, "norm_rows" + k).alias(k) for k in keys], x.alias("raw_rows"), y.alias("norm_rows"))


def one_path_per_hash(df: DataFrame, digest: str, path: str) -> DataFrame:
    """Hashes that map to several paths."""
    return df.groupBy(digest).agg(F.count_distinct(path).alias("paths")).where("paths > 1")


def audit_totals(df: DataFrame, declared: DataFrame, status: str, n: str = "n") -> DataFrame:
    """Statuses whose declared count is not the recomputed one: (status, declared, actual, code)."""
    got = df.groupBy(F.col(status).alias("_s")).agg(F.count("*").alias("actual"))
    both = declared.select(F.col(status), F.col(n).alias("declared")).join(got, F.col(status).eqNullSafe(F.col("_s")), "full")
    code = F.when(F.col("declared").isNull(), "NOT_DECLARED").when(F.col("actual").isNull(), "NOT_FOUND").when(F.col("declared") != F.col("actual"), "COUNT_MISMATCH")
    return both.select(F.coalesce(status, "_s").alias(status), "declared", "actual", code.alias("code")).where("code is not null")

