"""Record checks, accounting identities, certification and field contracts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.functions.values import decimal_token, same_keys


def validate_observation(df: DataFrame, required: list[str], layer: str = "layer", layers: tuple[str, ...] = ("native", "derived"), unit: str = "unit", native_unit: str = "native_unit", token: str = "value_text", status: str = "value_status") -> DataFrame:
    """P10: rows with ``code``, the first contract rule that fails, null if none does: MISSING_<FIELD>, BAD_LAYER,
    UNIT_MISMATCH, BAD_DECIMAL, NULL_WITHOUT_STATUS."""
    code = F.when(F.col(required[0]).isNull(), f"MISSING_{required[0].upper()}")
    for c in required[1:]:
        code = code.when(F.col(c).isNull(), f"MISSING_{c.upper()}")
    code = code.when(~F.coalesce(F.col(layer).isin(*layers), F.lit(False)), "BAD_LAYER").when(~F.col(unit).eqNullSafe(F.col(native_unit)), "UNIT_MISMATCH")
    code = code.when(F.col(token).isNotNull() & ~decimal_token(F.col(token)), "BAD_DECIMAL").when(F.col(token).isNull() & F.col(status).isNull(), "NULL_WITHOUT_STATUS")
    return df.withColumn("code", code)


def record_checks(df: DataFrame, ident: str, source: str = "source", price: str = "price", volume: str = "volume", statement: str = "statement_type", items: str = "line_items", days: str = "dates") -> tuple[DataFrame, DataFrame]:
    """(id, check, state) of every rule that applies to a record, and (id, status, passed, warned, failed).

    ``items`` is a map of line item to number, ``days`` an array of the dates of a series. States are passed, warning and
    failed; a rule whose inputs are absent does not apply. Gross profit and A = L + E may be off by 1 % of revenue or
    assets, revenue below 1000 or below zero is a warning, and so are dates out of order. A record fails if half of its
    checks or more do, else it has warnings if any check is not passed. A record without any field is empty and has no
    other check. Repeated ids are counted together.
    """
    item = lambda *names: F.coalesce(*[F.col(items)[n] for n in names])
    revenue = item("Total Revenue", "total_revenue")
    cost, gross = item("Cost Of Revenue", "cost_of_revenue"), item("Gross Profit", "gross_profit")
    assets, liabilities, equity = item("Total Assets", "total_assets"), item("Total Liabilities", "total_liabilities"), item("Total Equity", "total_equity", "Total Stockholders Equity")
    any_revenue = item("Total Revenue", "total_revenue", "Revenue", "Revenues")
    dated = F.filter(days, lambda d: d.isNotNull())
    nothing = reduce(and_, [F.col(c).isNull() for c in (source, price, volume, statement, items, days)])
    judge = lambda ok, bad: F.when(ok.isNull(), None).when(ok, "passed").otherwise(bad)
    income, balance = F.col(statement) == "income_statement", F.col(statement) == "balance_sheet"
    rules = {
        "non_empty": F.when(nothing, "failed").otherwise("passed"),
        "source_attribution": F.when(~nothing, judge(F.coalesce(F.col(source) != "", F.lit(False)), "failed")),
        "price_bounds": judge((F.col(price) > 0) & (F.col(price) < 1_000_000), "failed"),
        "volume_non_negative": judge(F.col(volume) >= 0, "failed"),
        "income_math": F.when(income, judge(F.abs(revenue - cost - gross) <= F.abs(revenue) * 0.01, "warning")),
        "balance_identity": F.when(balance, judge(F.abs(assets - liabilities - equity) <= F.when(assets != 0, F.abs(assets) * 0.01).otherwise(1), "warning")),
        "scale_plausibility": judge(~((any_revenue != 0) & (F.abs(any_revenue) < 1000)), "warning"),
        "sign_plausibility": F.when(any_revenue < 0, "warning"),
        "chronological_order": F.when(F.size(days) > 1, judge(dated == F.array_sort(dated), "warning")),
        "has_type_field": F.when(F.col(statement).isNotNull(), "passed"),
    }
    cells = F.filter(F.array(*[F.struct(F.lit(n).alias("check"), c.alias("state")) for n, c in rules.items()]), lambda x: x["state"].isNotNull())
    long = df.select(ident, F.explode(cells).alias("_c")).select(ident, "_c.check", "_c.state")
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    got = long.groupBy(ident).agg(n("passed").alias("passed"), n("warning").alias("warned"), n("failed").alias("failed"), F.count("*").alias("_n"))
    status = F.when(F.col("failed") >= F.col("_n") / 2, "failed").when((F.col("failed") > 0) | (F.col("warned") > 0), "warning").otherwise("passed")
    return long, got.select(ident, status.alias("status"), "passed", "warned", "failed")


def balance_check(df: DataFrame, keys: list[str], left: str, right: list[str], concept: str = "concept", value: str = "value") -> DataFrame:
    """Per key left = sum of right: PASS, FAIL with the difference, or UNAVAILABLE unless each side's concepts are
    there once."""
    l, r = F.col(concept) == left, F.col(concept).isin(right)  # noqa: E741
    got = df.where(l | r).groupBy(*keys).agg(F.sum(F.when(l, F.col(value)).otherwise(-F.col(value))).alias("_d"), F.count(F.when(l, F.col(value))).alias("_l"), F.count(F.when(r, F.col(value))).alias("_r"), F.count_distinct(F.when(r, F.col(concept))).alias("_k"))
    there = (F.col("_l") == 1) & (F.col("_r") == len(right)) & (F.col("_k") == len(right))
    state = F.when(~there, "UNAVAILABLE").when(F.col("_d") == 0, "PASS").otherwise("FAIL")
    return got.select(*keys, state.alias("state"), F.when(there, F.col("_d")).alias("difference"))


def same_vintage_guard(df: DataFrame, keys: list[str], state: str, fields: list[str]) -> DataFrame:
    """PASS or FAIL stands only if all rows of the key agree in ``fields`` (accession, form, availability, unit,
    currency); else NOT_COMPARABLE."""
    got = df.groupBy(*keys).agg(F.min(state).alias("_s"), F.count_distinct(F.struct(*fields)).alias("_n"))
    return got.select(*keys, F.when(F.col("_n") == 1, F.col("_s")).otherwise("NOT_COMPARABLE").alias("state"))


#: name -> terms of a sum that must be zero: (metric, coefficient).
IDENTITIES = {
    "gross_profit": [("revenue", 1), ("cost_of_revenue", -1), ("gross_profit", -1)],
    "operating_income": [("gross_profit", 1), ("operating_expenses", -1), ("operating_income", -1)],
    "net_income": [("pretax_income", 1), ("tax_expense", -1), ("net_income", -1)],
    "balance": [("assets", 1), ("liabilities", -1), ("equity", -1)],
    "cash_movement": [("cash_begin", 1), ("operating_cash_flow", 1), ("investing_cash_flow", 1), ("financing_cash_flow", 1), ("fx_cash_effect", 1), ("cash_end", -1)],
    "debt": [("short_term_debt", 1), ("long_term_debt", 1), ("debt", -1)],
}


def identity_check(df: DataFrame, keys: list[str], terms: list[tuple[str, int]], tolerance: Column | float = 0, metric: str = "metric", value: str = "value") -> DataFrame:
    """Per key whether a linear identity holds within a tolerance: PASS, FAIL or UNAVAILABLE, and the residual."""
    names = [m for m, _ in terms]
    signed = F.when(F.lit(False), F.col(value))
    for m, c in terms:
        signed = signed.when(F.col(metric) == m, F.col(value) if c == 1 else -F.col(value))
    got = df.where(F.col(metric).isin(names)).groupBy(*keys).agg(F.sum(signed).alias("_d"), F.count_distinct(F.when(F.col(value).isNotNull(), F.col(metric))).alias("_m"), F.count(value).alias("_n"))
    there = (F.col("_m") == len(names)) & (F.col("_n") == len(names))
    limit = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    state = F.when(~there, "UNAVAILABLE").when(F.abs("_d") <= limit, "PASS").otherwise("FAIL")
    return got.select(*keys, state.alias("state"), F.when(there, F.col("_d")).alias("residual"))


def per_share_check(eps: Column, shares: Column, income: Column, digits: int = 2) -> Column:
    """EPS x shares = income within what rounding EPS to ``digits`` can hide; null if one is missing."""
    return F.abs(eps.cast("double") * shares.cast("double") - income.cast("double")) <= 0.5 * 10**-digits * F.abs(shares.cast("double")) + 0.5


LADDER = ["SOURCE_OBSERVED", "RECONCILED", "DERIVATION_VERIFIED", "ACCOUNTING_CERTIFIED"]


def recompute_check(results: DataFrame, terms: DataFrame, ident: str, value: str = "value", coefficient: str = "coefficient") -> DataFrame:
    """(id, stored, recomputed) where a stored result is not exactly the sum of its signed terms."""
    signed = F.when(F.col(coefficient) == 1, F.col(value)).otherwise(exact.by_whole(F.col(value), F.col(coefficient)))
    again = terms.groupBy(ident).agg(F.try_sum(signed).alias("recomputed"))
    out = results.select(ident, F.col(value).alias("stored")).join(again, ident, "left")
    return out.where(~F.col("stored").eqNullSafe(F.col("recomputed")))


def certify(results: DataFrame, terms: DataFrame, leaves: DataFrame, identities: DataFrame, ident: str, source: str = "source_id") -> DataFrame:
    """C4: each result's step on the ladder and why it is no higher. RECONCILED: every cited leaf exists;
    DERIVATION_VERIFIED: the value is the exact sum of its terms; ACCOUNTING_CERTIFIED: an identity it takes part in
    passes and none fails (``identities``: id, state). Reasons: MISSING_LEAF, NOT_RECOMPUTED, IDENTITY_FAILED,
    NO_IDENTITY."""
    lost = terms.join(leaves.select(source).distinct().withColumn("_l", F.lit(1)), source, "left").groupBy(ident).agg(F.count(F.when(F.col("_l").isNull(), 1)).alias("_lost"))
    wrong = recompute_check(results, terms, ident).select(ident, F.lit(True).alias("_wrong"))
    states = identities.groupBy(ident).agg(F.count(F.when(F.col("state") == "PASS", 1)).alias("_ok"), F.count(F.when(F.col("state") == "FAIL", 1)).alias("_bad"))
    out = results.join(lost, ident, "left").join(wrong, ident, "left").join(states, ident, "left")
    why = F.when(F.coalesce("_lost", F.lit(1)) > 0, "MISSING_LEAF").when(F.col("_wrong"), "NOT_RECOMPUTED").when(F.coalesce("_bad", F.lit(0)) > 0, "IDENTITY_FAILED").when(F.coalesce("_ok", F.lit(0)) == 0, "NO_IDENTITY")
    step = F.when(why == "MISSING_LEAF", LADDER[0]).when(why == "NOT_RECOMPUTED", LADDER[1]).when(why.isNotNull(), LADDER[2]).otherwise(LADDER[3])
    return out.select(*results.columns, step.alias("evidence_state"), why.alias("reason"))


def statement_policy(df: DataFrame, key: str, tag: str, evidence: dict[str, list[str]], quarantined: dict[str, list[str]]) -> DataFrame:
    """Per key the statement families whose evidence tags it has, and a map of quarantined metric to family."""
    known = sorted({t for v in evidence.values() for t in v})
    tags = df.groupBy(key).agg(F.collect_set(F.when(F.col(tag).isin(known), F.col(tag))).alias("_t"))
    fam = F.array_compact(F.array(*[F.when(F.arrays_overlap("_t", F.array(*map(F.lit, t))), F.lit(f)) for f, t in sorted(evidence.items())]))
    pairs = [F.when(F.array_contains("families", f), F.struct(F.lit(m).alias("metric"), F.lit(f).alias("family"))) for f, ms in sorted(quarantined.items(), reverse=True) for m in ms]
    return tags.select(key, fam.alias("families")).withColumn("quarantined", F.array_sort(F.array_distinct(F.array_compact(F.array(*pairs)))))


def quarantine_violations(outputs: DataFrame, quarantine: DataFrame, keys: list[str]) -> DataFrame:
    """Outputs that should not exist: those of a quarantined (key, metric), in whatever period or frequency."""
    return outputs.join(quarantine.select(*keys).distinct(), keys, "left_semi")


def evaluate_contract(df: DataFrame, keys: list[str], required_unit: str, period: str, wanted_period: str, unit: str = "unit", available: str = "available_at", as_of=None, value: str = "value", validated: str = "validated") -> DataFrame:
    """C11: per (period, field) the first stage that leaves no candidate: MISSING, PERIOD_MISMATCH, UNIT_MISMATCH,
    NOT_PIT_ELIGIBLE, then CONFLICT of the values left, SOURCE_UNVALIDATED, else AVAILABLE; and the value if there is
    just one."""
    there = F.col(value).isNotNull()
    fits = there & (F.col(period) == F.col(wanted_period))
    units = fits & (F.col(unit) == F.lit(required_unit))
    pit = units & (F.col(available) <= as_of if as_of is not None else F.col(available).isNotNull())
    n = lambda c: F.count(F.when(c, 1))
    got = df.groupBy(*keys).agg(n(there).alias("_1"), n(fits).alias("_2"), n(units).alias("_3"), n(pit).alias("_4"), F.count_distinct(F.when(pit, F.col(value))).alias("_5"), n(pit & F.col(validated)).alias("_6"), F.min(F.when(pit, F.col(value))).alias("_v"))
    state = F.when(F.col("_1") == 0, "MISSING").when(F.col("_2") == 0, "PERIOD_MISMATCH").when(F.col("_3") == 0, "UNIT_MISMATCH").when(F.col("_4") == 0, "NOT_PIT_ELIGIBLE").when(F.col("_5") > 1, "CONFLICT").when(F.col("_6") == 0, "SOURCE_UNVALIDATED").otherwise("AVAILABLE")
    return got.select(*keys, state.alias("state"), F.when(F.col("_5") == 1, F.col("_v")).alias("value"))


def cross_validate(primary: DataFrame, secondary: DataFrame, keys: list[str], value: str = "value", unit: str = "unit", tolerance: float = 0.0) -> DataFrame:
    """The primary's rows against a second source: AGREES, CONFLICT with the delta, UNIT_MISMATCH, NOT_COMPARABLE
    (no second value) or PRIMARY_NOT_AVAILABLE. One row a key on each side."""
    s = secondary.select(*[F.col(k).alias("_" + k) for k in keys], F.col(value).alias("_v"), F.col(unit).alias("_u"))
    out = primary.join(s, same_keys(primary, secondary, keys, "", "_"), "left")
    delta = exact.minus(F.col("_v"), F.col(value))
    state = F.when(F.col(value).isNull(), "PRIMARY_NOT_AVAILABLE").when(F.col("_v").isNull(), "NOT_COMPARABLE").when(F.col(unit) != F.col("_u"), "UNIT_MISMATCH").when(F.abs(delta) <= F.lit(tolerance) * F.abs(F.col(value)), "AGREES").otherwise("CONFLICT")
    return out.select(*primary.columns, state.alias("validation"), F.when(state == "CONFLICT", delta).alias("delta"))
