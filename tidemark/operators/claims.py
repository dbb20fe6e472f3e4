"""Equity claims, the bridge from enterprise to equity value, and readiness of methods."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import exact

DECIMAL = "decimal(38,9)"

#: claim -> (concept of the total, concepts of its parts).
CLAIMS: dict[str, tuple[str | None, list[str]]] = {
    "debt": ("DebtTotal", ["DebtCurrent", "DebtNoncurrent"]),
    "leases": ("LeaseLiability", ["LeaseLiabilityCurrent", "LeaseLiabilityNoncurrent"]),
    "cash": ("CashAndEquivalents", []),
    "preferred": ("PreferredStock", []),
    "noncontrolling": ("NoncontrollingInterest", []),
    "nonoperating": ("NonoperatingInvestments", []),
    "shares": ("SharesOutstanding", []),
}


def eligible_instants(df: DataFrame, on, max_age: int = 400, start: str = "period_start", end: str = "period_end", filed: str = "filed", segment: str | None = None) -> DataFrame:
    """Instants (no duration, no segment) that end and were filed by a day and are at most ``max_age`` days old."""
    out = df.where(F.col(start).isNull() & (F.col(end) <= on) & (F.col(filed) <= on) & (F.datediff(F.lit(on).cast("date"), F.col(end)) <= max_age))
    return out.where(F.col(segment).isNull()) if segment else out


def claims(df: DataFrame, keys: list[str], table: dict[str, tuple[str | None, list[str]]] | None = None, concept: str = "concept", value: str = "value", ident: str = "id") -> DataFrame:
    """(keys, claim, value, state, sources) from selected instants, one row a concept.

    The total counts where it is reported; parts are summed only where it is not and all of them are there, so nothing
    is added twice. A part above its total is CONFLICTING, and so is a claim one of whose concepts has two values; a claim
    with some parts is PARTIAL, one with nothing ABSENT.
    """
    table = table or CLAIMS
    every = sorted({c for t, p in table.values() for c in ([t] if t else []) + p})
    of = F.map_from_entries(F.collect_list(F.when(F.col(concept).isin(every) & F.col(value).isNotNull(), F.struct(concept, value))))
    ids = F.map_from_entries(F.collect_list(F.when(F.col(concept).isin(every), F.struct(concept, F.col(ident).cast("string")))))
    one = df.groupBy(*keys, concept).agg(F.max(value).alias(value), F.max(ident).alias(ident), (F.min(value) < F.max(value)).alias("_two"))
    got = one.groupBy(*keys).agg(of.alias("_v"), ids.alias("_i"), F.collect_set(F.when(F.col("_two"), F.col(concept))).alias("_twice"))
    cells = []
    for name, (total, parts) in sorted(table.items()):
        t = F.col("_v")[total] if total else F.lit(None).cast("decimal(38,9)")
        p = [F.col("_v")[c] for c in parts]
        there = sum((x.isNotNull().cast("int") for x in p), F.lit(0))
        over = F.lit(False)
        for x in p:
            over |= F.coalesce(x > t, F.lit(False))
        total_of = exact.total(p) if p else F.lit(None).cast("decimal(38,9)")
        whole = (there == len(p)) if p else F.lit(False)
        names = F.array(*map(F.lit, ([total] if total else []) + parts))
        state = F.when(over | F.arrays_overlap("_twice", names), "CONFLICTING").when(t.isNotNull(), "REPORTED").when(whole, "SUMMED").when(there > 0, "PARTIAL").otherwise("ABSENT")
        val = F.when(state == "REPORTED", t).when(state == "SUMMED", total_of).cast("decimal(38,9)")
        src = F.array_sort(F.array_compact(F.array(*[F.col("_i")[c] for c in ([total] if total else []) + parts])))
        cells.append(F.struct(F.lit(name).alias("claim"), val.alias("value"), state.alias("state"), src.alias("sources")))
    return got.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")


#: The concepts of each scope, in the order in which one is preferred where that counts.
SCOPES: dict[str, tuple[str, ...]] = {
    "debt_current_total": ("DebtCurrent",),
    "debt_current_parts": ("LongTermDebtCurrent",),
    "current_borrowings": ("CommercialPaper", "ShortTermBorrowings", "OtherShortTermBorrowings"),
    "debt_noncurrent": ("LongTermDebtNoncurrent",),
    "debt_combined": ("LongTermDebt",),
    "finance_lease_total": ("FinanceLeaseLiability", "CapitalLeaseObligations"),
    "finance_lease_parts": ("FinanceLeaseLiabilityCurrent", "FinanceLeaseLiabilityNoncurrent", "CapitalLeaseObligationsCurrent", "CapitalLeaseObligationsNoncurrent"),
    "operating_lease_total": ("OperatingLeaseLiability",),
    "operating_lease_parts": ("OperatingLeaseLiabilityCurrent", "OperatingLeaseLiabilityNoncurrent"),
    "cash": ("CashAndCashEquivalentsAtCarryingValue",),
    "short_investments": ("ShortTermInvestments", "MarketableSecuritiesCurrent"),
    "noncurrent_securities": ("MarketableSecuritiesNoncurrent",),
    "excluded_investments": ("OtherLongTermInvestments", "EquitySecuritiesFvNi", "LongTermInvestments"),
    "preferred_carrying": ("ConvertiblePreferredStockNonredeemableOrRedeemableIssuerOptionValue", "PreferredStockValue", "PreferredStockValueOutstanding"),
    "noncontrolling_total": ("MinorityInterest",),
    "noncontrolling_vie": ("NoncontrollingInterestInVariableInterestEntity",),
    "cover_shares": ("EntityCommonStockSharesOutstanding",),
    "balance_shares": ("CommonStockSharesOutstanding",),
}
SHARE_SCOPES = ("cover_shares", "balance_shares")
#: What the bridge deducts and adds, and the states on which a claim may be used.
DEDUCTED = ["debt", "finance_leases", "preferred_equity", "noncontrolling_interests"]
ADDED = ["cash", "nonoperating_assets"]
USABLE = ("REPORTED",)


def select_instants(facts: DataFrame, keys: list[str], on, concept: str = "concept", unit: str = "unit", value: str = "value", ident: str = "id", max_age: int = 400) -> DataFrame:
    """(keys, concept, unit, value, period_end, filed, id, ambiguous) of each concept as it stood on a day.

    Of the eligible instants the latest period end counts, of these the latest filing, of these the highest accession.
    If that filing has several values for it there is none, and ``ambiguous`` is true. Columns: keys, concept, unit,
    value, period_start, period_end, filed, accession, id, and segment where there is one.
    """
    rows = eligible_instants(facts, on, max_age, segment="segment" if "segment" in facts.columns else None).where(F.col(value).isNotNull())
    rank = F.struct("period_end", "filed", F.coalesce(F.col("accession").cast("string"), F.lit("")).alias("accession"))
    # what each instant holds is combined first, then the latest instant is taken: one shuffle of partial sums
    each = rows.groupBy(*keys, concept, unit, rank.alias("_at")).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.min(F.col(ident).cast("string")).alias("_id"))
    last = each.groupBy(*keys, concept, unit).agg(F.max_by(F.struct("_at", "_low", "_high", "_id"), "_at").alias("_r"))
    same = F.col("_r._low") == F.col("_r._high")
    return last.select(*keys, concept, unit, F.when(same, F.col("_r._low")).alias(value), F.col("_r._at.period_end").alias("period_end"), F.col("_r._at.filed").alias("filed"), F.col("_r._id").alias(ident), (~same).alias("ambiguous"))


class _Facts:
    """The selected facts of a key by concept, as Column expressions over a map of structs."""

    def __init__(self, of: Column):
        self.of = of

    def has(self, c: str) -> Column:
        return self.of[c].isNotNull()

    def value(self, c: str) -> Column:
        return self.of[c]["value"]

    def end(self, c: str) -> Column:
        return self.of[c]["end"]

    def ident(self, c: str) -> Column:
        return self.of[c]["id"]

    def unclear(self, names) -> Column:
        return reduce(or_, [F.coalesce(self.of[c]["ambiguous"], F.lit(False)) for c in names])

    def any(self, names) -> Column:
        return reduce(or_, [self.has(c) for c in names])

    def first(self, names) -> Column:
        """The fact of the first of some concepts that there is."""
        return F.coalesce(*[self.of[c] for c in names])

    def sum(self, names, where=None) -> Column:
        return exact.total([F.when(where(c) if where else F.lit(True), self.value(c)) for c in names])


def _list(*items: tuple[Column, Column]) -> Column:
    """The second of each pair whose first holds."""
    return F.array_compact(F.array(*[F.when(test, x if isinstance(x, Column) else F.lit(x)) for test, x in items]))


def _ids(f: _Facts, *named: tuple[Column, str]) -> Column:
    return F.array_sort(F.array_distinct(_list(*[(test & f.has(c), f.ident(c)) for test, c in named])))


def _debt(f: _Facts) -> dict[str, Column]:
    """Interest-bearing borrowings without leases: the stated current total or else the current parts, plus what is
    noncurrent. A component of the total's own period may be inside it: it is a duplicate and never added; one above the
    total is a conflict."""
    (total,), (part,), borrowings, (later,), (whole,) = (SCOPES[s] for s in ("debt_current_total", "debt_current_parts", "current_borrowings", "debt_noncurrent", "debt_combined"))
    inner = (part, *borrowings)
    stated, twice = f.has(total), {c: f.has(total) & f.has(c) & (f.end(c) == f.end(total)) for c in (part, *borrowings)}
    above = F.coalesce(reduce(or_, [twice[c] & (f.value(c) > f.value(total)) for c in inner]), F.lit(False))
    current = F.when(stated, f.value(total)).otherwise(f.sum(inner))
    combined = f.has(whole) & ~f.has(later)
    noncurrent = F.when(f.has(later), f.value(later)).when(combined, f.value(whole)).otherwise(F.lit(0).cast(DECIMAL))
    there = f.any((total, later, whole)) | f.any(inner)
    alike = lambda c: f.end(c) == f.end(whole)
    both = f.has(whole) & f.has(later)
    same = F.coalesce(alike(part), F.lit(False)) | F.coalesce(alike(later), F.lit(False))
    gap = exact.minus(f.value(whole), f.sum((part, later), alike))
    notes = _list(
        *[(twice[c] & (f.value(c) != f.value(total)), f"POTENTIAL_DUPLICATE:{c}") for c in sorted(inner)],
        (~stated & ~f.any(inner), "NO_CURRENT_DEBT_CONCEPT"),
        (combined, "COMBINED_TOTAL_USED"),
        (both & same & f.has(part) & (gap != 0), "COMBINED_TOTAL_DIFFERS"),
        (both & same & ~f.has(part) & stated, "COMBINED_TOTAL_OF_OTHER_SCOPE"),
        (both & same & ~f.has(part) & ~stated, F.when(gap != 0, "COMBINED_TOTAL_DIFFERS").otherwise("COMBINED_TOTAL_MATCHES")),
        (both & ~same, "COMBINED_TOTAL_OF_OTHER_PERIOD"),
        (above, "COMPONENT_ABOVE_TOTAL"),
    )
    used = [(stated, total), *[(~stated, c) for c in inner], (F.lit(True), later), (combined, whole), *[(above & twice[c] & (f.value(c) != f.value(total)), c) for c in inner]]
    return {
        "there": there, "conflict": above, "value": exact.total([current, noncurrent]), "current": current, "noncurrent": noncurrent, "notes": notes, "sources": _ids(f, *used),
        "candidates": _list(*[(twice[c] & (f.value(c) != f.value(total)), c) for c in sorted(inner)]), "duplicates": _list(*[(twice[c], c) for c in sorted(inner)]), "names": (total, *inner, later, whole),
    }


def _total_or_parts(f: _Facts, totals, parts) -> dict[str, Column]:
    """The total where it is reported, else its parts; parts beside a total are evidence and never added."""
    stated, total = f.any(totals), f.first(sorted(totals))
    same = {c: F.coalesce(stated & (f.end(c) == total["end"]), F.lit(False)) for c in parts}
    gap = exact.minus(total["value"], f.sum(parts, lambda c: same[c]))
    ends = F.array_distinct(_list(*[(f.has(c), f.end(c)) for c in parts]))
    notes = _list(
        (stated & (reduce(add, [f.has(c).cast("int") for c in totals]) > 1), "SEVERAL_TOTALS"),
        (reduce(or_, same.values()) & (gap != 0), "TOTAL_DIFFERS_FROM_PARTS"),
        (stated & reduce(or_, [f.has(c) & ~same[c] for c in parts]), "PARTS_OF_OTHER_PERIOD"),
        (~stated & (F.size(ends) > 1), "PARTS_SPAN_PERIODS"),
    )
    half = lambda tail: F.coalesce(*[F.when(~stated | same[c], f.value(c)) for c in sorted(parts) if c.endswith(tail)])
    first = [(reduce(and_, [~f.has(b) for b in sorted(totals)[:i]], F.lit(True)), c) for i, c in enumerate(sorted(totals))]
    return {
        "there": stated | f.any(parts), "conflict": F.lit(False), "value": F.when(stated, total["value"]).otherwise(f.sum(parts)), "current": half("Current"), "noncurrent": half("Noncurrent"), "notes": notes,
        "sources": _ids(f, *first, *[(~stated, c) for c in parts]), "candidates": _list((F.lit(False), "")), "duplicates": _list(*[(same[c], c) for c in sorted(parts)]), "names": (*totals, *parts),
    }


def _plain(f: _Facts, value: Column, used, names, notes=(), conflict: Column | None = None) -> dict[str, Column]:
    none = F.lit(None).cast(DECIMAL)
    return {"there": reduce(or_, [t & f.has(c) for t, c in used]), "conflict": F.lit(False) if conflict is None else conflict, "value": value, "current": none, "noncurrent": none, "notes": _list(*notes) if notes else _list((F.lit(False), "")), "sources": _ids(f, *used), "candidates": _list((F.lit(False), "")), "duplicates": _list((F.lit(False), "")), "names": names}


def _nonoperating(f: _Facts) -> dict[str, Column]:
    """Cash, one of the two measures of short-term securities, and noncurrent securities; long-term and equity
    investments are left out."""
    cash, short, later, out = (SCOPES[s] for s in ("cash", "short_investments", "noncurrent_securities", "excluded_investments"))
    a, b = sorted(short)
    value = exact.total([f.value(cash[0]), F.coalesce(f.value(a), f.value(b)), f.value(later[0])])
    notes = [(f.has(a) & f.has(b), f"NOT_ADDED:{b}"), *[(f.has(c), f"EXCLUDED:{c}") for c in sorted(out)]]
    return _plain(f, value, [(F.lit(True), cash[0]), (F.lit(True), a), (~f.has(a), b), (F.lit(True), later[0])], (*cash, *short, *later), notes)


def _preferred(f: _Facts) -> dict[str, Column]:
    names = SCOPES["preferred_carrying"]
    differ = F.size(F.array_distinct(_list(*[(f.has(c), f.value(c)) for c in names]))) > 1
    return _plain(f, f.first(names)["value"], [(F.lit(True), c) for c in names], names, [(differ, "CARRYING_VALUES_DISAGREE")])


def _noncontrolling(f: _Facts) -> dict[str, Column]:
    """The reported total, or else the measure of variable interest entities; where both are there and differ, both are
    reported and neither may be deducted."""
    (total,), (vie,) = SCOPES["noncontrolling_total"], SCOPES["noncontrolling_vie"]
    differ = F.coalesce(f.value(total) != f.value(vie), F.lit(False))
    return _plain(f, F.coalesce(f.value(total), f.value(vie)), [(F.lit(True), total), (F.lit(True), vie)], (total, vie), [(differ, "MEASURES_DISAGREE"), (~f.has(total) & f.has(vie), "VIE_MEASURE_USED")], differ)


def _shares(f: _Facts) -> dict[str, Column]:
    (cover,), (balance,) = SCOPES["cover_shares"], SCOPES["balance_shares"]
    return _plain(f, F.coalesce(f.value(cover), f.value(balance)), [(F.lit(True), cover), (~f.has(cover), balance)], (cover, balance), [(~f.has(cover) & f.has(balance), "BALANCE_SHEET_COUNT_USED")])


def scoped_claims(selected: DataFrame, keys: list[str], concept: str = "concept", unit: str = "unit", value: str = "value", ident: str = "id", currency: str = "USD") -> DataFrame:
    """The eight claims of each key from ``select_instants``: (keys, claim, value, state, current, noncurrent, sources,
    candidates, duplicates, notes, period_end, permitted).

    A rule for each claim says which scopes count and when they may be added; what could be counted twice is listed in
    ``duplicates`` and not added, what disagrees in ``candidates``, and why in ``notes``. States: REPORTED;
    REVIEWED_ABSENT if none of the claim's concepts is there (no value, not a zero; UNAVAILABLE for shares); CONFLICTING
    if a component is above its total, two measures disagree, or a concept that counts has several values in one filing
    (AMBIGUOUS_VALUE), in which cases there is no value; OUT_OF_RANGE. Facts in another unit count as absent. A key
    without any fact of these concepts, of whatever unit, has no rows.
    """
    every = sorted({c for names in SCOPES.values() for c in names})
    shares = [c for s in SHARE_SCOPES for c in SCOPES[s]]
    fits = F.col(unit) == F.when(F.col(concept).isin(shares), "shares").otherwise(currency)
    cell = F.struct(F.col(concept), F.struct(F.col(value).cast(DECIMAL).alias("value"), F.col("period_end").alias("end"), F.col(ident).cast("string").alias("id"), F.col("ambiguous").alias("ambiguous")))
    got = selected.where(F.col(concept).isin(every)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(fits, cell))).alias("_of"))  # one entry for each concept at most
    f = _Facts(F.col("_of"))
    rules = {
        "debt": _debt(f),
        "finance_leases": _total_or_parts(f, SCOPES["finance_lease_total"], SCOPES["finance_lease_parts"]),
        "operating_leases": _total_or_parts(f, SCOPES["operating_lease_total"], SCOPES["operating_lease_parts"]),
        "cash": _plain(f, f.value(SCOPES["cash"][0]), [(F.lit(True), SCOPES["cash"][0])], SCOPES["cash"]),
        "nonoperating_assets": _nonoperating(f),
        "preferred_equity": _preferred(f),
        "noncontrolling_interests": _noncontrolling(f),
        "common_shares": _shares(f),
    }
    cells = []
    for name, r in rules.items():
        unclear = f.unclear(r["names"])
        absent = "UNAVAILABLE" if name == "common_shares" else "REVIEWED_ABSENT"
        state = F.when(unclear | r["conflict"], "CONFLICTING").when(~r["there"], absent).when(r["value"].isNull(), "OUT_OF_RANGE").otherwise("REPORTED")
        notes = F.concat(_list(*[(f.unclear([c]), f"AMBIGUOUS_VALUE:{c}") for c in r["names"]]), r["notes"])
        ends = F.array_max(_list(*[(F.array_contains(r["sources"], f.ident(c)), f.end(c)) for c in r["names"]]))
        cells.append(F.struct(F.lit(name).alias("claim"), state.alias("state"), *[r[c].alias(c) for c in ("value", "current", "noncurrent", "sources", "candidates", "duplicates")], notes.alias("notes"), ends.alias("period_end")))
    out = got.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")
    ok, there = F.col("state") == "REPORTED", F.col("state") != "REVIEWED_ABSENT"
    kept = [F.when(ok, F.col(c)).alias(c) for c in ("value", "current", "noncurrent")]
    rest = [F.when(there & (F.col("state") != "UNAVAILABLE"), F.col(c)).otherwise(F.array().cast("array<string>")).alias(c) for c in ("sources", "candidates", "duplicates", "notes")]
    return out.select(*keys, "claim", kept[0], "state", *kept[1:], *rest, F.when(there, F.col("period_end")).alias("period_end"), F.col("state").isin("REPORTED", "REVIEWED_ABSENT").alias("permitted"))


def equity_bridge(df: DataFrame, keys: list[str], deduct: list[str], add: list[str], good: tuple[str, ...] = ("REPORTED", "SUMMED"), absent: str = "REVIEWED_ABSENT") -> DataFrame:
    """What to add to enterprise value: added claims less deducted ones, only if every one is good or reviewed as
    absent; else UNAVAILABLE with the sorted missing claims. A missing claim is never taken as zero."""
    names = [*deduct, *add]
    ok, none = F.col("state").isin(*good) & F.col("value").isNotNull(), F.col("state") == absent
    signed = F.when(ok & F.col("claim").isin(add), F.col("value")).when(ok & F.col("claim").isin(deduct), -F.col("value"))
    got = df.where(F.col("claim").isin(names)).groupBy(*keys).agg(F.sum(signed).alias("_s"), F.collect_set(F.when(ok | none, F.col("claim"))).alias("_ok"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, names)), "_ok"))
    whole = F.size(missing) == 0
    return got.select(*keys, F.when(whole, F.coalesce("_s", F.lit(0).cast("decimal(38,9)"))).alias("bridge"), F.when(whole, "AVAILABLE").otherwise("UNAVAILABLE").alias("status"), missing.alias("missing"))


def method_eligibility(df: DataFrame, ident: str, methods: dict[str, dict[str, Column]], financial: Column | None = None, not_for_financials: list[str] = ()) -> DataFrame:
    """(id, method, status, missing): for each method the sorted codes whose condition does not hold; READY, BLOCKED
    or, for financial filers and the listed methods, NOT_APPLICABLE."""
    cells = []
    for name, needs in methods.items():
        codes = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in needs.items()]))))
        off = F.coalesce(financial, F.lit(False)) if financial is not None and name in not_for_financials else F.lit(False)
        status = F.when(off, "NOT_APPLICABLE").when(F.size(codes) == 0, "READY").otherwise("BLOCKED")
        cells.append(F.struct(F.lit(name).alias("method"), status.alias("status"), F.when(off, F.array().cast("array<string>")).otherwise(codes).alias("missing")))
    return df.select(ident, F.explode(F.array(*cells)).alias("_c")).select(ident, "_c.*")


#: The claims of the bridge, and the states that count as certified.
BRIDGE_CLAIMS = ("debt", "finance_leases", "preferred_equity", "noncontrolling_interests", "cash", "nonoperating_assets")
SHARES = "MISSING_DATED_OUTSTANDING_SHARES"
INDUSTRIAL = "INDUSTRIAL_DCF_NOT_APPLICABLE_TO_FINANCIAL_FILER"


def readiness_methods(df: DataFrame, ident: str, certified: tuple[str, ...], metrics: str = "metrics", claim_states: str = "claims", shares: str = "shares_state", family: str = "statement_family", book: str = "equity_totals", dividends: str = "dividends") -> DataFrame:
    """(id, method, eligible, missing) for the seven methods, ``missing`` being the sorted codes of absent inputs.

    A row has the annual metrics it has (array), its claims' states (map), the state of its dated share count, its
    statement family, and whether equity totals and dividends are reported; nulls count as absent. For filers of the
    financial family the three industrial methods have one code, that they don't apply.
    """
    has = lambda *names: F.coalesce(F.size(F.array_except(F.array(*map(F.lit, names)), metrics)) == 0, F.lit(False))
    ok = lambda c: F.coalesce(F.col(claim_states)[c].isin(*certified), F.lit(False))
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    financial = F.coalesce(F.col(family) == "financial_statement_evidence", F.lit(False))
    operating, cash_flow, income = has("revenue", "operating_income"), has("operating_cash_flow", "capital_expenditures"), has("net_income")
    dated = F.coalesce(F.col(shares).isin(*certified), F.lit(False))
    no_income, no_book = (income, "MISSING_NET_INCOME"), (true(book), "MISSING_BOOK_EQUITY_TOTAL")
    needs = {
        "operating_dcf": [(operating, "MISSING_OPERATING_INCOME_OR_REVENUE"), (cash_flow, "MISSING_CASH_FLOW_OR_CAPEX"), *[(ok(c), f"MISSING_BRIDGE_CLAIM_{c.upper()}") for c in BRIDGE_CLAIMS]],
        "fcfe": [(operating, "MISSING_OPERATING_INCOME_OR_REVENUE"), (cash_flow, "MISSING_CASH_FLOW_OR_CAPEX"), no_income],
        "apv": [(operating & cash_flow, "MISSING_UNLEVERED_FREE_CASH_FLOW_INPUTS"), (ok("debt"), "MISSING_BRIDGE_CLAIM_DEBT")],
        "bank_excess_return": [(financial, "NOT_A_FINANCIAL_STATEMENT_FAMILY_FILER"), no_income, no_book, (ok("preferred_equity"), "MISSING_BRIDGE_CLAIM_PREFERRED_EQUITY")],
        "residual_income": [no_income, no_book, (ok("preferred_equity") & ok("noncontrolling_interests"), "PREFERRED_OR_NCI_CLAIM_NOT_RESOLVED")],
        "ddm": [(true(dividends), "MISSING_DIVIDEND_EVIDENCE")],
        "comparables": [(has("revenue") | income, "MISSING_REVENUE_AND_NET_INCOME")],
    }
    cells = []
    for name, tests in needs.items():
        codes = F.array_sort(F.array_compact(F.array(*[F.when(~t, F.lit(code)) for t, code in [*tests, (dated, SHARES)]])))
        if name in ("operating_dcf", "fcfe", "apv"):
            codes = F.when(financial, F.array(F.lit(INDUSTRIAL))).otherwise(codes)
        cells.append(F.struct(F.lit(name).alias("method"), codes.alias("missing")))
    out = df.select(ident, F.explode(F.array(*cells)).alias("_c")).select(ident, "_c.*")
    return out.select(ident, "method", (F.size("missing") == 0).alias("eligible"), "missing")
