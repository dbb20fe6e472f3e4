"""Derived quarters, trailing sums, ratios and growth, exact and with reasons for what can't be derived.

Values are decimal(38,9), of which all digits count: differences, products and quotients are those of
``functions/exact.py``. What 38 digits can't hold has the reason OUT_OF_RANGE; it never stops a job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.operators.ranges import bucket, buckets, day_number, with_halo

DECIMAL = "decimal(38,9)"


def signed(value: Column, coefficient: Column) -> Column:
    """value times a coefficient of 1 or -1 (0: nothing), without loss of digits."""
    return F.when(coefficient == -1, exact.minus(F.lit(0).cast(DECIMAL), value)).when(coefficient == 1, value)


def linear_combine(terms: DataFrame, result: str, ident: str = "id", coefficient: str = "coefficient", value: str = "value", unit: str = "unit", available: str = "available_at") -> DataFrame:
    """A1: per ``result`` the sum of value times coefficient (any whole number), merged (id, coefficient) terms without
    zeros, available_at as the latest of all, and a reason: UNIT_MISMATCH, MISSING_VALUE or OUT_OF_RANGE instead of a value.

    Coefficients of one id are added before use; a coefficient of n counts the value n times in the sum.
    """
    merged = terms.groupBy(result, ident).agg(F.sum(coefficient).cast("int").alias("_c"), F.min(value).alias("_v"), F.min(unit).alias("_u"), F.max(available).alias("_a"))
    times = F.when(F.col("_c").between(-1, 1), signed(F.col("_v"), F.col("_c"))).otherwise(exact.by_whole(F.col("_v"), F.col("_c")))
    on = F.col("_c") != 0
    out = merged.groupBy(result).agg(
        F.try_sum(F.when(on, times)).alias("_sum"),
        F.array_sort(F.collect_list(F.when(on, F.struct(F.col(ident).alias("id"), F.col("_c").alias("coefficient"))))).alias("terms"),
        F.max("_a").alias(available),
        F.count_distinct(F.when(on, F.col("_u"))).alias("_units"),
        F.count(F.when(on & F.col("_v").isNull(), 1)).alias("_nulls"),
        F.count(F.when(on & F.col("_v").isNotNull() & times.isNull(), 1)).alias("_large"),
        F.count(F.when(on, 1)).alias("_terms"),
    )
    reason = F.when(F.col("_units") > 1, "UNIT_MISMATCH").when(F.col("_nulls") > 0, "MISSING_VALUE")
    reason = reason.when((F.col("_large") > 0) | (F.col("_terms") > 0) & F.col("_sum").isNull(), "OUT_OF_RANGE")
    return out.select(result, F.when(reason.isNull(), F.col("_sum")).alias("value"), "terms", available, reason.alias("reason"))


def decumulate(df: DataFrame, keys: list[str], start: str = "period_start", end: str = "period_end", value: str = "value", most: int = 105, non_negative: list[str] | None = None, metric: str = "metric") -> tuple[DataFrame, DataFrame]:
    """A2: (quarters, gaps) from cumulative flows of one start. A cumulative value of 150 days or more, less the one of
    75 to 300 days that ends 75 to ``most`` days before it, is the quarter between; quarters that begin the chain are
    taken as they are. Gaps: AMBIGUOUS_PREDECESSOR, NO_PREDECESSOR, MISSING_VALUE, OUT_OF_RANGE, NEGATIVE_FLOW (for
    ``non_negative`` metrics), and CONFLICTING_QUARTER where a reported quarter has another value.
    """
    days = F.datediff(end, start) + 1
    rows = df.select(*keys, start, end, value, days.alias("_d"))
    width, day = most - 74, day_number(F.col(end))
    prev = rows.where(F.col("_d").between(75, 300)).select(*[F.col(k).alias("_" + k) for k in keys], F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(value).alias("_v"), bucket(day, width).alias("_pb"))
    long = rows.where(F.col("_d") >= 150).withColumn("_b", F.explode(buckets(day - most, day - 75, width)))
    on = [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys] + [F.col(start) == F.col("_s"), F.col("_b") == F.col("_pb"), F.datediff(F.col(end), F.col("_e")).between(75, most)]
    got = long.join(prev, on, "left").groupBy(*keys, start, end).agg(F.count("_e").alias("n"), F.max("_e").alias("_e"), F.max(value).alias("_y"), F.max("_v").alias("_m"))
    q = got.withColumns({value: exact.minus(F.col("_y"), F.col("_m")), "_q": F.date_add("_e", 1)})
    wrong = F.when(F.col("n") == 0, "NO_PREDECESSOR").when(F.col("n") > 1, "AMBIGUOUS_PREDECESSOR")
    wrong = wrong.when(F.col("_y").isNull() | F.col("_m").isNull(), "MISSING_VALUE").when(F.col(value).isNull(), "OUT_OF_RANGE")
    if non_negative:
        wrong = wrong.when(F.col(metric).isin(non_negative) & (F.col(value) < 0), "NEGATIVE_FLOW")
    q = q.withColumn("reason", wrong)
    reported = rows.where(F.col("_d").between(75, most)).select(*keys, start, end, value).withColumn("derived", F.lit(False))
    made = q.where("reason is null").select(*keys, F.col("_q").alias(start), end, value, F.lit(True).alias("derived"))
    both = reported.unionByName(made).groupBy(*keys, start, end).agg(F.count_distinct(value).alias("_n"), F.min_by(value, "derived").alias(value), F.min("derived").alias("derived"))
    gaps = q.where("reason is not null").select(*keys, start, end, "reason").unionByName(both.where("_n > 1").select(*keys, start, end, F.lit("CONFLICTING_QUARTER").alias("reason")))
    return both.where("_n <= 1").drop("_n"), gaps


#: Days of a block of an ordered scan; it changes nothing in the result.
BLOCK_DAYS = 1461


def _laid(df: DataFrame, keys: list[str], n: int, start: str, end: str, days: int) -> tuple[DataFrame, Window]:
    """Rows in blocks of days of their end, with what windows of n rows need of the block before, and that window."""
    laid = with_halo(df, keys, [end, start], n, bucket(day_number(F.col(end)), days))
    return laid, Window.partitionBy(*keys, "_block").orderBy(end, start)


def _touching(df: DataFrame, w: Window, n: int, start: str, end: str) -> DataFrame:
    touch = F.coalesce(F.lag(F.date_add(end, 1)).over(w) == F.col(start), F.lit(False)).cast("int")
    return df.withColumn("_touch", touch).withColumn("contiguous", (F.sum("_touch").over(w.rowsBetween(-(n - 2), 0)) == n - 1) & (F.count("*").over(w.rowsBetween(-(n - 1), 0)) == n)).drop("_touch")


def rolling_contiguous(df: DataFrame, keys: list[str], n: int, start: str, end: str, days: int = BLOCK_DAYS) -> DataFrame:
    """True if a row and the n - 1 (at least 1) before it touch: each starts the day after the previous end."""
    laid, w = _laid(df, keys, n, start, end, days)
    return _touching(laid, w, n, start, end).where("_own").select(*df.columns, "contiguous")


def ttm(df: DataFrame, keys: list[str], start: str = "period_start", end: str = "period_end", value: str = "value", concept: str = "concept", non_additive: list[str] | None = None, metric: str = "metric", days: int = BLOCK_DAYS) -> tuple[DataFrame, DataFrame]:
    """A3: (sums, gaps) of four touching quarters of one concept that span 330 to 380 days. Gaps: NON_ADDITIVE_METRIC,
    NOT_FOUR_CONTIGUOUS_QUARTERS, CONCEPT_CHANGE, SPAN, MISSING_VALUE, OUT_OF_RANGE."""
    laid, w = _laid(df, keys, 4, start, end, days)
    rows, w = _touching(laid, w, 4, start, end), w.rowsBetween(-3, 0)
    rows = rows.select(
        *keys, F.col(end), "_own", "contiguous", F.min(start).over(w).alias("ttm_start"), F.try_sum(value).over(w).alias("ttm_value"), F.count(value).over(w).alias("_n"),
        (F.min(concept).over(w) != F.max(concept).over(w)).alias("_mixed") if concept not in keys else F.lit(False).alias("_mixed"),
    )
    span = F.datediff(F.col(end), F.col("ttm_start")) + 1
    reason = F.when(F.col(metric).isin(non_additive or []), "NON_ADDITIVE_METRIC") if non_additive else F.when(F.lit(False), "")
    reason = reason.when(~F.col("contiguous"), "NOT_FOUR_CONTIGUOUS_QUARTERS").when(F.col("_mixed"), "CONCEPT_CHANGE").when(~span.between(330, 380), "SPAN").when(F.col("_n") < 4, "MISSING_VALUE").when(F.col("ttm_value").isNull(), "OUT_OF_RANGE")
    rows = rows.where("_own").withColumn("reason", reason)
    return rows.where("reason is null").select(*keys, F.col("ttm_start").alias(start), end, F.col("ttm_value").alias(value)), rows.where("reason is not null").select(*keys, end, "reason")


def sum_components(df: DataFrame, keys: list[str], required: list[str], part: str = "concept", value: str = "value", total: str | None = None) -> DataFrame:
    """A4: the sum of ``required`` parts, all or nothing: value and reason MISSING_COMPONENT or OUT_OF_RANGE. With ``total``, the name
    of a reported part, also ``reconciles``: within the larger of a million and half a percent of it."""
    need = F.col(part).isin(required) & F.col(value).isNotNull()
    aggs = [F.try_sum(F.when(need, F.col(value))).alias("_s"), F.count_distinct(F.when(need, F.col(part))).alias("_n")]
    if total:
        aggs.append(F.max(F.when(F.col(part) == total, F.col(value))).alias("reported"))
    out = df.groupBy(*keys).agg(*aggs)
    whole = F.col("_n") == len(required)
    cols = [*keys, F.when(whole, F.col("_s")).alias("value"), F.when(~whole, "MISSING_COMPONENT").when(F.col("_s").isNull(), "OUT_OF_RANGE").alias("reason")]
    if total:
        off = F.abs(F.col("_s").cast("double") - F.col("reported").cast("double"))
        cols += ["reported", F.when(whole, off <= F.greatest(F.lit(1e6), 0.005 * F.abs(F.col("reported").cast("double")))).alias("reconciles")]
    return out.select(*cols)


def difference(df: DataFrame, keys: list[str], plus: str, minus: str, metric: str = "metric", value: str = "value", non_negative: bool = True) -> DataFrame:
    """A5: ``plus`` less ``minus`` on the same period, with reason MISSING_INPUT, NEGATIVE_SUBTRAHEND or OUT_OF_RANGE."""
    a, b = F.col(metric) == plus, F.col(metric) == minus
    out = df.where(a | b).groupBy(*keys).agg(F.max(F.when(a, F.col(value))).alias("_p"), F.max(F.when(b, F.col(value))).alias("_m"), F.count(F.when(a, F.col(value))).alias("_a"), F.count(F.when(b, F.col(value))).alias("_b"), F.min(F.when(b, F.col(value))).alias("_low"))
    reason = F.when((F.col("_a") != 1) | (F.col("_b") != 1), "MISSING_INPUT")
    if non_negative:
        reason = reason.when(F.col("_low") < 0, "NEGATIVE_SUBTRAHEND")
    made = exact.minus(F.col("_p"), F.col("_m"))
    reason = reason.when(made.isNull(), "OUT_OF_RANGE")
    return out.select(*keys, F.when(reason.isNull(), made).alias("value"), reason.alias("reason"))


def ratio(num: Column, den: Column, positive: bool = True) -> tuple[Column, Column]:
    """(quotient to six places, reason) of two decimals: MISSING_NUMERATOR, MISSING_DENOMINATOR, ZERO_DENOMINATOR and,
    if the denominator must be positive, NEGATIVE_DENOMINATOR, and OUT_OF_RANGE."""
    reason = F.when(num.isNull(), "MISSING_NUMERATOR").when(den.isNull(), "MISSING_DENOMINATOR").when(den == 0, "ZERO_DENOMINATOR")
    if positive:
        reason = reason.when(den < 0, "NEGATIVE_DENOMINATOR")
    q = exact.quotient(num, den, 6)
    reason = reason.when(q.isNull(), "OUT_OF_RANGE")
    return F.when(reason.isNull(), q), reason


#: Formula -> its inputs, the last one being the denominator of a ratio.
FORMULAS: dict[str, tuple[str, ...]] = {
    "revenue_growth": ("revenue", "prior_revenue"),
    "operating_margin": ("operating_income", "revenue"),
    "net_margin": ("net_income", "revenue"),
    "free_cash_flow": ("operating_cash_flow", "capital_expenditures"),
    "free_cash_flow_margin": ("free_cash_flow", "revenue"),
    "market_cap": ("price", "shares_outstanding"),
    "price_to_earnings": ("market_cap", "net_income"),
    "price_to_sales": ("market_cap", "revenue"),
    "enterprise_value": ("market_cap", "total_debt", "cash", "preferred_equity", "noncontrolling_interest"),
    "ev_ebitda": ("enterprise_value", "ebitda"),
    "ev_revenue": ("enterprise_value", "revenue"),
    "free_cash_flow_yield": ("free_cash_flow", "market_cap"),
    "leverage": ("total_debt", "ebitda"),
}
AMOUNTS = ("free_cash_flow", "market_cap", "enterprise_value")
NEEDS_NONFINANCIAL = ("enterprise_value", "ev_ebitda", "ev_revenue", "leverage")
YEARLY = ("net_income", "revenue", "free_cash_flow", "ebitda")
VALUED = ("price_to_earnings", "price_to_sales", "ev_ebitda", "ev_revenue", "free_cash_flow_yield", "leverage")
#: Input -> the definitions it must have, and the reason if it has none of them.
DEFINITIONS = {
    "free_cash_flow": (["OPERATING_CASH_FLOW_MINUS_CASH_PPE_PURCHASES_VERIFIED"], "FCF_DEFINITION_UNVERIFIED"),
    "capital_expenditures": (["CASH_PPE_PURCHASES_POSITIVE_OUTFLOW"], "CAPEX_DEFINITION_UNVERIFIED"),
    "shares_outstanding": (["COMMON_SHARES_OUTSTANDING"], "OUTSTANDING_SHARE_DEFINITION_REQUIRED"),
    "total_debt": (["NONOVERLAPPING_INTEREST_BEARING_DEBT"], "DEBT_COMPONENT_OVERLAP_UNRESOLVED"),
    "ebitda": (["REPORTED_RECONCILED_EBITDA", "OPERATING_INCOME_PLUS_DA_RECONCILED"], "EBITDA_DEFINITION_UNVERIFIED"),
}
INPUT_COLUMNS = [
    "value", "unit", "currency", "available_at", "period_start", "period_end", "frequency", "definition", "quality", "source_ids", "valuation_at", "price_basis", "adjustment_method", "security_id",
]


def formulas(df: DataFrame, keys: list[str], names: list[str], as_of: Column, role: str = "metric", industry: str = "industry", scope: str = "security_scope") -> DataFrame:
    """(keys, formula, value, numerator, denominator, terminates, unit, currency, source_ids, available_at, reason) for each key
    and formula name.

    ``df`` has a row for each input: keys, role and INPUT_COLUMNS, of which those it lacks count as null, and industry and
    security scope of the key. An input that a key has several times is AMBIGUOUS_INPUT. The reason is the first rule
    that is broken, or OUT_OF_RANGE, else null. numerator and denominator are whole numbers in lowest terms, the exact
    result; ``value`` is their quotient to nine places, and ``terminates`` tells that it is exact too. Inputs are gathered
    once for all formulas, one row a role.
    """
    roles = sorted({r for n in names for r in FORMULAS[n]})
    kinds = {"value": DECIMAL, "available_at": "timestamp", "period_start": "date", "period_end": "date", "valuation_at": "timestamp", "source_ids": "array<string>"}
    cols = [(F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in INPUT_COLUMNS]
    extra = [(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(n) for c, n in ((industry, "_industry"), (scope, "_scope"))]
    rows = df.select(*keys, F.col(role).alias("_role"), F.struct(*cols).alias("_in"), *extra)
    of = lambda r: F.when(F.col("_role") == r, F.col("_in"))
    aggs = [a for i, r in enumerate(roles) for a in (F.first(of(r), ignorenulls=True).alias(f"_{i}"), F.count(of(r)).alias(f"_n{i}"))]
    got = rows.groupBy(*keys).agg(F.max("_industry").alias("_industry"), F.max("_scope").alias("_scope"), *aggs)
    at = {r: i for i, r in enumerate(roles)}
    one_unit = F.lit(1).cast(DECIMAL)

    def one(name):
        parts = FORMULAS[name]
        x = {r: (lambda c, r=r: F.col(f"_{at[r]}.{c}")) for r in parts}
        no = lambda c: F.coalesce(~c, F.lit(True))
        rules: list[tuple[Column, str]] = []
        if name in NEEDS_NONFINANCIAL:
            rules += [(F.col("_industry").isin("financial_statement_evidence", "bank", "insurance"), "FINANCIAL_INDUSTRY_EV_DEFINITION_EXCLUDED"), (no(F.col("_industry") == "nonfinancial_verified"), "NONFINANCIAL_INDUSTRY_UNVERIFIED")]
        for r in parts:
            rules += [
                (F.col(f"_n{at[r]}") == 0, f"MISSING_COMPONENT:{r}"),
                (F.col(f"_n{at[r]}") > 1, f"AMBIGUOUS_INPUT:{r}"),
                (x[r]("quality").isin("UNAVAILABLE", "AMBIGUOUS", "EXCLUDED", "FAIL"), f"INPUT_QUALITY_NOT_PERMITTED:{r}"),
                (F.coalesce(F.size(x[r]("source_ids")), F.lit(0)) < 1, f"INPUT_PROVENANCE_MISSING:{r}"),
                (x[r]("available_at").isNull(), f"INPUT_AVAILABILITY_UNESTABLISHED:{r}"),
                (x[r]("available_at") > as_of, "INPUT_NOT_AVAILABLE"),
                (x[r]("value").isNull(), "NULL_INPUT"),
            ]
        money = [r for r in parts if r != "shares_outstanding"]
        currency = x[money[0]]("currency")
        for r in money:
            rules.append((no(x[r]("currency") != "UNKNOWN"), "CURRENCY_UNESTABLISHED"))
        for r in money[1:]:
            rules.append((x[r]("currency") != currency, "CURRENCY_MISMATCH"))
        for r in parts:
            want = F.lit("shares") if r == "shares_outstanding" else F.concat(currency, F.lit("/share")) if r == "price" else currency
            rules.append((no(x[r]("unit") == want), "UNIT_MISMATCH"))
        define = lambda r: rules.append((no(x[r]("definition").isin(DEFINITIONS[r][0])), DEFINITIONS[r][1]))
        if "free_cash_flow" in parts:
            define("free_cash_flow")
        if "market_cap" in parts:
            rules.append((x["market_cap"]("value") <= 0, "NONPOSITIVE_EQUITY_INPUT"))
        days = lambda r: F.datediff(x[r]("period_end"), x[r]("period_start")) + 1
        yearly = [r for r in parts if r in YEARLY]
        if name in VALUED:
            for r in yearly:
                rules += [(no(x[r]("frequency").isin("annual", "ttm")), "ANNUAL_OR_TTM_REQUIRED"), (no(days(r).between(350, 378)), "ANNUAL_OR_TTM_DURATION_UNSUPPORTED")]
        if name == "leverage":
            rules.append((~x["total_debt"]("period_end").eqNullSafe(x["ebitda"]("period_end")), "BALANCE_FLOW_PERIOD_MISMATCH"))
        priced = "price" if name == "market_cap" else next((r for r in ("market_cap", "enterprise_value") if r in parts), None)
        if priced:
            then = x[priced]("valuation_at")
            rules += [(then.isNull(), "PRICE_VALUATION_TIME_UNESTABLISHED"), (then > as_of, "PRICE_AFTER_CUTOFF")]
            rules += [(x[r]("available_at") > then, "FINANCIAL_INPUT_AFTER_PRICE") for r in parts if r != priced]
        if name in ("operating_margin", "net_margin", "free_cash_flow", "free_cash_flow_margin"):
            a, b = parts
            for c in ("period_start", "period_end", "frequency"):
                rules.append((no(x[a](c) == x[b](c)), "PERIOD_MISMATCH"))
        a, b = parts[0], parts[-1]
        v = lambda r: x[r]("value")
        num, den, by = v(a), v(b), None
        if name == "revenue_growth":
            lengths = F.abs(days(a) - days(b))
            rules += [(~x[a]("frequency").eqNullSafe(x[b]("frequency")) | x[a]("period_start").isNull() | x[b]("period_start").isNull(), "PERIOD_MISMATCH")]
            rules += [(no(F.datediff(x[a]("period_end"), x[b]("period_end")).between(350, 378)) | no(lengths <= 8), "NONCOMPARABLE_PRIOR_PERIOD"), (v(b) <= 0, "NONPOSITIVE_DENOMINATOR")]
            num = exact.minus(v(a), v(b))
        elif name == "free_cash_flow":
            define(b)
            rules.append((v(b) < 0, DEFINITIONS[b][1]))
            num, den = exact.minus(v(a), v(b)), one_unit
        elif name == "market_cap":
            rules.append((no((x[a]("price_basis") == "RAW") & (x[a]("adjustment_method") == "NONE")), "PRICE_SHARE_ADJUSTMENT_BASIS_UNVERIFIED"))
            define(b)
            rules += [(no(F.col("_scope") == "SINGLE_COMMON_CLASS_VERIFIED"), "SECURITY_SCOPE_UNVERIFIED"), (no(x[a]("security_id") == x[b]("security_id")), "SECURITY_SCOPE_MISMATCH")]
            rules += [((v(a) <= 0) | (v(b) <= 0), "NONPOSITIVE_EQUITY_INPUT"), (no(x[a]("period_end") == x[b]("period_end")), "SAME_DATE_SHARE_COUNT_REQUIRED")]
            num, den, by = v(a), one_unit, v(b)
        elif name == "enterprise_value":
            define("total_debt")
            balance = [r for r in parts if r != "market_cap"]
            rules += [(no(x[r]("period_end") == x[balance[0]]("period_end")), "BALANCE_PERIOD_MISMATCH") for r in balance]
            num, den = exact.minus(reduce(exact.plus, [v("market_cap"), v("total_debt"), v("preferred_equity"), v("noncontrolling_interest")]), v("cash")), one_unit
        else:
            if name == "price_to_earnings":
                rules.append((no(x["net_income"]("definition") == "NET_INCOME_ATTRIBUTABLE_TO_COMMON"), "COMMON_INCOME_SCOPE_UNVERIFIED"))
            if b == "ebitda":
                define("ebitda")
            if name == "leverage":
                define("total_debt")
            rules.append((v(b) <= 0, "NONPOSITIVE_DENOMINATOR"))
        reason = F.lit(None).cast("string")
        for test, why in reversed(rules):
            reason = F.when(test, why).otherwise(reason)
        ids = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x[r]("source_ids"), F.array().cast("array<string>")) for r in parts])))
        return F.struct(
            F.lit(name).alias("formula"), *[F.when(reason.isNull(), F.lit(None) if c is None else c).cast(DECIMAL).alias(n) for c, n in ((num, "_num"), (den, "_den"), (by, "_by"))], (currency if name in AMOUNTS else F.lit("ratio")).alias("unit"), currency.alias("currency"),
            ids.alias("source_ids"), F.greatest(*[x[r]("available_at") for r in parts]).alias("available_at"), reason.alias("reason"),
        )

    each = got.select(*keys, F.explode(F.array(*[one(n) for n in names])).alias("_f")).select(*keys, "_f.*")
    made = exact.fraction(F.col("_num"), F.col("_den"))
    if "market_cap" in names:
        made = F.when(F.col("_by").isNull(), made).otherwise(exact.times(exact.fraction(F.col("_num")), exact.fraction(F.col("_by"))))
    each = each.withColumn("made", made).withColumn("value", exact.rounded(F.col("made")))
    reason = F.coalesce("reason", F.when(F.col("value").isNull(), "OUT_OF_RANGE"))
    if_made = lambda c: F.when(reason.isNull(), c)
    return each.select(
        *keys, "formula", "value", if_made(F.col("made.n")).alias("numerator"), if_made(F.col("made.d")).alias("denominator"), if_made(exact.ends_within(F.col("made"))).alias("terminates"),
        F.when(F.col("unit") == "ratio", F.col("unit")).otherwise(if_made(F.col("unit"))).alias("unit"), *[if_made(F.col(c)).alias(c) for c in ("currency", "source_ids", "available_at")], reason.alias("reason"),
    )


def annual_growth(df: DataFrame, keys: list[str], years: int, start: str = "period_start", end: str = "period_end", value: str = "value", days: int = BLOCK_DAYS) -> DataFrame:
    """Per row and its ``years`` predecessors: yearly and cumulative growth in percent, or a reason: the chain must
    be full, touching and positive, and the result within 38 digits (OUT_OF_RANGE)."""
    laid, w = _laid(df, keys, years + 1, start, end, days * years)
    rows = _touching(laid, w, years + 1, start, end)
    rows = rows.select(*keys, start, end, value, "_own", "contiguous", F.lag(value).over(w).alias("_p"), F.lag(value, years).over(w).alias("_b"), F.min(value).over(w.rowsBetween(-years, 0)).alias("_low"), F.count("*").over(w.rowsBetween(-years, 0)).alias("_n"))
    reason = F.when(F.col("_n") <= years, "CHAIN_TOO_SHORT").when(~F.col("contiguous"), "NOT_CONTIGUOUS").when(F.col("_low") <= 0, "NOT_POSITIVE")

    def percent(a, b):
        fast = ((F.try_divide(a.try_cast("decimal(24,9)"), b.try_cast("decimal(24,9)")) - 1) * 100).try_cast("decimal(38,4)")
        hundred = F.struct(exact.whole(100).alias("n"), exact.whole(1).alias("d"))
        wide = a.try_cast("decimal(24,9)").isNull() | b.try_cast("decimal(24,9)").isNull()
        return F.when(wide, exact.rounded(exact.times(exact.fraction(exact.minus(a, b), b), hundred), 4)).otherwise(fast)

    growth = {n: F.when(reason.isNull(), percent(F.col(value), F.col(c))) for n, c in (("growth_percent", "_p"), ("cumulative_percent", "_b"))}
    rows = rows.where("_own").select(*keys, end, *[c.alias(n) for n, c in growth.items()], reason.alias("_r"))
    reason = F.coalesce("_r", F.when(F.col("growth_percent").isNull() | F.col("cumulative_percent").isNull(), "OUT_OF_RANGE"))
    return rows.select(*keys, end, *[F.when(reason.isNull(), F.col(n)).alias(n) for n in growth], reason.alias("reason"))


def latest_growth(df: DataFrame, keys: list[str], same: list[str], start: str = "period_start", end: str = "period_end", value: str = "value") -> DataFrame:
    """Growth of the latest period over the one before as an exact ratio (numerator, denominator) and a rounded
    one; the two must touch, agree in ``same`` and have a positive base."""
    w = Window.partitionBy(*keys).orderBy(F.col(end).desc(), F.col(start).desc())
    rows = df.select(*keys, start, end, value, F.row_number().over(w).alias("_rn"), F.lead(value).over(w).alias("_p"), F.lead(end).over(w).alias("_pe"), *[F.lead(c).over(w).eqNullSafe(F.col(c)).alias("_same_" + c) for c in same])
    last = rows.where("_rn = 1")
    reason = F.when(F.col("_pe").isNull(), "NO_PRIOR_PERIOD").when(F.date_add("_pe", 1) != F.col(start), "NOT_CONTIGUOUS")
    for c in same:
        reason = reason.when(~F.col("_same_" + c), f"{c.upper()}_CHANGED")
    reason = reason.when(F.col("_p") <= 0, "BASE_NOT_POSITIVE").when(F.col(value).isNull() | F.col("_p").isNull(), "MISSING_VALUE")
    up = exact.minus(F.col(value), F.col("_p"))
    growth = exact.quotient(up, F.col("_p"), 6)
    reason = reason.when(up.isNull() | growth.isNull(), "OUT_OF_RANGE")
    last = last.select(*keys, end, value, "_p", up.alias("_up"), growth.alias("_g"), reason.alias("reason"))
    ok = F.col("reason").isNull()
    return last.select(*keys, end, F.when(ok, F.col("_up")).alias("numerator"), F.when(ok, F.col("_p")).alias("denominator"), F.when(ok, F.col("_g")).alias("growth"), "reason")


def calculate(df: DataFrame, keys: list[str], op: str, order: str, value: str = "value") -> DataFrame:
    """Difference, percent_change or ratio of the last to the first value in ``order``, or the sum or average of
    all; (value, status) with status OK, ZERO_DENOMINATOR or OUT_OF_RANGE; keys without values have no row."""
    first, last = F.min_by(value, order), F.max_by(value, order)
    got = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(first.alias("_f"), last.alias("_l"), F.try_sum(value).alias("_s"), F.count(value).alias("_n"))
    f, l, s, n = (F.col(c) for c in ("_f", "_l", "_s", "_n"))  # noqa: E741
    made = {
        "difference": exact.minus(l, f),
        "percent_change": exact.quotient(l, f, 6) * 100 - 100,
        "ratio": exact.quotient(l, f, 9),
        "sum": s,
        "average": exact.quotient(s, n.cast(DECIMAL), 9),
    }[op].try_cast("decimal(38,4)")
    zero = F.lit(op in ("percent_change", "ratio")) & (f == 0)
    got = got.select(*keys, made.alias("value"), zero.alias("_zero"))
    status = F.when(F.col("_zero"), "ZERO_DENOMINATOR").when(F.col("value").isNull(), "OUT_OF_RANGE").otherwise("OK")
    return got.select(*keys, F.when(~F.col("_zero"), F.col("value")).alias("value"), status.alias("status"))


def margins(df: DataFrame, keys: list[str], revenue: str, parts: dict[str, str], metric: str = "metric", value: str = "value") -> DataFrame:
    """Per period one column for each named part, as a share of revenue; null without a nonzero revenue."""
    of = lambda m: F.max(F.when(F.col(metric) == m, F.col(value)))
    got = df.groupBy(*keys).agg(of(revenue).alias("_r"), *[of(m).alias("_" + n) for n, m in parts.items()])
    return got.select(*keys, *[F.when(F.col("_r") != 0, exact.quotient(F.col("_" + n), F.col("_r"), 6)).alias(n) for n in parts])


def request_coverage(df: DataFrame, keys: list[str], metrics: list[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """Which of the requested metrics each key has: available, missing (sorted) and AVAILABLE, PARTIAL or
    SOURCE_LIMITED."""
    wanted = F.array(*map(F.lit, metrics))
    got = df.groupBy(*keys).agg(F.collect_set(F.when(F.col(value).isNotNull() & F.col(metric).isin(metrics), F.col(metric))).alias("_h"))
    missing = F.array_sort(F.array_except(wanted, "_h"))
    status = F.when(F.size(missing) == 0, "AVAILABLE").when(F.size("_h") == 0, "SOURCE_LIMITED").otherwise("PARTIAL")
    return got.select(*keys, F.array_sort("_h").alias("available"), missing.alias("missing"), status.alias("status"))
