"""Comparison of two whole reports as a tree: report, source family, company, period, field.

Each level is a table, and a finding belongs to the highest level that explains it: a company that one report lacks has no
findings about its periods and fields, a lost period none about its fields. A company's row carries what its children
need to know (both sides' periods and its identity checks), so that fields meet it by one equality join.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.releases import OVERALL_RANK, REPORT_COLUMNS, USABLE, _lookup, diff_reports

#: Finding code -> severity, beside those of ``releases.SEVERITY``; overall moves have their own rule.
TREE_SEVERITY = {
    "CONTRACT_SCHEMA_MISMATCH": "FAIL", "MODE_MISMATCH": "FAIL", "REPORT_CONTENT_ADDRESS_CHANGED": "INFO", "AS_OF_REGRESSION": "WARNING",
    "TICKER_IDENTITY_COLLISION": "FAIL", "SOURCE_FAMILY_UNRESOLVED": "FAIL", "SOURCE_FAMILY_RECOVERED": "INFO", "MANIFEST_ARTIFACT_SAMPLE_INCOMPLETE": "FAIL",
    "COMPANY_ADDED": "INFO", "COMPANY_DROPPED": "WARNING", "ISSUER_IDENTITY_CHANGED": "FAIL", "ISSUER_IDENTITY_UNRESOLVED": "FAIL",
    "SOURCE_IDENTITY_REGRESSION": "WARNING", "SOURCE_IDENTITY_DIVERGENCE_OBSERVED": "INFO", "PERIOD_OBSERVED_LOST": "WARNING", "PERIOD_OBSERVED_ADDED": "INFO",
    "BLOCKING_ISSUE_ADDED": "FAIL", "BLOCKING_ISSUE_RESOLVED": "INFO", "NEW_PERIOD_FIELD_OBSERVED": "INFO", "FIELD_GAINED": "INFO", "FIELD_LOST": "WARNING", "UNUSABLE_FIELD_REMOVED": "INFO",
    "NON_INDEPENDENT_CORROBORATION": "FAIL", "NON_INDEPENDENT_CORROBORATION_PREEXISTING": "WARNING",
}
#: The states that claim validation, those of a report that stop it, and severities from light to heavy.
VALIDATED, STOPPED, SCALE = ["SOURCE_VALIDATED", "PASS"], ["CONFLICT", "BLOCKED"], ["PASS", "INFO", "WARNING", "FAIL"]
COLUMNS = ["level", "company", "period_end", "field", "subject", "code", "severity", "baseline", "candidate"]


class Report(NamedTuple):
    """The tables of a report.

    report: mode, contract, as_of, digest; one row. families: family, state, sample_complete; one row a family.
    companies: company, cik, overall, blocking (array<string>); one row a company, several if its identity collides.
    checks: company, check, state. fields: company, period_end, field, REPORT_COLUMNS and corroborations (array of
    struct(source, agrees), null where the report keeps no provenance); one row a key.
    """

    report: DataFrame
    families: DataFrame
    companies: DataFrame
    checks: DataFrame
    fields: DataFrame


def _finding(level: str, code: Column, **cols) -> list[Column]:
    none = F.lit(None).cast("string")
    made = {c: cols.get(c, none) for c in COLUMNS if c not in ("level", "code", "severity")}
    severity = cols.get("severity", _lookup(TREE_SEVERITY, F.col("code")))
    values = {"level": F.lit(level), "code": code, "severity": severity, **made}
    return [values[c].cast("string").alias(c) for c in COLUMNS]


def _exploded(df: DataFrame, level: str, cells: list[Column], company: bool = True) -> DataFrame:
    """Findings from an array of struct(code, subject, baseline, candidate, severity), null ones left out."""
    out = df.select(*(["company"] if company else []), F.explode(F.array_compact(cells[0] if len(cells) == 1 else F.concat(*cells))).alias("_x")).select("*", "_x.*")
    more = {"company": F.col("company")} if company else {}
    return out.select(*_finding(level, F.col("code"), subject=F.col("subject"), baseline=F.col("baseline"), candidate=F.col("candidate"), severity=F.coalesce("severity", _lookup(TREE_SEVERITY, F.col("code"))), **more))


def _cell(test: Column, code, subject=None, baseline=None, candidate=None, severity=None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c if isinstance(c, Column) else F.lit(c)).cast("string")
    return F.when(test, F.struct(text(code).alias("code"), text(subject).alias("subject"), text(baseline).alias("baseline"), text(candidate).alias("candidate"), text(severity).alias("severity")))


def _sides(base: DataFrame, cand: DataFrame, key: str) -> DataFrame:
    a = base.select(F.col(key).alias("_k"), F.struct(*[c for c in base.columns if c != key]).alias("a"))
    b = cand.select(F.col(key).alias("_j"), F.struct(*[c for c in cand.columns if c != key]).alias("b"))
    return a.join(b, F.col("_k") == F.col("_j"), "full").select(F.coalesce("_k", "_j").alias(key), "a", "b")


def report_level(base: DataFrame, cand: DataFrame) -> DataFrame:
    one = lambda t: t.agg(*[F.first(c).alias(c) for c in ("mode", "contract", "as_of", "digest")]).withColumn("one", F.lit(1))
    both = _sides(one(base), one(cand), "one")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    cells = [
        _cell(a("contract") != b("contract"), "CONTRACT_SCHEMA_MISMATCH", baseline=a("contract"), candidate=b("contract")), _cell(~a("mode").eqNullSafe(b("mode")), "MODE_MISMATCH", baseline=a("mode"), candidate=b("mode")),
        _cell(a("digest") != b("digest"), "REPORT_CONTENT_ADDRESS_CHANGED"), _cell(b("as_of") < a("as_of"), "AS_OF_REGRESSION", baseline=a("as_of"), candidate=b("as_of")),
    ]
    return _exploded(both, "report", [F.array(*cells)], company=False)


def family_level(base: DataFrame, cand: DataFrame) -> DataFrame:
    both = _sides(base, cand, "family").where("a is not null and b is not null")
    a, b = F.col("a.state"), F.col("b.state")
    ok = lambda c: F.coalesce(c == "resolved", F.lit(False))
    cells = [
        _cell(ok(a) & ~ok(b), "SOURCE_FAMILY_UNRESOLVED", F.col("family"), a, b), _cell(~ok(a) & ok(b), "SOURCE_FAMILY_RECOVERED", F.col("family"), a, b),
        _cell(F.col("a.sample_complete") & ~F.col("b.sample_complete"), "MANIFEST_ARTIFACT_SAMPLE_INCOMPLETE", F.col("family"), F.lit("true"), F.lit("false")),
    ]
    return _exploded(both, "family", [F.array(*cells)], company=False)


def company_tree(base: Report, cand: Report) -> DataFrame:
    """(company, a, b): what each report has of a company: cik, ciks, overall, blocking, periods, distinct and match, the
    last two being whether an identity check names another or the same source object. A company has few periods and
    issues, so its row is small."""

    def side(r: Report) -> DataFrame:
        own = r.companies.groupBy("company").agg(F.min("cik").alias("cik"), F.array_sort(F.collect_set("cik")).alias("ciks"), F.max("overall").alias("overall"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("blocking", F.array().cast("array<string>")))))).alias("blocking"))
        periods = r.fields.groupBy("company").agg(F.array_sort(F.collect_set(F.col("period_end").cast("string"))).alias("periods"))
        seen = r.checks.groupBy("company").agg(F.max(F.col("state") == "DIFFERENT_SOURCE_OBJECT").alias("distinct"), F.max(F.col("state") == "MATCH").alias("match"))
        out = own.join(periods, "company", "left").join(seen, "company", "left")
        return out.withColumns({"periods": F.coalesce("periods", F.array().cast("array<string>")), "distinct": F.coalesce("distinct", F.lit(False)), "match": F.coalesce("match", F.lit(False))})

    return _sides(side(base), side(cand), "company")


def company_level(tree: DataFrame) -> DataFrame:
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    in_a, in_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    both = in_a & in_b
    joined = lambda c: F.array_join(c, ", ")
    lost, added = F.array_except(a("periods"), b("periods")), F.array_except(b("periods"), a("periods"))
    before, after = _lookup(OVERALL_RANK, a("overall"), 2), _lookup(OVERALL_RANK, b("overall"), 2)
    moved = F.when(after < before, "COMPANY_OVERALL_DOWNGRADE").when(after > before, "COMPANY_OVERALL_UPGRADE").otherwise("COMPANY_OVERALL_CHANGED")
    weight = F.when(b("overall").isin(STOPPED), "FAIL").when(after < before, "WARNING").otherwise("INFO")
    cells = [
        _cell(~in_a, "COMPANY_ADDED"), _cell(~in_b, "COMPANY_DROPPED"),
        *[_cell(F.size(s("ciks")) > 1, "TICKER_IDENTITY_COLLISION", subject=n, candidate=joined(s("ciks"))) for s, n in ((a, "baseline"), (b, "candidate"))],
        _cell(both & (a("cik") != b("cik")), "ISSUER_IDENTITY_CHANGED", baseline=a("cik"), candidate=b("cik")), _cell(both & a("cik").isNotNull() & b("cik").isNull(), "ISSUER_IDENTITY_UNRESOLVED", baseline=a("cik")),
        _cell(both & (F.size(lost) > 0), "PERIOD_OBSERVED_LOST", joined(lost), joined(a("periods")), joined(b("periods"))), _cell(both & (F.size(added) > 0), "PERIOD_OBSERVED_ADDED", joined(added), joined(a("periods")), joined(b("periods"))),
        _cell(both & (a("overall") != b("overall")), moved, baseline=a("overall"), candidate=b("overall"), severity=weight),
    ]
    issues = lambda x, y, code: F.transform(F.when(both, F.array_except(x("blocking"), y("blocking"))).otherwise(F.array().cast("array<string>")), lambda i: _cell(F.lit(True), code, i))
    return _exploded(tree, "company", [F.array(*cells), issues(b, a, "BLOCKING_ISSUE_ADDED"), issues(a, b, "BLOCKING_ISSUE_RESOLVED")])


def check_level(base: DataFrame, cand: DataFrame, tree: DataFrame) -> DataFrame:
    now = cand.where(F.col("state") == "DIFFERENT_SOURCE_OBJECT").groupBy("company", "check").agg(F.max("state").alias("new"))
    was = base.groupBy("company", "check").agg(F.max("state").alias("old"))
    both = now.join(was, ["company", "check"], "left").join(tree.where("a is not null and b is not null").select("company"), "company")
    cells = [_cell(F.col("old") == "MATCH", "SOURCE_IDENTITY_REGRESSION", F.col("check"), F.col("old"), F.col("new")), _cell(F.col("old").isNull(), "SOURCE_IDENTITY_DIVERGENCE_OBSERVED", F.col("check"), None, F.col("new"))]
    return _exploded(both, "company", [F.array(*cells)])


def field_level(base: DataFrame, cand: DataFrame, tree: DataFrame, contract: DataFrame | None, as_of) -> DataFrame:
    keys = ["company", "period_end", "field"]
    plain = lambda t: t.select(*keys, *REPORT_COLUMNS)
    found = diff_reports(plain(base), plain(cand), keys, "field", contract, as_of, base_state=True)
    held = tree.where("a is not null and b is not null").select("company", F.col("a.periods").alias("_was"), F.col("b.periods").alias("_is"))
    period = F.col("period_end").cast("string")
    gained = F.when(F.array_contains("_was", period), "FIELD_GAINED").otherwise("NEW_PERIOD_FIELD_OBSERVED")
    lost = F.when(F.array_contains("_is", period), F.when(F.col("base_state").isin(USABLE), "FIELD_LOST").otherwise("UNUSABLE_FIELD_REMOVED"))
    code = F.when(F.col("code") == "FIELD_GAINED", gained).when(F.col("code") == "FIELD_LOST", lost).otherwise(F.col("code"))
    out = found.join(held, "company").withColumn("code", code).where("code is not null")
    severity = F.coalesce(_lookup(TREE_SEVERITY, F.col("code")), F.col("severity"))
    return out.select(*_finding("field", F.col("code"), company=F.col("company"), period_end=period, field=F.col("field"), baseline=F.col("base_value"), candidate=F.col("candidate_value"), severity=severity))


def corroboration_level(base: DataFrame, cand: DataFrame, tree: DataFrame) -> DataFrame:
    """Fields that claim validation on evidence that isn't independent: no corroboration, none that agrees, or only
    such as read the same stored object. New claims fail, those carried over are warnings; where nothing tells whether
    evidence is independent there is no finding."""
    keys = ["company", "period_end", "field"]
    seen = tree.where("a is not null and b is not null").select("company", F.col("b.distinct").alias("_distinct"), F.col("b.match").alias("_match"))
    claimed = cand.where(F.col("state").isin(VALIDATED) & F.col("corroborations").isNotNull()).select(*keys, F.col("state").alias("_new"), F.coalesce(F.exists("corroborations", lambda c: F.coalesce(c["agrees"], F.lit(False))), F.lit(False)).alias("_agrees"))
    weak = claimed.join(seen, "company").where(~F.col("_agrees") | ~F.col("_distinct") & F.col("_match"))
    was = base.select(*keys, F.col("state").alias("_old"))
    both = weak.join(was, keys)
    code = F.when(F.coalesce(F.col("_old").isin(VALIDATED), F.lit(False)), "NON_INDEPENDENT_CORROBORATION_PREEXISTING").otherwise("NON_INDEPENDENT_CORROBORATION")
    both = both.withColumn("code", code)
    return both.select(*_finding("field", F.col("code"), company=F.col("company"), period_end=F.col("period_end"), field=F.col("field"), baseline=F.col("_old"), candidate=F.col("_new")))


def compare_reports(base: Report, cand: Report, contract: DataFrame | None = None, as_of=None) -> DataFrame:
    """Every finding about two reports, of whatever level (columns: COLUMNS). ``contract`` and ``as_of`` as in
    ``diff_reports``. Equal reports have none."""
    tree = company_tree(base, cand)
    levels = [
        report_level(base.report, cand.report), family_level(base.families, cand.families), company_level(tree), check_level(base.checks, cand.checks, tree),
        field_level(base.fields, cand.fields, tree, contract, as_of), corroboration_level(base.fields, cand.fields, tree),
    ]
    return reduce(lambda x, y: x.unionByName(y), levels)


def outcome(findings: DataFrame) -> DataFrame:
    """One row: the heaviest severity, PASS without findings, and the number of findings of each."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SCALE)), F.col("severity")), F.lit(1))
    counts = [F.count(F.when(F.col("severity") == s, 1)).alias(s.lower()) for s in SCALE[1:]]
    return findings.agg(F.element_at(F.array(*map(F.lit, SCALE)), F.coalesce(F.max(rank), F.lit(1)).cast("int")).alias("outcome"), *counts)
