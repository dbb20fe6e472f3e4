"""One query for each operator over the driver's tables, with the SQL that gives the same rows.

Dates and decimals are returned as text, so that both engines print them alike. Every query reads whole tables.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import functions as F

from tidemark.functions import temporal, values
from tidemark.operators import claims, comparison, derive, joins, pit, quality, releases, screen, series
from tidemark.plans import views as V
from tidemark.sources import documents, ingest, sinks
from tidemark.streaming import upkeep

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = "1998-06-30"
CONTEXT = ["cik", "metric", "concept", "period_end"]


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``views`` are the SQL definitions its statement starts with."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = (f"WITH {', '.join(views)} " if views else "") + sql
        return f

    return put


def text(df, *cols):
    """Named columns as text: dates, decimals and instants."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def cut():
    return F.lit(AS_OF).cast("timestamp")


_AVAILABLE = f"available_at <= TIMESTAMP '{AS_OF}'"


# Revision selection


@query("pit_latest_revision", f"""SELECT s_suppkey, s_name, metric, concept, period_end::VARCHAR AS period_end, value::VARCHAR AS value, accession, strftime(available_at, '%Y-%m-%d %H:%M:%S') AS available_at,
  CASE WHEN cik IS NULL THEN 'NO_ELIGIBLE_RECORD' ELSE 'PRESENT' END AS record_status,
  CASE WHEN cik IS NULL THEN 'NOT_APPLICABLE' WHEN value IS NULL THEN 'NULL_IN_SOURCE' ELSE 'PRESENT' END AS value_status
FROM supplier LEFT JOIN (SELECT * FROM obs WHERE {_AVAILABLE}
  QUALIFY row_number() OVER (PARTITION BY cik, metric, concept, period_end ORDER BY available_at DESC, accession DESC, id DESC) = 1) ON lpad(s_suppkey::VARCHAR, 10, '0') = cik""", (V.OBS,))  # fmt: skip
def pit_latest_revision(spark, sf_dir):
    facts = pit.latest_revision(V.observations(spark, sf_dir), CONTEXT, ["available_at", "accession", "id"], cut())
    anchor = V.table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"]).withColumn("cik", values.pad_id(F.col("s_suppkey")))
    out = joins.left_with_coverage(anchor, facts, "cik").withColumn("available_at", ts("available_at"))
    return text(out, "period_end", "value").select("s_suppkey", "s_name", "metric", "concept", "period_end", "value", "accession", "available_at", "record_status", "value_status")


_LAST = f"""last AS (SELECT cik, metric, concept, period_end, max(available_at) AS last_at FROM obs WHERE {_AVAILABLE} GROUP BY ALL),
sel AS (SELECT cik, metric, concept, period_end, min(available_at) AS available_at, arg_min(value, id) AS value, min(id) AS id, list_sort(list(DISTINCT id)) AS ids, count(DISTINCT value) AS n
  FROM obs JOIN last USING (cik, metric, concept, period_end) WHERE available_at = last_at GROUP BY ALL)"""


def _strict(spark, sf_dir):
    return pit.select_or_conflict(V.observations(spark, sf_dir), CONTEXT, cut())


@query("pit_select_or_conflict", "SELECT cik, metric, concept, period_end::VARCHAR AS period_end, value::VARCHAR AS value, array_to_string(ids, ',') AS source_ids FROM sel WHERE n = 1", (V.OBS, _LAST))
def pit_select(spark, sf_dir):
    out = _strict(spark, sf_dir)[0].withColumn("source_ids", F.array_join("source_ids", ","))
    return text(out, "period_end", "value").select(*CONTEXT, "value", "source_ids")


@query("pit_conflict_gaps", "SELECT cik, metric, concept, period_end::VARCHAR AS period_end, 'CONFLICTING_SOURCE_VALUES' AS reason FROM sel WHERE n > 1", (V.OBS, _LAST))
def pit_conflicts(spark, sf_dir):
    return text(_strict(spark, sf_dir)[1], "period_end").select(*CONTEXT, "reason")


_BAD = f"bad AS (SELECT cik, metric, concept, period_end, max(available_at) AS last_at FROM obs WHERE period_end > filed AND {_AVAILABLE} GROUP BY ALL)"
_GOOD = f"good AS (SELECT cik, metric, concept, period_end, max(available_at) AS last_at FROM obs WHERE period_end <= filed AND {_AVAILABLE} GROUP BY ALL)"


@query("pit_blocked_by_rejected", """SELECT g.cik, metric, concept, g.period_end::VARCHAR AS period_end, CASE WHEN b.last_at >= g.last_at THEN 'BLOCKED_BY_NEWER_INVALID' END AS reason
FROM good g LEFT JOIN bad b USING (cik, metric, concept)""", (V.OBS, _BAD.replace("cik, metric, concept, period_end", "cik, metric, concept"), _GOOD))  # fmt: skip
def pit_blocked(spark, sf_dir):
    keys = ["cik", "metric", "concept"]
    rows = pit.available_as_of(V.observations(spark, sf_dir), cut())
    good = rows.where("period_end <= filed").groupBy(*CONTEXT).agg(F.max("available_at").alias("available_at"))
    bad = rows.where("period_end > filed")
    kept, _ = pit.block_by_rejected(good, bad, keys)
    void = good.join(kept.select(*CONTEXT), CONTEXT, "left_anti").withColumn("reason", F.lit("BLOCKED_BY_NEWER_INVALID"))
    return text(kept.withColumn("reason", F.lit(None).cast("string")).unionByName(void).select(*CONTEXT, "reason"), "period_end")


@query("pit_ambiguity", """SELECT cik, metric, period_end::VARCHAR AS period_end, strftime(available_at, '%Y-%m-%d %H:%M:%S') AS available_at, 'AMBIGUOUS_REVISION' AS reason
FROM obs GROUP BY cik, metric, period_end, available_at HAVING count(DISTINCT (value, unit, concept)) > 1""", (V.OBS,))  # fmt: skip
def pit_ambiguity(spark, sf_dir):
    out = pit.ambiguity(V.observations(spark, sf_dir), ["cik", "metric", "period_end"], ["value", "unit", "concept"]).withColumn("available_at", ts("available_at"))
    return text(out, "period_end")


@query("pit_pick_by_priority", """SELECT cik, metric, period_end::VARCHAR AS period_end, arg_max(concept, (CASE concept WHEN 'O' THEN -1 ELSE -2 END, filed, accession, id)) AS concept,
  arg_max(id, (CASE concept WHEN 'O' THEN -1 ELSE -2 END, filed, accession, id)) AS id, CASE WHEN count(DISTINCT concept) > 1 THEN 'F' ELSE '' END AS superseded FROM obs GROUP BY cik, metric, period_end""", (V.OBS,))  # fmt: skip
def pit_priority(spark, sf_dir):
    rows = V.observations(spark, sf_dir).withColumns({"p": F.when(F.col("concept") == "O", 1).otherwise(2), "acc": F.struct("accession", "id")}).select("cik", "metric", "period_end", "concept", "p", "filed", "acc")
    out = pit.pick_by_priority(rows, ["cik", "metric", "period_end"], "p", "filed", "acc").withColumn("superseded", F.array_join("superseded", ","))
    return text(out, "period_end").select("cik", "metric", "period_end", "concept", "acc.id", "superseded")


@query("pit_merge_concepts", """SELECT cik, metric, period_end::VARCHAR AS period_end, CASE WHEN count(DISTINCT value) > 1 THEN 'AMBIGUOUS_CONCEPTS' END AS reason, CASE WHEN count(DISTINCT value) <= 1 THEN min(value)::VARCHAR END AS value
FROM sel WHERE n = 1 GROUP BY ALL""", (V.OBS, _LAST))  # fmt: skip
def pit_merge(spark, sf_dir):
    rows = _strict(spark, sf_dir)[0].withColumn("p", F.when(F.col("concept") == "O", 1).otherwise(2))
    merged, gaps = pit.merge_concepts(rows, ["cik", "metric", "period_end"], "p")
    keys = ["cik", "metric", "period_end"]
    out = merged.select(*keys, F.lit(None).cast("string").alias("reason"), "value").unionByName(gaps.select(*keys, "reason", F.lit(None).cast("decimal(38,9)").alias("value")))
    return text(out, "period_end", "value")


@query("pit_void_overlaps", """SELECT cik, metric, count(*) AS kept, sum(value)::VARCHAR AS total FROM (
  SELECT *, count(DISTINCT period_start) OVER (PARTITION BY cik, metric, period_end) AS n FROM (SELECT cik, metric, period_start, period_end, value FROM flows UNION ALL SELECT cik, metric, period_start, period_end, value FROM ytd WHERE period_start <> date_trunc('quarter', period_end)))
WHERE n = 1 GROUP BY ALL""", (V.FLOWS, V.CUMULATIVE))  # fmt: skip
def pit_overlaps(spark, sf_dir):
    cols = ["cik", "metric", "period_start", "period_end", "value"]
    both = V.flows(spark, sf_dir).select(*cols).unionByName(V.cumulative(spark, sf_dir).where("period_start <> date_trunc('quarter', period_end)").select(*cols))
    rows = both.withColumn("source_ids", F.array(F.concat_ws(":", "cik", "metric", "period_start", "period_end")))
    kept, _ = pit.void_overlaps(rows, ["cik", "metric"])
    return text(kept.groupBy("cik", "metric").agg(F.count("*").alias("kept"), F.sum("value").alias("total")), "total")


@query("pit_revisions", """SELECT id, cik, metric, concept, period_end::VARCHAR AS period_end, row_number() OVER (PARTITION BY cik, metric, concept, period_end ORDER BY available_at, id) AS revision FROM obs""", (V.OBS,))
def pit_revisions(spark, sf_dir):
    out = pit.revisions(V.observations(spark, sf_dir), CONTEXT)
    return text(out, "period_end").select("id", *CONTEXT, F.col("revision").cast("long").alias("revision"))


@query("pit_dated_observations", f"""SELECT cik, concept, id, row_number() OVER (PARTITION BY cik, concept ORDER BY period_end DESC, filed DESC, accession DESC, id DESC) AS rank FROM obs
WHERE period_end <= DATE '{AS_OF}' AND filed <= DATE '{AS_OF}' QUALIFY rank <= 12""", (V.OBS,))  # fmt: skip
def pit_dated(spark, sf_dir):
    rows = V.observations(spark, sf_dir).withColumn("acc", F.struct("accession", "id"))
    out = pit.dated_observations(rows, ["cik", "concept"], F.lit(AS_OF).cast("date"), 12, accession="acc")
    return out.select("cik", "concept", "id", F.col("rank").cast("long").alias("rank"))


@query("pit_select_release", f"""SELECT o_orderpriority AS dataset_id, (arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderdate <= TIMESTAMP '1995-01-01'))::VARCHAR AS release_id,
  CASE WHEN count(*) FILTER (o_orderdate <= TIMESTAMP '1995-01-01') = 0 THEN 'NO_RELEASE_AS_OF' ELSE 'SELECTED' END AS status FROM orders GROUP BY ALL""")  # fmt: skip
def pit_release(spark, sf_dir):
    rel = V.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderkey").alias("release_id"), F.col("o_orderdate").alias("published_at"))
    return pit.select_release(rel, "dataset_id", F.lit("1995-01-01").cast("timestamp")).select("dataset_id", F.col("release_id").cast("string").alias("release_id"), "status")


@query("pit_leakage", f"""SELECT form, count(*) AS rows FROM obs WHERE available_at > TIMESTAMP '{AS_OF}' GROUP BY ALL""", (V.OBS,))
def pit_leakage(spark, sf_dir):
    return pit.leakage(V.observations(spark, sf_dir), cut()).groupBy("form").agg(F.count("*").alias("rows"))


@query("pit_long_quarters", """SELECT c1.cik, c1.metric, c1.period_start::VARCHAR AS q_start, c1.period_end::VARCHAR AS q_end, strftime(greatest(c1.a, c2.a, c3.a, c4.a), '%Y-%m-%d %H:%M:%S') AS evidence_at
FROM m c1 JOIN m c2 USING (cik, metric, period_start) JOIN m c3 USING (cik, metric, period_start) JOIN m c4 USING (cik, metric, period_start)
WHERE month(c1.period_end) = 4 AND month(c2.period_end) = 6 AND month(c3.period_end) = 9 AND month(c4.period_end) = 12 AND c1.cik::BIGINT % 4 < 3""", (V.FLOWS, V.CUMULATIVE, """m AS (SELECT cik, metric, period_start,
  CASE WHEN month(period_end) = 3 THEN period_end + 16 ELSE period_end END AS period_end, ((period_end + 1)::TIMESTAMP AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS a FROM ytd)"""))  # fmt: skip
def pit_long_quarters(spark, sf_dir):
    ytd = V.cumulative(spark, sf_dir).withColumn("available_at", temporal.available_at(F.col("period_end")))
    moved = ytd.withColumn("period_end", F.when(F.month("period_end") == 3, F.date_add("period_end", 16)).otherwise(F.col("period_end")))
    kind = F.element_at(F.array(*map(F.lit, ("10-K", "10-K/A", "10-K", "10-Q"))), (F.col("cik").cast("long") % 4 + 1).cast("int"))  # a year of a 10-Q is no evidence
    moved = moved.withColumn("form", F.when(F.month("period_end") == 12, kind).otherwise("10-Q"))
    return text(pit.infer_long_quarters(moved, ["cik", "metric"]).withColumn("evidence_at", ts("evidence_at")), "q_start", "q_end")


@query("pit_fiscal_period", """SELECT id, CASE WHEN m IS NULL THEN NULL WHEN fp = 'FY' THEN 'FY' || y::VARCHAR ELSE 'Q' || (CASE WHEN a = 0 THEN 4 ELSE (a + 2) // 3 END)::VARCHAR || ' ' || y::VARCHAR END AS label
FROM (SELECT id, fp, m, ((month(period_end) - m + 12) % 12)::INT AS a, year(period_end) + CASE WHEN month(period_end) > m THEN 1 ELSE 0 END AS y
  FROM (SELECT *, CASE form WHEN '10-K' THEN 'FY' ELSE 'Q' END AS fp FROM obs) LEFT JOIN
    (SELECT cik, arg_max(m, (n, -m)) AS m FROM (SELECT cik, month(period_end) AS m, count(*) AS n FROM obs WHERE form = '10-K' GROUP BY ALL) GROUP BY cik) USING (cik))""", (V.OBS,))  # fmt: skip
def pit_fiscal(spark, sf_dir):
    rows = V.observations(spark, sf_dir).withColumn("fp", F.when(F.col("form") == "10-K", "FY").otherwise("Q"))
    return pit.match_fiscal_period(rows, "cik").select("id", "label")


@query("strict_admission", """SELECT cik, CASE WHEN value IS NULL THEN 'MISSING_VALUE' WHEN unit <> 'USD' THEN 'UNSUPPORTED_UNIT' WHEN form NOT IN ('10-K', '10-Q') THEN 'UNSUPPORTED_FORM' WHEN period_end > filed THEN 'END_AFTER_FILING' ELSE 'ACCEPTED' END AS reason, count(*) AS n
FROM obs GROUP BY ALL""", (V.OBS,))  # fmt: skip
def strict_admission(spark, sf_dir):
    good, bad = ingest.admit(V.observations(spark, sf_dir).withColumn("val", F.col("value")), ["USD"], ["10-K", "10-Q"], start="period_start", end="period_end")
    return ingest.rejection_counts(bad, "cik").unionByName(good.groupBy("cik").agg(F.count("*").alias("n")).withColumn("reason", F.lit("ACCEPTED")))


# Derivations


@query("derive_linear_combine", """SELECT cik, metric, sum(c * v)::VARCHAR AS value, count(*) FILTER (c <> 0) AS terms FROM (
  SELECT cik, metric, id, sum(CASE form WHEN '10-K' THEN 1 WHEN '10-Q' THEN -1 ELSE 0 END)::INT AS c, min(value)::DECIMAL(20,9) AS v FROM obs GROUP BY ALL) GROUP BY ALL HAVING count(*) FILTER (c <> 0) > 0""", (V.OBS,))  # fmt: skip
def derive_linear(spark, sf_dir):
    c = F.when(F.col("form") == "10-K", 1).when(F.col("form") == "10-Q", -1).otherwise(0)
    terms = V.observations(spark, sf_dir).withColumns({"coefficient": c, "r": F.concat_ws("|", "cik", "metric")})
    out = derive.linear_combine(terms, "r").where("size(terms) > 0")
    return text(out.select(F.split("r", "[|]")[0].alias("cik"), F.split("r", "[|]")[1].alias("metric"), "value", F.size("terms").cast("long").alias("terms")), "value")


@query("derive_decumulate", """SELECT cik, metric, (CASE WHEN p IS NULL THEN period_start ELSE p + 1 END)::DATE::VARCHAR AS period_start, period_end::VARCHAR AS period_end,
  (value - coalesce(v, 0))::DECIMAL(28,9)::VARCHAR AS value FROM (
  SELECT y.*, x.period_end AS p, x.value AS v FROM ytd y LEFT JOIN ytd x ON y.cik = x.cik AND y.metric = x.metric AND y.period_start = x.period_start AND y.period_end - x.period_end BETWEEN 75 AND 105)
WHERE (p IS NOT NULL AND period_end - period_start >= 149) OR (period_end - period_start + 1 BETWEEN 75 AND 105)""", (V.FLOWS, V.CUMULATIVE.replace("::DECIMAL(38,9) AS value", "::DECIMAL(28,9) AS value")))  # fmt: skip
def derive_decumulate(spark, sf_dir):
    quarters, _ = derive.decumulate(V.cumulative(spark, sf_dir), ["cik", "metric"])
    return text(quarters.drop("derived"), "period_start", "period_end", "value")


@query("derive_decumulate_gaps", """SELECT cik, metric, period_end::VARCHAR AS period_end, 'NO_PREDECESSOR' AS reason FROM ytd y WHERE period_end - period_start >= 149
  AND NOT EXISTS (FROM ytd x WHERE y.cik = x.cik AND y.metric = x.metric AND y.period_start = x.period_start AND y.period_end - x.period_end BETWEEN 75 AND 105)""", (V.FLOWS, V.CUMULATIVE))  # fmt: skip
def derive_decumulate_gaps(spark, sf_dir):
    _, gaps = derive.decumulate(V.cumulative(spark, sf_dir), ["cik", "metric"])
    return text(gaps.select("cik", "metric", "period_end", "reason"), "period_end")


_TTM = """t AS (SELECT cik, metric, period_end, first_value(period_start) OVER w AS s, count(*) OVER w AS n, sum(value) OVER w AS v,
  (lag(period_end) OVER o + 1 = period_start) AS a, lag(period_end, 1) OVER o AS p1, lag(period_start, 1) OVER o AS s1, lag(period_end, 2) OVER o AS p2, lag(period_start, 2) OVER o AS s2, lag(period_end, 3) OVER o AS p3, period_start AS s0
  FROM flows WINDOW o AS (PARTITION BY cik, metric ORDER BY period_end), w AS (PARTITION BY cik, metric ORDER BY period_end ROWS 3 PRECEDING))"""


@query("derive_ttm", """SELECT cik, metric, s::VARCHAR AS period_start, period_end::VARCHAR AS period_end, v::VARCHAR AS value FROM t WHERE n = 4 AND p1 + 1 = s0 AND p2 + 1 = s1 AND p3 + 1 = s2""", (V.FLOWS, _TTM))
def derive_ttm(spark, sf_dir):
    sums, _ = derive.ttm(V.flows(spark, sf_dir), ["cik", "metric"])
    return text(sums, "period_start", "period_end", "value")


@query("derive_ttm_gaps", """SELECT cik, metric, period_end::VARCHAR AS period_end, 'NOT_FOUR_CONTIGUOUS_QUARTERS' AS reason FROM t WHERE NOT coalesce(n = 4 AND p1 + 1 = s0 AND p2 + 1 = s1 AND p3 + 1 = s2, false)""", (V.FLOWS, _TTM))
def derive_ttm_gaps(spark, sf_dir):
    return text(derive.ttm(V.flows(spark, sf_dir), ["cik", "metric"])[1], "period_end")


@query("derive_sum_components", """SELECT cik, period_end::VARCHAR AS period_end, CASE WHEN count(DISTINCT metric) = 3 THEN sum(value)::VARCHAR END AS value, CASE WHEN count(DISTINCT metric) < 3 THEN 'MISSING_COMPONENT' END AS reason FROM flows GROUP BY cik, period_end""", (V.FLOWS,))
def derive_components(spark, sf_dir):
    return text(derive.sum_components(V.flows(spark, sf_dir), ["cik", "period_end"], ["A", "N", "R"], part="metric"), "period_end", "value")


@query("derive_difference", """SELECT cik, period_end::VARCHAR AS period_end, CASE WHEN a = 1 AND b = 1 THEN v::VARCHAR END AS value, CASE WHEN a = 1 AND b = 1 THEN NULL ELSE 'MISSING_INPUT' END AS reason FROM (
  SELECT cik, period_end, sum(CASE metric WHEN 'A' THEN value ELSE -value END) AS v, count(*) FILTER (metric = 'A') AS a, count(*) FILTER (metric = 'R') AS b FROM flows WHERE metric IN ('A', 'R') GROUP BY ALL)""", (V.FLOWS,))  # fmt: skip
def derive_difference(spark, sf_dir):
    return text(derive.difference(V.flows(spark, sf_dir), ["cik", "period_end"], "A", "R"), "period_end", "value")


_FORMULA_METRICS = {"A": "net_income", "N": "revenue", "R": "operating_income"}


@query("derive_formulas", """SELECT cik, period_end::VARCHAR AS period_end, formula, reason, n::VARCHAR AS numerator, d::VARCHAR AS denominator, 1000000000::HUGEINT % d = 0 AS terminates,
  CASE WHEN n < 0 THEN '-' ELSE '' END || (v // 1000000000)::VARCHAR || '.' || lpad((v % 1000000000)::VARCHAR, 9, '0') AS value FROM (
  SELECT *, (2000000000 * abs(n) + d) // (2 * d) AS v FROM (SELECT *, CASE WHEN reason IS NULL THEN num // gcd(num, den) END AS n, CASE WHEN reason IS NULL THEN den // gcd(num, den) END AS d FROM (
  SELECT *, CASE formula WHEN 'revenue_growth' THEN rev - prior WHEN 'operating_margin' THEN op ELSE net END AS num, CASE formula WHEN 'revenue_growth' THEN prior ELSE rev END AS den,
    CASE formula WHEN 'revenue_growth' THEN CASE WHEN rev IS NULL THEN 'MISSING_COMPONENT:revenue' WHEN prior IS NULL THEN 'MISSING_COMPONENT:prior_revenue' END
      WHEN 'operating_margin' THEN CASE WHEN op IS NULL THEN 'MISSING_COMPONENT:operating_income' WHEN rev IS NULL THEN 'MISSING_COMPONENT:revenue' END
      ELSE CASE WHEN net IS NULL THEN 'MISSING_COMPONENT:net_income' WHEN rev IS NULL THEN 'MISSING_COMPONENT:revenue' END END AS reason
  FROM (SELECT *, unnest(['revenue_growth', 'operating_margin', 'net_margin']) AS formula FROM (
    SELECT cik, period_end, max(value) FILTER (metric = 'N') AS rev, max(value) FILTER (metric = 'R') AS op, max(value) FILTER (metric = 'A') AS net, max(value) FILTER (metric = 'P') AS prior
    FROM (SELECT cik, metric, period_end, replace(value::VARCHAR, '.', '')::HUGEINT AS value FROM flows UNION ALL SELECT cik, 'P', last_day(period_end + INTERVAL 1 YEAR)::DATE, replace(value::VARCHAR, '.', '')::HUGEINT FROM flows WHERE metric = 'N') GROUP BY ALL)))))""", (V.FLOWS,))  # fmt: skip
def derive_formulas(spark, sf_dir):
    """Quarterly flows as revenue, operating and net income, and the revenue of the same quarter a year before."""
    names = F.create_map(*[F.lit(x) for kv in _FORMULA_METRICS.items() for x in kv])
    flows = V.flows(spark, sf_dir)
    rows = flows.withColumns({"metric": names[F.col("metric")], "at": F.col("period_end")})
    prior = flows.where("metric = 'N'").withColumns({"metric": F.lit("prior_revenue"), "at": F.last_day(F.add_months("period_end", 12))})
    rows = rows.unionByName(prior).withColumns({"unit": F.lit("USD"), "currency": F.lit("USD"), "frequency": F.lit("quarterly"), "available_at": F.col("period_end").cast("timestamp"), "source_ids": F.array(F.concat_ws(":", "metric", "period_end"))})
    out = derive.formulas(rows.withColumnRenamed("at", "period"), ["cik", "period"], ["revenue_growth", "operating_margin", "net_margin"], F.lit("2030-01-01").cast("timestamp"))
    out = out.select("cik", F.col("period").alias("period_end"), "formula", "numerator", "denominator", "terminates", "value", "reason")
    return text(out, "period_end", "numerator", "denominator", "value")


@query("derive_annual_growth", """SELECT cik, metric, period_end::VARCHAR AS period_end, reason, CASE WHEN reason IS NULL THEN round((v0::DOUBLE / v1::DOUBLE - 1) * 100, 4) END AS growth_percent, CASE WHEN reason IS NULL THEN round((v0::DOUBLE / v3::DOUBLE - 1) * 100, 4) END AS cumulative_percent
FROM (SELECT *, CASE WHEN n < 4 THEN 'CHAIN_TOO_SHORT' WHEN NOT (p1 + 1 = s0 AND p2 + 1 = s1 AND p3 + 1 = s2) THEN 'NOT_CONTIGUOUS' END AS reason FROM t)""", (V.FLOWS, _TTM.replace("SELECT cik, metric,", "SELECT cik, metric, value AS v0, lag(value, 1) OVER o AS v1, lag(value, 3) OVER o AS v3,", 1)))  # fmt: skip
def derive_growth(spark, sf_dir):
    out = derive.annual_growth(V.flows(spark, sf_dir), ["cik", "metric"], 3)
    return text(out.withColumns({c: F.col(c).cast("double") for c in ("growth_percent", "cumulative_percent")}), "period_end")


@query("derive_latest_growth", """SELECT cik, metric, period_end::VARCHAR AS period_end, CASE WHEN pe IS NULL THEN 'NO_PRIOR_PERIOD' WHEN pe + 1 <> period_start THEN 'NOT_CONTIGUOUS' END AS reason,
  CASE WHEN pe + 1 = period_start THEN (value::DECIMAL(28,9) - p::DECIMAL(28,9))::DECIMAL(38,9)::VARCHAR END AS numerator, CASE WHEN pe + 1 = period_start THEN p::VARCHAR END AS denominator,
  CASE WHEN pe + 1 = period_start THEN round((value::DOUBLE - p::DOUBLE) / p::DOUBLE, 6) END AS growth FROM (
  SELECT *, lag(value) OVER w AS p, lag(period_end) OVER w AS pe FROM flows WINDOW w AS (PARTITION BY cik, metric ORDER BY period_end) QUALIFY row_number() OVER (PARTITION BY cik, metric ORDER BY period_end DESC) = 1)""", (V.FLOWS,))  # fmt: skip
def derive_latest(spark, sf_dir):
    out = derive.latest_growth(V.flows(spark, sf_dir), ["cik", "metric"], ["concept"])
    return text(out.withColumn("growth", F.col("growth").cast("double")), "period_end", "numerator", "denominator")


@query("derive_calculate", """SELECT cik, metric, op, CASE op WHEN 'difference' THEN l - f WHEN 'sum' THEN t WHEN 'average' THEN round(t::DOUBLE / n, 4) WHEN 'ratio' THEN round(l::DOUBLE / f::DOUBLE, 4) ELSE round(round(l::DOUBLE / f::DOUBLE, 6) * 100 - 100, 4) END::DOUBLE AS value, 'OK' AS status FROM (
  SELECT *, unnest(['difference', 'percent_change', 'ratio', 'sum', 'average']) AS op FROM (SELECT cik, metric, arg_max(value, period_end)::DOUBLE AS l, arg_min(value, period_end)::DOUBLE AS f, sum(value)::DOUBLE AS t, count(*) AS n FROM flows GROUP BY ALL))""", (V.FLOWS,))  # fmt: skip
def derive_calculate(spark, sf_dir):
    flows = V.flows(spark, sf_dir)
    each = [derive.calculate(flows, ["cik", "metric"], op, "period_end").withColumn("op", F.lit(op)) for op in ("difference", "percent_change", "ratio", "sum", "average")]
    return reduce(lambda a, b: a.unionByName(b), each).withColumn("value", F.col("value").cast("double"))


@query("derive_margins", """SELECT cik, period_end::VARCHAR AS period_end, CASE WHEN n <> 0 THEN round(r::DOUBLE / n::DOUBLE, 6) END AS gross, CASE WHEN n <> 0 THEN round(a::DOUBLE / n::DOUBLE, 6) END AS operating FROM (
  SELECT cik, period_end, max(value) FILTER (metric = 'N') AS n, max(value) FILTER (metric = 'R') AS r, max(value) FILTER (metric = 'A') AS a FROM flows GROUP BY ALL)""", (V.FLOWS,))  # fmt: skip
def derive_margins(spark, sf_dir):
    out = derive.margins(V.flows(spark, sf_dir), ["cik", "period_end"], "N", {"gross": "R", "operating": "A"})
    return text(out.withColumns({c: F.col(c).cast("double") for c in ("gross", "operating")}), "period_end")


@query("derive_request_coverage", """SELECT cik, period_end::VARCHAR AS period_end, array_to_string([x FOR x IN ['A', 'R'] IF list_contains(h, x)], ',') AS available, array_to_string([x FOR x IN ['A', 'R'] IF NOT list_contains(h, x)], ',') AS missing,
  CASE WHEN list_has_all(h, ['A', 'R']) THEN 'AVAILABLE' WHEN list_has_any(h, ['A', 'R']) THEN 'PARTIAL' ELSE 'SOURCE_LIMITED' END AS status FROM (SELECT cik, period_end, list(DISTINCT metric) AS h FROM flows GROUP BY cik, period_end)""", (V.FLOWS,))  # fmt: skip
def derive_coverage(spark, sf_dir):
    out = derive.request_coverage(V.flows(spark, sf_dir), ["cik", "period_end"], ["A", "R"])
    return text(out.withColumns({c: F.array_join(c, ",") for c in ("available", "missing")}), "period_end")


# Joins


@query("join_counts", "SELECT cik, count(*) AS n FROM obs WHERE cik IN (SELECT lpad(s_suppkey::VARCHAR, 10, '0') FROM supplier) GROUP BY cik", (V.OBS,))
def join_counts(spark, sf_dir):
    anchor = V.table(spark, sf_dir, "supplier", ["s_suppkey"]).select(values.pad_id(F.col("s_suppkey")).alias("cik"))
    return joins.joined_counts(anchor, V.observations(spark, sf_dir), "cik")


@query("join_interval", """SELECT security, day::VARCHAR AS day, points, CASE WHEN n = 1 THEN l END AS symbol, CASE n WHEN 0 THEN 'NONE' WHEN 1 THEN 'FOUND' ELSE 'AMBIGUOUS' END AS status FROM (
  SELECT p.security, p.day, p.points, count(DISTINCT symbol) AS n, min(symbol) AS l FROM (SELECT user_id AS security, (ts::DATE - 9500)::DATE AS day, count(*) AS points FROM events GROUP BY ALL) p
  LEFT JOIN intervals i ON p.security = i.security AND p.day >= valid_from AND (valid_to IS NULL OR p.day <= valid_to) GROUP BY ALL)""", (V.INTERVALS,))  # fmt: skip
def join_interval(spark, sf_dir):
    points = V.table(spark, sf_dir, "events", ["user_id", "ts"]).select(F.col("user_id").alias("security"), F.date_sub(F.col("ts").cast("date"), 9500).alias("day"))
    return text(joins.interval_join(points, V.intervals(spark, sf_dir), "security", "day", "valid_from", "valid_to", "symbol"), "day")


@query("join_resolve_symbol", f"""SELECT symbol, CASE WHEN n = 1 THEN e::VARCHAR END AS security, CASE n WHEN 0 THEN 'NONE' WHEN 1 THEN 'FOUND' ELSE 'AMBIGUOUS' END AS status FROM (
  SELECT symbol, count(DISTINCT security) FILTER (valid_from <= DATE '1995-01-02' AND (valid_to IS NULL OR valid_to >= DATE '1995-01-02')) AS n, min(security) FILTER (valid_from <= DATE '1995-01-02' AND (valid_to IS NULL OR valid_to >= DATE '1995-01-02')) AS e FROM intervals GROUP BY symbol)""", (V.INTERVALS,))  # fmt: skip
def join_resolve(spark, sf_dir):
    return text(joins.resolve(V.intervals(spark, sf_dir), "symbol", "security", F.lit("1995-01-02").cast("date")), "security")


@query("join_bitemporal", """SELECT o_orderkey AS request, CASE WHEN n = 1 THEN e END AS entity_id, CASE n WHEN 0 THEN 'NONE' WHEN 1 THEN 'FOUND' ELSE 'AMBIGUOUS' END AS status FROM (
  SELECT o_orderkey, count(DISTINCT symbol) AS n, min(symbol) AS e FROM orders LEFT JOIN (SELECT *, valid_from + 30 AS known FROM intervals) i
    ON o_custkey = security AND valid_from <= o_orderdate::DATE AND valid_to IS NOT NULL AND o_orderdate::DATE < valid_to AND known <= o_orderdate::DATE + 60 GROUP BY ALL)""", (V.INTERVALS,))  # fmt: skip
def join_bitemporal(spark, sf_dir):
    links = V.intervals(spark, sf_dir).select(F.lit("cust").alias("namespace"), F.col("security").alias("identifier"), F.col("symbol").alias("entity_id"), "valid_from", "valid_to", F.lit("known").alias("valid_to_kind"), F.date_add("valid_from", 30).alias("known_at"))
    day = F.col("o_orderdate").cast("date")
    asked = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.lit("cust").alias("namespace"), F.col("o_custkey").alias("identifier"), day.alias("on"), F.date_add(day, 60).alias("as_of"))
    return joins.resolve_bitemporal(links, asked, "request").drop("entities")


@query("join_point_identity", """SELECT event_id, CASE WHEN n = 1 THEN e::VARCHAR END AS entity, CASE WHEN n IS NULL THEN 'NONE' WHEN n = 1 THEN 'FOUND' ELSE 'AMBIGUOUS' END AS status FROM (SELECT event_id, user_id AS symbol, (ts::DATE - 9500)::DATE AS day FROM events)
LEFT JOIN (SELECT o_custkey AS symbol, o_orderdate::DATE AS day, count(DISTINCT o_orderkey) AS n, min(o_orderkey) AS e FROM orders GROUP BY ALL) USING (symbol, day)""")  # fmt: skip
def join_point_identity(spark, sf_dir):
    anchors = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").alias("entity"))
    asked = V.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("symbol"), F.date_sub(F.col("ts").cast("date"), 9500).alias("day"))
    return text(joins.resolve_point(anchors, asked, "symbol", "day", "entity").select("event_id", "entity", "status"), "entity")


@query("join_points", """SELECT c_custkey, CASE WHEN b.symbol IS NULL THEN 'NO_PRICE' WHEN o_custkey IS NULL THEN 'NO_IDENTITY' WHEN n_nationkey IS NULL THEN 'NO_NATION' END AS reason, close
FROM customer LEFT JOIN (SELECT symbol, max(close) AS close FROM bars WHERE session_date = DATE '2024-01-02' GROUP BY ALL) b ON c_custkey::VARCHAR = b.symbol
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""", (V.BARS,))  # fmt: skip
def join_points(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]).withColumn("symbol", F.col("c_custkey").cast("string"))
    price = V.bars(spark, sf_dir).where("session_date = date'2024-01-02'").groupBy("symbol").agg(F.max("close").alias("close"))
    ident = V.table(spark, sf_dir, "orders", ["o_custkey"]).distinct().select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("there"))
    nation = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    stages = [("price", price, ["symbol"], "close"), ("identity", ident, ["c_custkey"], "there"), ("nation", nation, ["c_nationkey"], "n_name")]
    return joins.point_join(c, stages).select("c_custkey", "reason", "close")


@query("join_point_screen", """SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'NO_CUSTOMER' WHEN n_nationkey IS NULL THEN 'NO_NATION' WHEN o_totalprice NOT BETWEEN 50000 AND 250000 THEN 'OUTSIDE_O_TOTALPRICE' WHEN c_acctbal NOT BETWEEN 0 AND 5000 THEN 'OUTSIDE_C_ACCTBAL' END AS reason
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 3) ON c_nationkey = n_nationkey""")  # fmt: skip
def join_point_screen(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    c = V.table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal", "c_nationkey"]).where("c_custkey % 7 <> 0").withColumnRenamed("c_custkey", "o_custkey")
    n = V.table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]).where("n_nationkey <> 3").withColumnRenamed("n_nationkey", "c_nationkey")
    good, bad = joins.point_screen(o, [("customer", c, ["o_custkey"], "c_acctbal"), ("nation", n, ["c_nationkey"], "n_name")], {"o_totalprice": (50000, 250000), "c_acctbal": (0, 5000)})
    return good.select("o_orderkey", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("o_orderkey", "reason"))


@query("join_asof_latest", "SELECT symbol, max(session_date)::VARCHAR AS session_date, arg_max(close, session_date) AS close FROM bars WHERE session_date <= DATE '2024-01-15' GROUP BY symbol", (V.BARS,))
def join_asof_latest(spark, sf_dir):
    return text(joins.asof_latest(V.bars(spark, sf_dir), ["symbol"], "session_date", F.lit("2024-01-15").cast("date")).select("symbol", "session_date", "close"), "session_date")


@query("join_asof_rows", """SELECT e.event_id, b.value AS asof_value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') e
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) b ON e.user_id = b.user_id AND e.ts >= b.ts""")  # fmt: skip
def join_asof_rows(spark, sf_dir):
    e = V.table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof_join(left, e.where("event_type = 'view'").select("user_id", "ts", "value"), ["user_id"], "ts", "value").select("event_id", "asof_value")


_PRIOR = """SELECT y.cik, y.metric, y.period_end::VARCHAR AS period_end, x.value::VARCHAR AS prior_value{} FROM flows y LEFT JOIN flows x ON y.cik = x.cik AND y.metric = x.metric AND {}"""


@query("join_prior_year", _PRIOR.format(", CASE WHEN x.value IS NULL THEN 'NONE' ELSE 'FOUND' END AS status", "y.period_end - x.period_end BETWEEN 350 AND 378 AND abs((y.period_end - y.period_start) - (x.period_end - x.period_start)) <= 8"), (V.FLOWS,))
def join_prior(spark, sf_dir):
    return text(joins.prior_year(V.flows(spark, sf_dir), ["cik", "metric"]).select("cik", "metric", "period_end", "prior_value", "status"), "period_end", "prior_value")


@query("join_prior_year_exact", _PRIOR.format("", "x.period_end = y.period_end - INTERVAL 1 YEAR AND x.period_start = y.period_start - INTERVAL 1 YEAR"), (V.FLOWS,))
def join_prior_exact(spark, sf_dir):
    return text(joins.prior_year_exact(V.flows(spark, sf_dir), ["cik", "metric"]).select("cik", "metric", "period_end", "prior_value"), "period_end", "prior_value")


@query("join_missing_keys", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def join_missing(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem", ["l_orderkey"]).withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.missing_keys(V.table(spark, sf_dir, "orders", ["o_orderkey"]), li, "o_orderkey")


def _cited(spark, sf_dir):
    return _strict(spark, sf_dir)[0].withColumn("result", F.concat_ws("|", "cik", "metric", "concept", "period_end")).select("result", "source_ids")


@query("join_lineage", "SELECT concat_ws('|', s.cik, s.metric, s.concept, s.period_end) AS result, o.id, o.accession FROM (SELECT *, unnest(ids) AS i FROM sel) s JOIN obs o ON o.id = i", (V.OBS, _LAST))
def join_lineage(spark, sf_dir):
    found, _ = joins.lineage(_cited(spark, sf_dir), V.observations(spark, sf_dir).select("id", "accession"), "result", "source_ids", "id")
    return found.select("result", "id", "accession")


SQL["join_lineage"] = SQL["join_lineage"].replace("FROM sel) s", "FROM sel WHERE n = 1) s")


@query("join_evidence", "SELECT concat_ws('|', cik, metric, concept, period_end) AS result, min(substr(sha256(i), 1, 2)) AS shard, count(*) AS n FROM (SELECT DISTINCT cik, metric, concept, period_end, unnest(ids) AS i FROM sel WHERE n = 1) GROUP BY ALL", (V.OBS, _LAST))
def join_evidence(spark, sf_dir):
    index = joins.evidence_index(_cited(spark, sf_dir), "source_ids").withColumn("of", F.concat_ws("~", "result", "source_id"))
    found = joins.evidence(index, V.observations(spark, sf_dir).select(F.col("id").alias("source_id")), "of")
    return found.groupBy("result").agg(F.min("shard").alias("shard"), F.count("*").alias("n"))


# Series


_LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{t}' AS series_id, user_id, ts::DATE AS day, max(value) FILTER (event_type = '{t}') AS v FROM events GROUP BY user_id, ts::DATE" for t in V.TYPES) + ")"


def _series(spark, sf_dir):
    wide = V.event_types(spark, sf_dir)
    one = wide.select(F.to_json(F.struct("user_id", "day")).alias("k"), "user_id", "day", *V.TYPES)
    return one.unpivot(["k", "user_id", "day"], V.TYPES, "series_id", "v")


@query("series_coverage", """SELECT series_id, is_total, count(*) AS cells, count(v) AS populated, count(*) - count(v) AS missing, count(*) FILTER (v IS NULL AND day < f) AS before_first,
  count(*) FILTER (v IS NULL AND day > f AND day < l) AS interior, count(*) FILTER (v IS NULL AND day > l) AS after_last, count(*) FILTER (v IS NULL AND f IS NULL) AS all_missing,
  (min(day) FILTER (v IS NOT NULL))::VARCHAR AS first_valid, (max(day) FILTER (v IS NOT NULL))::VARCHAR AS last_valid, count(*) FILTER (v IS NULL AND day(day) % 3 = 0) AS errors
FROM (SELECT *, min(day) FILTER (v IS NOT NULL) OVER (PARTITION BY k) AS f, max(day) FILTER (v IS NOT NULL) OVER (PARTITION BY k) AS l FROM (
  SELECT series_id || ':' || user_id AS k, day, v, unnest([series_id || ':' || user_id, NULL]) AS series_id, unnest([0, 1]) AS is_total FROM long)) GROUP BY series_id, is_total""", (_LONG,))  # fmt: skip
def series_coverage(spark, sf_dir):
    rows = _series(spark, sf_dir).withColumn("series_id", F.concat_ws(":", "series_id", "user_id"))
    rows = rows.withColumn("why", F.when(F.col("v").isNull(), F.when(F.day("day") % 3 == 0, "cell_error").otherwise("blank")))
    out = series.series_coverage(rows, "series_id", "day", "v", "why").withColumn("is_total", F.col("is_total").cast("int"))
    return text(out, "first_valid", "last_valid")


@query("series_unpivot", """SELECT series_id, day::VARCHAR AS observation_date, count(v) AS n_values, sum(v::DECIMAL(20,2))::DECIMAL(38,9)::VARCHAR AS total, count(*) FILTER (v IS NULL) AS n_gaps FROM long GROUP BY ALL""", (_LONG,))
def series_unpivot(spark, sf_dir):
    wide = V.event_types(spark, sf_dir).drop("user_id").withColumns({t: F.col(t).cast("decimal(20,2)").cast("string") for t in V.TYPES})
    long = ingest.unpivot_series(wide, "day", {t: t for t in V.TYPES})
    return text(long.groupBy("series_id", "observation_date").agg(F.count("value_decimal").alias("n_values"), F.sum("value_decimal").alias("total"), F.count("missing_reason").alias("n_gaps")), "observation_date", "total")


@query("series_metric_coverage", """SELECT metric, year, sum(o)::BIGINT AS observations, sum(g)::BIGINT AS gaps FROM (SELECT metric, year(period_end) AS year, CASE WHEN n = 1 THEN 1 ELSE 0 END AS o, CASE WHEN n > 1 THEN 1 ELSE 0 END AS g FROM sel) GROUP BY ALL""", (V.OBS, _LAST))
def series_metric_coverage(spark, sf_dir):
    a, b = (t.withColumn("year", F.year("period_end").cast("long")) for t in _strict(spark, sf_dir))
    return series.metric_coverage(a, b, ["metric", "year"])


@query("series_inventory", """SELECT cik, count(*) AS records, count(*) FILTER (form IN ('10-K', '10-Q')) AS periodic, count(DISTINCT (metric, concept, period_end)) AS contexts, array_to_string(list_sort(list(DISTINCT concept)), ',') AS concepts, min(period_end)::VARCHAR AS first_end, max(period_end)::VARCHAR AS last_end FROM obs GROUP BY cik""", (V.OBS,))
def series_inventory(spark, sf_dir):
    out = series.source_inventory(V.observations(spark, sf_dir), "cik", ["metric", "concept", "period_start", "period_end"], "form", "concept", "period_end")
    return text(out.withColumn("concepts", F.array_join("concepts", ",")), "first_end", "last_end")


@query("series_severity", """SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, CASE WHEN min(o_orderpriority) IN ('1-URGENT', '2-HIGH') THEN min(o_orderpriority) END AS worst FROM orders GROUP BY ALL""")
def series_severity(spark, sf_dir):
    out = series.severity_summary(V.table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return out.select("o_custkey", F.col("n_1-urgent").alias("urgent"), F.col("n_2-high").alias("high"), "worst")


@query("series_spans", """SELECT user_id, min(event_id) AS "offset", count(*) AS rows, min(ts::DATE)::VARCHAR AS first_day, max(ts::DATE)::VARCHAR AS last_day, bool_and(up) AS monotonic FROM (SELECT *, coalesce(lag(ts::DATE) OVER (PARTITION BY user_id ORDER BY event_id) <= ts::DATE OR lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) + 1 <> event_id, true) AS up, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) GROUP BY user_id, g""")
def series_spans(spark, sf_dir):
    e = V.table(spark, sf_dir, "events", ["event_id", "ts", "user_id"]).withColumn("day", F.col("ts").cast("date"))
    return text(series.spans(e, ["user_id"], "event_id", "day"), "first_day", "last_day")


@query("series_catalogue", """SELECT symbol, count(*) AS rows, min(session_date)::VARCHAR AS first_day, max(session_date)::VARCHAR AS last_day, symbol AS aliases, substr(sha256(symbol), 1, 2) AS shard FROM bars GROUP BY symbol""", (V.BARS,))
def series_catalogue(spark, sf_dir):
    return text(series.catalogue(V.bars(spark, sf_dir), "symbol", "session_date", "symbol").withColumn("aliases", F.array_join("aliases", ",")), "first_day", "last_day")


@query("series_merge_or_conflict", """SELECT cik, metric, period_end::VARCHAR AS period_end, count(DISTINCT (value, unit)) AS variants, CASE WHEN count(DISTINCT (value, unit)) > 1 THEN 'CONFLICTING_VALUES' END AS reason,
  CASE WHEN count(DISTINCT (value, unit)) = 1 THEN min(value)::VARCHAR END AS value, array_to_string(list_sort(list(DISTINCT id)), ',') AS sources FROM obs GROUP BY cik, metric, period_end""", (V.OBS,))  # fmt: skip
def series_merge(spark, sf_dir):
    keys = ["cik", "metric", "period_end"]
    merged, gaps = series.merge_or_conflict(V.observations(spark, sf_dir), keys, ["value", "unit"], "id")
    out = merged.select(*keys, F.lit(1).cast("long").alias("variants"), F.lit(None).cast("string").alias("reason"), "value", "sources")
    out = out.unionByName(gaps.select(*keys, "variants", "reason", F.lit(None).cast(V.DECIMAL).alias("value"), "sources"))
    return text(out.withColumn("sources", F.array_join("sources", ",")), "period_end", "value")


@query("series_evidence_by_year", "SELECT year(period_end) AS year, count(*) FILTER (form IN ('10-K')) AS annual, count(*) FILTER (form IN ('10-Q', '8-K')) AS other FROM obs GROUP BY ALL", (V.OBS,))
def series_evidence(spark, sf_dir):
    return series.evidence_by_year(V.observations(spark, sf_dir), "period_end", "form", {"annual": ["10-K"], "other": ["10-Q", "8-K"]}).withColumn("year", F.col("year").cast("long"))


@query("series_lookback", "SELECT cik, metric, period_end::VARCHAR AS period_end, value::VARCHAR AS value FROM flows QUALIFY row_number() OVER (PARTITION BY cik, metric ORDER BY period_end DESC) <= 4", (V.FLOWS,))
def series_lookback(spark, sf_dir):
    return text(series.lookback(V.flows(spark, sf_dir), ["cik", "metric"], 4, "period_end").select("cik", "metric", "period_end", "value"), "period_end", "value")


@query("series_contiguous", "SELECT cik, metric, period_end::VARCHAR AS period_end, coalesce(lag(period_end) OVER (PARTITION BY cik, metric ORDER BY period_end) + 1 = period_start, false) AS touches FROM flows", (V.FLOWS,))
def series_contiguous(spark, sf_dir):
    return text(series.contiguous(V.flows(spark, sf_dir), ["cik", "metric"], "period_start", "period_end").select("cik", "metric", "period_end", "touches"), "period_end")


@query("series_bars", """SELECT symbol, session_date::VARCHAR AS session_date, open, high, low, close, volume, CASE WHEN least(open, high, low, close) <= 0 THEN 'NOT_POSITIVE' END AS reason FROM bars""", (V.BARS,))
def series_bars(spark, sf_dir):
    good, gaps = ingest.split_bars(V.bars(spark, sf_dir))
    return text(good.withColumn("reason", F.lit(None).cast("string")).unionByName(gaps), "session_date")


@query("series_native_prices", "SELECT l_orderkey, l_linenumber, abs(l_extendedprice - 50000) AS magnitude, l_extendedprice < 50000 AS bid_ask_average FROM lineitem")
def series_native(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_tax"]).withColumn("price", F.col("l_extendedprice") - 50000)
    return ingest.native_price_point(rows, "price", ["l_tax"]).select("l_orderkey", "l_linenumber", "magnitude", "bid_ask_average")


# Screens


@query("screen_threshold", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal BETWEEN 1000 AND 5000 AND c_mktsegment <> 'BUILDING'")
def screen_threshold(spark, sf_dir):
    return screen.screen(V.table(spark, sf_dir, "customer"), [("c_acctbal", "between", (1000, 5000)), ("c_mktsegment", "ne", "BUILDING")]).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("screen_rank", """SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey DESC) AS rank, count(*) OVER () AS matches, (SELECT count(*) FROM customer) AS universe FROM customer WHERE c_acctbal >= 0""")
def screen_rank(spark, sf_dir):
    ranked, _ = screen.rank_screen(V.table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"]), "c_custkey", "c_acctbal", low=0)
    return ranked.select("c_custkey", "c_acctbal", "rank", "matches", "universe")


@query("screen_sort_limit", "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC NULLS LAST, p_retailprice ASC NULLS LAST, p_partkey LIMIT 25")
def screen_sort(spark, sf_dir):
    return screen.sort_limit(V.table(spark, sf_dir, "part", ["p_partkey", "p_size", "p_retailprice"]), [("p_size", "desc"), ("p_retailprice", "asc"), ("p_partkey", "asc")], 25)


@query("screen_page", f"SELECT o_orderkey, o_totalprice, '{screen.fingerprint({'from': 'orders'}, 'r1')}' AS token FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50")
def screen_page(spark, sf_dir):
    return screen.page(V.table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]), "o_orderkey", 50, after=500, params={"from": "orders"}, release="r1")


@query("screen_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(p_partkey::VARCHAR, 'red') OR contains(lower(p_brand), 'red')")
def screen_search(spark, sf_dir):
    parts = V.table(spark, sf_dir, "part").withColumn("aliases", F.array("p_brand"))
    return screen.search(parts, "Red", "p_partkey", "p_name", "aliases").select("p_partkey", "p_name")


def _tags(spark, sf_dir):
    return V.table(spark, sf_dir, "orders", ["o_custkey", "o_orderpriority", "o_orderstatus"]).groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("tags"), F.min("o_orderstatus").alias("status"))


_TAGS = "tags AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS tags, min(o_orderstatus) AS status FROM orders GROUP BY ALL)"


@query("screen_any_all", "SELECT o_custkey, status FROM tags WHERE list_has_any(tags, ['1-URGENT', '2-HIGH']) AND list_has_all(tags, ['5-LOW']) AND status = 'F'", (_TAGS,))
def screen_any_all(spark, sf_dir):
    return screen.any_all_filter(_tags(spark, sf_dir), {"tags": ["1-URGENT", "2-HIGH"]}, {"tags": ["5-LOW"]}, {"status": "F"}).select("o_custkey", "status")


@query("screen_filter_index", "SELECT 'status' AS filter, status AS value, o_custkey FROM tags UNION ALL SELECT 'tags', unnest(tags), o_custkey FROM tags", (_TAGS,))
def screen_filter_index(spark, sf_dir):
    return screen.filter_index(_tags(spark, sf_dir), "o_custkey", ["status"], ["tags"])


@query("screen_cross_section", """SELECT cik, coalesce(array_to_string(list(m || '=' || v::VARCHAR ORDER BY m) FILTER (v IS NOT NULL), ','), '') AS metrics, array_to_string(list(m || '=' || CASE WHEN m = 'R' AND cik LIKE '%3' THEN 'QUARANTINED' ELSE 'NO_OBSERVATION' END ORDER BY m) FILTER (v IS NULL), ',') AS missing
FROM (SELECT cik, m, CASE WHEN m = 'R' AND cik LIKE '%3' THEN NULL ELSE v END AS v FROM (SELECT DISTINCT cik, unnest(['A', 'N', 'R', 'Z']) AS m FROM flows) LEFT JOIN (SELECT cik, metric AS m, arg_max(value, period_end) AS v FROM flows GROUP BY ALL) USING (cik, m)) GROUP BY cik""", (V.FLOWS,))  # fmt: skip
def screen_cross_section(spark, sf_dir):
    flows = V.flows(spark, sf_dir)
    out = screen.cross_section(flows, "cik", ["A", "N", "R", "Z"], quarantine=flows.where("metric = 'R' and cik like '%3'"))
    pack = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("cik", pack("metrics").alias("metrics"), pack("missing").alias("missing"))


@query("screen_cross_section_price", """SELECT k AS key, arg_max(v, (d, v)) FILTER (m = 'A') AS "A", arg_max(v, (d, v)) FILTER (m = 'R') AS "R", arg_max(v, (d, v)) FILTER (m = 'price') AS price, (max(d) FILTER (m = 'price'))::VARCHAR AS price_day FROM (
  SELECT ltrim(cik, '0') AS k, metric AS m, value::DOUBLE AS v, period_end AS d FROM flows WHERE metric IN ('A', 'R') UNION ALL SELECT symbol, 'price', close, session_date FROM bars) WHERE d <= DATE '2024-01-20' GROUP BY k""", (V.FLOWS, V.BARS))  # fmt: skip
def screen_cross_section_price(spark, sf_dir):
    obs = V.flows(spark, sf_dir).withColumn("key", F.regexp_replace("cik", "^0+", ""))
    bars = V.bars(spark, sf_dir).withColumnRenamed("symbol", "key")
    return text(screen.cross_section_with_price(obs, bars, "key", F.lit("2024-01-20").cast("date"), ["A", "R"]), "price_day")


@query("screen_align_peers", """SELECT metric, period_end::VARCHAR AS period_end, max(value) FILTER (cik = '0000000001')::VARCHAR AS v1, max(value) FILTER (cik = '0000000002')::VARCHAR AS v2,
  array_to_string([x FOR x IN ['0000000001', '0000000002'] IF NOT list_contains(h, x)], ',') AS missing, CASE WHEN len(h) = 2 THEN (max(value) FILTER (cik = '0000000002')::DECIMAL(28,9) - max(value) FILTER (cik = '0000000001')::DECIMAL(28,9))::DECIMAL(29,9)::VARCHAR END AS difference FROM (SELECT *, list(cik) OVER (PARTITION BY metric, period_end) AS h FROM flows WHERE cik IN ('0000000001', '0000000002')) GROUP BY metric, period_end, h""", (V.FLOWS,))  # fmt: skip
def screen_peers(spark, sf_dir):
    out = screen.align_peers(V.flows(spark, sf_dir), ["0000000001", "0000000002"], ["metric", "period_end"])
    return text(out.select("metric", "period_end", F.col("v_0000000001").alias("v1"), F.col("v_0000000002").alias("v2"), F.array_join("missing", ",").alias("missing"), F.col("diff_0000000002").alias("difference")), "period_end", "v1", "v2", "difference")


@query("screen_compare", "SELECT cik, period_end::VARCHAR AS period_end, value::VARCHAR AS value FROM flows WHERE cik IN ('0000000001', '0000000003') AND metric = 'N' QUALIFY row_number() OVER (PARTITION BY cik ORDER BY period_end DESC) <= 8", (V.FLOWS,))
def screen_compare(spark, sf_dir):
    return text(screen.compare(V.flows(spark, sf_dir), ["0000000001", "0000000003"], "N", 8).select("cik", "period_end", "value"), "period_end", "value")


@query("screen_combined", """SELECT o_custkey AS security, d::VARCHAR AS day, price, value FROM (SELECT o_custkey, o_orderdate::DATE AS d, max(o_totalprice) AS price FROM orders GROUP BY ALL HAVING price BETWEEN 100000 AND 300000)
JOIN (SELECT o_custkey, o_orderdate::DATE AS d, count(*) AS value, min(o_orderstatus) = 'F' AS ok FROM orders GROUP BY ALL HAVING ok AND value BETWEEN 1 AND 2) USING (o_custkey, d)""")  # fmt: skip
def screen_combined(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").withColumns({"security": F.col("o_custkey"), "day": F.col("o_orderdate").cast("date")})
    prices = o.groupBy("security", "day").agg(F.max("o_totalprice").alias("price"))
    facts = o.groupBy("security", "day").agg(F.count("*").alias("value"), (F.min("o_orderstatus") == "F").alias("certified"))
    return text(screen.combined_screen(prices, facts, "security", "day", "price", "value", (100000, 300000), (1, 2), "certified").drop("certified"), "day")


@query("screen_sector", "SELECT s_suppkey, n_nationkey AS code, r_name AS \"group\" FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def screen_sector(spark, sf_dir):
    codes = V.table(spark, sf_dir, "nation").join(V.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("code"), F.col("r_name").alias("group"))
    return screen.sector(V.table(spark, sf_dir, "supplier").withColumn("code", F.col("s_nationkey")), codes, "code").select("s_suppkey", "code", "group")


@query("screen_actions", """SELECT event_id, CASE WHEN ts::DATE > DATE '2024-01-10' THEN 'ANNOUNCED' ELSE 'EFFECTIVE' END AS status FROM events WHERE (user_id::VARCHAR IN ('1', '2') OR event_type = 'signup') AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND event_type IN ('signup', 'click')""")
def screen_actions(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", F.array(F.col("user_id").cast("string"), "event_type").alias("refs"), F.col("ts").cast("date").alias("effective"), F.col("event_type").alias("kind"))
    day = lambda d: F.lit(d).cast("date")
    return screen.actions(e, ["1", "2", "signup"], day("2024-01-05"), day("2024-01-20"), day("2024-01-10"), ["signup", "click"]).select("event_id", "status")


@query("screen_readiness", "SELECT status, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM tags), 4) AS percent FROM tags GROUP BY status", (_TAGS,))
def screen_readiness(spark, sf_dir):
    return screen.readiness_summary(_tags(spark, sf_dir), "status", "tags")[0]


@query("screen_readiness_codes", "SELECT code, count(*) AS n FROM (SELECT unnest(tags) AS code FROM tags) GROUP BY code", (_TAGS,))
def screen_readiness_codes(spark, sf_dir):
    return screen.readiness_summary(_tags(spark, sf_dir), "status", "tags")[1]


@query("screen_top_missing", "SELECT code, count(DISTINCT o_custkey) AS ids, count(DISTINCT o_custkey) FILTER (n = 1) AS unlocks FROM (SELECT o_custkey, len(tags) AS n, unnest(tags) AS code FROM tags) GROUP BY code ORDER BY ids DESC, code LIMIT 20", (_TAGS,))
def screen_top_missing(spark, sf_dir):
    return screen.top_missing(_tags(spark, sf_dir), "o_custkey", "tags")


@query("set_union_sources", "SELECT 'customer' AS source, c_custkey AS id, c_name AS name, NULL::VARCHAR AS s_nationkey FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey::VARCHAR FROM supplier")
def set_union(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("s_nationkey"))
    return screen.union_sources({"customer": c, "supplier": s})


@query("set_difference", "SELECT id, CASE WHEN b.id IS NULL THEN 'removed' WHEN a.id IS NULL THEN 'added' ELSE 'common' END AS state FROM (SELECT DISTINCT id FROM obs) a FULL JOIN (SELECT DISTINCT id FROM altered) b USING (id)", (V.OBS, V.ALTERED))
def set_difference(spark, sf_dir):
    a = V.observations(spark, sf_dir)
    return screen.set_diff(a, V.altered(a), "id")


@query("set_filters", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) AND bool_or(o_orderstatus IN ('P'))")
def set_filters(spark, sf_dir):
    return screen.filter_sets(V.table(spark, sf_dir, "orders"), "o_custkey", {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": ["P"]}, ["o_totalprice"])[0]


@query("set_filter_conflicts", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def set_conflicts(spark, sf_dir):
    return screen.filter_sets(V.table(spark, sf_dir, "orders"), "o_custkey", {"o_orderpriority": ["1-URGENT"]}, ["o_orderstatus"])[1]


# Quality and claims


@query("quality_checks", """SELECT p_partkey, c.check, c.state FROM (SELECT p_partkey, unnest([struct_pack("check" := 'non_empty', state := 'passed'), struct_pack("check" := 'source_attribution', state := 'passed'),
  struct_pack("check" := 'price_bounds', state := CASE WHEN p_retailprice - 1000 > 0 THEN 'passed' ELSE 'failed' END), struct_pack("check" := 'volume_non_negative', state := CASE WHEN p_size >= 10 THEN 'passed' ELSE 'failed' END),
  struct_pack("check" := 'income_math', state := CASE WHEN p_size * 10 <= p_retailprice * 0.01 * 10 THEN 'passed' ELSE 'warning' END), struct_pack("check" := 'scale_plausibility', state := CASE WHEN p_retailprice * 10 < 10000 AND p_retailprice * 10 - 9000 < 1000 AND false THEN 'warning' ELSE 'passed' END),
  struct_pack("check" := 'has_type_field', state := 'passed')]) AS c FROM part)""")
def quality_checks(spark, sf_dir):
    """Parts as income statements whose gross profit is off by ten times the part's size."""
    r = F.col("p_retailprice") * 10
    parts = V.table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_retailprice", "p_size"]).select(
        "p_partkey", F.col("p_brand").alias("source"), (F.col("p_retailprice") - 1000).alias("price"), (F.col("p_size") - 10).alias("volume"), F.lit("income_statement").alias("statement_type"),
        F.create_map(F.lit("total_revenue"), r, F.lit("cost_of_revenue"), r / 2, F.lit("gross_profit"), r / 2 + F.col("p_size") * 10).alias("line_items"), F.lit(None).cast("array<string>").alias("dates"),
    )
    return quality.record_checks(parts, "p_partkey")[0]


_BAL = "SELECT cik, period_end::VARCHAR AS period_end, CASE WHEN n < 3 THEN 'UNAVAILABLE' WHEN d = 0 THEN 'PASS' ELSE 'FAIL' END AS state, CASE WHEN n = 3 THEN d::VARCHAR END AS {} FROM (SELECT cik, period_end, count(*) AS n, sum(CASE metric WHEN 'N' THEN value ELSE -value END) AS d FROM flows GROUP BY cik, period_end)"


@query("quality_balance", _BAL.format("difference"), (V.FLOWS,))
def quality_balance(spark, sf_dir):
    return text(quality.balance_check(V.flows(spark, sf_dir), ["cik", "period_end"], "N", ["A", "R"], concept="metric"), "period_end", "difference")


@query("quality_identity", _BAL.format("residual"), (V.FLOWS,))
def quality_identity(spark, sf_dir):
    return text(quality.identity_check(V.flows(spark, sf_dir), ["cik", "period_end"], [("N", 1), ("A", -1), ("R", -1)]), "period_end", "residual")


@query("quality_vintage", "SELECT cik, metric, period_end::VARCHAR AS period_end, CASE WHEN count(DISTINCT concept) = 1 THEN min(CASE WHEN value > 50000 THEN 'FAIL' ELSE 'PASS' END) ELSE 'NOT_COMPARABLE' END AS state FROM obs GROUP BY ALL", (V.OBS,))
def quality_vintage(spark, sf_dir):
    rows = V.observations(spark, sf_dir).withColumn("s", F.when(F.col("value") > 50000, "FAIL").otherwise("PASS"))
    return text(quality.same_vintage_guard(rows, ["cik", "metric", "period_end"], "s", ["concept"]), "period_end")


@query("quality_recompute", """SELECT o_orderkey AS result, o_totalprice::DECIMAL(38,9)::VARCHAR AS stored, s::VARCHAR AS recomputed FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(38,9)) AS s FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey WHERE o_totalprice::DECIMAL(38,9) IS DISTINCT FROM s""")
def quality_recompute(spark, sf_dir):
    res = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("result"), F.col("o_totalprice").cast(V.DECIMAL).alias("value"))
    terms = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("result"), F.col("l_extendedprice").cast(V.DECIMAL).alias("value"), F.lit(1).alias("coefficient"))
    return text(quality.recompute_check(res, terms, "result"), "stored", "recomputed")


@query("quality_certify", """SELECT o_orderkey AS result, CASE r WHEN 'MISSING_LEAF' THEN 'SOURCE_OBSERVED' WHEN 'NOT_RECOMPUTED' THEN 'RECONCILED' ELSE CASE WHEN r IS NULL THEN 'ACCOUNTING_CERTIFIED' ELSE 'DERIVATION_VERIFIED' END END AS evidence_state, r AS reason
FROM (SELECT o_orderkey, CASE WHEN m IS NULL OR m > 0 THEN 'MISSING_LEAF' WHEN o_orderkey % 7 = 0 THEN 'NOT_RECOMPUTED' WHEN f > 0 THEN 'IDENTITY_FAILED' WHEN p = 0 THEN 'NO_IDENTITY' END AS r
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_suppkey % 50 = 0) AS m, count(*) FILTER (l_quantity > 48) AS f, count(*) FILTER (l_quantity <= 10) AS p FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey)""")  # fmt: skip
def quality_certify(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem").withColumns({"result": F.col("l_orderkey"), "source_id": F.col("l_suppkey"), "value": F.col("l_extendedprice").cast(V.DECIMAL), "coefficient": F.lit(1)})
    res = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("result")).join(li.groupBy("result").agg(F.sum("value").alias("value")), "result", "left")
    res = res.withColumn("value", F.when(F.col("result") % 7 == 0, (F.col("value").cast("decimal(28,9)") + 1).cast(V.DECIMAL)).otherwise(F.col("value")))
    leaves = li.where("l_suppkey % 50 <> 0").select("source_id")
    states = li.select("result", F.when(F.col("l_quantity") > 48, "FAIL").when(F.col("l_quantity") <= 10, "PASS").otherwise("UNAVAILABLE").alias("state"))
    return quality.certify(res, li, leaves, states, "result").select("result", "evidence_state", "reason")


@query("quality_statement_policy", "SELECT accession, CASE WHEN o THEN 'open' ELSE '' END AS families, CASE WHEN o THEN 'N=open,Q=open' ELSE '' END AS quarantined FROM (SELECT accession, bool_or(concept = 'O') AS o FROM obs GROUP BY accession)", (V.OBS,))
def quality_policy(spark, sf_dir):
    out = quality.statement_policy(V.observations(spark, sf_dir), "accession", "concept", {"open": ["O"], "bank": ["X"]}, {"open": ["N", "Q"], "bank": ["A"]})
    pairs = F.array_join(F.transform("quarantined", lambda q: F.concat_ws("=", q["metric"], q["family"])), ",")
    return out.select("accession", F.array_join("families", ",").alias("families"), pairs.alias("quarantined"))


@query("quality_quarantine", "SELECT cik, metric, count(*) AS n FROM flows WHERE (cik, metric) IN (SELECT DISTINCT cik, metric FROM obs WHERE value > 100000) GROUP BY ALL", (V.OBS, V.FLOWS))
def quality_quarantine(spark, sf_dir):
    bad = V.observations(spark, sf_dir).where("value > 100000")
    return quality.quarantine_violations(V.flows(spark, sf_dir), bad, ["cik", "metric"]).groupBy("cik", "metric").agg(F.count("*").alias("n"))


@query("quality_contract", f"""SELECT cik, metric, CASE WHEN count(*) FILTER (form = '10-K') = 0 THEN 'PERIOD_MISMATCH' WHEN count(*) FILTER (form = '10-K' AND {_AVAILABLE}) = 0 THEN 'NOT_PIT_ELIGIBLE' WHEN count(DISTINCT value) FILTER (form = '10-K' AND {_AVAILABLE}) > 1 THEN 'CONFLICT'
  WHEN count(*) FILTER (form = '10-K' AND {_AVAILABLE} AND concept = 'O') = 0 THEN 'SOURCE_UNVALIDATED' ELSE 'AVAILABLE' END AS state,
  CASE WHEN count(DISTINCT value) FILTER (form = '10-K' AND {_AVAILABLE}) = 1 THEN (min(value) FILTER (form = '10-K' AND {_AVAILABLE}))::VARCHAR END AS value, strftime(date_trunc('month', filed), '%Y-%m') AS month FROM obs GROUP BY cik, metric, month""", (V.OBS,))  # fmt: skip
def quality_contract(spark, sf_dir):
    rows = V.observations(spark, sf_dir).withColumns({"want": F.lit("10-K"), "ok": F.col("concept") == "O", "month": F.date_format("filed", "yyyy-MM")})
    return text(quality.evaluate_contract(rows, ["cik", "metric", "month"], "USD", "form", "want", as_of=cut(), validated="ok"), "value")


_ONE = "one AS (SELECT DISTINCT ON (id) * FROM obs ORDER BY id, period_end)"


def _one(df, *cols):
    """One row an id, with the named columns only: each goes through the shuffle."""
    return df.groupBy("id").agg(F.min_by(F.struct(*cols), "period_end").alias("r")).select("id", "r.*")


@query("quality_cross_validate", """SELECT a.id, CASE WHEN b.value IS NULL THEN 'NOT_COMPARABLE' WHEN a.unit <> b.unit THEN 'UNIT_MISMATCH' WHEN a.value = b.value THEN 'AGREES' ELSE 'CONFLICT' END AS validation, CASE WHEN a.unit = b.unit AND a.value <> b.value THEN (b.value::DECIMAL(28,9) - a.value::DECIMAL(28,9))::DECIMAL(29,9)::VARCHAR END AS delta FROM one a LEFT JOIN altered b ON a.id = b.id""", (V.OBS, _ONE, V.ALTERED.replace("FROM obs", "FROM one")))
def quality_cross(spark, sf_dir):
    a = _one(V.observations(spark, sf_dir), "value", "unit", "l_orderkey")
    return text(quality.cross_validate(a, V.altered(a), ["id"]).select("id", "validation", "delta"), "delta")


@query("claims_bridge", """SELECT cik, period_end::VARCHAR AS period_end, CASE WHEN n = 3 THEN s::DECIMAL(28,9)::VARCHAR END AS bridge, CASE WHEN n = 3 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS status, array_to_string([c[2] FOR c IN [['R', 'cash'], ['A', 'debt'], ['N', 'leases']] IF NOT list_contains(h, c[1])], ',') AS missing FROM (
  SELECT cik, period_end, count(*) AS n, list(metric) AS h, sum(CASE metric WHEN 'R' THEN v ELSE -v END) AS s FROM (SELECT cik, period_end, metric, value::DECIMAL(28,9) AS v FROM flows) GROUP BY ALL)""", (V.FLOWS,))  # fmt: skip
def claims_bridge(spark, sf_dir):
    rows = V.flows(spark, sf_dir).withColumn("id", F.concat_ws(":", "metric", "period_end"))
    got = claims.claims(rows, ["cik", "period_end"], {"debt": ("A", []), "leases": (None, ["N"]), "cash": ("R", [])}, concept="metric")
    return text(claims.equity_bridge(got, ["cik", "period_end"], ["debt", "leases"], ["cash"]).withColumn("missing", F.array_join("missing", ",")), "period_end", "bridge")


_SCOPED = ["DebtCurrent", "LongTermDebtCurrent", "ShortTermBorrowings", "LongTermDebtNoncurrent", "LongTermDebt", "MinorityInterest", "NoncontrollingInterestInVariableInterestEntity"]


@query("claims_scoped", """SELECT cik, claim, state, CASE WHEN state = 'REPORTED' THEN value END::VARCHAR AS value, CASE WHEN state <> 'REVIEWED_ABSENT' THEN duplicates ELSE '' END AS duplicates FROM (
  SELECT cik, 'debt' AS claim, array_to_string([x FOR x IN [CASE WHEN e1 = e0 THEN 'LongTermDebtCurrent' END, CASE WHEN e2 = e0 THEN 'ShortTermBorrowings' END] IF x IS NOT NULL], ',') AS duplicates,
    CASE WHEN a0 OR a1 OR a2 OR a3 OR a4 OR coalesce(e1 = e0 AND v1 > v0, false) OR coalesce(e2 = e0 AND v2 > v0, false) THEN 'CONFLICTING' WHEN coalesce(e0, e1, e2, e3, e4) IS NULL THEN 'REVIEWED_ABSENT' ELSE 'REPORTED' END AS state,
    (coalesce(v0, coalesce(v1, 0) + coalesce(v2, 0)) + coalesce(v3, v4, 0))::DECIMAL(38,9) AS value FROM p
  UNION ALL SELECT cik, 'noncontrolling_interests', '', CASE WHEN a5 OR a6 OR coalesce(v5 <> v6, false) THEN 'CONFLICTING' WHEN coalesce(e5, e6) IS NULL THEN 'REVIEWED_ABSENT' ELSE 'REPORTED' END, coalesce(v5, v6)::DECIMAL(38,9) FROM p)""", (
    "facts AS (SELECT lpad(l_suppkey::VARCHAR, 10, '0') AS cik, l_partkey % 7 AS c, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS e, o_orderdate::DATE AS filed, l_orderkey::VARCHAR AS acc, l_extendedprice::DECIMAL(20,2) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "sel AS (SELECT * FROM (SELECT cik, c, e, filed, acc, min(v) AS lo, max(v) AS hi FROM facts WHERE e <= DATE '1996-01-01' AND filed <= DATE '1996-01-01' AND DATE '1996-01-01' - e <= 400 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cik, c ORDER BY e DESC, filed DESC, acc DESC) = 1)",
    "p AS (SELECT cik, " + ", ".join(f"max(CASE WHEN c = {i} AND lo = hi THEN lo END) AS v{i}, max(CASE WHEN c = {i} THEN e END) AS e{i}, coalesce(bool_or(lo <> hi) FILTER (c = {i}), false) AS a{i}" for i in range(7)) + " FROM sel GROUP BY cik)"))
def claims_scoped(spark, sf_dir):
    """Line items as instants of seven concepts, of which several may be of one filing."""
    li = V.table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]).join(V.table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"]), F.col("l_orderkey") == F.col("o_orderkey"))
    end = F.date_sub(F.add_months(F.date_trunc("quarter", "l_shipdate").cast("date"), 3), 1)
    facts = li.select(
        values.pad_id(F.col("l_suppkey")).alias("cik"), F.element_at(F.array(*map(F.lit, _SCOPED)), (F.col("l_partkey") % 7 + 1).cast("int")).alias("concept"), F.lit("USD").alias("unit"), F.col("l_extendedprice").cast(V.DECIMAL).alias("value"),
        F.lit(None).cast("date").alias("period_start"), end.alias("period_end"), F.col("o_orderdate").cast("date").alias("filed"), F.col("l_orderkey").cast("string").alias("accession"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
    )
    got = claims.scoped_claims(claims.select_instants(facts, ["cik"], dt.date(1996, 1, 1)), ["cik"]).where(F.col("claim").isin("debt", "noncontrolling_interests"))
    return text(got.select("cik", "claim", "state", "value", F.array_join("duplicates", ",").alias("duplicates")), "value")


@query("claims_methods", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'NOT_APPLICABLE' WHEN c_acctbal > 0 AND c_nationkey < 10 THEN 'READY' ELSE 'BLOCKED' END AS status, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE concat_ws(',', CASE WHEN c_acctbal > 0 THEN NULL ELSE 'NO_BALANCE' END, CASE WHEN c_nationkey < 10 THEN NULL ELSE 'NO_NATION' END) END AS missing FROM customer""")
def claims_methods(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    out = claims.method_eligibility(c, "c_custkey", {"dcf": {"NO_BALANCE": F.col("c_acctbal") > 0, "NO_NATION": F.col("c_nationkey") < 10}}, F.col("c_mktsegment") == "BUILDING", ["dcf"])
    return out.select("c_custkey", "status", F.array_join("missing", ",").alias("missing"))


@query("claims_readiness", """SELECT c_custkey, method, array_to_string(list_sort(list_filter(CASE WHEN method IN ('operating_dcf', 'fcfe', 'apv') AND bank THEN ['INDUSTRIAL_DCF_NOT_APPLICABLE_TO_FINANCIAL_FILER'] ELSE [CASE WHEN NOT dated THEN 'MISSING_DATED_OUTSTANDING_SHARES' END,
  CASE WHEN method IN ('operating_dcf', 'fcfe') AND NOT op THEN 'MISSING_OPERATING_INCOME_OR_REVENUE' END, CASE WHEN method IN ('operating_dcf', 'fcfe') AND NOT flow THEN 'MISSING_CASH_FLOW_OR_CAPEX' END, CASE WHEN method = 'apv' AND NOT (op AND flow) THEN 'MISSING_UNLEVERED_FREE_CASH_FLOW_INPUTS' END,
  CASE WHEN method IN ('fcfe', 'bank_excess_return', 'residual_income') AND NOT inc THEN 'MISSING_NET_INCOME' END, CASE WHEN method IN ('operating_dcf', 'apv') AND NOT debt THEN 'MISSING_BRIDGE_CLAIM_DEBT' END,
  CASE WHEN method IN ('operating_dcf', 'bank_excess_return') AND NOT pref THEN 'MISSING_BRIDGE_CLAIM_PREFERRED_EQUITY' END, CASE WHEN method = 'residual_income' AND NOT pref THEN 'PREFERRED_OR_NCI_CLAIM_NOT_RESOLVED' END,
  CASE WHEN method = 'bank_excess_return' AND NOT bank THEN 'NOT_A_FINANCIAL_STATEMENT_FAMILY_FILER' END, CASE WHEN method IN ('bank_excess_return', 'residual_income') AND NOT book THEN 'MISSING_BOOK_EQUITY_TOTAL' END,
  CASE WHEN method = 'ddm' AND NOT divs THEN 'MISSING_DIVIDEND_EVIDENCE' END, CASE WHEN method = 'comparables' AND NOT (op OR inc) THEN 'MISSING_REVENUE_AND_NET_INCOME' END] END, lambda x: x IS NOT NULL)), ',') AS missing
FROM (SELECT c_custkey, unnest(['operating_dcf', 'fcfe', 'apv', 'bank_excess_return', 'residual_income', 'ddm', 'comparables']) AS method, c_mktsegment = 'BUILDING' AS bank, c_custkey % 2 = 0 AS op, c_custkey % 3 <> 0 AS flow, c_custkey % 5 <> 0 AS inc, c_acctbal > 0 AS debt, c_nationkey < 12 AS pref, c_custkey % 7 <> 0 AS dated, c_nationkey % 2 = 0 AS book, c_nationkey % 3 = 0 AS divs FROM customer)""")  # fmt: skip
def claims_readiness(spark, sf_dir):
    """Customers as issuers: what they have follows from their keys, balance and nation."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    some = lambda ok, *names: F.when(ok, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    state = lambda ok: F.when(ok, "CERTIFIED").otherwise("UNAVAILABLE")
    c = V.table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(some(k % 2 == 0, "revenue", "operating_income"), some(k % 3 != 0, "operating_cash_flow", "capital_expenditures"), some(k % 5 != 0, "net_income")).alias("metrics"),
        F.create_map(*[x for name in claims.BRIDGE_CLAIMS for x in (F.lit(name), state(F.col("c_acctbal") > 0) if name == "debt" else state(n < 12) if name == "preferred_equity" else F.lit("CERTIFIED"))]).alias("claims"),
        state(k % 7 != 0).alias("shares_state"), F.when(F.col("c_mktsegment") == "BUILDING", "financial_statement_evidence").otherwise("industrial").alias("statement_family"), (n % 2 == 0).alias("equity_totals"), (n % 3 == 0).alias("dividends"),
    )
    out = claims.readiness_methods(c, "c_custkey", ("CERTIFIED",))
    return out.select("c_custkey", "method", F.array_join("missing", ",").alias("missing"))


@query("claims_eligible_instants", f"SELECT id FROM obs WHERE period_end <= DATE '{AS_OF}' AND filed <= DATE '{AS_OF}' AND DATE '{AS_OF}' - period_end <= 400 AND form <> '8-K'", (V.OBS,))
def claims_instants(spark, sf_dir):
    rows = V.observations(spark, sf_dir).withColumn("segment", F.when(F.col("form") == "8-K", "s"))
    return claims.eligible_instants(rows, F.lit(AS_OF).cast("date"), segment="segment").select("id")


# Releases


@query("release_diff", """SELECT id, code, base_value, candidate_value FROM (SELECT a.id, a.value::VARCHAR AS base_value, b.value::VARCHAR AS candidate_value, unnest([
  CASE WHEN b.id IS NULL THEN 'FIELD_LOST' END, CASE WHEN a.unit <> b.unit THEN 'CONTRACT_UNIT_VIOLATION' END,
  CASE WHEN b.id IS NULL OR a.value = b.value THEN NULL WHEN abs(a.value::DOUBLE - b.value::DOUBLE) <= 1000000 THEN 'IMMATERIAL_VALUE_DRIFT' WHEN a.unit = b.unit AND a.l_orderkey % 37 = 0 AND a.l_orderkey % 31 <> 0 THEN 'SUSPECTED_UNCONVERTED_SCALE'
    WHEN a.l_orderkey % 2 = 0 THEN CASE WHEN b.filed > a.filed THEN 'RESTATEMENT_WITH_NEW_FILING' ELSE 'FILING_REGRESSION_EARLIER_ACCESSION' END WHEN a.l_orderkey % 3 = 0 THEN 'VALUE_CHANGED_WITH_SOURCE_REVISION' ELSE 'VALUE_CHANGED_WITHOUT_SOURCE_REVISION' END,
  CASE WHEN b.value < 0 THEN 'SIGN_CONVENTION_VIOLATION' END, CASE WHEN a.l_orderkey % 2 <> 0 AND b.filed <> a.filed THEN 'FILING_DATE_INCONSISTENT' END,
  CASE WHEN a.l_orderkey % 17 = 0 AND b.id IS NOT NULL THEN 'VALIDATION_DOWNGRADE' WHEN a.l_orderkey % 19 = 0 AND b.id IS NOT NULL THEN 'SOURCE_BLOCKED' END]) AS code FROM big a LEFT JOIN altered b ON a.id = b.id) WHERE code IS NOT NULL""", (V.OBS, _ONE, "big AS (SELECT * REPLACE ((value::DECIMAL(20,2) * 100)::DECIMAL(38,9) AS value) FROM one)", V.ALTERED.replace("FROM obs", "FROM big")))  # fmt: skip
def release_diff(spark, sf_dir):
    """Observations in hundredths against the altered ones; odd orders keep their accession."""
    k = F.col("l_orderkey")
    a = _one(V.observations(spark, sf_dir), "value", "unit", "concept", "accession", "filed", "available_at", "l_orderkey").withColumns({"state": F.lit("SOURCE_VALIDATED"), "source_object": F.lit("o1"), "field": F.lit("revenue"), "value": (F.col("value").cast("decimal(20,2)") * 100).cast(V.DECIMAL)})
    b = V.altered(a).withColumns({
        "accession": F.when(k % 2 == 0, F.concat("accession", F.lit("x"))).otherwise(F.col("accession")), "source_object": F.when(k % 3 == 0, "o2").otherwise("o1"),
        "state": F.when(k % 17 == 0, "SOURCE_UNVALIDATED").when(k % 19 == 0, "BLOCKED").otherwise(F.col("state")),
    })
    contract = spark.createDataFrame([("revenue", "USD", ["O", "F"], [])], "field string, unit string, concepts array<string>, prohibited array<string>")
    return text(releases.diff_reports(a, b, ["id", "field"], "field", contract).select("id", "code", "base_value", "candidate_value"), "base_value", "candidate_value")


@query("release_coverage", """SELECT cik, array_to_string(list_sort([x FOR x IN coalesce(a, []) IF NOT list_contains(coalesce(b, []), x)]), ',') AS lost, array_to_string(list_sort([x FOR x IN coalesce(b, []) IF NOT list_contains(coalesce(a, []), x)]), ',') AS added
FROM (SELECT cik, list(DISTINCT period_end::VARCHAR || metric) AS a FROM obs WHERE l_orderkey % 23 <> 0 GROUP BY cik) FULL JOIN (SELECT cik, list(DISTINCT period_end::VARCHAR || metric) AS b FROM altered GROUP BY cik) USING (cik) WHERE lost <> '' OR added <> ''""", (V.OBS, V.ALTERED))  # fmt: skip
def release_coverage(spark, sf_dir):
    a = V.observations(spark, sf_dir).withColumn("item", F.concat(F.col("period_end").cast("string"), "metric"))
    out = releases.diff_coverage(a.where("l_orderkey % 23 <> 0"), V.altered(a), ["cik"], "item")
    return out.select("cik", F.array_join("lost", ",").alias("lost"), F.array_join("added", ",").alias("added"))


@query("release_identity_conflicts", """SELECT 'ID_TO_ENTITIES' AS kind, accession AS key, count(DISTINCT cik) AS n FROM obs GROUP BY accession HAVING n > 1 UNION ALL SELECT 'ENTITY_TO_IDS', cik, count(DISTINCT accession) AS n FROM obs GROUP BY cik HAVING n > 1""", (V.OBS,))
def release_identity(spark, sf_dir):
    return releases.identity_conflicts(V.observations(spark, sf_dir), "accession", "cik")


@query("release_corroboration", """SELECT a.id, CASE WHEN b.id IS NULL THEN 'UNCORROBORATED' WHEN a.accession = b.accession THEN 'NOT_INDEPENDENT' ELSE 'INDEPENDENT' END AS state FROM one a LEFT JOIN (SELECT id, CASE WHEN l_orderkey % 2 = 0 THEN accession ELSE accession || 'x' END AS accession FROM altered) b ON a.id = b.id""", (V.OBS, _ONE, V.ALTERED.replace("FROM obs", "FROM one")))
def release_corroboration(spark, sf_dir):
    a = _one(V.observations(spark, sf_dir), "accession", "l_orderkey")
    b = V.altered(a).withColumn("accession", F.when(F.col("l_orderkey") % 2 == 0, F.col("accession")).otherwise(F.concat("accession", F.lit("x"))))
    return releases.corroboration_check(a, b, ["id"], "accession")


@query("release_reconcile", """SELECT 'REMOVED' AS kind, id AS key FROM (SELECT id FROM obs EXCEPT SELECT id FROM altered) UNION ALL SELECT 'ADDED', id FROM (SELECT id FROM altered EXCEPT SELECT id FROM obs WHERE l_orderkey % 23 <> 0) WHERE id NOT IN (SELECT id FROM obs WHERE l_orderkey % 23 <> 0) UNION ALL
  SELECT 'CHANGED', concat_ws('|', cik, metric, period_end) FROM (SELECT cik, metric, period_end, list_sort(list(DISTINCT value)) AS a FROM obs WHERE l_orderkey % 23 <> 0 GROUP BY ALL) x JOIN (SELECT cik, metric, period_end, list_sort(list(DISTINCT value)) AS b FROM altered GROUP BY ALL) y USING (cik, metric, period_end) WHERE a <> b""".replace("SELECT id FROM obs EXCEPT", "SELECT id FROM obs WHERE l_orderkey % 23 <> 0 EXCEPT"), (V.OBS, V.ALTERED))  # fmt: skip
def release_reconcile(spark, sf_dir):
    a = V.observations(spark, sf_dir)
    return releases.reconcile(a.where("l_orderkey % 23 <> 0"), V.altered(a), "id", ["cik", "metric", "period_end"], "value")


@query("release_replace", "SELECT cik, count(*) AS n, sum(value)::VARCHAR AS total FROM (SELECT cik, value FROM obs WHERE cik NOT LIKE '%7' UNION ALL SELECT cik, value FROM altered WHERE cik LIKE '%7') GROUP BY cik", (V.OBS, V.ALTERED))
def release_replace(spark, sf_dir):
    a = V.observations(spark, sf_dir)
    out = releases.replace_snapshot(a, V.altered(a).where("cik like '%7'"), "cik")
    return text(out.groupBy("cik").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


@query("release_reproduce", """SELECT kind, count(*) AS n FROM (SELECT 'CONTENT_LOST' AS kind FROM (SELECT id, metric, value FROM obs EXCEPT SELECT id, metric, value FROM altered) UNION ALL SELECT 'CONTENT_NEW' FROM (SELECT id, metric, value FROM altered EXCEPT SELECT id, metric, value FROM obs)
  UNION ALL SELECT 'COVERAGE_SHRANK' FROM (SELECT DISTINCT o.accession FROM obs o WHERE NOT EXISTS (FROM altered a WHERE a.accession = o.accession AND a.metric = o.metric))) GROUP BY kind""", (V.OBS, V.ALTERED))  # fmt: skip
def release_reproduce(spark, sf_dir):
    a = V.observations(spark, sf_dir).select("id", "metric", "value", "l_orderkey", "filed", "unit", "accession")
    b = V.altered(a)
    out = releases.reproduce_check(a.dropDuplicates(["id", "metric", "value"]), b.dropDuplicates(["id", "metric", "value"]), ["id", "metric", "value"], ["accession"], "metric")
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@query("release_multiset", "SELECT metric, period_end::VARCHAR AS period_end, value::VARCHAR AS value, sum(n)::BIGINT AS surplus FROM (SELECT metric, period_end, value, 1 AS n FROM obs UNION ALL SELECT metric, period_end, value, -1 FROM altered) GROUP BY ALL HAVING sum(n) <> 0", (V.OBS, V.ALTERED))
def release_multiset(spark, sf_dir):
    cols = ["metric", "period_end", "value"]
    a = V.observations(spark, sf_dir)
    return text(releases.multiset_difference(a.select(*cols), V.altered(a).select(*cols)), "period_end", "value")


_TREE_SIDE = """co{n} AS (SELECT c_custkey AS company, CASE WHEN c_custkey % 31 = {n} THEN NULL ELSE c_nationkey + (c_custkey % 37 = {n})::INT END AS cik, CASE WHEN c_acctbal > {n} * 3000 THEN 'SOURCE_VALIDATED' ELSE 'BLOCKED' END AS overall, CASE WHEN c_acctbal > {n} * 2000 THEN [] ELSE [c_mktsegment] END AS blocking FROM customer WHERE c_custkey % 11 <> {n})"""
_TREE_FIELDS = """fi{n} AS (SELECT o_custkey AS company, make_date(year(o_orderdate)::INT, 12, 31) AS period_end, o_orderpriority AS field, max(o_orderkey) % 5 = 0 AS bad FROM orders WHERE o_custkey % 11 <> {n} AND NOT (o_custkey % 7 = {n} AND year(o_orderdate) = 1993 + {n}) AND o_orderkey % 13 <> {n} GROUP BY ALL),
pe{n} AS (SELECT DISTINCT company, period_end FROM fi{n})"""


@query("release_tree", """SELECT level, company::VARCHAR AS company, period_end, field, subject, code, severity FROM (
  SELECT 'company' AS level, company, NULL AS period_end, NULL AS field, NULL AS subject, CASE WHEN b.company IS NULL THEN 'COMPANY_DROPPED' ELSE 'COMPANY_ADDED' END AS code, CASE WHEN b.company IS NULL THEN 'WARNING' ELSE 'INFO' END AS severity FROM co0 a FULL JOIN co1 b USING (company) WHERE a.company IS NULL OR b.company IS NULL
  UNION ALL SELECT 'company', company, NULL, NULL, NULL, CASE WHEN c2 IS NULL THEN 'ISSUER_IDENTITY_UNRESOLVED' ELSE 'ISSUER_IDENTITY_CHANGED' END, 'FAIL' FROM pair WHERE c1 IS NOT NULL AND c1 IS DISTINCT FROM c2
  UNION ALL SELECT 'company', company, NULL, NULL, NULL, CASE WHEN o2 = 'BLOCKED' THEN 'COMPANY_OVERALL_DOWNGRADE' ELSE 'COMPANY_OVERALL_UPGRADE' END, CASE WHEN o2 = 'BLOCKED' THEN 'FAIL' ELSE 'INFO' END FROM pair WHERE o1 <> o2
  UNION ALL SELECT 'company', company, NULL, NULL, unnest(list_filter(b2, lambda x: NOT list_contains(b1, x))), 'BLOCKING_ISSUE_ADDED', 'FAIL' FROM pair
  UNION ALL SELECT 'company', company, NULL, NULL, unnest(list_filter(b1, lambda x: NOT list_contains(b2, x))), 'BLOCKING_ISSUE_RESOLVED', 'INFO' FROM pair
  UNION ALL SELECT 'company', company, NULL, NULL, string_agg(period_end::VARCHAR, ', ' ORDER BY period_end), 'PERIOD_OBSERVED_LOST', 'WARNING' FROM pe0 JOIN pair USING (company) ANTI JOIN pe1 USING (company, period_end) GROUP BY company
  UNION ALL SELECT 'company', company, NULL, NULL, string_agg(period_end::VARCHAR, ', ' ORDER BY period_end), 'PERIOD_OBSERVED_ADDED', 'INFO' FROM pe1 JOIN pair USING (company) ANTI JOIN pe0 USING (company, period_end) GROUP BY company
  UNION ALL SELECT 'field', company, period_end::VARCHAR, field, NULL, CASE WHEN bad THEN 'UNUSABLE_FIELD_REMOVED' ELSE 'FIELD_LOST' END, CASE WHEN bad THEN 'INFO' ELSE 'WARNING' END FROM fi0 JOIN pair USING (company) SEMI JOIN pe1 USING (company, period_end) ANTI JOIN fi1 USING (company, period_end, field)
  UNION ALL SELECT 'field', company, period_end::VARCHAR, field, NULL, CASE WHEN p.company IS NULL THEN 'NEW_PERIOD_FIELD_OBSERVED' ELSE 'FIELD_GAINED' END, 'INFO' FROM fi1 JOIN pair USING (company) LEFT JOIN pe0 p USING (company, period_end) ANTI JOIN fi0 USING (company, period_end, field))""", (
    *[x.format(n=n) for n in (0, 1) for x in (_TREE_SIDE, _TREE_FIELDS)], "pair AS (SELECT company, a.cik AS c1, b.cik AS c2, a.overall AS o1, b.overall AS o2, a.blocking AS b1, b.blocking AS b2 FROM co0 a JOIN co1 b USING (company))"))
def release_tree(spark, sf_dir):
    """Customers as companies and their orders, by year and priority, as fields: two reports that lack different ones."""
    c, o = V.table(spark, sf_dir, "customer"), V.table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    none = lambda kind: F.lit(None).cast(kind)

    def side(n):
        companies = c.where(F.col("c_custkey") % 11 != n).select(
            F.col("c_custkey").alias("company"), F.when(F.col("c_custkey") % 31 != n, (F.col("c_nationkey") + (F.col("c_custkey") % 37 == n).cast("int")).cast("string")).alias("cik"),
            F.when(F.col("c_acctbal") > n * 3000, "SOURCE_VALIDATED").otherwise("BLOCKED").alias("overall"), F.when(F.col("c_acctbal") > n * 2000, F.array().cast("array<string>")).otherwise(F.array("c_mktsegment")).alias("blocking"),
        )
        year = F.year("o_orderdate")
        held = o.where((F.col("o_custkey") % 11 != n) & ~((F.col("o_custkey") % 7 == n) & (year == 1993 + n)) & (F.col("o_orderkey") % 13 != n))
        fields = held.groupBy(F.col("o_custkey").alias("company"), F.make_date(year, F.lit(12), F.lit(31)).alias("period_end"), F.col("o_orderpriority").alias("field")).agg((F.max("o_orderkey") % 5 == 0).alias("bad"))
        fields = fields.select("company", "period_end", "field", none(V.DECIMAL).alias("value"), F.lit("USD").alias("unit"), F.lit("c").alias("concept"), F.lit("1").alias("accession"), none("date").alias("filed"), none("timestamp").alias("available_at"), F.lit("o").alias("source_object"), F.when(F.col("bad"), "CONFLICT").otherwise("SOURCE_UNVALIDATED").alias("state"), none("array<struct<source: string, agrees: boolean>>").alias("corroborations"))
        one = c.agg(F.lit("live").alias("mode"), F.lit("v1").alias("contract"), F.lit("2024").alias("as_of"), F.lit("d").alias("digest"))
        return comparison.Report(one, c.groupBy(F.col("c_mktsegment").alias("family")).agg(F.lit("resolved").alias("state"), F.lit(True).alias("sample_complete")), companies, companies.select("company", F.lit("facts").alias("check"), F.lit("MATCH").alias("state")), fields)

    states = ("STATE_IMPROVED", "EVIDENCE_CONFLICT_INTRODUCED")  # of years whose largest order went
    return comparison.compare_reports(side(0), side(1)).where(~F.col("code").isin(*states)).select("level", "company", "period_end", "field", "subject", "code", "severity")


@query("release_gate", "SELECT bool_and(s_acctbal > 0) AS promote, count(*) AS checks, count(*) FILTER (s_acctbal <= 0) AS failed FROM supplier")
def release_gate(spark, sf_dir):
    return releases.gate(V.table(spark, sf_dir, "supplier").withColumn("ok", F.col("s_acctbal") > 0), "s_name", "ok")[0]


@query("release_gate_failed", "SELECT DISTINCT s_name FROM supplier WHERE s_acctbal <= 0")
def release_gate_failed(spark, sf_dir):
    return releases.gate(V.table(spark, sf_dir, "supplier").withColumn("ok", F.col("s_acctbal") > 0), "s_name", "ok")[1]


@query("release_inventory", """SELECT path, CASE WHEN b IS NULL THEN 'MISSING' WHEN a IS NULL THEN 'UNREGISTERED' WHEN a <> b THEN 'SIZE_MISMATCH' ELSE 'MATCH' END AS state FROM
  (SELECT o_orderkey AS path, o_custkey AS a FROM orders WHERE o_orderkey % 11 <> 0) FULL JOIN (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS b FROM orders WHERE o_orderkey % 13 <> 0) USING (path)""")  # fmt: skip
def release_inventory(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("size"))
    there = o.where("path % 13 <> 0").withColumn("size", F.when(F.col("path") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return releases.reconcile_inventory(o.where("path % 11 <> 0"), there, "path", "size")


@query("release_count_parity", "SELECT cik, metric, coalesce(a, 0) AS raw_rows, coalesce(b, 0) AS norm_rows FROM (SELECT cik, metric, count(*) AS a FROM obs GROUP BY ALL) FULL JOIN (SELECT cik, metric, count(*) AS b FROM altered GROUP BY ALL) USING (cik, metric) WHERE coalesce(a, 0) <> coalesce(b, 0)", (V.OBS, V.ALTERED))
def release_parity(spark, sf_dir):
    a = V.observations(spark, sf_dir)
    return releases.count_parity(a, V.altered(a), ["cik", "metric"])


@query("release_audit_totals", "SELECT form, a AS declared, b AS actual, 'COUNT_MISMATCH' AS code FROM (SELECT form, count(*) AS a FROM obs GROUP BY form) JOIN (SELECT form, count(*) AS b FROM altered GROUP BY form) USING (form) WHERE a <> b", (V.OBS, V.ALTERED))
def release_audit(spark, sf_dir):
    a = V.observations(spark, sf_dir)
    return releases.audit_totals(V.altered(a), a.groupBy("form").agg(F.count("*").alias("n")), "form")


_MANIFEST = ["cik", "concept", "period_start", "period_end", "value", "unit", "accession"]
_MANIFEST_MD5 = "md5(concat_ws('|', " + ", ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '~')" for c in _MANIFEST) + "))"


@query("release_manifest", f"""SELECT metric, count(*) AS rows, min(period_end)::VARCHAR AS first_day, max(period_end)::VARCHAR AS last_day, sum(('0x' || m[1:15])::HUGEINT)::HUGEINT::VARCHAR || '-' || sum(('0x' || m[16:30])::HUGEINT)::HUGEINT::VARCHAR AS digest
FROM (SELECT *, {_MANIFEST_MD5} AS m FROM obs) GROUP BY metric""", (V.OBS,))  # fmt: skip
def release_manifest(spark, sf_dir):
    """The digest covers a column that is null throughout."""
    return text(sinks.manifest(V.observations(spark, sf_dir).select("metric", *_MANIFEST), "metric", "period_end"), "first_day", "last_day")


# Sources and functions


@query("source_json_props", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def source_json(spark, sf_dir):
    e = V.table(spark, sf_dir, "events", ["event_id", "props"])
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("source_content_dedupe", """SELECT DISTINCT sha256('{"day":"' || l_shipdate::DATE::VARCHAR || '","l_linestatus":"' || l_linestatus || '","l_returnflag":"' || l_returnflag || '","l_suppkey":' || l_suppkey::VARCHAR || '}') AS id FROM lineitem""")
def source_dedupe(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").alias("day"))
    return ingest.dedupe_by_id(ingest.with_content_id(li, li.columns)).select("id")


_LINEITEM = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp"}


@query("source_describe", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls FROM lineitem" for c, t in _LINEITEM.items()))
def source_describe(spark, sf_dir):
    return ingest.describe(V.table(spark, sf_dir, "lineitem", list(_LINEITEM))).withColumn("type", F.regexp_replace("type", "timestamp_ntz", "timestamp"))


_CRC = "(xor(list_reduce(list_concat([4294967295::UBIGINT], [ascii(x)::UBIGINT FOR x IN string_split({}, '')]), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT))"


@query("source_clustered", f"SELECT s_suppkey, s_name, ({_CRC.format('s_suppkey::VARCHAR')} % 16)::INT AS g FROM supplier")
def source_clustered(spark, sf_dir):
    return sinks.with_group(V.table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"]), "s_suppkey")


@query("source_canonical", "SELECT lpad(s_suppkey::VARCHAR, 10, '0') AS cik, s_acctbal::DECIMAL(38,9)::VARCHAR AS value FROM supplier")
def source_canonical(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier").select(values.pad_id(F.col("s_suppkey")).alias("cik"), F.col("s_acctbal").alias("value"))
    return text(ingest.canonical(s, {"cik": "string", "value": V.DECIMAL}), "value")


@query("text_markdown_pages", None)
def text_markdown(spark, sf_dir):
    return documents.html_to_markdown(V.table(spark, sf_dir, "pages", ["page_id", "html"]), "page_id", "html")


@query("text_sections", "SELECT doc_id, 'full' AS item, 'Full Document' AS title, sha256(coalesce(text, '')) AS content_sha256, 0 AS start_line, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS end_line FROM documents")
def text_sections(spark, sf_dir):
    out = documents.sections(V.table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")
    return out.select("doc_id", "item", "title", F.sha2("content", 256).alias("content_sha256"), "start_line", F.col("end_line").cast("long").alias("end_line"))


def _filings(spark, sf_dir):
    """Documents in which every third line is an item: a heading, or a plain line where the id is divisible by three."""
    d = V.table(spark, sf_dir, "documents", ["doc_id", "text"])
    mark = F.when(F.col("doc_id") % 3 == 0, "ITEM ").otherwise("## Item ")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 3 == 1, F.concat(mark, (i % 14 + 1).cast("string"), F.when(i % 2 == 0, F.concat(F.lit(". "), F.substring(F.regexp_replace(x, "[^a-z]", ""), 1, 20))).otherwise(""))).otherwise(x))
    return d.select("doc_id", F.array_join(lines, "\n").alias("text"))


_TITLES = "MAP {" + ", ".join("'{}': '{}'".format(k, v.replace("'", "''")) for k, v in documents.TITLES.items()) + "}"
_FILINGS = f"""lines AS (SELECT doc_id, i, CASE WHEN i % 3 = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'ITEM ' ELSE '## Item ' END || (i % 14 + 1)::VARCHAR || CASE WHEN i % 2 = 0 THEN '. ' || name ELSE '' END ELSE x END AS line, name
  FROM (SELECT doc_id, x, i, left(regexp_replace(x, '[^a-z]', '', 'g'), 20) AS name FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))),
marks AS (SELECT doc_id, i AS s, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS e, 'Item ' || (i % 14 + 1)::VARCHAR AS item, CASE WHEN i % 2 = 0 AND name <> '' THEN name ELSE coalesce({_TITLES}[(i % 14 + 1)::VARCHAR], '') END AS title FROM lines WHERE i % 3 = 1),
items AS (SELECT m.doc_id, item, title, s AS start_line, coalesce(e, max(i) + 1) AS end_line, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS content FROM marks m JOIN lines l ON m.doc_id = l.doc_id AND i >= s AND (e IS NULL OR i < e) GROUP BY m.doc_id, item, title, s, e
  UNION ALL SELECT doc_id, 'full', 'Full Document', 0, 1, coalesce(text, '') FROM documents WHERE strpos(coalesce(text, ''), chr(10)) = 0)"""


@query("text_section_items", "SELECT doc_id, item, title, start_line, end_line, sha256(content) AS content_sha256 FROM items", (_FILINGS,))
def text_items(spark, sf_dir):
    out = documents.sections(_filings(spark, sf_dir), "doc_id", "text")
    return out.select("doc_id", "item", "title", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.sha2("content", 256).alias("content_sha256"))


@query("text_section_summary", "SELECT doc_id, count(*) AS n_sections, sum(length(content))::BIGINT AS n_chars, array_to_string([x FOR x IN ['Item 2', 'Item 5', 'full'] IF NOT list_contains(list(item), x)], ',') AS missing_items FROM items GROUP BY doc_id", (_FILINGS,))
def text_summary(spark, sf_dir):
    out = documents.section_summary(documents.sections(_filings(spark, sf_dir), "doc_id", "text"), "doc_id", ["Item 2", "Item 5", "full"])
    return out.withColumn("missing_items", F.array_join("missing_items", ","))


@query("text_table_values", """SELECT l_orderkey, 0::BIGINT AS table_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity)::INT AS row_index, 'line ' || l_linenumber AS label,
  (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * l_extendedprice::DECIMAL(20,2))::DECIMAL(38,9)::VARCHAR AS value, 1000 AS scale, (CASE WHEN l_linenumber % 2 = 0 THEN -1000 ELSE 1000 END * l_extendedprice::DECIMAL(20,2))::DECIMAL(38,9)::VARCHAR AS scaled_value FROM lineitem""")
def text_tables(spark, sf_dir):
    """A page for each order with its line items in a table, even lines as (1,234.50)."""
    li = V.table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"])
    price = F.format_number(F.col("l_extendedprice").cast("decimal(20,2)"), 2)
    cell = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("$ ("), price, F.lit(")"))).otherwise(F.concat(F.lit("$"), price))
    row = F.concat(F.lit("| line "), F.col("l_linenumber").cast("string"), F.lit(" | - | "), cell, F.lit(" |"))
    each = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_quantity", row.alias("row")))).alias("r"))  # an order's lines
    page = F.concat(F.lit("Amounts (in thousands)\n| Line | None | Price |\n| --- | --- | --- |\n"), F.array_join(F.transform("r", lambda x: x["row"]), "\n"), F.lit("\nend"))
    out = documents.table_values(each.select("l_orderkey", page.alias("page")), "l_orderkey", "page")
    return text(out.drop("raw_text"), "value", "scaled_value")


@query("text_cover_facts", """SELECT o_orderkey, unnest(['dei:TradingSymbol', 'dei:Shares']) AS name, unnest([o_orderdate::DATE::VARCHAR, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE::VARCHAR END]) AS day, unnest([NULL, (o_custkey * 1000)::VARCHAR]) AS value,
  unnest([NULL, CASE WHEN o_orderkey % 2 = 1 THEN 'DIMENSIONS' END]) AS reason FROM orders""")
def text_cover(spark, sf_dir):
    """A cover page for each order; odd ones report shares for one class."""
    o = V.table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    lit_, even = F.lit, F.col("o_orderkey") % 2 == 0
    html = F.concat(
        lit_('<xbrli:context id="c1"><xbrli:instant>'), F.col("o_orderdate").cast("date").cast("string"), lit_('</xbrli:instant></xbrli:context><xbrli:context id="c2"><x dimension="us:ClassAxis"/></xbrli:context><ix:nonNumeric name="dei:TradingSymbol" contextRef="c1">S</ix:nonNumeric>'),
        lit_('<ix:nonFraction name="dei:Shares" scale="3" contextRef="'), F.when(even, "c1").otherwise("c2"), lit_('">'), F.col("o_custkey").cast("string"), lit_("</ix:nonFraction>"),
    )
    return documents.cover_facts(o.select("o_orderkey", html.alias("html")), "o_orderkey", "html").select("o_orderkey", "name", "day", "value", "reason")


@query("text_leaks", f"SELECT doc_id, marker FROM (SELECT doc_id, unnest([{', '.join(f'CASE WHEN regexp_matches(text, $x${p}$x$) THEN {k!r} END' for k, p in values.PRIVATE.items())}]) AS marker FROM documents) WHERE marker IS NOT NULL")
def text_leaks(spark, sf_dir):
    return values.leaks(V.table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


@query("function_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def function_slug(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", values.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query("function_instants", "SELECT event_id, epoch_us(ts) * 1000 AS epoch_ns, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso FROM events")
def function_instants(spark, sf_dir):
    e = V.table(spark, sf_dir, "events", ["event_id", "ts"]).withColumn("i", temporal.parse_instant(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")))
    return e.select("event_id", F.col("i.epoch_ns").alias("epoch_ns"), temporal.iso_from_ns(F.col("i.epoch_ns"), 6).alias("iso"))


@query("function_available_at", "SELECT o_orderkey, strftime(((o_orderdate::DATE + 1)::TIMESTAMP AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS next_day FROM orders")
def function_available(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"]).withColumn("a", temporal.available_at(F.col("o_orderdate").cast("date")))
    return o.select("o_orderkey", ts("a").alias("next_day"))


@query("function_local_time", "SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') AS local FROM events")
def function_local(spark, sf_dir):
    e = V.table(spark, sf_dir, "events", ["event_id", "ts"]).withColumn("l", F.from_utc_timestamp("ts", "America/New_York"))
    back = temporal.local_to_utc(F.col("l"), "America/New_York")
    return e.where(back["status"] == "ok").select("event_id", ts("l").alias("local"))


@query("function_sessions", """SELECT event_id, d::VARCHAR AS session_date, strftime(d + INTERVAL 14 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS open_utc, strftime(d + INTERVAL 21 HOUR, '%Y-%m-%d %H:%M:%S') AS close_utc
FROM (SELECT event_id, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE AS d FROM events) WHERE isodow(d) < 6 AND d NOT IN (DATE '2023-12-25', DATE '2024-01-01', DATE '2024-01-15', DATE '2024-02-19')""")  # fmt: skip
def function_sessions(spark, sf_dir):
    days = V.table(spark, sf_dir, "events", ["event_id", "ts"]).select("event_id", F.from_utc_timestamp("ts", "America/New_York").cast("date").alias("session_date"))
    s = F.broadcast(temporal.sessions(spark, 2023, 2025))  # at most 366 rows a year
    return text(days.join(s, "session_date").select("event_id", "session_date", ts("open_utc").alias("open_utc"), ts("close_utc").alias("close_utc")), "session_date")


@query("function_numbers", "SELECT p_partkey, (CASE WHEN p_size % 5 = 1 THEN -1 ELSE 1 END * CASE p_size % 5 WHEN 2 THEN p_retailprice::DECIMAL(20,2) * 1000000 WHEN 3 THEN p_retailprice::DECIMAL(20,2)::DECIMAL(20,4) / 100 ELSE p_retailprice::DECIMAL(20,2) END)::DECIMAL(38,9)::VARCHAR AS value FROM part WHERE p_size % 5 <> 4 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 5 = 4")
def function_numbers(spark, sf_dir):
    p = V.table(spark, sf_dir, "part", ["p_partkey", "p_retailprice", "p_size"])
    n, k = F.format_number(F.col("p_retailprice").cast("decimal(20,2)"), 2), F.col("p_size") % 5
    shown = F.when(k == 0, F.concat(F.lit("$"), n)).when(k == 1, F.concat(F.lit("("), n, F.lit(")"))).when(k == 2, F.concat(n, F.lit("M"))).when(k == 3, F.concat(n, F.lit("%"))).otherwise("-")
    return text(p.select("p_partkey", values.parse_number(shown).alias("value")), "value")


@query("function_scale", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){lead}{word}{close}') THEN {n}" for lead, close in zip(values.SCALE_LEADS, ("", r"\)", ""), strict=True) for word, n in values.SCALE_WORDS) + " ELSE 1 END::BIGINT AS scale FROM (SELECT doc_id, text || CASE doc_id % 7 WHEN 0 THEN ' $ in Millions, (in thousands)' WHEN 1 THEN ' (in thousands) in billions' WHEN 2 THEN ' of millions' WHEN 3 THEN ' in  billion' ELSE '' END AS t FROM documents WHERE text IS NOT NULL)")
def function_scale(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents", ["doc_id", "text"]).where("text is not null")
    k = F.col("doc_id") % 7
    note = F.when(k == 0, " $ in Millions, (in thousands)").when(k == 1, " (in thousands) in billions").when(k == 2, " of millions").when(k == 3, " in  billion").otherwise("")
    return d.select("doc_id", values.scale_of(F.concat("text", note)).alias("scale"))


@query("function_terminating", "SELECT p_partkey, CASE WHEN (p_partkey * 1000000000) % (p_size + 1) = 0 THEN (p_partkey * 1000000000 // (p_size + 1))::BIGINT::VARCHAR END AS nanos FROM part")
def function_terminating(spark, sf_dir):
    p = V.table(spark, sf_dir, "part", ["p_partkey", "p_size"])
    t = values.terminating(F.col("p_partkey"), F.col("p_size") + 1)
    return p.select("p_partkey", (t.cast("decimal(28,9)") * F.lit(1_000_000_000)).cast("long").cast("string").alias("nanos"))


@query("function_path_role", "SELECT o_orderkey, 'ns' || (o_orderkey % 5)::VARCHAR AS namespace, CASE o_orderkey % 3 WHEN 0 THEN 'manifest' WHEN 1 THEN 'data' ELSE 'other' END AS role FROM orders")
def function_path(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, "manifest.json").when(k % 3 == 1, "part.parquet").otherwise("notes")
    p = values.path_role(F.concat_ws("/", F.concat(F.lit("ns"), (k % 5).cast("string")), k.cast("string"), name))
    return V.table(spark, sf_dir, "orders", ["o_orderkey"]).select("o_orderkey", p["namespace"].alias("namespace"), p["role"].alias("role"))


@query("function_data_as_of", "SELECT max(greatest(l_shipdate, l_shipdate + INTERVAL 1 DAY))::DATE::VARCHAR AS data_as_of FROM lineitem")
def function_as_of(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem", ["l_shipdate"]).select(F.col("l_shipdate").cast("date").alias("a"), F.date_add("l_shipdate", 1).alias("b"))
    return text(values.data_as_of(li, ["a", "b"]), "data_as_of")


# Operators that need a source of their own, made from the driver's tables


@query("source_flatten_facts", """SELECT cik, metric, concept, unit, value::VARCHAR AS value, period_end::VARCHAR AS period_end, accession FROM obs WHERE metric <> 'A' AND form <> '8-K' AND period_end <= filed""", (V.OBS,))
def source_flatten(spark, sf_dir):
    """Observations nested by issuer, taxonomy, tag and unit, then flattened to the registry's tags and admitted."""
    o = V.observations(spark, sf_dir).select("cik", "concept", "metric", "unit", F.struct(F.col("value").cast("string").alias("val"), F.lit(None).cast("string").alias("start"), F.col("period_end").cast("string").alias("end"), F.col("filed").cast("string").alias("filed"), F.col("accession").alias("accn"), "form", F.lit(None).cast("string").alias("fy"), F.lit(None).cast("string").alias("fp"), F.lit(None).cast("string").alias("frame")).alias("r"))
    units = o.groupBy("cik", "metric", "concept", "unit").agg(F.collect_list("r").alias("rows")).groupBy("cik", "metric", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "rows"))).alias("units"))
    tag = F.struct(F.col("concept"), F.struct(F.lit("l").alias("label"), F.lit("d").alias("description"), "units"))
    raw = units.groupBy("cik", "metric").agg(F.map_from_entries(F.collect_list(tag)).alias("tags")).groupBy("cik").agg(F.lit("x").alias("entityName"), F.map_from_entries(F.collect_list(F.struct("metric", "tags"))).alias("facts"))
    registry = spark.createDataFrame([(t, c, t) for t in "NR" for c in "OF"], "taxonomy string, concept string, metric string")
    good, _ = ingest.admit(ingest.flatten_facts(raw, registry), ["USD"], ["10-K", "10-Q"])
    return text(good.select("cik", "metric", "concept", "unit", "value", "period_end", F.col("accn").alias("accession")), "value", "period_end")


@query("text_reconcile", """SELECT l_orderkey, metric, CASE min(r) WHEN 0 THEN 'matched' WHEN 1 THEN 'sign_mismatch' WHEN 2 THEN 'scale_mismatch' WHEN 3 THEN 'label_mismatch' ELSE 'missing' END AS state FROM (
  SELECT f.l_orderkey, metric, CASE WHEN name = label AND abs(x - y) <= 0.005 * abs(y) THEN 0 WHEN name = label AND abs(-x - y) <= 0.005 * abs(y) THEN 1
    WHEN name = label AND (abs(x * 1e3 - y) <= 0.005 * abs(y) OR abs(x * 1e6 - y) <= 0.005 * abs(y) OR abs(x * 1e9 - y) <= 0.005 * abs(y) OR abs(x - y * 1e3) <= 0.005 * abs(y * 1e3) OR abs(x - y * 1e6) <= 0.005 * abs(y * 1e6) OR abs(x - y * 1e9) <= 0.005 * abs(y * 1e9)) THEN 2
    WHEN abs(x - y) <= 0.005 * abs(y) THEN 3 ELSE 4 END AS r
  FROM (SELECT l_orderkey, 'm' || l_linenumber AS metric, 'line ' || l_linenumber AS name, CASE k WHEN 0 THEN p WHEN 1 THEN -p WHEN 2 THEN p / 1000 WHEN 3 THEN p * 1.2 ELSE -1.001 * p END AS y
    FROM (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 5 AS k, 1000 * l_extendedprice AS p FROM lineitem)) f
  JOIN (SELECT l_orderkey, 'line ' || l_linenumber AS label, (CASE WHEN l_linenumber % 2 = 0 THEN -1000 ELSE 1000 END * l_extendedprice::DECIMAL(20,2))::DOUBLE AS x FROM lineitem) v ON f.l_orderkey = v.l_orderkey) GROUP BY ALL""")
def text_reconcile(spark, sf_dir):
    """Prices of line items as facts, some with another sign, scale or value, against the tables of the orders' pages."""
    li = V.table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"])
    k, p = (F.col("l_orderkey") + F.col("l_linenumber")) % 5, F.lit(1000) * F.col("l_extendedprice")
    y = F.when(k == 0, p).when(k == 1, -p).when(k == 2, p / 1000).when(k == 3, p * 1.2).otherwise(F.lit(-1.001) * p)
    facts = li.select("l_orderkey", F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("metric"), y.alias("value"))
    aliases = li.select(F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("metric"), F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("alias")).distinct()
    values_ = text_tables(spark, sf_dir).select("l_orderkey", "label", F.col("scaled_value").cast("decimal(38,9)").alias("scaled_value"))
    return documents.reconcile_text(facts, values_, aliases, "l_orderkey")[0]


@query("series_parse_bars", """SELECT symbol, session_date::VARCHAR AS session_date, open, high, low, close, volume::DOUBLE AS volume, CASE WHEN least(open, high, low, close) <= 0 THEN 'NOT_POSITIVE' END AS reason FROM bars""", (V.BARS,))
def series_parse(spark, sf_dir):
    """Bars as a JSON page for each symbol, stamped at noon UTC."""
    b = V.bars(spark, sf_dir)
    bar = F.struct(F.concat(F.col("session_date").cast("string"), F.lit("T12:00:00Z")).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").cast("double").alias("v"))
    pages = b.groupBy("symbol").agg(F.collect_list(bar).alias("x")).select(F.to_json(F.struct(F.create_map("symbol", "x").alias("bars"))).alias("page"))
    good, gaps = ingest.parse_bars(pages, "page")
    cols = ["symbol", "session_date", "open", "high", "low", "close", "volume"]
    return text(good.select(*cols, F.lit(None).cast("string").alias("reason")).unionByName(gaps.select(*cols, "reason")), "session_date")


@query("series_monthly", """SELECT type AS series_id, month::VARCHAR AS observation_date, v::DECIMAL(20,2)::DECIMAL(38,9)::VARCHAR AS value_decimal, CASE WHEN v IS NULL THEN 'BLANK' END AS missing_reason FROM (
  SELECT date_trunc('month', o_orderdate)::DATE AS month, unnest(['F', 'O', 'P']) AS type, unnest([sum(o_totalprice::DECIMAL(20,2)) FILTER (o_orderstatus = 'F'), sum(o_totalprice::DECIMAL(20,2)) FILTER (o_orderstatus = 'O'), sum(o_totalprice::DECIMAL(20,2)) FILTER (o_orderstatus = 'P')]) AS v FROM orders GROUP BY month)""")  # fmt: skip
def series_monthly(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders", ["o_orderdate", "o_orderstatus", "o_totalprice"]).withColumn("v", F.col("o_totalprice").cast("decimal(20,2)"))
    sheet = o.groupBy(F.date_format("o_orderdate", "yyyy'M'MM").alias("month")).agg(*[F.sum(F.when(F.col("o_orderstatus") == t, F.col("v"))).cast("string").alias(t) for t in "FOP"])
    return text(ingest.monthly_series(sheet, "month", {t: (t, "USD") for t in "FOP"}).select("series_id", "observation_date", "value_decimal", "missing_reason"), "observation_date", "value_decimal")


@query("screen_between_dates", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def screen_dates(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"]).withColumn("day", F.col("o_orderdate").cast("date"))
    return screen.between_dates(o, "day", "1996-01-01", "1997-06-30").select("o_orderkey")


@query("function_classify_period", """SELECT cik, metric, period_start::VARCHAR AS period_start, period_end::VARCHAR AS period_end, CASE WHEN d BETWEEN 330 AND 380 AND metric <> 'A' THEN 'annual' WHEN d BETWEEN 75 AND 105 THEN 'quarter' END AS kind FROM (
  SELECT DISTINCT cik, metric, period_start, period_end, period_end - period_start + 1 AS d FROM (SELECT cik, metric, period_start, period_end FROM flows UNION ALL SELECT cik, metric, period_start, period_end FROM ytd))""", (V.FLOWS, V.CUMULATIVE))  # fmt: skip
def function_classify(spark, sf_dir):
    cols = ["cik", "metric", "period_start", "period_end"]
    both = V.flows(spark, sf_dir).select(*cols).unionByName(V.cumulative(spark, sf_dir).select(*cols)).distinct()
    kind = temporal.classify_period(F.col("period_start"), F.col("period_end"), F.when(F.col("metric") == "A", "10-Q").otherwise("10-K"))
    return text(both.withColumn("kind", kind), "period_start", "period_end")


@query("quality_observation_codes", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_partkey % 11 = 0 THEN 'MISSING_ACCESSION' WHEN l_partkey % 7 = 0 THEN 'BAD_LAYER' WHEN l_returnflag = 'A' THEN 'UNIT_MISMATCH' WHEN l_linenumber = 2 THEN 'BAD_DECIMAL' WHEN l_linenumber = 3 THEN 'NULL_WITHOUT_STATUS' END AS code FROM lineitem""")
def quality_codes(spark, sf_dir):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    li = V.table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag"]).withColumns({
        "accession": F.when(p % 11 != 0, F.col("l_orderkey")), "layer": F.when(p % 7 == 0, "other").otherwise("native"), "unit": F.lit("USD"), "native_unit": F.when(F.col("l_returnflag") == "A", "EUR").otherwise("USD"),
        "value_text": F.when(n == 2, "1,000").when(n == 3, None).otherwise(F.col("l_extendedprice").cast("decimal(20,2)").cast("string")), "value_status": F.lit(None).cast("string"),
    })
    return quality.validate_observation(li, ["accession"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "code")


@query("series_inventory_ledger", """SELECT namespace, role, count(*) FILTER (o) AS objects, count(*) FILTER (o AND NOT r) AS unregistered, count(*) FILTER (NOT o) AS absent FROM (
  SELECT 'ns' || (o_orderkey % 5)::VARCHAR AS namespace, CASE o_orderkey % 3 WHEN 0 THEN 'manifest' WHEN 1 THEN 'data' ELSE 'other' END AS role, o_orderkey % 11 <> 0 AS o, o_orderkey % 13 <> 0 AS r FROM orders) WHERE o OR r GROUP BY ALL""")  # fmt: skip
def series_ledger(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, "manifest.json").when(k % 3 == 1, "part.parquet").otherwise("notes")
    paths = V.table(spark, sf_dir, "orders", ["o_orderkey"]).withColumn("path", F.concat_ws("/", F.concat(F.lit("ns"), (k % 5).cast("string")), k.cast("string"), name))
    return series.inventory_ledger(paths.where("o_orderkey % 11 <> 0"), paths.where("o_orderkey % 13 <> 0"), "path")


@query("pit_top1", "SELECT cik, metric, id FROM obs QUALIFY row_number() OVER (PARTITION BY cik, metric ORDER BY filed DESC, id DESC) = 1", (V.OBS,))
def pit_top(spark, sf_dir):
    return pit.top1(V.observations(spark, sf_dir), ["cik", "metric"], [F.desc("filed"), F.desc("id")]).select("cik", "metric", "id")


@query("join_lineage_tree", """SELECT root AS result, count(*) FILTER (NOT derived AND stored) AS sources, count(*) FILTER (NOT derived AND NOT stored) AS missing,
  CASE WHEN bool_or(root = node) THEN 'CYCLE' WHEN count(*) FILTER (NOT derived AND NOT stored) > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS state FROM (
  SELECT root, node, node IN (SELECT up FROM cites) AS derived, node IN (SELECT 'P' || p_partkey FROM part WHERE p_size > 5) AS stored FROM reached) GROUP BY root""", ("""RECURSIVE cites AS (
  SELECT 'N' || c_nationkey AS up, 'C' || c_custkey AS down FROM customer UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders UNION SELECT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem
  UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation WHERE n_regionkey = 0 UNION SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation)""", "reached AS (SELECT up AS root, down AS node FROM cites WHERE up LIKE 'N%' UNION SELECT root, down FROM reached JOIN cites ON node = up)"))
def join_lineage_tree(spark, sf_dir):
    """Nations rest on customers, these on orders, these on parts, of which small ones aren't stored; one region closes a cycle."""
    take = lambda t, *c: V.table(spark, sf_dir, t, list(c))
    ident = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    pair = lambda t, a, x, b, y: take(t, x, y).select(ident(a, x).alias("result"), ident(b, y).alias("source"))
    nation = take("nation", "n_nationkey", "n_regionkey")
    up = nation.where("n_regionkey = 0").select(ident("N", "n_nationkey").alias("result"), ident("R", "n_regionkey").alias("source"))
    parts = [pair("customer", "N", "c_nationkey", "C", "c_custkey"), pair("orders", "C", "o_custkey", "O", "o_orderkey"), pair("lineitem", "O", "l_orderkey", "P", "l_partkey"), pair("nation", "R", "n_regionkey", "N", "n_nationkey"), up]
    cites = reduce(lambda a, b: a.unionByName(b), parts)
    stored = take("part", "p_partkey", "p_size").where("p_size > 5").select(ident("P", "p_partkey").alias("source"))
    roots = cites.where("result like 'N%'").select("result")
    return joins.lineage_tree(roots, cites, stored, "result", "source")[1].select("result", "sources", "missing", "state")


@query("join_lineage_missing", "SELECT concat_ws('|', s.cik, s.metric, s.concept, s.period_end) AS result, i AS id FROM (SELECT *, unnest(ids) AS i FROM sel WHERE n = 1) s WHERE i NOT IN (SELECT id FROM altered)", (V.OBS, _LAST, V.ALTERED))
def join_lineage_missing(spark, sf_dir):
    return joins.lineage(_cited(spark, sf_dir), V.altered(V.observations(spark, sf_dir)).select("id", "accession"), "result", "source_ids", "id")[1]


@query("release_overall_moves", """SELECT c_custkey, CASE WHEN b IS NULL THEN 'COMPANY_DROPPED' WHEN a IS NULL THEN 'COMPANY_ADDED' WHEN b < a THEN 'COMPANY_OVERALL_DOWNGRADE' WHEN b > a THEN 'COMPANY_OVERALL_UPGRADE' END AS code FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN CASE WHEN c_acctbal > 0 THEN 4 ELSE 0 END END AS a, CASE WHEN c_custkey % 13 <> 0 THEN CASE WHEN c_nationkey > 12 THEN 4 ELSE 0 END END AS b FROM customer) WHERE (a IS NOT NULL OR b IS NOT NULL) AND a IS DISTINCT FROM b""")  # fmt: skip
def release_moves(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal", "c_nationkey"])
    state = lambda ok: F.when(ok, "SOURCE_VALIDATED").otherwise("BLOCKED").alias("overall")
    return releases.overall_moves(c.where("c_custkey % 11 <> 0").select("c_custkey", state(F.col("c_acctbal") > 0)), c.where("c_custkey % 13 <> 0").select("c_custkey", state(F.col("c_nationkey") > 12)), "c_custkey").select("c_custkey", "code")


def _event_stream(spark, sf_dir):
    """A new place in the shared folder, and the events as a stream."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    kind = V.table(spark, sf_dir, "events").schema
    return f"{shared}/tidemark-{uuid.uuid4().hex}", spark.readStream.schema(kind).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: a stream takes no single file


@query("stream_ingest", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY ALL")
def stream_ingest(spark, sf_dir):
    """Events as a stream, twice over by two queries: of each user the first row by content is kept for good."""
    base, stream = _event_stream(spark, sf_dir)
    rows = stream.select("user_id", "event_id")
    for i in range(2):
        upkeep.ingest_once(rows, f"{base}-once", f"{base}-progress{i}", "user_id", 8).start().awaitTermination()
    return upkeep.current(spark, f"{base}-once")


@query("stream_upsert", "SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 THEN -value ELSE value END AS value FROM events")
def stream_upsert(spark, sf_dir):
    """Events as a stream; then, by a second query with a checkpoint of its own, those of a third of the users replaced."""
    base, stream = _event_stream(spark, sf_dir)
    rows = stream.select("user_id", "event_id", "value")
    again = rows.where("user_id % 3 = 0").withColumn("value", -F.col("value"))
    for i, x in enumerate((rows, again)):
        upkeep.upsert_stream(x, f"{base}-upsert", f"{base}-progress{i}", "user_id", 8).start().awaitTermination()
    return upkeep.current(spark, f"{base}-upsert")


@query("stream_latest", "SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest(spark, sf_dir):
    """Events as a stream: the latest of each user and type is kept in a table of the shared folder."""
    base, stream = _event_stream(spark, sf_dir)
    upkeep.latest_stream(stream, f"{base}-latest", f"{base}-progress", ["user_id", "event_type"], ["ts", "event_id"], 8).start().awaitTermination()
    return upkeep.current(spark, f"{base}-latest").select("user_id", "event_type", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "value")
