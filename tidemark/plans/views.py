"""The driver's tables seen as facts, flows, bars, intervals, series and releases; as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.temporal import available_at
from tidemark.functions.values import pad_id
from tidemark.sources.ingest import scan

DECIMAL = "decimal(38,9)"


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet", columns)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as facts of suppliers, filed on the order's date."""
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_shipdate"])
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    filed = F.col("o_orderdate").cast("date")
    form = F.when(F.col("l_linenumber") % 3 == 0, "10-K").when(F.col("l_linenumber") % 3 == 1, "10-Q").otherwise("8-K")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        pad_id(F.col("l_suppkey")).alias("cik"), F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("concept"), F.lit(None).cast("date").alias("period_start"),
        F.last_day("l_shipdate").alias("period_end"), F.col("l_extendedprice").cast(DECIMAL).alias("value"), F.lit("USD").alias("unit"), F.col("l_orderkey").cast("string").alias("accession"),
        form.alias("form"), filed.alias("filed"), available_at(filed).alias("available_at"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("id"), "l_orderkey",
    )


OBS = """obs AS (
  SELECT lpad(l_suppkey::VARCHAR, 10, '0') AS cik, l_returnflag AS metric, l_linestatus AS concept, NULL::DATE AS period_start,
    last_day(l_shipdate)::DATE AS period_end, l_extendedprice::DECIMAL(38,9) AS value, 'USD' AS unit, l_orderkey::VARCHAR AS accession,
    CASE l_linenumber % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END AS form, o_orderdate::DATE AS filed,
    ((o_orderdate::DATE + 1)::TIMESTAMP AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS available_at,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS id, l_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly sums by supplier and return flag: cik, metric, concept, period_start, period_end, value."""
    li = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_returnflag", "l_extendedprice", "l_shipdate"])
    start = F.date_trunc("quarter", "l_shipdate").cast("date")
    got = li.groupBy(pad_id(F.col("l_suppkey")).alias("cik"), F.col("l_returnflag").alias("metric"), start.alias("period_start")).agg(F.sum(F.col("l_extendedprice").cast(DECIMAL)).alias("value"))
    return got.select("cik", "metric", F.lit("sales").alias("concept"), "period_start", F.date_sub(F.add_months("period_start", 3), 1).alias("period_end"), "value")


FLOWS = """flows AS (
  SELECT lpad(l_suppkey::VARCHAR, 10, '0') AS cik, l_returnflag AS metric, 'sales' AS concept, date_trunc('quarter', l_shipdate)::DATE AS period_start,
    (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period_end, sum(l_extendedprice::DECIMAL(38,9))::DECIMAL(38,9) AS value
  FROM lineitem GROUP BY ALL)"""


def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-to-date values of the flows: every period starts on 1 January."""
    from pyspark.sql import Window

    q = flows(spark, sf_dir)
    w = Window.partitionBy("cik", "metric", F.year("period_start")).orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    return q.select("cik", "metric", F.trunc("period_start", "year").alias("period_start"), "period_end", F.sum("value").over(w).alias("value"))


CUMULATIVE = """ytd AS (
  SELECT cik, metric, date_trunc('year', period_start)::DATE AS period_start, period_end,
    (sum(value) OVER (PARTITION BY cik, metric, year(period_start) ORDER BY period_end))::DECIMAL(38,9) AS value FROM flows)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the events of each user: symbol, session_date, open, high, low, close, volume."""
    e = table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"])
    at = F.struct("ts", "event_id")
    return e.groupBy(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("date").alias("session_date")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume")
    )


BARS = """bars AS (
  SELECT user_id::VARCHAR AS symbol, ts::DATE AS session_date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers over time: from each order's date to the day before the next; the last one is open."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.col("o_orderdate").cast("date")
    return o.select(F.col("o_custkey").alias("security"), F.col("o_orderpriority").alias("symbol"), day.alias("valid_from"), F.date_sub(F.lead(day).over(w), 1).alias("valid_to"))


INTERVALS = """intervals AS (
  SELECT o_custkey AS security, o_orderpriority AS symbol, o_orderdate::DATE AS valid_from,
    (lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::DATE AS valid_to FROM orders)"""

TYPES = ["click", "view", "purchase", "signup", "error"]


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide daily table of each user: a column for each event type, null where the day has none."""
    e = table(spark, sf_dir, "events", ["ts", "user_id", "event_type", "value"])
    return e.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(*[F.max(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in TYPES])


def altered(df: DataFrame) -> DataFrame:
    """A later release of the observations: some rows are gone, some have other values, units, dates or states. Columns
    that ``df`` lacks are left out."""
    k = F.col("l_orderkey")
    v = F.col("value").cast("decimal(20,2)")
    value = F.when(k % 31 == 0, -v).when(k % 37 == 0, v * 1000).when(k % 41 == 0, v + 1).when(k % 43 == 0, v * 2).when(k % 47 == 0, v * 3).otherwise(v)
    filed = F.when(k % 43 == 0, F.date_add("filed", 30)).when(k % 53 == 0, F.date_sub("filed", 5)).otherwise(F.col("filed"))
    unit = F.when(k % 59 == 0, "EUR").otherwise(F.col("unit"))
    new = {"value": value.cast(DECIMAL), "filed": filed, "unit": unit}
    return df.where(k % 29 != 0).withColumns({c: x for c, x in new.items() if c in df.columns})


ALTERED = """altered AS (
  SELECT * REPLACE (
    (CASE WHEN l_orderkey % 31 = 0 THEN -v WHEN l_orderkey % 37 = 0 THEN v * 1000 WHEN l_orderkey % 41 = 0 THEN v + 1 WHEN l_orderkey % 43 = 0 THEN v * 2
      WHEN l_orderkey % 47 = 0 THEN v * 3 ELSE v END)::DECIMAL(38,9) AS value,
    (CASE WHEN l_orderkey % 43 = 0 THEN filed + 30 WHEN l_orderkey % 53 = 0 THEN filed - 5 ELSE filed END)::DATE AS filed,
    CASE WHEN l_orderkey % 59 = 0 THEN 'EUR' ELSE unit END AS unit)
  FROM (SELECT *, value::DECIMAL(20,2) AS v FROM obs) WHERE l_orderkey % 29 <> 0)"""
