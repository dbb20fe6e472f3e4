"""Hand-made cases of the operators, by family."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal as D
from decimal import getcontext
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exact, temporal, values
from tidemark.operators import claims, comparison, derive, joins, pit, quality, ranges, releases, screen, series
from tidemark.sources import documents, ingest, sinks
from tidemark.streaming import upkeep

day = dt.date.fromisoformat


def at(s):
    return dt.datetime.fromisoformat(s)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def one(spark, c, **kinds):
    """The value of a column over literals."""
    return spark.range(1).select(c.alias("x")).first()["x"]


def lit(v, kind=None):
    return F.lit(v).cast(kind) if kind else F.lit(v)


# Instants and numbers


@pytest.mark.parametrize(("text", "ns", "precision"), [
    ("2026-09-17T20:50:00.123456789Z", 1789678200123456789, "nanosecond"), ("2026-09-17T16:50:00-04:00", 1789678200000000000, "second"), ("2026-09-17T13:50:00-07:00", 1789678200000000000, "second"),
    ("2026-09-17T20:50:00.123456Z", 1789678200123456000, "microsecond"), ("1969-12-31T23:59:59.500000Z", -500000000, "microsecond"), ("2040-01-01T00:00:00Z", 2208988800000000000, "second"),
    ("2026-09-17T20:50:00", None, None), ("2026-09-17", None, None), ("", None, None), (None, None, None),
])
def test_instants(spark, text, ns, precision):
    got = one(spark, temporal.parse_instant(lit(text, "string")))
    assert (got and (got["epoch_ns"], got["precision"])) == (ns and (ns, precision))


def test_equal_offsets_and_iso(spark):
    a, b = (one(spark, temporal.parse_instant(lit(t)))["epoch_ns"] for t in ("2026-09-17T17:00:00Z", "2026-09-17T12:00:00-05:00"))
    assert a == b
    assert one(spark, temporal.iso_from_ns(lit(-500000000, "long"), 6)) == "1969-12-31T23:59:59.500000Z"
    assert one(spark, temporal.iso_from_ns(lit(1789678200123456789, "long"))) == "2026-09-17T20:50:00.123456789Z"
    assert one(spark, temporal.iso_from_ns(lit(2208988800000000000, "long"), 0)) == "2040-01-01T00:00:00Z"


def test_availability_policies(spark):
    d = lit("2025-05-20", "date")
    assert one(spark, temporal.available_at(d)) == at("2025-05-21T04:00:00")
    assert one(spark, temporal.available_at(lit("2025-01-10", "date"))) == at("2025-01-11T05:00:00")
    assert one(spark, temporal.available_at(lit("2026-09-17", "date"), "end_of_day")) == at("2026-09-17T23:59:59.999999")
    assert one(spark, temporal.available_at(lit("2025-05-20 01:02:03"), "instant")) == at("2025-05-20T01:02:03")
    with pytest.raises(ValueError):
        temporal.available_at(d, "whenever")


@pytest.mark.parametrize(("local", "status"), [("2026-03-08 02:30:00", "nonexistent"), ("2026-11-01 01:30:00", "ambiguous"), ("2026-11-01 00:30:00", "ok"), ("2026-07-01 12:00:00", "ok")])
def test_local_time(spark, local, status):
    got = one(spark, temporal.local_to_utc(lit(local, "timestamp"), "America/New_York"))
    assert got["status"] == status and (got["utc"] is None) == (status != "ok")


def test_sessions(spark):
    got = {r["session_date"]: r for r in temporal.sessions(spark, 2023, 2024).collect()}
    shut = "2023-01-02 2023-01-16 2023-02-20 2023-04-07 2023-05-29 2023-06-19 2023-07-04 2023-09-04 2023-11-23 2023-12-25 2024-01-01 2024-03-29 2024-06-19 2024-12-25 2024-06-01".split()
    assert not [d for d in shut if day(d) in got]
    assert len([d for d in got if d.year == 2023]) == 250 and len([d for d in got if d.year == 2024]) == 252
    assert {d.isoformat() for d, r in got.items() if r["early_close"]} == {"2023-07-03", "2023-11-24", "2024-07-03", "2024-11-29", "2024-12-24"}
    assert got[day("2024-03-08")]["open_utc"] == at("2024-03-08T14:30:00") and got[day("2024-03-11")]["close_utc"] == at("2024-03-11T20:00:00")


@pytest.mark.parametrize(("start", "end", "form", "evidence", "want"), [
    (None, "2020-12-31", "10-K", False, "instant"), ("2020-01-01", "2020-12-31", "10-K", False, "annual"), ("2020-01-01", "2020-12-31", "10-Q", False, None), ("2020-01-01", "2020-03-31", "10-Q", False, "quarter"),
    ("2020-01-01", "2020-04-28", "10-Q", False, None), ("2020-01-01", "2020-04-28", "10-Q", True, "quarter"), ("2020-01-01", "2020-06-30", "10-Q", True, None),
])
def test_classify_period(spark, start, end, form, evidence, want):
    assert one(spark, temporal.classify_period(lit(start, "date"), lit(end, "date"), lit(form), lit(evidence))) == want


@pytest.mark.parametrize(("text", "want"), [("1.5", True), ("-0", True), ("1e3", True), ("1E-9", True), ("1e-10", False), ("01", False), ("NaN", False), ("Infinity", False), ("", False), ("1,000", False), (None, False), ("1" * 30, False)])
def test_decimal_token(spark, text, want):
    assert one(spark, values.decimal_token(lit(text, "string"))) is want


@pytest.mark.parametrize(("text", "want"), [("1.500", "1.5"), ("-0.000", "0"), ("100", "100"), ("1e3", "1000"), ("0.000000001", "0.000000001"), (None, None)])
def test_plain(spark, text, want):
    assert one(spark, values.plain(lit(text, "string"))) == want


@pytest.mark.parametrize(("text", "want"), [
    ("$1,234.56", "1234.56"), ("(1,234)", "-1234"), ("-1234", "-1234"), ("1.2M", "1200000"), ("1.2B", "1200000000"), ("3K", "3000"), ("2t", "2000000000000"), ("5%", "0.05"), ("(5%)", "-0.05"), ("-$5", "-5"),
    ("$ (7)", "-7"), (" 8 ", "8"), (".5", "0.5"), ("-", None), ("—", None), ("(5", None), ("abc", None), ("", None), ("1.2.3", None), (None, None),
])
def test_parse_number(spark, text, want):
    got = one(spark, values.parse_number(lit(text, "string")))
    assert got == (None if want is None else D(want))


@pytest.mark.parametrize(("text", "want"), [
    ("hundreds of millions of people", 1), ("$ in millions; market in billions", 10**6), ("(in thousands) and then in billions", 1000), ("amounts In Billions", 10**9), ("$ in thousand", 1000), ("within millions", 1), ("", 1), (None, 1),
])
def test_scale(spark, text, want):
    assert one(spark, values.scale_of(F.coalesce(lit(text, "string"), F.lit("")))) == want


def test_public_and_leaks(spark):
    texts = ["plain words", "see s3://x/y", "Bearer abcdefgh1", "a" * 32, "password: x", "api_key=1", "f" * 31, "dir/part.parquet", None]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, t string, secret_col int")
    assert rows(values.leaks(df, "id", "t")) == [(1, "uri"), (2, "bearer"), (3, "digest"), (4, "secret"), (5, "secret"), (7, "path")]
    assert values.public(df, ["secret_col", "absent"]).columns == ["id", "t"]


# Filing text


def text_df(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


def test_sections_by_heading_and_plain(spark):
    marked = "intro\n## Item 1. Business\nwe make\nthings\n\n### ITEM 1A\nrisks\nItem 2. not a heading"
    plain = "x\nItem 7: Discussion here\nbody\nITEM 8\nnumbers"
    got = rows(documents.sections(text_df(spark, marked, plain, "no items\nhere", None), "id", "t"))
    assert got == [
        (0, "Item 1", "Business", "## Item 1. Business\nwe make\nthings", 1, 5), (0, "Item 1A", "Risk Factors", "### ITEM 1A\nrisks\nItem 2. not a heading", 5, 8),
        (1, "Item 7", "Discussion here", "Item 7: Discussion here\nbody", 1, 3), (1, "Item 8", "Financial Statements and Supplementary Data", "ITEM 8\nnumbers", 3, 5),
        (2, "full", "Full Document", "no items\nhere", 0, 2), (3, "full", "Full Document", "", 0, 1),
    ]


def test_sections_drop_a_table_of_contents(spark):
    head = [f"Item {i}. T{i}" for i in range(1, 5)]
    body = [x for i in range(1, 5) for x in (f"Item {i}. T{i}", *["text"] * 60)]
    long, short = "\n".join(head + body), "\n".join(head + body[:100])
    got = documents.sections(text_df(spark, long, short), "id", "t")
    n = {r["id"]: r["n"] for r in got.groupBy("id").agg(F.count("*").alias("n")).collect()}
    # the first real heading of the long text is within its first fifth and goes with the contents
    assert n == {0: 3, 1: 6}
    summary = documents.section_summary(got, "id", ["Item 1", "Item 4"])
    assert rows(summary, "id", "n_sections", "missing_items") == [(0, 3, ["Item 1"]), (1, 6, [])]


def test_sections_of_repeated_and_null_ids(spark):
    t = "Item 1. A\nx\nItem 2. B\ny"
    df = spark.createDataFrame([(1, t), (1, t), (None, t)], "id long, t string")
    got = rows(documents.sections(df, "id", "t"), "id", "item", "end_line")
    assert got == sorted([(1, "Item 1", 2), (1, "Item 2", 4)] * 2 + [(None, "Item 1", 2), (None, "Item 2", 4)], key=str)


TABLE = "Amounts (in thousands)\n| Item | 2020 | 2019 |\n| --- | --- | --- |\n| Revenue | $1,234 | 5 |\n| Loss | - | (7) |\n| Note | text |\nafter\n| only header |\nx\n| A | B |\n| B \\| C | 5% |"


def test_table_values(spark):
    df = spark.createDataFrame([(1, TABLE), (1, TABLE), (None, TABLE), (2, None), (3, "no table")], "id long, t string")
    got = rows(documents.table_values(df, "id", "t"), "id", "table_index", "row_index", "label", "raw_text", "value", "scale", "scaled_value")
    each = [(0, 1, "Revenue", "$1,234", D(1234), 1000, D(1234000)), (0, 2, "Loss", "(7)", D(-7), 1000, D(-7000)), (2, 1, "B \\| C", "5%", D("0.05"), 1000, D(50))]
    assert got == sorted([(1, *e) for e in each] * 2 + [(None, *e) for e in each], key=str)


def test_markdown_and_cover_facts(spark):
    html = "<html><head><title>t</title></head><body><h1>Top</h1><p>Item 1. Business</p><script>x</script><table><tr><th>A</th><th>B|C</th></tr><tr><td>x</td><td> 1 </td></tr></table>tail</body>"
    got = rows(documents.html_to_markdown(spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, h string"), "id", "h"))
    assert got == [(1, "# Top\n## Item 1. Business\n| A | B\\|C |\n| --- | --- |\n| x | 1 |\ntail"), (2, None), (3, "")]
    page = """<xbrli:context id="c1"><xbrli:instant>2024-01-31</xbrli:instant></xbrli:context><xbrli:context id="c2"><xbrldi:explicitMember dimension="us:ClassAxis">x</xbrldi:explicitMember></xbrli:context>
    <ix:nonNumeric name="dei:TradingSymbol" contextRef="c1">AB<b>C</b></ix:nonNumeric><ix:nonFraction name="dei:Shares" contextRef="c1" unitRef="shares" scale="3">1,234.5</ix:nonFraction>
    <ix:nonFraction name="dei:Shares" contextRef="c2" unitRef="shares">5</ix:nonFraction><ix:nonFraction name="x" contextRef="c9">5</ix:nonFraction><ix:nonFraction name="y" contextRef="c1" sign="-">7</ix:nonFraction><ix:nonFraction name="z" contextRef="c1">n/a</ix:nonFraction>"""
    got = rows(documents.cover_facts(spark.createDataFrame([(1, page), (2, None)], "id long, h string"), "id", "h"), "name", "day", "text", "value", "reason")
    assert got == sorted([("dei:TradingSymbol", "2024-01-31", "AB C", None, None), ("dei:Shares", "2024-01-31", "1,234.5", "1234500", None), ("dei:Shares", None, "5", "5", "DIMENSIONS"), ("x", None, "5", "5", "UNKNOWN_CONTEXT"), ("y", "2024-01-31", "7", "-7", None), ("z", "2024-01-31", "n/a", None, "NOT_A_NUMBER")], key=str)


def test_reconcile_text(spark):
    values_ = spark.createDataFrame([(1, "Revenue", 1000.0), (1, "Net loss", -50.0), (1, "Assets", 7.0), (1, "Other", 33.0)], "id long, label string, scaled_value double")
    facts = spark.createDataFrame([(1, "revenue", 1001.0), (1, "net", 50.0), (1, "assets", 7000.0), (1, "cash", 33.0), (1, "debt", 99.0), (2, "revenue", 5.0)], "id long, metric string, value double")
    names = spark.createDataFrame([("revenue", "revenue"), ("net", "net loss"), ("assets", "assets"), ("cash", "cash"), ("debt", "debt")], "metric string, alias string")
    detail, status = documents.reconcile_text(facts, values_, names, "id")
    assert rows(detail) == [(1, "assets", "scale_mismatch"), (1, "cash", "label_mismatch"), (1, "debt", "missing"), (1, "net", "sign_mismatch"), (1, "revenue", "matched"), (2, "revenue", "missing")]
    assert rows(status) == [(1, 0.2, "fail"), (2, 0.0, "fail")]


# Sources


def fact(val, **more):
    return {"val": val, "start": "2020-01-01", "end": "2020-12-31", "filed": "2021-02-01", "accn": "a", "form": "10-K", "fy": "2020", "fp": "FY", "frame": None, **more}


def test_flatten_and_admit(spark):
    tag = lambda unit, *facts: {"label": "l", "description": "d", "units": {unit: list(facts)}}
    raw = [
        {"cik": "1", "entityName": "One", "facts": {"us-gaap": {"Revenues": tag("USD", fact("100.50"), fact(None), fact("NaN"), fact("7", end="2022-01-01"), fact("8", form="S-1"), fact("9", end="x")), "Other": tag("EUR", fact("3"))}, "dei": {"Shares": tag("shares", fact("5", start=None))}}},
        {"cik": "2", "entityName": "Two", "facts": {}}, {"cik": "3", "entityName": "Three", "facts": None},
    ]
    df = spark.createDataFrame(raw, ingest.FACTS)
    every = ingest.flatten_all(df)
    assert every.count() == 8 and rows(ingest.flatten_all(df, "GAAP", "oth"), "concept", "unit", "val") == [("Other", "EUR", "3")]
    assert rows(ingest.namespace_counts(every)) == sorted([("us-gaap", 7), ("dei", 1), (None, 8)], key=str)
    registry = spark.createDataFrame([("us-gaap", "Revenues", "revenue", 1, "x"), ("us-gaap", "Other", "revenue", 2, "x")], "taxonomy string, concept string, metric string, concept_priority int, unit string")
    found = ingest.flatten_facts(df, registry)
    assert found.count() == 7 and {r["metric"] for r in found.collect()} == {"revenue"}
    good, bad = ingest.admit(found, ["USD"], ["10-K"])
    assert rows(good, "value", "period_start", "period_end", "filed_date") == [(D("100.50"), day("2020-01-01"), day("2020-12-31"), day("2021-02-01"))]
    assert rows(bad, "reason") == [(r,) for r in sorted(["MISSING_VALUE", "NON_FINITE_VALUE", "END_AFTER_FILING", "UNSUPPORTED_FORM", "INCOMPLETE_CONTEXT", "UNSUPPORTED_UNIT"])]
    assert rows(ingest.rejection_counts(bad, "cik"), "n") == [(1,)] * 6


def test_content_ids(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (None, "a")], "a int, b string")
    got = ingest.with_content_id(df, ["b", "a"])
    assert ingest.dedupe_by_id(got).count() == 3 and {len(r["id"]) for r in got.collect()} == {64}
    assert rows(ingest.with_content_id(df, ["a", "b"]), "id") == rows(got, "id")


def test_wide_and_monthly_series(spark):
    wide = spark.createDataFrame([("2024-01-02", "5.1", "N/A"), ("2024-01-03", "", "x")], "Date string, `1 Mo` string, `10 Yr` string")
    assert rows(ingest.unpivot_series(wide, "Date", {"1 Mo": "m1", "10 Yr": "y10"})) == [
        ("m1", day("2024-01-02"), D("5.1"), None), ("m1", day("2024-01-03"), None, "BLANK_OR_NOT_AVAILABLE"), ("y10", day("2024-01-02"), None, "BLANK_OR_NOT_AVAILABLE"), ("y10", day("2024-01-03"), None, "NOT_A_NUMBER"),
    ]
    with pytest.raises(ValueError):
        ingest.unpivot_series(wide, "Date", {"1 Mo": "m1"})
    sheet = spark.createDataFrame([("1960M01", "1.5", "#N/A"), ("1960M02", "..", "word"), ("1960M12", None, "0")], "month string, oil string, gold string")
    assert rows(ingest.monthly_series(sheet, "month", {"oil": ("Crude oil", "$/bbl"), "gold": ("Gold", "$/oz")})) == sorted([
        ("oil", "Crude oil", "$/bbl", day("1960-01-01"), D("1.5"), None), ("oil", "Crude oil", "$/bbl", day("1960-02-01"), None, "BLANK"), ("oil", "Crude oil", "$/bbl", day("1960-12-01"), None, "BLANK"),
        ("gold", "Gold", "$/oz", day("1960-01-01"), None, "CELL_ERROR"), ("gold", "Gold", "$/oz", day("1960-02-01"), None, "NOT_A_NUMBER"), ("gold", "Gold", "$/oz", day("1960-12-01"), D(0), None),
    ], key=str)


def test_bars_from_pages(spark):
    page = '{"bars": {"AB": [{"t": "2024-01-03T04:59:00Z", "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10, "vw": 1.2, "n": 3}, {"t": "2024-01-03T05:00:00Z", "o": 1, "h": 2, "l": 1.5, "c": 1.5, "v": 10}, {"t": "2024-01-04T15:00:00Z", "o": 0, "h": 2, "l": 0, "c": 1, "v": 1}, {"t": "2024-01-05T15:00:00Z", "o": 3, "h": 2, "l": 1, "c": 1, "v": 1}, {"t": "2024-01-06T15:00:00Z", "o": 1, "h": 2, "l": 1, "c": 1, "v": -1}, {"t": "2024-01-07T15:00:00Z", "o": 1, "h": 2, "l": 1, "v": 1}]}}'
    good, gaps = ingest.parse_bars(spark.createDataFrame([(page,), ("no page",), (None,)], "p string"), "p")
    assert rows(good, "symbol", "session_date", "open", "vwap", "transactions") == [("AB", day("2024-01-02"), 1.0, 1.2, 3)]
    assert rows(gaps, "session_date", "reason") == [(day("2024-01-03"), "LOW_ABOVE"), (day("2024-01-04"), "NOT_POSITIVE"), (day("2024-01-05"), "HIGH_BELOW"), (day("2024-01-06"), "NEGATIVE_VOLUME"), (day("2024-01-07"), "NULL_FIELD")]
    odd = spark.createDataFrame([(1.0, float("inf"), 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0, 1.0)], "open double, high double, low double, close double, volume double")
    assert rows(ingest.split_bars(odd)[1], "reason") == [("NON_FINITE",)] * 2


def test_native_prices(spark):
    df = spark.createDataFrame([(-5.0, None, 1.0), (None, 0.1, None), (3.0, 0.0, 2.0)], "prc double, ret double, vol double")
    got = rows(ingest.native_price_point(df, "prc", ["ret", "vol"]), "magnitude", "bid_ask_average", "missing")
    assert got == sorted([(5.0, True, {"ret": "NOT_REPORTED"}), (None, False, {"prc": "NOT_REPORTED", "vol": "NOT_REPORTED"}), (3.0, False, {})], key=str)


def test_releases_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a", day("2024-01-01"), 1), ("a", day("2024-01-02"), 2), ("b", day("2024-01-03"), None)], "k string, d date, v int")
    sinks.write_release(df, f"{tmp_path}/r", "k", "d")
    assert spark.read.parquet(f"{tmp_path}/r/data").count() == 3
    written = spark.read.parquet(f"{tmp_path}/r/manifest")
    assert rows(written, "k", "rows", "first_day", "last_day") == [("a", 2, day("2024-01-01"), day("2024-01-02")), ("b", 1, day("2024-01-03"), day("2024-01-03"))]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_release(df, f"{tmp_path}/r", "k", "d")
    ids = {sinks.release_id(sinks.manifest(x, "k", "d"), "k").first()[0] for x in (df, df.repartition(3), df.orderBy(F.desc("v")))}
    other = sinks.release_id(sinks.manifest(df.withColumn("v", F.lit(9)), "k", "d"), "k").first()[0]
    assert len(ids) == 1 and other not in ids


def test_clustered_tables(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").cast("string").alias("cik"), "id")
    sinks.write_clustered(df, f"{tmp_path}/c", "cik", 8, ["cik"])
    back = spark.read.parquet(f"{tmp_path}/c")
    assert back.count() == 1000 and back.where(F.col("g") != F.crc32("cik") % 8).count() == 0 and back.select("g").distinct().count() == 8
    sinks.write_clustered(df.where("false"), f"{tmp_path}/none", "cik")


# Point in time


OBS = "cik string, metric string, concept string, period_start date, period_end date, value decimal(38,9), available_at timestamp, accession string, id string"


def obs(spark, *items):
    base = {"cik": "1", "metric": "m", "concept": "c", "period_start": None, "period_end": day("2020-12-31"), "value": D(1), "available_at": at("2021-01-01"), "accession": "a", "id": "i"}
    return spark.createDataFrame([tuple({**base, **x}.values()) for x in items], OBS)


def test_latest_revision_filters_before_it_ranks(spark):
    df = obs(spark, {"id": "1", "value": D(1)}, {"id": "2", "value": D(2), "available_at": at("2021-06-01")}, {"id": "3", "available_at": None}, {"id": "4", "cik": "2", "available_at": at("2022-01-01")})
    order = ["available_at", "accession", "id"]
    assert rows(pit.latest_revision(df, pit.CONTEXT, order, lit("2021-03-01", "timestamp")), "id") == [("1",)]
    assert rows(pit.latest_revision(df, pit.CONTEXT, order, lit("2021-06-01", "timestamp")), "id", "value") == [("2", D(2))]
    top = pit.top1(pit.available_as_of(df, lit("2021-06-01", "timestamp")), pit.CONTEXT, [F.desc(c) for c in order])
    assert rows(top) == rows(pit.latest_revision(df, pit.CONTEXT, order, lit("2021-06-01", "timestamp")))


def test_selection_conflicts_and_nulls(spark):
    same = [{"id": "1"}, {"id": "2"}]
    unequal = [{"cik": "2", "id": "3"}, {"cik": "2", "id": "4", "value": D(5)}]
    null = [{"cik": "3", "id": "5", "value": None}, {"cik": "3", "id": "6"}]
    nulls = [{"cik": "4", "id": "7", "value": None}, {"cik": "4", "id": "8", "value": None}]
    settled = [{"cik": "5", "id": "9"}, {"cik": "5", "id": "10", "value": D(2)}, {"cik": "5", "id": "11", "value": D(3), "available_at": at("2021-02-01")}]
    good, gaps = pit.select_or_conflict(obs(spark, *same, *unequal, *null, *nulls, *settled), pit.CONTEXT)
    assert rows(good, "cik", "value", "id", "source_ids") == [("1", D(1), "1", ["1", "2"]), ("4", None, "7", ["7", "8"]), ("5", D(3), "11", ["11"])]
    assert rows(gaps, "cik", "reason") == [("2", "CONFLICTING_SOURCE_VALUES"), ("3", "CONFLICTING_SOURCE_VALUES")]
    kept, blocked = pit.block_by_rejected(good, obs(spark, {"available_at": at("2021-01-01")}, {"cik": "5"}), pit.CONTEXT)
    assert rows(kept, "cik") == [("4",), ("5",)] and rows(blocked, "cik", "reason") == [("1", "BLOCKED_BY_NEWER_INVALID")]


def test_ambiguity_and_concepts(spark):
    df = obs(spark, {"id": "1"}, {"id": "2", "value": D(2)}, {"cik": "2", "id": "3"}, {"cik": "2", "id": "4", "available_at": None}, {"cik": "3", "id": "5"})
    assert rows(pit.ambiguity(df, ["cik"], ["value"]), "cik", "reason") == [("1", "AMBIGUOUS_REVISION"), ("2", "UNKNOWN_AVAILABILITY")]
    rank = df.withColumns({"p": F.lit(1), "concept": F.col("id")}).withColumn("p", F.when(F.col("id") == "2", 0).otherwise(1))
    best = pit.pick_by_priority(rank, ["cik"], "p", "available_at", "id")
    assert rows(best, "cik", "id", "superseded") == [("1", "2", ["1"]), ("2", "3", ["4"]), ("3", "5", [])]
    merged, gaps = pit.merge_concepts(rank, ["cik"], "p")
    assert rows(merged, "cik") == [("2",), ("3",)] and rows(gaps) == [("1", "AMBIGUOUS_CONCEPTS")]


def test_void_overlaps_reach_what_cites_them(spark):
    df = spark.createDataFrame([("1", day("2020-01-01"), day("2020-03-31"), ["a"]), ("1", day("2020-02-01"), day("2020-03-31"), ["b"]), ("1", day("2020-01-01"), day("2020-12-31"), ["a", "z"]), ("1", day("2021-01-01"), day("2021-03-31"), ["y"])], "cik string, period_start date, period_end date, source_ids array<string>")
    kept, gone = pit.void_overlaps(df, ["cik"])
    assert rows(kept, "source_ids") == [(["y"],)] and gone.count() == 3


def test_releases_at_an_instant(spark):
    rel = spark.createDataFrame([("d", "r1", at("2020-01-01")), ("d", "r2", at("2021-01-01")), ("e", "r3", at("2022-01-01"))], "dataset_id string, release_id string, published_at timestamp")
    assert rows(pit.select_release(rel, "dataset_id", lit("2020-06-01", "timestamp")), "dataset_id", "release_id", "status") == [("d", "r1", "SELECTED"), ("e", None, "NO_RELEASE_AS_OF")]


def test_long_quarters(spark):
    ends = ["2020-04-25", "2020-07-18", "2020-10-10", "2020-12-31"]  # 116, 84, 84 and 82 days
    row = lambda k, e, when, form: (k, day("2020-01-01"), day(e), at(when), form)
    data = [row("1", e, f"2021-0{i + 1}-01", "10-K" if i == 3 else "10-Q") for i, e in enumerate(ends)] + [row("2", e, "2021-01-01", "10-K") for e in ends[:3]]
    data += [row("3", e, "2021-01-01", "10-Q") for e in ends] + [row("4", e, "2021-01-01", "10-Q") for e in ends] + [row("4", ends[3], "2021-06-01", "10-K/A")]  # the year of a 10-Q; and of an amendment later
    df = spark.createDataFrame(data, "cik string, period_start date, period_end date, available_at timestamp, form string")
    found = lambda *key: (*key[:1], day("2020-01-01"), day("2020-04-25"), at(key[1]))
    assert rows(pit.infer_long_quarters(df, ["cik"])) == [found("1", "2021-04-01"), found("4", "2021-06-01")]
    assert rows(pit.infer_long_quarters(df, ["cik"], form=None)) == [found("1", "2021-04-01"), found("3", "2021-01-01"), found("4", "2021-01-01")]


def test_fiscal_periods_and_leakage(spark):
    df = spark.createDataFrame([("1", day("2020-06-30"), "FY"), ("1", day("2021-06-30"), "FY"), ("1", day("2020-09-30"), "Q1"), ("2", day("2020-03-31"), "Q1")], "cik string, period_end date, fp string")
    assert rows(pit.match_fiscal_period(df, "cik"), "cik", "period_end", "label") == [("1", day("2020-06-30"), "FY2020"), ("1", day("2020-09-30"), "Q1 2021"), ("1", day("2021-06-30"), "FY2021"), ("2", day("2020-03-31"), None)]
    seen = spark.createDataFrame([(1, at("2020-01-02"), [at("2020-01-01")]), (2, at("2020-01-02"), [at("2020-01-03")]), (3, None, []), (4, at("2021-01-01"), None)], "id int, available_at timestamp, ins array<timestamp>")
    assert rows(pit.leakage(seen, lit("2020-06-01", "timestamp"), inputs="ins"), "id", "violation") == [(2, "BEFORE_INPUT"), (3, "NO_AVAILABILITY"), (4, "AFTER_CUTOFF")]
    got = pit.dated_observations(obs(spark, *[{"id": str(i), "period_end": day(f"2020-0{i}-01")} for i in range(1, 6)]).withColumn("filed", F.col("period_end")), ["cik"], lit("2020-04-15", "date"), 2)
    assert rows(got, "id", "rank") == [("3", 2), ("4", 1)]
    assert rows(pit.revisions(obs(spark, {"id": "b", "available_at": at("2021-02-01")}, {"id": "a"}), ["cik"]), "id", "revision") == [("a", 1), ("b", 2)]


# Derivations


def periods(spark, *items):
    return spark.createDataFrame([(k, m, day(s), day(e), None if v is None else D(v)) for k, m, s, e, v in items], "cik string, metric string, period_start date, period_end date, value decimal(38,9)")


def test_linear_combinations(spark):
    df = spark.createDataFrame([("r", "a", 1, D("5.000000001"), "USD", at("2020-01-01")), ("r", "a", 1, D("5.000000001"), "USD", at("2020-01-01")), ("r", "b", -1, D(3), "USD", at("2020-02-01")), ("r", "c", 1, D(9), "USD", at("2020-03-01")), ("r", "c", -1, D(9), "USD", at("2020-03-01")), ("u", "a", 1, D(1), "USD", None), ("u", "b", 1, D(1), "EUR", None), ("n", "a", 1, None, "USD", None)], "r string, id string, coefficient int, value decimal(38,9), unit string, available_at timestamp")
    got = {x["r"]: x for x in derive.linear_combine(df, "r").collect()}
    assert got["r"]["value"] == D("7.000000002") and [tuple(t) for t in got["r"]["terms"]] == [("a", 2), ("b", -1)] and got["r"]["available_at"] == at("2020-03-01")
    assert got["u"]["reason"] == "UNIT_MISMATCH" and got["n"]["reason"] == "MISSING_VALUE" and got["n"]["value"] is None


def test_decumulate(spark):
    chain = [("1", "ocf", "2020-01-01", e, v) for e, v in (("2020-03-31", 10), ("2020-06-30", 25), ("2020-09-30", 45), ("2020-12-31", 70))]
    missing = [("2", "ocf", "2020-01-01", e, v) for e, v in (("2020-03-31", 10), ("2020-09-30", 45))]
    two = [("3", "ocf", "2020-01-01", e, 10) for e in ("2020-03-31", "2020-04-02", "2020-06-30")]
    capex = [("4", "capex", "2020-01-01", "2020-03-31", 10), ("4", "capex", "2020-01-01", "2020-06-30", 8)]
    clash = [("5", "ocf", "2020-01-01", "2020-03-31", 10), ("5", "ocf", "2020-01-01", "2020-06-30", 30), ("5", "ocf", "2020-04-01", "2020-06-30", 21)]
    null = [("6", "ocf", "2020-01-01", "2020-03-31", None), ("6", "ocf", "2020-01-01", "2020-06-30", 30)]
    long = [("7", "ocf", "2020-01-01", "2020-03-31", 1), ("7", "ocf", "2020-01-01", "2020-07-20", 4)]
    df = periods(spark, *chain, *missing, *two, *capex, *clash, *null, *long)
    good, gaps = derive.decumulate(df, ["cik", "metric"], non_negative=["capex"])
    assert sorted(rows(good.where("cik = '1'"), "period_start", "value")) == [(day("2020-01-01"), D(10)), (day("2020-04-01"), D(15)), (day("2020-07-01"), D(20)), (day("2020-10-01"), D(25))]
    assert rows(gaps, "cik", "reason") == [("2", "NO_PREDECESSOR"), ("3", "AMBIGUOUS_PREDECESSOR"), ("4", "NEGATIVE_FLOW"), ("5", "CONFLICTING_QUARTER"), ("6", "MISSING_VALUE"), ("7", "NO_PREDECESSOR")]
    assert rows(derive.decumulate(df.where("cik = '7'"), ["cik", "metric"], most=120)[0].where("derived"), "value") == [(D(3),)]


def test_ttm(spark):
    q = [("2020-01-01", "2020-03-31"), ("2020-04-01", "2020-06-30"), ("2020-07-01", "2020-09-30"), ("2020-10-01", "2020-12-31")]
    make = lambda k, m, vals, skip=None: [(k, m, s, e, v) for i, ((s, e), v) in enumerate(zip(q, vals, strict=True)) if i != skip]
    df = periods(spark, *make("1", "rev", [1, 2, 3, 4]), *make("2", "rev", [1, 2, 3, 4], 1), *make("3", "eps", [1, 1, 1, 1]), *make("4", "rev", [1, None, 3, 4]), *make("5", "rev", [1, 2, 3, 4]))
    df = df.withColumn("concept", F.when((F.col("cik") == "5") & (F.month("period_end") == 6), "other").otherwise("c"))
    sums, gaps = derive.ttm(df, ["cik", "metric"], non_additive=["eps"])
    assert rows(sums) == [("1", "rev", day("2020-01-01"), day("2020-12-31"), D(10))]
    last = rows(gaps.where("period_end = date'2020-12-31'"), "cik", "reason")
    assert last == [("2", "NOT_FOUR_CONTIGUOUS_QUARTERS"), ("3", "NON_ADDITIVE_METRIC"), ("4", "MISSING_VALUE"), ("5", "CONCEPT_CHANGE")]
    weeks = periods(spark, *[("1", "rev", f"2020-0{i}-01", f"2020-0{i}-28", 1) for i in range(1, 5)])
    weeks = weeks.withColumn("period_end", F.last_day("period_end"))
    assert "SPAN" in {r["reason"] for r in derive.ttm(weeks.withColumn("concept", F.lit("c")), ["cik", "metric"])[1].collect()}


def test_components_and_difference(spark):
    df = spark.createDataFrame([("1", "a", D(600_000)), ("1", "b", D(1_000_000)), ("1", "t", D(1_700_000)), ("2", "a", D(1)), ("2", "b", None), ("3", "a", D(5_000_000)), ("3", "b", D(1)), ("3", "t", D(9_000_000))], "cik string, concept string, value decimal(38,9)")
    got = rows(derive.sum_components(df, ["cik"], ["a", "b"], total="t"), "cik", "value", "reason", "reconciles")
    assert got == [("1", D(1_600_000), None, True), ("2", None, "MISSING_COMPONENT", None), ("3", D(5_000_001), None, False)]
    flow = spark.createDataFrame([("1", "ocf", D(5)), ("1", "capex", D(2)), ("2", "ocf", D(5)), ("3", "ocf", D(5)), ("3", "capex", D(-1))], "cik string, metric string, value decimal(38,9)")
    assert rows(derive.difference(flow, ["cik"], "ocf", "capex")) == [("1", D(3), None), ("2", None, "MISSING_INPUT"), ("3", None, "NEGATIVE_SUBTRAHEND")]


YEAR = {"period_start": day("2023-01-01"), "period_end": day("2023-12-31"), "frequency": "annual"}
INPUTS = {
    "revenue": {**YEAR, "value": "200"}, "prior_revenue": {"value": "160", "period_start": day("2022-01-01"), "period_end": day("2022-12-31"), "frequency": "annual"}, "operating_income": {**YEAR, "value": "30"},
    "net_income": {**YEAR, "value": "20", "definition": "NET_INCOME_ATTRIBUTABLE_TO_COMMON"}, "operating_cash_flow": {**YEAR, "value": "50"}, "capital_expenditures": {**YEAR, "value": "10", "definition": "CASH_PPE_PURCHASES_POSITIVE_OUTFLOW"},
    "free_cash_flow": {**YEAR, "value": "40", "definition": "OPERATING_CASH_FLOW_MINUS_CASH_PPE_PURCHASES_VERIFIED"}, "ebitda": {**YEAR, "value": "50", "definition": "REPORTED_RECONCILED_EBITDA"},
    "price": {"value": "12.5", "unit": "USD/share", "period_end": day("2024-03-01"), "valuation_at": at("2024-03-01T21:00:00"), "price_basis": "RAW", "adjustment_method": "NONE", "security_id": "s"},
    "shares_outstanding": {"value": "40", "unit": "shares", "currency": None, "period_end": day("2024-03-01"), "definition": "COMMON_SHARES_OUTSTANDING", "security_id": "s"},
    "market_cap": {"value": "500", "valuation_at": at("2024-03-01T21:00:00")}, "enterprise_value": {"value": "600", "valuation_at": at("2024-03-01T21:00:00")},
    "total_debt": {"value": "150", "period_end": day("2023-12-31"), "definition": "NONOVERLAPPING_INTEREST_BEARING_DEBT"}, "cash": {"value": "60", "period_end": day("2023-12-31")},
    "preferred_equity": {"value": "5", "period_end": day("2023-12-31")}, "noncontrolling_interest": {"value": "5", "period_end": day("2023-12-31")},
}
INPUT_SCHEMA = "cik string, metric string, industry string, security_scope string, value decimal(38,9), unit string, currency string, available_at timestamp, period_start date, period_end date, frequency string, definition string, quality string, source_ids array<string>, valuation_at timestamp, price_basis string, adjustment_method string, security_id string"


def formula(spark, name, change=None, industry="nonfinancial_verified", scope="SINGLE_COMMON_CLASS_VERIFIED", drop=()):
    items = []
    for role, x in INPUTS.items():
        row = {"unit": "USD", "currency": "USD", "available_at": at("2024-02-01"), "period_start": None, "period_end": None, "frequency": None, "definition": None, "quality": None, "source_ids": [role], "valuation_at": None, "price_basis": None, "adjustment_method": None, "security_id": None, **x, **(change or {}).get(role, {})}
        if role not in drop:
            items.append(("1", role, industry, scope, None if row["value"] is None else D(row["value"]), *[row[c] for c in derive.INPUT_COLUMNS[1:]]))
    df = spark.createDataFrame(items, INPUT_SCHEMA)
    (r,) = derive.formulas(df, ["cik"], [name], lit("2024-06-01", "timestamp")).collect()
    return r


@pytest.mark.parametrize(("name", "value"), [
    ("revenue_growth", "0.25"), ("operating_margin", "0.15"), ("net_margin", "0.1"), ("free_cash_flow", "40"), ("free_cash_flow_margin", "0.2"), ("market_cap", "500"), ("price_to_earnings", "25"), ("price_to_sales", "2.5"),
    ("enterprise_value", "600"), ("ev_ebitda", "12"), ("ev_revenue", "3"), ("free_cash_flow_yield", "0.08"), ("leverage", "3"),
])
def test_formulas(spark, name, value):
    r = formula(spark, name)
    assert r["reason"] is None and r["value"] == D(value) and r["source_ids"] == sorted(derive.FORMULAS[name]) and r["available_at"] == at("2024-02-01")


@pytest.mark.parametrize(("name", "more", "reason"), [
    ("net_margin", {"drop": ("net_income",)}, "MISSING_COMPONENT:net_income"), ("net_margin", {"change": {"revenue": {"value": "0"}}}, "NONPOSITIVE_DENOMINATOR"), ("net_margin", {"change": {"revenue": {"value": "-1"}}}, "NONPOSITIVE_DENOMINATOR"),
    ("net_margin", {"change": {"revenue": {"value": None}}}, "NULL_INPUT"), ("net_margin", {"change": {"revenue": {"quality": "FAIL"}}}, "INPUT_QUALITY_NOT_PERMITTED:revenue"), ("net_margin", {"change": {"revenue": {"source_ids": []}}}, "INPUT_PROVENANCE_MISSING:revenue"),
    ("net_margin", {"change": {"revenue": {"available_at": None}}}, "INPUT_AVAILABILITY_UNESTABLISHED:revenue"), ("net_margin", {"change": {"revenue": {"available_at": at("2025-01-01")}}}, "INPUT_NOT_AVAILABLE"),
    ("net_margin", {"change": {"revenue": {"currency": "EUR"}}}, "CURRENCY_MISMATCH"), ("net_margin", {"change": {"revenue": {"currency": None}}}, "CURRENCY_UNESTABLISHED"), ("net_margin", {"change": {"revenue": {"unit": "shares"}}}, "UNIT_MISMATCH"),
    ("net_margin", {"change": {"revenue": {"frequency": "ttm"}}}, "PERIOD_MISMATCH"), ("free_cash_flow", {"change": {"capital_expenditures": {"value": "-1"}}}, "CAPEX_DEFINITION_UNVERIFIED"), ("free_cash_flow_margin", {"change": {"free_cash_flow": {"definition": None}}}, "FCF_DEFINITION_UNVERIFIED"),
    ("revenue_growth", {"change": {"prior_revenue": {"period_end": day("2022-11-30")}}}, "NONCOMPARABLE_PRIOR_PERIOD"), ("revenue_growth", {"change": {"prior_revenue": {"value": "0"}}}, "NONPOSITIVE_DENOMINATOR"),
    ("market_cap", {"scope": None}, "SECURITY_SCOPE_UNVERIFIED"), ("market_cap", {"change": {"price": {"security_id": "t"}}}, "SECURITY_SCOPE_MISMATCH"), ("market_cap", {"change": {"price": {"price_basis": "ADJUSTED"}}}, "PRICE_SHARE_ADJUSTMENT_BASIS_UNVERIFIED"),
    ("market_cap", {"change": {"shares_outstanding": {"period_end": day("2024-02-29")}}}, "SAME_DATE_SHARE_COUNT_REQUIRED"), ("price_to_sales", {"change": {"market_cap": {"valuation_at": at("2024-01-01")}}}, "FINANCIAL_INPUT_AFTER_PRICE"),
    ("price_to_sales", {"change": {"market_cap": {"valuation_at": None}}}, "PRICE_VALUATION_TIME_UNESTABLISHED"), ("price_to_sales", {"change": {"revenue": {"frequency": "quarterly"}}}, "ANNUAL_OR_TTM_REQUIRED"), ("price_to_sales", {"change": {"market_cap": {"value": "0"}}}, "NONPOSITIVE_EQUITY_INPUT"),
    ("price_to_earnings", {"change": {"net_income": {"definition": None}}}, "COMMON_INCOME_SCOPE_UNVERIFIED"), ("enterprise_value", {"industry": "bank"}, "FINANCIAL_INDUSTRY_EV_DEFINITION_EXCLUDED"), ("enterprise_value", {"industry": None}, "NONFINANCIAL_INDUSTRY_UNVERIFIED"),
    ("enterprise_value", {"change": {"cash": {"period_end": day("2023-09-30")}}}, "BALANCE_PERIOD_MISMATCH"), ("enterprise_value", {"change": {"total_debt": {"definition": None}}}, "DEBT_COMPONENT_OVERLAP_UNRESOLVED"),
    ("ev_ebitda", {"change": {"ebitda": {"definition": "ADJUSTED"}}}, "EBITDA_DEFINITION_UNVERIFIED"), ("leverage", {"change": {"total_debt": {"period_end": day("2023-09-30")}}}, "BALANCE_FLOW_PERIOD_MISMATCH"),
])
def test_formulas_refuse(spark, name, more, reason):
    r = formula(spark, name, **more)
    assert r["reason"] == reason and r["value"] is None


def random_decimal(rng):
    v = D(rng.randrange(10 ** rng.choice([1, 6, 15, 22, 30, 38]))).scaleb(-9)
    return (-v if rng.random() < 0.4 else v) if rng.random() < 0.7 else D(int(v))


def test_exact_arithmetic_against_fractions(spark):
    """Every result is that of Python's fractions, or null because it has more digits than there is room for."""
    getcontext().prec = 100
    rng, most = random.Random(9), 10**38
    items = [(i, random_decimal(rng), random_decimal(rng)) for i in range(400)] + [(-1, D("12.345678912"), D(10**9)), (-2, D(2 * 10**15), D(1)), (-3, D(3 * 10**20), D(7)), (-4, D(0), D(5)), (-5, D(5), D(0)), (-6, None, D(1))]
    df = spark.createDataFrame(items, "i int, a decimal(38,9), b decimal(38,9)")
    a, b = F.col("a"), F.col("b")
    x, y = exact.fraction(a), exact.fraction(b)
    made = {"plus": exact.plus(a, b), "minus": exact.minus(a, b), "fraction": exact.fraction(a, b), "times": exact.times(x, y), "over": exact.over(x, y), "sum": exact.plus_fractions(x, y), "compare": exact.compare(x, y), "rounded": exact.rounded(exact.fraction(a, b)), "whole": exact.by_whole(a, F.lit(-700_000_001))}
    refused = Counter()
    for r in df.select("i", "a", "b", *[c.alias(n) for n, c in made.items()]).collect():
        if r["a"] is None:
            assert all(r[n] is None for n in made)
            continue
        p, q = Fraction(r["a"]), Fraction(r["b"])
        half = lambda f: (lambda n: Fraction((-n if f < 0 else n), 10**9))((2 * abs(f) * 10**9 + 1) // 2)
        want = {"plus": p + q, "minus": p - q, "times": p * q, "sum": p + q, "compare": Fraction((p > q) - (p < q)), "whole": p * -700_000_001, **({"fraction": p / q, "over": p / q, "rounded": half(p / q)} if q else {"fraction": None, "over": None, "rounded": None})}
        for n, w in want.items():
            got = r[n] if r[n] is None or n in ("plus", "minus", "whole", "rounded", "compare") else Fraction(int(r[n]["n"]), int(r[n]["d"]))
            if got is not None:
                assert w is not None and Fraction(got) == w, (n, r["a"], r["b"])
            elif w is not None:
                refused[n] += 1
                fits = abs(w.numerator) < most and w.denominator < most
                assert n == "rounded" or n == "sum" or (abs(w * 10**9) >= most if n in ("plus", "minus", "whole") else not fits), (n, r["a"], r["b"])
    assert not refused["compare"] and not refused["fraction"] and refused["times"] and refused["rounded"] < 100


def test_wide_values_are_exact_or_refused(spark):
    cap = formula(spark, "market_cap", {"price": {"value": "12.345678912"}, "shares_outstanding": {"value": "1000000000"}})
    assert (cap["value"], int(cap["numerator"]), int(cap["denominator"]), cap["terminates"], cap["reason"]) == (D(12345678912), 12345678912, 1, True, None)
    small = formula(spark, "market_cap", {"price": {"value": "0.000000003"}, "shares_outstanding": {"value": "0.5"}})
    assert (int(small["numerator"]), int(small["denominator"]), small["terminates"]) == (3, 2 * 10**9, False)
    third = formula(spark, "net_margin", {"net_income": {"value": "1"}, "revenue": {"value": "3"}})
    assert (int(third["numerator"]), int(third["denominator"]), third["value"], third["terminates"]) == (1, 3, D("0.333333333"), False)
    huge = formula(spark, "market_cap", {"price": {"value": "12345678901234567890.123456789"}, "shares_outstanding": {"value": "98765432109876543210.987654321"}})
    assert (huge["reason"], huge["value"], huge["numerator"]) == ("OUT_OF_RANGE", None, None)
    wide = formula(spark, "enterprise_value", {"market_cap": {"value": "30000000000000000000000.000000001"}})
    assert wide["value"] == D("30000000000000000000100.000000001")
    df = periods(spark, ("1", "m", "2020-01-01", "2020-12-31", 2 * 10**15), ("1", "m", "2021-01-01", "2021-12-31", 3 * 10**15), ("2", "m", "2020-01-01", "2020-12-31", 3 * 10**20), ("2", "m", "2021-01-01", "2021-12-31", 6 * 10**20))
    growth = {r["cik"]: r for r in derive.annual_growth(df, ["cik", "metric"], 1).where("reason is null").collect()}
    assert growth["1"]["growth_percent"] == D(50) and growth["2"]["cumulative_percent"] == D(100)
    last = {r["cik"]: r for r in derive.latest_growth(df.withColumn("concept", F.lit("c")), ["cik", "metric"], ["concept"]).collect()}
    assert (last["1"]["growth"], last["2"]["numerator"], last["2"]["growth"]) == (D("0.5"), D(3 * 10**20), D(1))
    for op in ("difference", "percent_change", "ratio", "sum", "average"):
        assert {r["status"] for r in derive.calculate(df, ["cik"], op, "period_end").collect()} == {"OK"}
    top = D("99999999999999999999999999999.999999999")
    most = spark.createDataFrame([("x", "1", 1, top, "USD", None), ("x", "2", 1, top, "USD", None), ("y", "1", -1, top, "USD", None), ("z", "1", 2, top, "USD", None)], "r string, id string, coefficient int, value decimal(38,9), unit string, available_at timestamp")
    got = {r["r"]: (r["value"], r["reason"]) for r in derive.linear_combine(most, "r").collect()}
    assert got == {"x": (None, "OUT_OF_RANGE"), "y": (-top, None), "z": (None, "OUT_OF_RANGE")}


def test_growth_and_calculators(spark):
    years = [("1", "m", f"{y}-01-01", f"{y}-12-31", v) for y, v in ((2019, 100), (2020, 110), (2021, 121))]
    gap = [("2", "m", f"{y}-01-01", f"{y}-12-31", 5) for y in (2019, 2021)]
    loss = [("3", "m", f"{y}-01-01", f"{y}-12-31", v) for y, v in ((2019, -1), (2020, 5), (2021, 6))]
    df = periods(spark, *years, *gap, *loss)
    got = {(r["cik"], r["period_end"].year): r for r in derive.annual_growth(df, ["cik", "metric"], 2).collect()}
    assert got["1", 2021]["growth_percent"] == D(10) and got["1", 2021]["cumulative_percent"] == D(21)
    assert got["1", 2020]["reason"] == "CHAIN_TOO_SHORT" and got["3", 2021]["reason"] == "NOT_POSITIVE"
    assert {r["reason"] for r in derive.annual_growth(df.where("cik = '2'"), ["cik", "metric"], 1).collect()} == {"CHAIN_TOO_SHORT", "NOT_CONTIGUOUS"}
    last = {r["cik"]: r for r in derive.latest_growth(df.withColumn("concept", F.when(F.col("value") == 6, "x").otherwise("c")), ["cik", "metric"], ["concept"]).collect()}
    assert (last["1"]["numerator"], last["1"]["denominator"], last["1"]["growth"]) == (D(11), D(110), D("0.1")) and last["2"]["reason"] == "NOT_CONTIGUOUS" and last["3"]["reason"] == "CONCEPT_CHANGED"
    calc = lambda op: {r["cik"]: (r["value"], r["status"]) for r in derive.calculate(df, ["cik"], op, "period_end").collect()}
    assert calc("difference")["1"] == (D(21), "OK") and calc("percent_change")["1"] == (D(21), "OK") and calc("sum")["1"] == (D(331), "OK") and calc("ratio")["3"] == (D(-6), "OK") and calc("average")["2"] == (D(5), "OK")
    zero = periods(spark, ("1", "m", "2019-01-01", "2019-12-31", 0), ("1", "m", "2020-01-01", "2020-12-31", 4))
    assert rows(derive.calculate(zero, ["cik"], "ratio", "period_end"), "value", "status") == [(None, "ZERO_DENOMINATOR")]


def test_request_coverage(spark):
    df = spark.createDataFrame([("1", "a", D(1)), ("1", "b", D(1)), ("2", "a", D(1)), ("2", "b", None), ("3", "z", D(1))], "cik string, metric string, value decimal(38,9)")
    assert rows(derive.request_coverage(df, ["cik"], ["a", "b"])) == [("1", ["a", "b"], [], "AVAILABLE"), ("2", ["a"], ["b"], "PARTIAL"), ("3", [], ["a", "b"], "SOURCE_LIMITED")]


# Joins and series


def test_interval_and_identity_joins(spark):
    iv = spark.createDataFrame([(1, "A", day("2020-01-01"), day("2020-06-30")), (1, "B", day("2020-07-01"), None), (2, "C", None, day("2020-03-31")), (2, "D", day("2020-03-31"), day("2020-12-31"))], "sec int, symbol string, s date, e date")
    pts = spark.createDataFrame([(1, day("2020-06-30")), (1, day("2020-06-30")), (1, day("2030-01-01")), (1, day("2019-01-01")), (2, day("1990-01-01")), (2, day("2020-03-31")), (3, day("2020-01-01"))], "sec int, d date")
    assert rows(joins.interval_join(pts, iv, "sec", "d", "s", "e", "symbol"), "sec", "d", "points", "symbol", "status") == sorted([(1, day("2020-06-30"), 2, "A", "FOUND"), (1, day("2030-01-01"), 1, "B", "FOUND"), (1, day("2019-01-01"), 1, None, "NONE"), (2, day("1990-01-01"), 1, "C", "FOUND"), (2, day("2020-03-31"), 1, None, "AMBIGUOUS"), (3, day("2020-01-01"), 1, None, "NONE")], key=str)
    assert rows(joins.resolve(iv.withColumn("symbol", F.lit("X")), "symbol", "sec", lit("2020-03-31", "date"), "s", "e")) == [("X", None, "AMBIGUOUS")]
    assert rows(joins.resolve(iv, "symbol", "sec", lit("2020-05-01", "date"), "s", "e")) == [("A", 1, "FOUND"), ("B", None, "NONE"), ("C", None, "NONE"), ("D", 2, "FOUND")]
    anchors = spark.createDataFrame([("S", day("2020-01-01"), 1), ("S", day("2020-01-02"), 1), ("S", day("2020-01-02"), 2)], "sym string, d date, e int")
    asked = spark.createDataFrame([("S", day("2020-01-01")), ("S", day("2020-01-02")), ("S", day("2020-01-03"))], "sym string, d date")
    assert rows(joins.resolve_point(anchors, asked, "sym", "d", "e"), "d", "e", "status") == [(day("2020-01-01"), 1, "FOUND"), (day("2020-01-02"), None, "AMBIGUOUS"), (day("2020-01-03"), None, "NONE")]


def test_bitemporal_resolution(spark):
    link = lambda e, a, b, kind, known: ("cusip", "x", e, a and day(a), b and day(b), kind, day(known))
    links = spark.createDataFrame([link("e1", "2020-01-01", "2020-07-01", "closed", "2020-01-01"), link("e2", "2020-07-01", None, "source_open_end", "2020-07-05"), link("e3", "2020-01-01", None, "unknown", "2020-01-01"), link("e4", None, "2020-02-01", "closed", "2020-01-01")], "namespace string, identifier string, entity_id string, valid_from date, valid_to date, valid_to_kind string, known_at date")
    asked = spark.createDataFrame([(i, "cusip", "x", day(on), day(as_of)) for i, (on, as_of) in enumerate([("2020-03-01", "2020-12-31"), ("2020-07-01", "2020-12-31"), ("2020-07-01", "2020-07-01"), ("2020-01-15", "2020-12-31")])], "r int, namespace string, identifier string, `on` date, as_of date")
    assert rows(joins.resolve_bitemporal(links, asked, "r"), "r", "entity_id", "status", "entities") == [(0, "e1", "FOUND", ["e1"]), (1, "e2", "FOUND", ["e2"]), (2, None, "NONE", []), (3, None, "AMBIGUOUS", ["e1", "e4"])]


def test_asof_join_across_buckets(spark):
    rng = random.Random(3)
    stamp = lambda h: at("2024-01-01") + dt.timedelta(hours=h)
    right = [("hot" if rng.random() < 0.8 else "b", stamp(rng.randrange(400)), rng.choice([None, float(rng.randrange(99))])) for _ in range(150)]
    left = [(i, "hot" if rng.random() < 0.8 else rng.choice(["b", "none"]), stamp(rng.randrange(500))) for i in range(300)] + [(300, "hot", stamp(0)), (300, "hot", stamp(0))]
    want = []
    for i, k, t in left:
        before = [(u, v) for k2, u, v in right if k2 == k and u <= t and v is not None]
        want.append((i, max(before)[1] if before else None))
    l, r = spark.createDataFrame(left, "i int, k string, ts timestamp"), spark.createDataFrame(right, "k string, ts timestamp, v double")  # noqa: E741
    for bucket in ("day", "hour", "year"):
        assert rows(joins.asof_join(l, r, ["k"], "ts", "v", bucket), "i", "asof_v") == sorted(want, key=str)
    assert joins.asof_join(l, r.where("false"), ["k"], "ts", "v").where("asof_v is not null").count() == 0


def test_prior_years(spark):
    df = periods(spark, ("1", "m", "2019-01-01", "2019-12-31", 5), ("1", "m", "2020-01-01", "2020-12-31", 6), ("2", "m", "2019-02-01", "2020-02-29", 1), ("2", "m", "2018-02-01", "2019-02-28", 2), ("3", "m", "2019-01-01", "2019-12-31", 1), ("3", "m", "2019-01-05", "2019-12-28", 2), ("3", "m", "2020-01-01", "2020-12-31", 3))
    got = {(r["cik"], r["value"]): (r["prior_value"], r["status"]) for r in joins.prior_year(df, ["cik", "metric"]).collect()}
    assert got["1", D(6)] == (D(5), "FOUND") and got["1", D(5)] == (None, "NONE") and got["3", D(3)] == (None, "AMBIGUOUS") and got["2", D(1)] == (D(2), "FOUND")
    exact = {(r["cik"], r["value"]): r["prior_value"] for r in joins.prior_year_exact(df, ["cik", "metric"]).collect()}
    assert exact["1", D(6)] == D(5) and exact["2", D(1)] is None


def test_lineage_points_and_evidence(spark):
    res = spark.createDataFrame([("r1", ["a", "b"]), ("r2", ["a", "gone"]), ("r3", [])], "r string, ids array<string>")
    src = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    found, lost = joins.lineage(res, src, "r", "ids", "id")
    assert rows(found, "r", "id", "v") == [("r1", "a", 1), ("r1", "b", 2), ("r2", "a", 1)] and rows(lost, "r", "id") == [("r2", "gone")]
    index = joins.evidence_index(res, "ids")
    assert rows(joins.evidence(index, src.select(F.col("id").alias("source_id")), "r"), "r") == [("r1",), ("r2",)]
    assert rows(joins.missing_keys(spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int"), "k")) == [(1,)]
    anchor = spark.createDataFrame([("1",), ("2",), ("3",)], "cik string")
    facts = spark.createDataFrame([("1", 5), ("2", None)], "cik string, value int")
    assert rows(joins.left_with_coverage(anchor, facts, "cik"), "cik", "record_status", "value_status") == [("1", "PRESENT", "PRESENT"), ("2", "PRESENT", "NULL_IN_SOURCE"), ("3", "NO_ELIGIBLE_RECORD", "NOT_APPLICABLE")]
    price, ident = spark.createDataFrame([("1", 2.0), ("2", 3.0)], "cik string, close double"), spark.createDataFrame([("1", "S")], "cik string, sec string")
    assert rows(joins.point_join(anchor, [("price", price, ["cik"], "close"), ("identity", ident, ["cik"], "sec")]), "cik", "reason") == [("1", None), ("2", "NO_IDENTITY"), ("3", "NO_PRICE")]


def test_point_screen_orders_its_reasons(spark):
    c = spark.createDataFrame([(1, 5.0), (2, 50.0), (3, None), (4, 5.0)], "k int, p double")
    ident = spark.createDataFrame([(1, "a", 1), (2, "b", 9), (3, "c", 1)], "k int, sec string, v int")
    good, bad = joins.point_screen(c, [("identity", ident, ["k"], "sec")], {"p": (0, 10), "v": (0, 5)})
    assert rows(good, "k") == [(1,)] and rows(bad, "k", "reason") == [(2, "OUTSIDE_P"), (3, "OUTSIDE_P"), (4, "NO_IDENTITY")]


def test_series_coverage_places_gaps(spark):
    cells = [("s", 1, None, "blank"), ("s", 2, 0.0, None), ("s", 3, None, "cell_error"), ("s", 4, 5.0, None), ("s", 5, None, "blank"), ("none", 1, None, "blank"), (None, 1, 1.0, None)]
    df = spark.createDataFrame([(k, day(f"2024-01-0{d}"), v, r) for k, d, v, r in cells], "k string, d date, v double, r string")
    got = {(r["k"], r["is_total"]): r for r in series.series_coverage(df, "k", "d", "v", "r").collect()}
    s = got["s", 0]
    assert (s["cells"], s["populated"], s["missing"], s["before_first"], s["interior"], s["after_last"], s["all_missing"], s["errors"]) == (5, 2, 3, 1, 1, 1, 0, 1) and (s["first_valid"], s["last_valid"]) == (day("2024-01-02"), day("2024-01-04"))
    assert got["none", 0]["all_missing"] == 1 and got[None, 0]["cells"] == 1 and got[None, 1]["cells"] == 7


def test_spans_over_blocks(spark):
    rng = random.Random(4)
    data = []
    for i in range(200):
        if rng.random() < 0.9:
            data.append((i, "hot" if rng.random() < 0.95 else rng.choice("ab"), day("2024-01-01") + dt.timedelta(days=i if rng.random() < 0.97 else 0)))
    want, run = [], []
    for r in [*data, (10**6, None, None)]:
        if run and (r[1] != run[-1][1] or r[0] != run[-1][0] + 1):
            days = [x[2] for x in run]
            want.append((run[0][1], run[0][0], len(run), min(days), max(days), days == sorted(days)))
            run = []
        run.append(r)
    df = spark.createDataFrame(data, "i long, k string, d date")
    for block in (7, 64, 1 << 20):
        assert rows(series.spans(df, ["k"], "i", "d", block), "k", "offset", "rows", "first_day", "last_day", "monotonic") == sorted(want, key=str)


def test_catalogue_merge_and_ledger(spark):
    df = spark.createDataFrame([("k", day("2024-01-01"), 1, "p1"), ("k", day("2024-01-01"), 1, "p2"), ("k", day("2024-01-02"), 1, "p1"), ("k", day("2024-01-02"), 2, "p2")], "k string, d date, v int, src string")
    merged, gaps = series.merge_or_conflict(df, ["k", "d"], ["v"], "src")
    assert rows(merged) == [("k", day("2024-01-01"), 1, ["p1", "p2"])] and rows(gaps, "d", "variants", "sources") == [(day("2024-01-02"), 2, ["p1", "p2"])]
    assert rows(series.catalogue(df, "k", "d", "src"), "rows", "aliases", "shard") == [(4, ["p1", "p2"], "82")]
    objects = spark.createDataFrame([("ns/a/manifest.json",), ("ns/a/x.parquet",), ("ns/a/x.parquet",), ("other/readme",)], "path string")
    listed = spark.createDataFrame([("ns/a/manifest.json",), ("ns/a/y.parquet",)], "path string")
    assert rows(series.inventory_ledger(objects, listed, "path")) == [("ns", "data", 1, 1, 1), ("ns", "manifest", 1, 0, 0), ("other", "other", 1, 1, 0)]
    two = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", 2, "c"), ("k", 3, "d")], "k string, p int, v string")
    assert rows(series.lookback(two, ["k"], 2, "p", periods=True), "v") == [("c",), ("d",)] and rows(series.lookback(two, ["k"], 3, "p", periods=True), "v") == [("a",), ("b",), ("c",), ("d",)]


# Screens


def test_screens(spark):
    df = spark.createDataFrame([(1, 5.0, "USD"), (2, None, "USD"), (3, 5.0, "EUR"), (4, 7.0, "USD"), (5, 9.0, "USD")], "id int, v double, unit string")
    ids = lambda *f: [r[0] for r in rows(screen.screen(df, list(f)), "id")]
    assert ids(("v", "between", (5.0, 7.0), "unit", "USD")) == [1, 4] and ids(("v", "ne", 5.0)) == [4, 5] and ids(("v", "gte", 7.0), ("id", "lt", 5)) == [4] and ids(("v", "gt", 9.0)) == []
    assert [r["id"] for r in screen.sort_limit(df, [("v", "desc"), ("id", "asc")]).collect()] == [5, 4, 1, 3, 2] and [r["id"] for r in screen.sort_limit(df, [("v", "asc"), ("id", "desc")], 2).collect()] == [3, 1]
    dates = spark.createDataFrame([(i, day(f"2024-01-0{i}")) for i in range(1, 6)] + [(6, None)], "id int, d date")
    assert rows(screen.between_dates(dates, "d", "2024-01-02", "2024-01-04"), "id") == [(2,), (3,), (4,)]
    found = screen.search(spark.createDataFrame([("AB", "x", ["q"]), ("ZAB", "y", []), ("C", "about", []), ("D", "z", ["Abc"]), ("E", "e", [])], "id string, name string, al array<string>"), "ab", "id", "name", "al")
    assert [r["id"] for r in found.collect()] == ["AB", "C", "D", "ZAB"]
    first = screen.page(df, "id", 2, params={"q": 1}, release="r")
    (token,) = {r["token"] for r in first.collect()}
    assert [r["id"] for r in screen.page(df, "id", 2, after=2, token=token, params={"q": 1}, release="r").collect()] == [3, 4]
    with pytest.raises(ValueError):
        screen.page(df, "id", 2, after=2, token=token, params={"q": 1}, release="other")


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_ranks_with_a_popular_value(spark, descending, kind):
    rng = random.Random(5)
    data = [(f"name{i:04d}" if kind == "string" else i, rng.choice([3.0, 3.0, 3.0, float(rng.randrange(8)), None])) for i in range(400)]
    df = spark.createDataFrame(data, f"id {kind}, v double").repartition(4)
    ranked, missing = screen.rank_screen(df, "id", "v", low=1, high=6, descending=descending)
    want = sorted(((v, i) for i, v in data if v is not None and 1 <= v <= 6), reverse=descending)
    assert [(r["v"], r["id"]) for r in sorted(ranked.collect(), key=lambda r: r["rank"])] == want and {r["matches"] for r in ranked.collect()} == {len(want)}
    assert missing.count() == sum(v is None for _, v in data) and {r["reason"] for r in missing.collect()} == {"NO_VALUE"}


def test_cross_sections_and_peers(spark):
    df = spark.createDataFrame([("1", "a", D(1), day("2020-01-01")), ("1", "a", D(2), day("2021-01-01")), ("1", "b", None, day("2021-01-01")), ("2", "c", D(3), day("2021-01-01"))], "cik string, metric string, value decimal(38,9), period_end date")
    bad = spark.createDataFrame([("2", "c")], "cik string, metric string")
    assert rows(screen.cross_section(df, "cik", ["a", "b", "c"], quarantine=bad)) == [("1", {"a": D(2)}, {"b": "NULL_VALUE", "c": "NO_OBSERVATION"}), ("2", {}, {"a": "NO_OBSERVATION", "b": "NO_OBSERVATION", "c": "QUARANTINED"})]
    peers = spark.createDataFrame([("1", "m", D(5)), ("2", "m", D(8)), ("1", "n", D(1)), ("1", "n", D(2))], "cik string, metric string, value decimal(38,9)")
    assert rows(screen.align_peers(peers, ["1", "2"], ["metric"])) == [("m", D(5), D(8), D(3), [], None), ("n", D(2), None, None, ["2"], "AMBIGUOUS")]
    codes = spark.createDataFrame([(1, "tech")], "code int, group string")
    assert rows(screen.sector(spark.createDataFrame([("a", 1), ("b", 9), ("c", None)], "id string, code int"), codes, "code"), "id", "group", "reason") == [("a", "tech", None), ("b", None, "UNMAPPED_CODE"), ("c", "ABSENT", None)]
    idx = spark.createDataFrame([("a", "x", ["p", "q", "p"]), ("b", None, None)], "id string, s string, t array<string>")
    assert rows(screen.filter_index(idx, "id", ["s"], ["t"])) == [("remainder", "", "b"), ("s", "x", "a"), ("t", "p", "a"), ("t", "q", "a")]
    both = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 1), (2, "x", 1), (3, "z", 1)], "id int, f string, c int")
    got, clash = screen.filter_sets(both, "id", {"f": ["x", "y"]}, ["c"])
    assert rows(got) == [(1,), (2,)] and rows(clash) == [(1,)]
    assert rows(screen.set_diff(both.select("id"), spark.createDataFrame([(2,), (9,), (None,)], "id int"), "id")) == sorted([(1, "removed"), (2, "common"), (3, "removed"), (9, "added"), (None, "added")], key=str)
    states, missing = screen.readiness_summary(spark.createDataFrame([("READY", []), ("BLOCKED", ["x", "y"]), ("BLOCKED", ["x"])], "s string, m array<string>"), "s", "m")
    assert rows(states) == [("BLOCKED", 2, 66.6667), ("READY", 1, 33.3333)] and rows(missing) == [("x", 2), ("y", 1)]


# Quality and claims


def test_record_checks(spark):
    item = lambda **x: tuple({"source": "s", "price": None, "volume": None, "statement_type": None, "line_items": None, "dates": None, **x}.values())
    data = [
        item(price=5.0, volume=-1.0), item(source=None, price=0.0), item(source=None), item(statement_type="income_statement", line_items={"Total Revenue": 1000.0, "Cost Of Revenue": 400.0, "Gross Profit": 609.0}),
        item(statement_type="income_statement", line_items={"total_revenue": 1000.0, "cost_of_revenue": 400.0, "gross_profit": 611.0}), item(statement_type="balance_sheet", line_items={"Total Assets": 100.0, "Total Liabilities": 60.0, "Total Equity": 40.5}),
        item(statement_type="balance_sheet", line_items={"total_assets": 100.0, "total_liabilities": 60.0, "total_equity": 42.0}), item(line_items={"Revenues": 5.0}), item(line_items={"Revenue": -5000.0}), item(dates=["2024-01-01", "2024-01-02"]), item(dates=["2024-01-02", "2024-01-01"]),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, source string, price double, volume double, statement_type string, line_items map<string,double>, dates array<string>")
    long, status = quality.record_checks(df, "id")
    got = {(r["id"], r["check"]): r["state"] for r in long.collect()}
    assert got[0, "volume_non_negative"] == "failed" and got[0, "price_bounds"] == "passed" and got[1, "price_bounds"] == "failed" and got[1, "source_attribution"] == "failed" and got[2, "non_empty"] == "failed" and (2, "source_attribution") not in got
    assert [got[i, "income_math"] for i in (3, 4)] == ["passed", "warning"] and [got[i, "balance_identity"] for i in (5, 6)] == ["passed", "warning"] and got[7, "scale_plausibility"] == "warning" and got[8, "sign_plausibility"] == "warning"
    assert [got[i, "chronological_order"] for i in (9, 10)] == ["passed", "warning"] and got[3, "has_type_field"] == "passed"
    assert [r["status"] for r in sorted(status.collect(), key=lambda r: r["id"])] == ["warning", "failed", "failed", "passed", "warning", "passed", "warning", "warning", "warning", "passed", "warning"]


def test_observation_contract(spark):
    ok = ("id", "native", "USD", "USD", "1.5", None)
    data = [ok, (None, *ok[1:]), ("id", "odd", *ok[2:]), ("id", "derived", "USD", "EUR", "1", None), ("id", "native", "USD", "USD", "1,5", None), ("id", "native", "USD", "USD", None, None), ("id", "native", "USD", "USD", None, "NOT_REPORTED")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "n int, id string, layer string, unit string, native_unit string, value_text string, value_status string")
    assert [r["code"] for r in sorted(quality.validate_observation(df, ["id"]).collect(), key=lambda r: r["n"])] == [None, "MISSING_ID", "BAD_LAYER", "UNIT_MISMATCH", "BAD_DECIMAL", "NULL_WITHOUT_STATUS", None]


def test_identities(spark):
    make = lambda **v: spark.createDataFrame([("1", m, None if x is None else D(x)) for m, x in v.items()], "cik string, metric string, value decimal(38,9)")
    state = lambda df, name, tol=0: rows(quality.identity_check(df, ["cik"], quality.IDENTITIES[name], tol), "state", "residual")[0]
    assert state(make(revenue=10, cost_of_revenue=4, gross_profit=6), "gross_profit") == ("PASS", D(0)) and state(make(gross_profit=6, operating_expenses=4, operating_income=1), "operating_income") == ("FAIL", D(1))
    assert state(make(pretax_income=6, tax_expense=4, net_income=1), "net_income", 1) == ("PASS", D(1)) and state(make(pretax_income=6, tax_expense=None, net_income=1), "net_income") == ("UNAVAILABLE", None)
    assert state(make(cash_begin=1, operating_cash_flow=5, investing_cash_flow=-2, financing_cash_flow=-1, fx_cash_effect=0, cash_end=3), "cash_movement") == ("PASS", D(0))
    for eps, good in (("1.01", True), ("1.02", False), (None, None)):
        assert one(spark, quality.per_share_check(lit(eps, "decimal(20,2)"), lit("1000", "decimal(20,0)"), lit("1005", "decimal(20,0)"))) is good
    balance = spark.createDataFrame([("1", "A", D(3)), ("1", "L", D(1)), ("1", "E", D(2)), ("2", "A", D(3)), ("2", "L", D(1)), ("2", "E", D(1)), ("3", "A", D(3))], "cik string, concept string, value decimal(38,9)")
    assert rows(quality.balance_check(balance, ["cik"], "A", ["L", "E"])) == [("1", "PASS", D(0)), ("2", "FAIL", D(1)), ("3", "UNAVAILABLE", None)]
    vintage = spark.createDataFrame([("1", "PASS", "x"), ("1", "PASS", "x"), ("2", "FAIL", "x"), ("2", "FAIL", "y"), ("3", "FAIL", "x")], "cik string, s string, acc string")
    assert rows(quality.same_vintage_guard(vintage, ["cik"], "s", ["acc"])) == [("1", "PASS"), ("2", "NOT_COMPARABLE"), ("3", "FAIL")]


def test_certification_ladder(spark):
    res = spark.createDataFrame([(i, D(3)) for i in range(1, 7)], "r int, value decimal(38,9)")
    terms = spark.createDataFrame([(1, "a", D(3), 1), (2, "gone", D(3), 1), (3, "a", D(5), 1), (3, "b", D(1), -2), (4, "a", D(9), 1), (5, "a", D(3), 1)], "r int, source_id string, value decimal(38,9), coefficient int")
    leaves = spark.createDataFrame([("a",), ("b",)], "source_id string")
    states = spark.createDataFrame([(1, "PASS"), (3, "PASS"), (3, "FAIL"), (4, "PASS")], "r int, state string")
    got = rows(quality.certify(res, terms, leaves, states, "r"), "r", "evidence_state", "reason")
    assert got == [(1, "ACCOUNTING_CERTIFIED", None), (2, "SOURCE_OBSERVED", "MISSING_LEAF"), (3, "DERIVATION_VERIFIED", "IDENTITY_FAILED"), (4, "RECONCILED", "NOT_RECOMPUTED"), (5, "DERIVATION_VERIFIED", "NO_IDENTITY"), (6, "SOURCE_OBSERVED", "MISSING_LEAF")]


def test_contract_stages(spark):
    row = lambda k, **x: (k, *{"value": D(1), "period": "FY", "want": "FY", "unit": "USD", "available_at": at("2020-01-01"), "validated": True, **x}.values())
    data = [row("ok"), row("missing", value=None), row("period", period="Q"), row("unit", unit="EUR"), row("pit", available_at=at("2030-01-01")), row("clash"), row("clash", value=D(2)), row("loose", validated=False)]
    df = spark.createDataFrame(data, "k string, value decimal(38,9), period string, want string, unit string, available_at timestamp, validated boolean")
    got = rows(quality.evaluate_contract(df, ["k"], "USD", "period", "want", as_of=lit("2025-01-01", "timestamp")))
    assert got == [("clash", "CONFLICT", None), ("loose", "SOURCE_UNVALIDATED", D(1)), ("missing", "MISSING", None), ("ok", "AVAILABLE", D(1)), ("period", "PERIOD_MISMATCH", None), ("pit", "NOT_PIT_ELIGIBLE", None), ("unit", "UNIT_MISMATCH", None)]
    policy = quality.statement_policy(spark.createDataFrame([("1", "Deposits"), ("1", "X"), ("2", "X")], "cik string, tag string"), "cik", "tag", {"bank": ["Deposits"], "insurer": ["Premiums"]}, {"bank": ["gross_profit", "capex"], "insurer": ["capex"]})
    assert rows(policy) == [("1", ["bank"], [("capex", "bank"), ("gross_profit", "bank")]), ("2", [], [])]
    a = spark.createDataFrame([(1, D(100), "USD"), (2, D(100), "USD"), (3, D(100), "USD"), (4, None, "USD"), (5, D(1), "USD")], "k int, value decimal(38,9), unit string")
    b = spark.createDataFrame([(1, D(100), "USD"), (2, D(90), "USD"), (3, D(100), "EUR"), (4, D(1), "USD")], "k int, value decimal(38,9), unit string")
    assert rows(quality.cross_validate(a, b, ["k"]), "k", "validation", "delta") == [(1, "AGREES", None), (2, "CONFLICT", D(-10)), (3, "UNIT_MISMATCH", None), (4, "PRIMARY_NOT_AVAILABLE", None), (5, "NOT_COMPARABLE", None)]


def test_claims_and_bridge(spark):
    c = lambda k, name, v: (k, name, None if v is None else D(v), f"{k}-{name}")
    data = [c("1", "DebtTotal", 10), c("1", "DebtCurrent", 4), c("1", "CashAndEquivalents", 3), c("2", "DebtCurrent", 4), c("2", "DebtNoncurrent", 5), c("2", "CashAndEquivalents", 1), c("3", "DebtTotal", 3), c("3", "DebtCurrent", 4), c("4", "DebtCurrent", 4)]
    df = spark.createDataFrame(data, "cik string, concept string, value decimal(38,9), id string")
    got = claims.claims(df, ["cik"])
    assert rows(got.where("claim = 'debt'"), "cik", "value", "state", "sources") == [("1", D(10), "REPORTED", ["1-DebtCurrent", "1-DebtTotal"]), ("2", D(9), "SUMMED", ["2-DebtCurrent", "2-DebtNoncurrent"]), ("3", None, "CONFLICTING", ["3-DebtCurrent", "3-DebtTotal"]), ("4", None, "PARTIAL", ["4-DebtCurrent"])]
    assert rows(claims.equity_bridge(got, ["cik"], ["debt"], ["cash"])) == [("1", D(-7), "AVAILABLE", []), ("2", D(-8), "AVAILABLE", []), ("3", None, "UNAVAILABLE", ["cash", "debt"]), ("4", None, "UNAVAILABLE", ["cash", "debt"])]
    inst = spark.createDataFrame([(i, s and day(s), day(e), day(f), seg) for i, (s, e, f, seg) in enumerate([(None, "2020-12-31", "2021-02-01", None), ("2020-01-01", "2020-12-31", "2021-02-01", None), (None, "2019-12-31", "2020-02-01", None), (None, "2020-12-31", "2021-07-01", None), (None, "2020-12-31", "2021-02-01", "x")])], "i int, period_start date, period_end date, filed date, segment string")
    assert rows(claims.eligible_instants(inst, lit("2021-06-30", "date"), segment="segment"), "i") == [(0,)]


def fact(key, concept, value, end="2023-12-31", unit="USD", filed="2024-02-01", accession="1", start=None, segment=None):
    return (key, concept, unit, None if value is None else D(value), start and day(start), day(end), day(filed), accession, segment, f"{concept}@{end}")


FACTS = "cik string, concept string, unit string, value decimal(38,9), period_start date, period_end date, filed date, accession string, segment string, id string"


def test_instants_are_selected_or_ambiguous(spark):
    data = [
        fact("1", "A", 1, end="2023-09-30"), fact("1", "A", 2), fact("1", "A", 3, filed="2024-03-01"), fact("1", "A", 4, filed="2024-03-01", accession="2"), fact("1", "A", 9, filed="2024-07-01"), fact("1", "A", 8, end="2024-07-31"),
        fact("1", "A", 7, start="2023-01-01", filed="2024-03-05"), fact("1", "A", 6, segment="x", filed="2024-03-05"), fact("2", "A", 5, end="2022-01-31"), fact("3", "A", 5), fact("3", "A", 6), fact("3", "B", 5), fact("3", "B", 5), fact("3", "B", None), fact("4", "A", 0), fact("4", "A", 3, unit="EUR"),
    ]
    got = claims.select_instants(spark.createDataFrame(data, FACTS), ["cik"], lit("2024-06-30", "date"))
    assert rows(got, "cik", "concept", "unit", "value", "ambiguous") == [("1", "A", "USD", D(4), False), ("3", "A", "USD", None, True), ("3", "B", "USD", D(5), False), ("4", "A", "EUR", D(3), False), ("4", "A", "USD", D(0), False)]


SCOPED_CASES = {
    # a component equal to the stated total may be inside it: a duplicate, not added, nothing to say
    "equal part": ([("DebtCurrent", 10), ("LongTermDebtCurrent", 10), ("LongTermDebtNoncurrent", 40)], "debt", 50, "REPORTED", ["LongTermDebtCurrent"], []),
    "smaller part": ([("DebtCurrent", 10), ("CommercialPaper", 4), ("LongTermDebtNoncurrent", 40)], "debt", 50, "REPORTED", ["CommercialPaper"], ["POTENTIAL_DUPLICATE:CommercialPaper"]),
    "part above total": ([("DebtCurrent", 10), ("LongTermDebtCurrent", 11)], "debt", None, "CONFLICTING", ["LongTermDebtCurrent"], ["POTENTIAL_DUPLICATE:LongTermDebtCurrent", "COMPONENT_ABOVE_TOTAL"]),
    "part of other period": ([("DebtCurrent", 10), ("LongTermDebtCurrent", 11, "2023-09-30")], "debt", 10, "REPORTED", [], []),
    "parts alone": ([("LongTermDebtCurrent", 3), ("CommercialPaper", 4), ("ShortTermBorrowings", 1), ("LongTermDebtNoncurrent", 40)], "debt", 48, "REPORTED", [], []),
    "combined alone": ([("LongTermDebt", 70)], "debt", 70, "REPORTED", [], ["NO_CURRENT_DEBT_CONCEPT", "COMBINED_TOTAL_USED"]),
    "combined differs": ([("LongTermDebt", 70), ("LongTermDebtCurrent", 5), ("LongTermDebtNoncurrent", 60)], "debt", 65, "REPORTED", [], ["COMBINED_TOTAL_DIFFERS"]),
    "combined agrees": ([("LongTermDebt", 65), ("LongTermDebtCurrent", 5), ("LongTermDebtNoncurrent", 60)], "debt", 65, "REPORTED", [], []),
    "combined beside a stated total": ([("LongTermDebt", 70), ("DebtCurrent", 5), ("LongTermDebtNoncurrent", 60)], "debt", 65, "REPORTED", [], ["COMBINED_TOTAL_OF_OTHER_SCOPE"]),
    "combined and noncurrent": ([("LongTermDebt", 60), ("LongTermDebtNoncurrent", 60)], "debt", 60, "REPORTED", [], ["NO_CURRENT_DEBT_CONCEPT", "COMBINED_TOTAL_MATCHES"]),
    "combined of other period": ([("LongTermDebt", 60, "2023-09-30"), ("LongTermDebtNoncurrent", 61)], "debt", 61, "REPORTED", [], ["NO_CURRENT_DEBT_CONCEPT", "COMBINED_TOTAL_OF_OTHER_PERIOD"]),
    "no debt": ([("CashAndCashEquivalentsAtCarryingValue", 1)], "debt", None, "REVIEWED_ABSENT", [], []),
    "zero debt": ([("DebtCurrent", 0)], "debt", 0, "REPORTED", [], []),
    "leases in total": ([("FinanceLeaseLiability", 9), ("FinanceLeaseLiabilityCurrent", 2), ("FinanceLeaseLiabilityNoncurrent", 7)], "finance_leases", 9, "REPORTED", ["FinanceLeaseLiabilityCurrent", "FinanceLeaseLiabilityNoncurrent"], []),
    "leases in parts": ([("FinanceLeaseLiabilityCurrent", 2), ("FinanceLeaseLiabilityNoncurrent", 7, "2023-09-30")], "finance_leases", 9, "REPORTED", [], ["PARTS_SPAN_PERIODS"]),
    "leases differ": ([("FinanceLeaseLiability", 9), ("CapitalLeaseObligations", 8), ("FinanceLeaseLiabilityCurrent", 2)], "finance_leases", 8, "REPORTED", ["FinanceLeaseLiabilityCurrent"], ["SEVERAL_TOTALS", "TOTAL_DIFFERS_FROM_PARTS"]),
    "operating leases": ([("OperatingLeaseLiability", 5), ("OperatingLeaseLiabilityCurrent", 5, "2023-09-30")], "operating_leases", 5, "REPORTED", [], ["PARTS_OF_OTHER_PERIOD"]),
    "securities once": ([("CashAndCashEquivalentsAtCarryingValue", 1), ("ShortTermInvestments", 3), ("MarketableSecuritiesCurrent", 2), ("MarketableSecuritiesNoncurrent", 4), ("LongTermInvestments", 99)], "nonoperating_assets", 7, "REPORTED", [], ["NOT_ADDED:ShortTermInvestments", "EXCLUDED:LongTermInvestments"]),
    "preferred": ([("PreferredStockValueOutstanding", 6), ("PreferredStockValue", 5)], "preferred_equity", 5, "REPORTED", [], ["CARRYING_VALUES_DISAGREE"]),
    "minority": ([("MinorityInterest", 6), ("NoncontrollingInterestInVariableInterestEntity", 6)], "noncontrolling_interests", 6, "REPORTED", [], []),
    "minority disagrees": ([("MinorityInterest", 6), ("NoncontrollingInterestInVariableInterestEntity", 5)], "noncontrolling_interests", None, "CONFLICTING", [], ["MEASURES_DISAGREE"]),
    "minority by entities": ([("NoncontrollingInterestInVariableInterestEntity", 5)], "noncontrolling_interests", 5, "REPORTED", [], ["VIE_MEASURE_USED"]),
    "shares": ([("EntityCommonStockSharesOutstanding", 100), ("CommonStockSharesOutstanding", 90)], "common_shares", 100, "REPORTED", [], []),
    "shares of balance sheet": ([("CommonStockSharesOutstanding", 90)], "common_shares", 90, "REPORTED", [], ["BALANCE_SHEET_COUNT_USED"]),
    "no shares": ([("DebtCurrent", 90)], "common_shares", None, "UNAVAILABLE", [], []),
    "several values": ([("DebtCurrent", 10), ("LongTermDebtNoncurrent", 5), ("LongTermDebtNoncurrent", 6)], "debt", None, "CONFLICTING", [], ["AMBIGUOUS_VALUE:LongTermDebtNoncurrent"]),
    "too large": ([("CommercialPaper", "99999999999999999999999999999"), ("LongTermDebtNoncurrent", 5)], "debt", None, "OUT_OF_RANGE", [], []),
}


def test_claims_by_scope(spark):
    data = [fact(k, c, v, *end, unit="shares" if "Shares" in c else "USD") for k, (facts, *_) in SCOPED_CASES.items() for c, v, *end in facts]
    got = {(r["cik"], r["claim"]): r for r in claims.scoped_claims(claims.select_instants(spark.createDataFrame(data, FACTS), ["cik"], lit("2024-06-30", "date")), ["cik"]).collect()}
    assert len(got) == 8 * len(SCOPED_CASES)
    for k, (_, claim, value, state, duplicates, notes) in SCOPED_CASES.items():
        r = got[k, claim]
        assert (r["value"], r["state"], r["duplicates"], r["notes"]) == (None if value is None else D(value), state, duplicates, notes), k
        assert r["permitted"] == (state in ("REPORTED", "REVIEWED_ABSENT")), k
    r = got["smaller part", "debt"]
    assert (r["sources"], r["candidates"], r["current"], r["noncurrent"], r["period_end"]) == (["DebtCurrent@2023-12-31", "LongTermDebtNoncurrent@2023-12-31"], ["CommercialPaper"], D(10), D(40), day("2023-12-31"))
    assert got["part above total", "debt"]["sources"] == ["DebtCurrent@2023-12-31", "LongTermDebtCurrent@2023-12-31"]
    assert (got["leases in total", "finance_leases"]["current"], got["leases in total", "finance_leases"]["noncurrent"]) == (D(2), D(7))
    assert got["leases in total", "finance_leases"]["sources"] == ["FinanceLeaseLiability@2023-12-31"]
    assert got["minority disagrees", "noncontrolling_interests"]["sources"] == ["MinorityInterest@2023-12-31", "NoncontrollingInterestInVariableInterestEntity@2023-12-31"]


def test_bridge_of_scoped_claims(spark):
    """Reviewed absent claims count as nothing, conflicting ones make the bridge unavailable."""
    data = [fact("1", "DebtCurrent", 10), fact("1", "CashAndCashEquivalentsAtCarryingValue", 4), fact("2", "DebtCurrent", 10), fact("2", "CommercialPaper", 11), fact("2", "CashAndCashEquivalentsAtCarryingValue", 4)]
    got = claims.scoped_claims(claims.select_instants(spark.createDataFrame(data, FACTS), ["cik"], lit("2024-06-30", "date")), ["cik"])
    assert rows(claims.equity_bridge(got, ["cik"], claims.DEDUCTED, ["cash"], claims.USABLE)) == [("1", D(-6), "AVAILABLE", []), ("2", None, "UNAVAILABLE", ["debt"])]


def test_two_values_of_a_concept_conflict(spark):
    df = spark.createDataFrame([("1", "DebtTotal", D(5), "a"), ("1", "DebtTotal", D(6), "b"), ("1", "CashAndEquivalents", D(1), "c"), ("1", "CashAndEquivalents", D(1), "d")], "cik string, concept string, value decimal(38,9), id string")
    got = {r["claim"]: (r["value"], r["state"]) for r in claims.claims(df, ["cik"]).collect()}
    assert got["debt"] == (None, "CONFLICTING") and got["cash"] == (D(1), "REPORTED")


def test_seven_methods(spark):
    every = ["revenue", "operating_income", "operating_cash_flow", "capital_expenditures", "net_income"]
    full = {c: "CERTIFIED" for c in claims.BRIDGE_CLAIMS}
    data = [("all", every, full, "CERTIFIED", "industrial", True, True), ("bank", ["net_income"], full, "CERTIFIED", "financial_statement_evidence", True, False), ("bare", [], {"debt": "UNAVAILABLE"}, None, "industrial", None, None), ("null", None, None, "CERTIFIED", None, False, True)]
    df = spark.createDataFrame(data, "id string, metrics array<string>, claims map<string,string>, shares_state string, statement_family string, equity_totals boolean, dividends boolean")
    got = {(r["id"], r["method"]): r["missing"] for r in claims.readiness_methods(df, "id", ("CERTIFIED",)).collect()}
    assert len(got) == 28 and [m for (i, m), x in got.items() if i == "all" and x] == ["bank_excess_return"] and got["all", "bank_excess_return"] == ["NOT_A_FINANCIAL_STATEMENT_FAMILY_FILER"]
    assert got["bank", "operating_dcf"] == got["bank", "apv"] == [claims.INDUSTRIAL] and got["bank", "bank_excess_return"] == [] and got["bank", "ddm"] == ["MISSING_DIVIDEND_EVIDENCE"] and got["bank", "comparables"] == []
    assert got["bare", "operating_dcf"] == sorted(["MISSING_OPERATING_INCOME_OR_REVENUE", "MISSING_CASH_FLOW_OR_CAPEX", "MISSING_DATED_OUTSTANDING_SHARES", *[f"MISSING_BRIDGE_CLAIM_{c.upper()}" for c in claims.BRIDGE_CLAIMS]])
    assert got["bare", "residual_income"] == ["MISSING_BOOK_EQUITY_TOTAL", "MISSING_DATED_OUTSTANDING_SHARES", "MISSING_NET_INCOME", "PREFERRED_OR_NCI_CLAIM_NOT_RESOLVED"] and got["null", "comparables"] == ["MISSING_REVENUE_AND_NET_INCOME"] and got["null", "ddm"] == []


# Releases


BASE = {"value": D(100_000_000), "unit": "USD", "concept": "Revenues", "accession": "a1", "filed": day("2021-02-01"), "available_at": at("2021-02-02"), "source_object": "o1", "state": "SOURCE_VALIDATED"}
CONTRACT = [("revenue", "USD", ["Revenues", "SalesRevenueNet"], ["OtherIncome"]), ("net_income", "USD", ["NetIncomeCommon"], ["NetIncomeLoss"])]


@pytest.mark.parametrize(("before", "after", "codes"), [
    ({}, {}, []), ({}, None, ["FIELD_LOST"]), (None, {}, ["FIELD_GAINED"]), ({}, {"unit": "EUR"}, ["CONTRACT_UNIT_VIOLATION"]), ({"unit": "EUR"}, {}, ["UNIT_CORRECTED"]), ({}, {"concept": "SalesRevenueNet"}, ["CONCEPT_PRIORITY_DEMOTED"]),
    ({"concept": "SalesRevenueNet"}, {}, ["CONCEPT_CHANGED"]), ({}, {"concept": "OtherIncome"}, ["PROHIBITED_BASIS_SUBSTITUTION"]), ({}, {"concept": "Unknown"}, ["BASIS_SUBSTITUTION_UNSUPPORTED"]), ({}, {"value": D(100_900_000)}, ["IMMATERIAL_VALUE_DRIFT"]),
    ({}, {"value": D(100_000)}, ["SUSPECTED_UNCONVERTED_SCALE"]), ({}, {"value": D(100_000_000_000_000)}, ["SUSPECTED_UNCONVERTED_SCALE"]), ({}, {"value": D(150_000_000), "accession": "a2", "filed": day("2021-05-01")}, ["RESTATEMENT_WITH_NEW_FILING"]),
    ({}, {"value": D(150_000_000), "accession": "a0", "filed": day("2020-05-01")}, ["FILING_REGRESSION_EARLIER_ACCESSION"]), ({}, {"value": D(150_000_000), "source_object": "o2"}, ["VALUE_CHANGED_WITH_SOURCE_REVISION"]), ({}, {"value": D(150_000_000)}, ["VALUE_CHANGED_WITHOUT_SOURCE_REVISION"]),
    ({}, {"value": D(-150_000_000)}, ["SIGN_CONVENTION_VIOLATION", "VALUE_CHANGED_WITHOUT_SOURCE_REVISION"]), ({}, {"value": None}, ["VALUE_LOST_WITH_USABLE_STATE"]), ({}, {"available_at": at("2021-01-01")}, ["AVAILABILITY_CUTOFF_INCONSISTENT"]), ({}, {"filed": day("2021-02-03")}, ["FILING_DATE_INCONSISTENT"]),
    ({}, {"available_at": at("2031-01-01")}, ["FUTURE_AVAILABILITY_UNSUPPORTED"]), ({}, {"state": "SOURCE_UNVALIDATED"}, ["VALIDATION_DOWNGRADE"]), ({}, {"state": "CONFLICT"}, ["EVIDENCE_CONFLICT_INTRODUCED"]), ({}, {"state": "BLOCKED"}, ["SOURCE_BLOCKED"]), ({"state": "SOURCE_UNVALIDATED"}, {}, ["STATE_IMPROVED"]),
    ({"state": "CONFLICT"}, {"state": "BLOCKED"}, ["STATE_CHANGED"]), ({}, {"value": None, "unit": None, "concept": None, "state": "MISSING_OBSERVATION"}, ["OBSERVATION_LOST"]), ({}, {"state": "PERIOD_MISMATCH"}, ["PERIOD_ALIGNMENT_LOST"]), ({}, {"state": "UNIT_MISMATCH"}, ["UNIT_MISMATCH_INTRODUCED"]),
])
def test_release_findings(spark, before, after, codes):
    schema = "ticker string, field_id string, value decimal(38,9), unit string, concept string, accession string, filed date, available_at timestamp, source_object string, state string"
    side = lambda x: spark.createDataFrame([("T", "revenue", *{**BASE, **x}.values())] if x is not None else [], schema)
    rules = spark.createDataFrame(CONTRACT, "field string, unit string, concepts array<string>, prohibited array<string>")
    got = releases.diff_reports(side(before), side(after), ["ticker", "field_id"], "field_id", rules, lit("2022-01-01", "timestamp")).collect()
    assert sorted(r["code"] for r in got) == codes and all(r["severity"] == releases.SEVERITY[r["code"]] for r in got)


def test_report_and_company_findings(spark):
    rep = lambda mode, contract, as_of: spark.createDataFrame([(mode, contract, day(as_of))], "mode string, contract string, as_of date")
    assert rows(releases.report_findings(rep("live", "v1", "2024-01-02"), rep("fixture", "v2", "2024-01-01")), "code") == [("AS_OF_REGRESSION",), ("CONTRACT_SCHEMA_MISMATCH",), ("MODE_MISMATCH",)]
    assert rows(releases.report_findings(rep("live", "v1", "2024-01-02"), rep("live", "v1", "2024-01-02"))) == []
    a = spark.createDataFrame([("A", "SOURCE_VALIDATED"), ("B", "BLOCKED"), ("C", "BLOCKED"), ("D", "BLOCKED"), ("E", "BLOCKED")], "t string, overall string")
    b = spark.createDataFrame([("A", "BLOCKED"), ("B", "SOURCE_VALIDATED"), ("C", "CONFLICT"), ("D", "BLOCKED"), ("F", "BLOCKED")], "t string, overall string")
    assert rows(releases.overall_moves(a, b, "t"), "t", "code") == [("A", "COMPANY_OVERALL_DOWNGRADE"), ("B", "COMPANY_OVERALL_UPGRADE"), ("C", "COMPANY_OVERALL_CHANGED"), ("E", "COMPANY_DROPPED"), ("F", "COMPANY_ADDED")]


KINDS = {
    "report": "mode string, contract string, as_of string, digest string", "families": "family string, state string, sample_complete boolean", "companies": "company string, cik string, overall string, blocking array<string>",
    "checks": "company string, check string, state string",
    "fields": "company string, period_end date, field string, value decimal(38,9), unit string, concept string, accession string, filed date, available_at timestamp, source_object string, state string, corroborations array<struct<source: string, agrees: boolean>>",
}


def report_field(company="A", end="2023-12-31", field="revenue", value=10**9, unit="USD", concept="Revenues", accession="1", filed="2024-02-01", available="2024-02-01", source="o1", state="SOURCE_UNVALIDATED", corroborations=()):
    return (company, day(end), field, None if value is None else D(value), unit, concept, accession, day(filed), at(available), source, state, None if corroborations is None else list(corroborations))


GOOD = {
    "report": [("live", "v1", "2024-03-01", "d1")], "families": [("facts", "resolved", True)], "companies": [("A", "1", "SOURCE_UNVALIDATED", [])], "checks": [("A", "facts", "MATCH")],
    "fields": [report_field(), report_field(end="2022-12-31", value=9 * 10**8)],
}
CONTRACT_RULES = [("revenue", "USD", ["Revenues", "SalesRevenueNet"], ["GrossProfit"])]
#: What changes in the second report (level -> its rows), the findings, and the outcome.
TREE_CASES = {
    "unchanged": ({}, [], "PASS"),
    "content address": ({"report": [("live", "v1", "2024-03-01", "d2")]}, [("report", "REPORT_CONTENT_ADDRESS_CHANGED")], "INFO"),
    "earlier instant": ({"report": [("live", "v1", "2024-02-01", "d1")]}, [("report", "AS_OF_REGRESSION")], "WARNING"),
    "other mode and contract": ({"report": [("fixture", "v2", "2024-03-01", "d1")]}, [("report", "CONTRACT_SCHEMA_MISMATCH"), ("report", "MODE_MISMATCH")], "FAIL"),
    "new period": ({"fields": [*GOOD["fields"], report_field(end="2024-12-31")]}, [("company", "PERIOD_OBSERVED_ADDED"), ("field", "NEW_PERIOD_FIELD_OBSERVED")], "INFO"),
    "lost period": ({"fields": GOOD["fields"][:1]}, [("company", "PERIOD_OBSERVED_LOST")], "WARNING"),
    "new field": ({"fields": [*GOOD["fields"], report_field(field="net_income")]}, [("field", "FIELD_GAINED")], "INFO"),
    "restated": ({"fields": [report_field(value=2 * 10**9, accession="2", filed="2024-02-20", available="2024-02-20"), GOOD["fields"][1]]}, [("field", "RESTATEMENT_WITH_NEW_FILING")], "INFO"),
    "regressed filing": ({"fields": [report_field(value=2 * 10**9, accession="0", filed="2024-01-20", available="2024-01-20"), GOOD["fields"][1]]}, [("field", "FILING_REGRESSION_EARLIER_ACCESSION")], "FAIL"),
    "observation lost": ({"fields": [report_field(value=None, concept=None, unit=None, accession=None, source=None, state="MISSING_OBSERVATION"), GOOD["fields"][1]]}, [("field", "OBSERVATION_LOST")], "WARNING"),
    "demoted": ({"fields": [report_field(concept="SalesRevenueNet"), GOOD["fields"][1]]}, [("field", "CONCEPT_PRIORITY_DEMOTED")], "WARNING"),
    "prohibited": ({"fields": [report_field(concept="GrossProfit"), GOOD["fields"][1]]}, [("field", "PROHIBITED_BASIS_SUBSTITUTION")], "FAIL"),
    "scale": ({"fields": [report_field(value=10**6), GOOD["fields"][1]]}, [("field", "SUSPECTED_UNCONVERTED_SCALE")], "FAIL"),
    "unit": ({"fields": [report_field(unit="EUR"), GOOD["fields"][1]]}, [("field", "CONTRACT_UNIT_VIOLATION")], "FAIL"),
    "other source object": ({"fields": [report_field(value=2 * 10**9, source="o2"), GOOD["fields"][1]]}, [("field", "VALUE_CHANGED_WITH_SOURCE_REVISION")], "WARNING"),
    "unexplained": ({"fields": [report_field(value=2 * 10**9), GOOD["fields"][1]]}, [("field", "VALUE_CHANGED_WITHOUT_SOURCE_REVISION")], "FAIL"),
    "family": ({"families": [("facts", "unresolved", False)]}, [("family", "MANIFEST_ARTIFACT_SAMPLE_INCOMPLETE"), ("family", "SOURCE_FAMILY_UNRESOLVED")], "FAIL"),
    "family gone or new": ({"families": [("prices", "unresolved", False)]}, [], "PASS"),
    "validated alone": ({"fields": [report_field(state="SOURCE_VALIDATED"), GOOD["fields"][1]]}, [("field", "NON_INDEPENDENT_CORROBORATION"), ("field", "STATE_IMPROVED")], "FAIL"),
    "validated by the same object": ({"fields": [report_field(state="SOURCE_VALIDATED", corroborations=[("x", True)]), GOOD["fields"][1]]}, [("field", "NON_INDEPENDENT_CORROBORATION"), ("field", "STATE_IMPROVED")], "FAIL"),
    "validated by another": ({"fields": [report_field(state="SOURCE_VALIDATED", corroborations=[("x", True)]), GOOD["fields"][1]], "checks": [("A", "facts", "MATCH"), ("A", "other", "DIFFERENT_SOURCE_OBJECT")]}, [("company", "SOURCE_IDENTITY_DIVERGENCE_OBSERVED"), ("field", "STATE_IMPROVED")], "INFO"),
    "validated without provenance": ({"fields": [report_field(state="SOURCE_VALIDATED", corroborations=None), GOOD["fields"][1]]}, [("field", "STATE_IMPROVED")], "INFO"),
    "identity check": ({"checks": [("A", "facts", "DIFFERENT_SOURCE_OBJECT")]}, [("company", "SOURCE_IDENTITY_REGRESSION")], "WARNING"),
    "future": ({"fields": [report_field(available="2025-01-01"), GOOD["fields"][1]]}, [("field", "FUTURE_AVAILABILITY_UNSUPPORTED")], "FAIL"),
    "issuer": ({"companies": [("A", "2", "SOURCE_UNVALIDATED", [])]}, [("company", "ISSUER_IDENTITY_CHANGED")], "FAIL"),
    "no issuer": ({"companies": [("A", None, "SOURCE_UNVALIDATED", [])]}, [("company", "ISSUER_IDENTITY_UNRESOLVED")], "FAIL"),
    "collision": ({"companies": [("A", "1", "SOURCE_UNVALIDATED", []), ("A", "2", "SOURCE_UNVALIDATED", [])]}, [("company", "TICKER_IDENTITY_COLLISION")], "FAIL"),
    "blocked": ({"companies": [("A", "1", "BLOCKED", ["x", "y"])]}, [("company", "BLOCKING_ISSUE_ADDED"), ("company", "BLOCKING_ISSUE_ADDED"), ("company", "COMPANY_OVERALL_DOWNGRADE")], "FAIL"),
    "better": ({"companies": [("A", "1", "SOURCE_VALIDATED", [])]}, [("company", "COMPANY_OVERALL_UPGRADE")], "INFO"),
    "dropped": ({"companies": [("B", "9", "BLOCKED", ["x"])], "fields": [report_field("B"), report_field("B", end="2020-12-31")], "checks": [("B", "facts", "DIFFERENT_SOURCE_OBJECT")]}, [("company", "COMPANY_ADDED"), ("company", "COMPANY_DROPPED")], "WARNING"),
}


def make_report(spark, change=()):
    data = {**GOOD, **dict(change)}
    return comparison.Report(*[spark.createDataFrame(data[k], KINDS[k]).coalesce(1) for k in comparison.Report._fields])


def contract_rules(spark):
    return spark.createDataFrame(CONTRACT_RULES, "field string, unit string, concepts array<string>, prohibited array<string>")


@pytest.mark.parametrize("name", sorted(k for k, (change, *_) in TREE_CASES.items() if not change or "report" in change or "families" in change))
def test_reports_as_trees(spark, name):
    change, want, outcome = TREE_CASES[name]
    found = comparison.compare_reports(make_report(spark), make_report(spark, change), contract_rules(spark), lit("2024-06-01", "timestamp")).cache()
    assert rows(found, "level", "code") == sorted(want)
    assert comparison.outcome(found).first()["outcome"] == outcome


def test_companies_of_one_report(spark):
    """The cases that change a company, each a company of its own (and its B another) in one pair of reports."""
    cases = {k: c for k, c in TREE_CASES.items() if c[0] and not {"report", "families"} & set(c[0])}
    before, after = ({**GOOD, "companies": [], "checks": [], "fields": []} for _ in range(2))
    for name, (change, *_) in cases.items():
        named = lambda data, name=name: [(f"{name}/{r[0]}", *r[1:]) for r in data]
        for level in ("companies", "checks", "fields"):
            before[level] = before[level] + named(GOOD[level])
            after[level] = after[level] + named(change.get(level, GOOD[level]))
    found = comparison.compare_reports(make_report(spark, before), make_report(spark, after), contract_rules(spark), lit("2024-06-01", "timestamp")).collect()
    assert all(r["company"] for r in found)
    for name, (_, want, outcome) in cases.items():
        own = [r for r in found if r["company"].startswith(f"{name}/")]
        assert sorted((r["level"], r["code"]) for r in own) == sorted(want), name
        assert max((r["severity"] for r in own), key=comparison.SCALE.index) == outcome, name


def test_findings_tell_what_they_are_about(spark):
    """A field lost within a period that is still there, removed where it was unusable; a resolved issue; carried over claims."""
    was = {"fields": [*GOOD["fields"], report_field(field="capex", state="CONFLICT"), report_field(field="net_income"), report_field(field="assets", state="PASS")], "companies": [("A", "1", "SOURCE_UNVALIDATED", ["old"])]}
    now = {"fields": [GOOD["fields"][0], report_field(field="assets", state="PASS")]}
    found = comparison.compare_reports(make_report(spark, was), make_report(spark, now))
    assert rows(found, "code", "severity", "company", "period_end", "field", "subject") == sorted([
        ("UNUSABLE_FIELD_REMOVED", "INFO", "A", "2023-12-31", "capex", None), ("FIELD_LOST", "WARNING", "A", "2023-12-31", "net_income", None), ("PERIOD_OBSERVED_LOST", "WARNING", "A", None, None, "2022-12-31"),
        ("BLOCKING_ISSUE_RESOLVED", "INFO", "A", None, None, "old"), ("NON_INDEPENDENT_CORROBORATION_PREEXISTING", "WARNING", "A", "2023-12-31", "assets", None),
    ], key=str)


def test_reconcile_and_parity(spark):
    old = spark.createDataFrame([("1", "x", 1), ("2", "x", 2), ("3", "y", 5), (None, "z", 1)], "id string, c string, v int")
    new = spark.createDataFrame([("1", "x", 1), ("4", "x", 3), ("3", "y", 5), ("5", "w", 1), (None, "z", 1)], "id string, c string, v int")
    assert rows(releases.reconcile(old, new, "id", ["c"], "v")) == [("ADDED", "4"), ("ADDED", "5"), ("CHANGED", "x"), ("REMOVED", "2")]
    assert rows(releases.replace_snapshot(old, new.where("id = '1' or id is null"), "id"), "id") == sorted([("1",), ("2",), ("3",), (None,)], key=str)
    assert rows(releases.multiset_difference(old, new), "id", "surplus") == [("2", 1), ("4", -1), ("5", -1)]
    digest = lambda t: rows(releases.group_digest(t, ["c"]))
    assert digest(old) == digest(old.repartition(5)) and digest(old.where("c = 'y'")) == digest(new.where("c = 'y'")) and digest(old.where("c = 'x'")) != digest(new.where("c = 'x'"))
    assert rows(releases.reproduce_check(old, new, ["c", "v"], ["c"], "v").where("kind = 'COVERAGE_SHRANK'")) == [("COVERAGE_SHRANK", "x")]
    assert rows(releases.diff_coverage(old, new, ["c"], "v")) == [("w", [], [1]), ("x", [2], [3])]
    checks = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "name string, ok boolean")
    decision, failed = releases.gate(checks, "name", "ok")
    assert rows(decision) == [(False, 3, 2)] and rows(failed) == [("b",), ("c",)] and rows(releases.gate(checks.where("ok"), "name", "ok")[0]) == [(True, 1, 0)] and rows(releases.gate(checks.where("false"), "name", "ok")[0]) == [(False, 0, 0)]
    paths = spark.createDataFrame([("h1", "a"), ("h1", "b"), ("h2", "c"), ("h2", "c")], "h string, p string")
    assert rows(releases.one_path_per_hash(paths, "h", "p")) == [("h1", 2)]
    inv = releases.reconcile_inventory(spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 4)], "p string, s int"), spark.createDataFrame([("a", 1), ("b", 3), ("c", 3), ("e", 5)], "p string, s int"), "p", "s")
    assert rows(inv) == [("a", "MATCH"), ("b", "SIZE_MISMATCH"), ("c", "UNRESOLVED"), ("d", "MISSING"), ("e", "UNREGISTERED")]


# Streams


def test_stream_ingest_takes_each_id_once(spark, tmp_path):
    schema = "id string, ts timestamp, v int"
    write = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    write([("a", at("2024-01-01"), 1), ("a", at("2024-01-01"), 1), ("b", at("2024-01-02"), 2)])
    kind = spark.read.parquet(f"{tmp_path}/in").schema

    def run():
        s = upkeep.ingest(spark, f"{tmp_path}/in", kind, "id", "ts")
        s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    run()
    write([("b", at("2024-01-02"), 2), ("c", at("2024-01-03"), 3)])
    run()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "id", "v") == [("a", 1), ("b", 2), ("c", 3)]


def test_maintained_tables(spark, tmp_path):
    schema = "k string, v int, available_at timestamp"

    def run(name, data, make):
        path = f"{tmp_path}/{name}-in"
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        make(stream, f"{tmp_path}/{name}").start().awaitTermination()
        return rows(upkeep.current(spark, f"{tmp_path}/{name}"), "k", "v")

    up = lambda s, t: upkeep.upsert_stream(s, t, f"{t}-c", "k", 4)
    assert run("u", [("a", 1, None), ("a", 2, None), ("b", 3, None), (None, 4, None)], up) == sorted([("a", 1), ("a", 2), ("b", 3), (None, 4)], key=str)
    assert run("u", [("a", 9, None), ("c", 5, None), (None, 6, None)], up) == sorted([("a", 9), ("b", 3), ("c", 5), (None, 6)], key=str)
    last = lambda s, t: upkeep.latest_stream(s, t, f"{t}-c", ["k"], ["available_at", "v"], 4)
    assert run("l", [("a", 1, at("2024-01-02")), ("a", 2, at("2024-01-01")), ("b", 1, at("2024-01-01"))], last) == [("a", 1), ("b", 1)]
    assert run("l", [("a", 3, at("2024-01-01")), ("b", 2, at("2024-01-05")), ("c", 7, at("2024-01-01"))], last) == [("a", 1), ("b", 2), ("c", 7)]


def test_a_batch_tried_again_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    table = f"{tmp_path}/t"
    sum_up = lambda prev, new: prev.unionByName(new)  # noqa: E731 - would double rows if it ran twice
    upkeep._merge(df, 0, table, ["k"], 4, sum_up)
    upkeep._merge(df, 1, table, ["k"], 4, sum_up)
    upkeep._merge(df, 1, table, ["k"], 4, sum_up)
    assert rows(upkeep.current(spark, table)) == [("a", 1), ("a", 1), ("b", 2), ("b", 2)]


def stream_of(spark, path, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_queries_take_turns_at_a_table(spark, tmp_path):
    """Each query numbers its batches from 0: the mark must tell whose batch it was."""
    up = lambda s, c: upkeep.upsert_stream(s, f"{tmp_path}/t", f"{tmp_path}/{c}", "k", 4).start().awaitTermination()
    up(stream_of(spark, f"{tmp_path}/one", [("a", 1)], "k string, v int"), "c1")
    up(stream_of(spark, f"{tmp_path}/two", [("b", 2)], "k string, v int"), "c2")
    assert rows(upkeep.current(spark, f"{tmp_path}/t")) == [("a", 1), ("b", 2)]
    up(stream_of(spark, f"{tmp_path}/one", [("c", 3)], "k string, v int"), "c1")
    assert rows(upkeep.current(spark, f"{tmp_path}/t")) == [("a", 1), ("b", 2), ("c", 3)]
    last = lambda s, c: upkeep.latest_stream(s, f"{tmp_path}/l", f"{tmp_path}/{c}", ["k"], ["v"], 4).start().awaitTermination()
    last(stream_of(spark, f"{tmp_path}/three", [("a", 1)], "k string, v int"), "c3")
    last(stream_of(spark, f"{tmp_path}/four", [("a", 5), ("b", 2)], "k string, v int"), "c4")
    assert rows(upkeep.current(spark, f"{tmp_path}/l")) == [("a", 5), ("b", 2)]


def test_ids_are_taken_once_for_good(spark, tmp_path):
    schema = "id string, v int"
    run = lambda data: upkeep.ingest_once(stream_of(spark, f"{tmp_path}/in", data, schema), f"{tmp_path}/t", f"{tmp_path}/c", "id", 4).start().awaitTermination()
    run([("a", 2), ("a", 1), ("b", 5), (None, 4)])
    run([("a", 0), ("c", 3), (None, 1)])
    run([("b", 9)])
    assert rows(upkeep.current(spark, f"{tmp_path}/t")) == sorted([("a", 1), ("b", 5), ("c", 3), (None, 4)], key=str)


def test_digests_see_moved_nulls_and_cells(spark):
    schema = "g string, a string, b string"
    make = lambda *data: spark.createDataFrame([("g", *x) for x in data], schema)
    tables = [make(("x", None), (None, "y")), make((None, "x"), ("y", None)), make(("x", "y")), make(("x", "y"), ("x", "y")), make(("1:x|1:y", "")), make(("x", "1:y")), make(("~", None)), make((None, "~"))]
    digests = {releases.group_digest(t, ["g"]).first()["digest"] for t in tables}
    ids = {sinks.release_id(sinks.manifest(t.withColumn("d", F.lit("2024-01-01")), "g", "d"), "g").first()[0] for t in tables}
    assert len(digests) == len(ids) == len(tables)
    assert releases.group_digest(tables[0], ["g"]).first() == releases.group_digest(make((None, "y"), ("x", None)).repartition(2), ["g"]).first()


# Ranges, bands and blocks against all pairs


def some_days(rng, n, span=900):
    return [day("2019-01-01") + dt.timedelta(days=rng.randrange(span)) if rng.random() > 0.05 else None for _ in range(n)]


def test_interval_join_against_all_pairs(spark):
    rng = random.Random(5)
    far = [dt.date(1, 1, 1), dt.date(9999, 12, 31)]
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    iv = [(key(), rng.choice(["A", "B", "C", None]), a, b) for a, b in zip(some_days(rng, 40), some_days(rng, 40), strict=True)] + [("far", "Z", *far), ("one", "Y", far[1], far[1])]
    pts = [(key(), d) for d in some_days(rng, 300)] + [("far", far[0]), ("far", far[1]), ("one", far[1]), ("one", far[0]), ("far", None)]
    got = joins.interval_join(spark.createDataFrame(pts, "k string, d date"), spark.createDataFrame(iv, "k string, m string, a date, b date"), "k", "d", "a", "b", "m").collect()
    found = {(r["k"], r["d"]): (r["points"], r["m"], r["status"]) for r in got}
    assert len(found) == len(got) == len(set(pts))
    for k, d in pts:
        labels = {m for k2, m, a, b in iv if m and k and k2 == k and (a is None or d and d >= a) and (b is None or d and d <= b)}
        assert found[k, d] == (pts.count((k, d)), min(labels) if len(labels) == 1 else None, ["NONE", "FOUND", "AMBIGUOUS"][min(len(labels), 2)])


def test_interval_join_of_a_hot_key(spark):
    """100,000 points and 100,000 intervals of one key are not paired (10^10 rows would not end)."""
    n = spark.range(100_000)
    pts = n.select(F.lit("hot").alias("k"), F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") % 40_000).cast("int")).alias("d"))
    iv = n.select(F.lit("hot").alias("k"), F.lit("A").alias("m"), F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") % 30_000).cast("int")).alias("a"), F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") % 30_000 + F.col("id") % 17).cast("int")).alias("b"))
    got = joins.interval_join(pts, iv, "k", "d", "a", "b", "m")
    held = {d for i in range(100_000) for d in range(i % 30_000, i % 30_000 + i % 17 + 1)}
    asked = [i % 40_000 for i in range(100_000)]
    want = {("FOUND" if d in held else "NONE", d) for d in asked}
    found = {r["status"]: (r["n"], r["p"]) for r in got.groupBy("status").agg(F.count("*").alias("n"), F.sum("points").alias("p")).collect()}
    assert found == {s: (sum(t == s for t, _ in want), sum((d in held) == (s == "FOUND") for d in asked)) for s in ("FOUND", "NONE")}


def test_bitemporal_against_all_pairs(spark):
    rng = random.Random(6)
    links = [(rng.choice(["n", None]), rng.choice("xy"), rng.choice(["e1", "e2", "e3", None]), a, b, rng.choice(["source_open_end", "closed", None]), k) for a, b, k in zip(some_days(rng, 40), some_days(rng, 40), some_days(rng, 40), strict=True)]
    asked = [(i % 150, "n", rng.choice("xyz"), on, at_) for i, (on, at_) in enumerate(zip(some_days(rng, 200), some_days(rng, 200), strict=True))]
    want = {}
    for r, ns, i, on, as_of in asked:
        hit = {e for n2, i2, e, a, b, kind, known in links if e and n2 == ns and i2 == i and (a is None or on and a <= on) and (kind == "source_open_end" if b is None else on is not None and on < b) and known and as_of and known <= as_of}
        want.setdefault(r, set()).update(hit)
    got = joins.resolve_bitemporal(spark.createDataFrame(links, "namespace string, identifier string, entity_id string, valid_from date, valid_to date, valid_to_kind string, known_at date"), spark.createDataFrame(asked, "r int, namespace string, identifier string, `on` date, as_of date"), "r")
    assert {r["r"]: r["entities"] for r in got.collect()} == {r: sorted(e) for r, e in want.items()}


def test_prior_year_against_all_pairs(spark):
    rng = random.Random(7)
    data = []
    for i in range(250):
        a = day("2017-01-01") + dt.timedelta(days=rng.randrange(1500))
        data.append((rng.choice(["hot", "hot", "b", None]), None if rng.random() < 0.05 else a, a + dt.timedelta(days=rng.choice([89, 90, 97, 98, 181, 364])), i))
    data += data[:5]
    want = {}
    for k, a, b, v in data:
        old = [w for k2, c, d, w in data if k and k2 == k and a and c and 350 <= (b - d).days <= 378 and abs((b - a).days - (d - c).days) <= 8]
        want[v] = (old[0] if len(old) == 1 else None, ["NONE", "FOUND", "AMBIGUOUS"][min(len(old), 2)])
    got = joins.prior_year(spark.createDataFrame(data, "k string, s date, e date, v int"), ["k"], "s", "e", "v").collect()
    assert len(got) == 250 and {r["v"]: (r["prior_value"], r["status"]) for r in got} == want
    assert {"NONE", "FOUND", "AMBIGUOUS"} == {s for _, s in want.values()}


def test_decumulate_against_all_pairs(spark):
    rng = random.Random(8)
    a = day("2020-01-01")
    chain = [("k", "m", a, a + dt.timedelta(days=d), d) for d in sorted(rng.sample(range(70, 400), 60))]
    good, gaps = derive.decumulate(spark.createDataFrame(chain, "cik string, metric string, period_start date, period_end date, value int").withColumn("value", F.col("value").cast("decimal(38,9)")), ["cik", "metric"])
    prev = {d: [p for *_, p in chain if 75 <= p + 1 <= 300 and 75 <= d - p <= 105] for *_, d in chain if d + 1 >= 150}
    codes = {(r["period_end"], r["reason"]) for r in gaps.collect() if r["reason"] != "CONFLICTING_QUARTER"}
    assert codes == {(a + dt.timedelta(days=d), "NO_PREDECESSOR" if not p else "AMBIGUOUS_PREDECESSOR") for d, p in prev.items() if len(p) != 1}


def test_blocks_change_nothing(spark):
    rng = random.Random(9)
    data, at_ = [], day("2000-01-01")
    for i in range(160):  # a hot key with gaps of years, so that blocks are missing
        at_ += dt.timedelta(days=rng.choice([0, 0, 0, 0, 0, 0, 1, 900]))
        end = at_ + dt.timedelta(days=rng.choice([89, 90, 91]))
        data.append(("hot", at_, end, i))
        at_ = end + dt.timedelta(days=1)
    data += [(k, day("2010-01-01") + dt.timedelta(days=91 * i), day("2010-04-01") + dt.timedelta(days=91 * i), i) for k in ("b", None) for i in range(6)]
    df = spark.createDataFrame(data, "k string, period_start date, period_end date, v int").withColumns({"value": F.col("v").cast("decimal(38,9)"), "concept": F.lit("c")})
    by_key = lambda k: [d for d in data if d[0] == k]
    touch = {(k, d[3]): i > 0 and by_key(k)[i - 1][2] + dt.timedelta(days=1) == d[1] for k in ("hot", "b", None) for i, d in enumerate(by_key(k))}
    quad = {(k, d[3]): all(i - j > 0 and touch[k, by_key(k)[i - j][3]] for j in range(3)) for k in ("hot", "b", None) for i, d in enumerate(by_key(k))}
    sums = {(k, d[2]): sum(x[3] for x in by_key(k)[i - 3 : i + 1]) for k in ("hot", "b", None) for i, d in enumerate(by_key(k)) if quad[k, d[3]]}
    assert any(sums) and not all(quad.values())
    grown = None
    for days in (7, 64, 400, 1 << 20):
        assert {(r["k"], r["v"]): r["touches"] for r in series.contiguous(df, ["k"], "period_start", "period_end", days).collect()} == touch
        got = derive.rolling_contiguous(df, ["k"], 4, "period_start", "period_end", days)
        assert got.columns == [*df.columns, "contiguous"] and {(r["k"], r["v"]): r["contiguous"] for r in got.collect()} == quad
        good, gaps = derive.ttm(df, ["k"], days=days)
        assert {(r["k"], r["period_end"]): int(r["value"]) for r in good.collect()} == sums and gaps.count() == len(data) - len(sums)
        growth = rows(derive.annual_growth(df, ["k"], 2, days=days))
        assert grown in (None, growth)
        grown = growth
    seen = spark.createDataFrame([(rng.choice(["hot", "hot", "b", None]), at("2020-01-01") + dt.timedelta(days=rng.randrange(900)) if rng.random() > 0.1 else None, f"{i:03}") for i in range(200)], "k string, available_at timestamp, id string")
    order = sorted(seen.collect(), key=lambda r: (r["available_at"] is not None, r["available_at"] or at("1970-01-01"), r["id"]))
    want = {r["id"]: 1 + sum(o["k"] == r["k"] for o in order[:i]) for i, r in enumerate(order)}
    for block in ("day", "month", "year"):
        assert {r["id"]: r["revision"] for r in pit.revisions(seen, ["k"], block=block).collect()} == want


def test_reconcile_text_against_all_pairs(spark):
    rng = random.Random(10)
    number = lambda: rng.choice([0.0, -0.0, None, 1e-9, 999.99, 1000.0, 1.0, 0.001, 1e12]) if rng.random() < 0.3 else round(rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 12), 4)
    vals = [(rng.randrange(4), rng.choice(["Revenue", "Cash ", "Other"]), number()) for _ in range(120)]
    facts = []
    for i in range(200):
        d, _, x = rng.choice(vals)
        facts.append((d, f"{rng.choice(['revenue', 'cash'])}", None if x is None else x * rng.choice([1, -1]) * rng.choice([1e-9, 1e-6, 1e-3, 1, 1e3, 1e6, 1e9]) * rng.choice([1, 1.0049, 0.9951, 1.0051, 0.9949]), i))
    # each fact is a metric of its own, so that each state is compared
    names = {f"{m}{i}": m for _, m, _, i in facts}
    close = lambda a, b: abs(a - b) <= 0.005 * max(abs(b), 1e-9)

    def state(d, m, y):
        best = 4
        for d2, label, x in vals:
            if d2 != d or x is None or y is None:
                continue
            named = label.strip().lower() == m
            if named and close(x, y):
                best = min(best, 0)
            elif named and close(-x, y):
                best = min(best, 1)
            elif named and any(close(x * s, y) or close(x, y * s) for s in (1e3, 1e6, 1e9)):
                best = min(best, 2)
            elif close(x, y):
                best = min(best, 3)
        return ["matched", "sign_mismatch", "scale_mismatch", "label_mismatch", "missing"][best]

    # facts of less than a billionth aren't decimals of nine places
    facts = [f for f in facts if f[2] is None or f[2] == 0 or abs(f[2]) >= 1e-9]
    want = {f"{m}{i}": state(d, m, y) for d, m, y, i in facts}
    detail, _ = documents.reconcile_text(spark.createDataFrame([(d, f"{m}{i}", y) for d, m, y, i in facts], "id int, metric string, value double"), spark.createDataFrame(vals, "id int, label string, scaled_value double"), spark.createDataFrame(list(names.items()), "metric string, alias string"), "id")
    assert {r["metric"]: r["state"] for r in detail.collect()} == want and len(set(want.values())) == 5
    with pytest.raises(ValueError):
        documents.reconcile_text(detail, detail, detail, "id", 0.9)


def test_lineage_over_levels(spark):
    cites = [("ttm", "q1"), ("ttm", "q2"), ("q1", "h1"), ("q1", "a"), ("h1", "a"), ("h1", "b"), ("h1", "b"), ("q2", "gone"), ("x", "y"), ("y", "z"), ("z", "y"), ("over", "x"), ("over", "a"), ("self", "self"), ("flat", "a"), (None, "a"), ("flat", None)]
    res = spark.createDataFrame([(r,) for r in ("ttm", "ttm", "q1", "over", "self", "flat", "none", None)], "r string")
    e, src = spark.createDataFrame(cites, "r string, s string"), spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "s string, v int")
    nodes, roots = joins.lineage_tree(res, e, src, "r", "s")
    assert rows(roots, "r", "sources", "missing", "depth", "state") == sorted([("ttm", 2, 1, 3, "INCOMPLETE"), ("q1", 2, 0, 2, "COMPLETE"), ("over", 1, 0, 3, "CYCLE"), ("self", 0, 0, 1, "CYCLE"), ("flat", 1, 0, 1, "COMPLETE"), ("none", 0, 0, 0, "NO_SOURCES")], key=str)
    assert rows(nodes.where("r = 'ttm'"), "s", "depth", "kind") == [("a", 2, "SOURCE"), ("b", 3, "SOURCE"), ("gone", 2, "MISSING"), ("h1", 2, "DERIVED"), ("q1", 1, "DERIVED"), ("q2", 1, "DERIVED")]
    assert joins.lineage_tree(res, e.where("false"), src, "r", "s")[1].where("state <> 'NO_SOURCES'").count() == 0
    rng = random.Random(11)
    graph = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}" if rng.random() < 0.5 else f"s{rng.randrange(9)}") for _ in range(40)]

    def reach(n):
        got, todo = set(), [n]
        while todo:
            m = todo.pop()
            for down in {b for a, b in graph if a == m} - got:
                got.add(down)
                todo.append(down)
        return got

    nodes, roots = joins.lineage_tree(spark.createDataFrame([(f"n{i}",) for i in range(25)], "r string"), spark.createDataFrame(graph, "r string, s string"), src, "r", "s")
    assert {(r["r"], r["s"]) for r in nodes.collect()} == {(f"n{i}", m) for i in range(25) for m in reach(f"n{i}")}
    assert {r["r"] for r in roots.where("state = 'CYCLE'").collect()} == {f"n{i}" for i in range(25) if any(m in reach(m) for m in reach(f"n{i}"))}


def test_altered_sources(spark):
    shape = "id string, value decimal(38,9), unit string"
    stored = spark.createDataFrame([("a", D(1), "USD"), ("b", D(2), None), ("c", D(3), "USD"), ("c", D(4), "USD")], shape)
    claimed = spark.createDataFrame([("a", D(1), "USD"), ("b", D(2), "USD"), ("b", None, None), ("c", D(4), "USD"), ("c", D(5), "USD"), ("gone", D(1), "USD"), ("a", D(9), "EUR")], shape)
    got = rows(joins.altered_sources(claimed, stored, "id", ["value", "unit"]), "id", "reason", "fields")
    assert got == sorted([("b", "DIFFERS", ["unit"]), ("b", "DIFFERS", ["value"]), ("c", "DIFFERS", ["value"]), ("gone", "NOT_STORED", []), ("a", "DIFFERS", ["value", "unit"])], key=str)


# Findings of round 3


@pytest.mark.parametrize("join", ["bitemporal", "interval"])
def test_days_that_stand_for_ranges_are_not_broadcast(spark, join):
    links = spark.range(50).select(F.lit("n").alias("namespace"), F.col("id").alias("identifier"), F.lit("e").alias("entity_id"), lit("2020-01-01", "date").alias("valid_from"), lit("2021-01-01", "date").alias("valid_to"), F.lit("known").alias("valid_to_kind"), lit("2020-01-01", "date").alias("known_at"))
    asked = spark.range(50).select(F.col("id").alias("r"), F.lit("n").alias("namespace"), F.col("id").alias("identifier"), lit("2020-06-01", "date").alias("on"), lit("2020-06-01", "date").alias("as_of"))
    got = joins.resolve_bitemporal(links, asked, "r") if join == "bitemporal" else joins.interval_join(asked, links, "identifier", "on", "valid_from", "valid_to", "entity_id")
    met = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line and "_in#" in line]
    assert met and all("SortMergeJoin" in line for line in met)
    assert got.where("status = 'FOUND'").count() == 50


def test_texts_of_tables_are_parsed_once(spark):
    df = spark.createDataFrame([(1, "| a | b |\n| --- | --- |\n| x | - | $ (1,234.50) |")], "id long, t string")
    got = documents.table_values(df, "id", "t")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("KMBTkmbt%") == 3  # one test and two parts of it
    assert plan.count("StartsWith") <= 4
    assert rows(got, "label", "raw_text", "value") == [("x", "$ (1,234.50)", D("-1234.500000000"))]


def test_table_values_are_not_broadcast(spark):
    facts = spark.range(50).select("id", F.lit("m").alias("metric"), F.lit(7.0).alias("value"))
    found = spark.range(50).select("id", F.lit("l").alias("label"), F.lit(7).cast("decimal(38,9)").alias("scaled_value"))
    got = documents.reconcile_text(facts, found, spark.createDataFrame([("m", "L")], "metric string, alias string"), "id")[0]
    met = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line and "_near#" in line]
    assert met and all("SortMergeJoin" in line for line in met)
    assert got.where("state = 'matched'").count() == 50


def test_markdown_is_made_a_few_pages_at_a_time(spark):
    import pyarrow as pa

    made = []

    class Frame:
        schema = spark.createDataFrame([], "id long, h string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([None if i % 7 == 0 else f"<p>{i}</p>" for i in range(1000)])], ["id", "h"])
            made.extend(run(iter([batch])))

    documents.html_to_markdown(Frame(), "id", "h")
    assert max(b.num_rows for b in made) <= documents.PAGES
    assert [x for b in made for x in b.column(1).to_pylist()] == [None if i % 7 == 0 else str(i) for i in range(1000)]


def test_reproduction_reads_each_result_once(spark, tmp_path):
    kind = "id string, c string, m string"
    spark.createDataFrame([("1", "x", "p"), ("2", "x", "q"), ("3", None, "q"), ("4", "y", None), ("5", "y", "p"), ("6", "y", "p")], kind).write.parquet(f"{tmp_path}/old")
    spark.createDataFrame([("7", "x", "p"), ("8", None, "r"), ("9", "y", "p")], kind).write.parquet(f"{tmp_path}/new")
    got = releases.reproduce_check(spark.read.parquet(f"{tmp_path}/old"), spark.read.parquet(f"{tmp_path}/new"), ["c", "m"], ["c"], "m")
    assert got._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 2
    assert Counter(r["kind"] for r in got.collect()) == {"CONTENT_LOST": 4, "CONTENT_NEW": 1, "COVERAGE_SHRANK": 2}
    assert [r["detail"] for r in got.where("kind = 'COVERAGE_SHRANK'").orderBy("detail").collect()] == ["", "x"]
    assert got.where("kind <> 'COVERAGE_SHRANK' and not detail rlike '^[0-9a-f]{64}$'").count() == 0


def test_merged_series_and_gaps_share_one_shuffle(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 1, "x"), ("b", None, "z"), (None, None, "w")], "k string, v int, s string").write.parquet(f"{tmp_path}/t")
    merged, gaps = series.merge_or_conflict(spark.read.parquet(f"{tmp_path}/t"), ["k"], ["v"], "s")
    both = merged.select("k", F.lit(1).cast("long").alias("n"), "v", "sources").unionByName(gaps.select("k", F.col("variants").alias("n"), F.lit(None).cast("int").alias("v"), "sources"))
    assert rows(both) == rows(spark.createDataFrame([("a", 1, 1, ["x", "y"]), ("b", 2, None, ["x", "z"]), (None, 1, None, ["w"])], "k string, n long, v int, s array<string>"))
    assert both._jdf.queryExecution().sparkPlan().toString().count("Aggregate(keys=") == 4  # a partial and a final one a result


def test_wanted_sources_are_made_distinct_by_the_join_keys(spark):
    index = joins.evidence_index(spark.range(20).select(F.col("id").alias("of"), F.array(F.concat(F.lit("s"), F.col("id") % 4)).alias("ids")), "ids")
    wanted = spark.range(30).select(F.concat(F.lit("s"), F.col("id") % 3).alias("source_id"))
    got = joins.evidence(index, wanted, "of")
    assert "hashpartitioning(source_id#" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got, "of") == rows(spark.createDataFrame([(i,) for i in range(20) if i % 4 < 3], "of long"))


def test_numbering_shuffles_rows_into_blocks_once(spark, tmp_path):
    spark.range(100).select((F.col("id") % 3).alias("k"), (F.col("id") % 10).alias("b"), "id").write.parquet(f"{tmp_path}/t")
    got = ranges.numbered(spark.read.parquet(f"{tmp_path}/t"), ["k"], ["b", "id"], F.col("b"), "n")
    want = sorted((i % 3, i % 10, i) for i in range(100))
    assert rows(got, "k", "b", "id", "n") == sorted(((*r, sum(w[0] == r[0] and w <= r for w in want)) for r in want), key=str)
    got.collect()  # shuffles are found alike while the query runs
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


def test_each_citation_is_followed_once(spark, monkeypatch):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(3)] + [(f"c{i}", f"s{i}_{n}") for i in range(3) for n in range(4)]
    e, followed = spark.createDataFrame(chain, "r string, s string"), []
    join = type(e).join

    def counted(left, right, *how):
        followed.append(right.count() if "_up" in right.columns else 0)
        return join(left, right, *how)

    monkeypatch.setattr(type(e), "join", counted)
    nodes, roots = joins.lineage_tree(spark.createDataFrame([("c0",), ("c1",)], "r string"), e, e.select("s").where("s like 's%1'"), "r", "s")
    assert rows(roots, "r", "sources", "missing", "depth", "state") == [("c0", 3, 10, 3, "INCOMPLETE"), ("c1", 2, 7, 2, "INCOMPLETE")]
    assert sum(followed) == len(chain)  # each in its own level, not all of them in every round


def keyed(spark, ident):
    """Four facts whose id has no nulls, or (ident: a nullable column) might have some."""
    cols = {"value": F.col("id").cast("decimal(38,9)"), "unit": F.lit("USD"), "concept": F.lit("c"), "accession": F.lit("a"), "filed": lit("2020-01-01", "date"), "available_at": lit("2020-01-02", "timestamp"), "source_object": F.lit("o"), "state": F.lit("SOURCE_VALIDATED")}
    return spark.range(4).select(F.expr(ident).alias("key"), *[x.alias(c) for c, x in cols.items()])


SURE, UNSURE = "concat_ws('-', id, 'x')", "if(id > 0, string(id), null)"


def joined_by(df):
    return "<=>" if "<=>" in df._jdf.queryExecution().analyzed().toString() else "="


def test_reports_are_joined_where_their_keys_were_dealt(spark):
    diff = lambda ident: releases.diff_reports(keyed(spark, ident), keyed(spark, ident).withColumn("value", F.col("value") + 1), ["key"])
    joins_of = lambda df: [x for x in df._jdf.queryExecution().analyzed().toString().splitlines() if "Join FullOuter" in x]
    assert ["<=>" in x for x in joins_of(diff(SURE)) + joins_of(diff(UNSURE))] == [False, True]
    assert diff(SURE).count() == diff(UNSURE).count() == 4  # a null key meets a null key


def test_validation_is_joined_where_its_keys_were_dealt(spark):
    check = lambda ident: quality.cross_validate(keyed(spark, ident), keyed(spark, ident), ["key"])
    assert joined_by(check(SURE)) == "=" and joined_by(check(UNSURE)) == "<=>"
    assert check(SURE).where("validation = 'AGREES'").count() == check(UNSURE).where("validation = 'AGREES'").count() == 4


def test_corroboration_is_joined_where_its_keys_were_dealt(spark):
    check = lambda ident: releases.corroboration_check(keyed(spark, ident), keyed(spark, ident), ["key"], "accession")
    assert joined_by(check(SURE)) == "=" and joined_by(check(UNSURE)) == "<=>"
    assert check(SURE).where("state = 'NOT_INDEPENDENT'").count() == check(UNSURE).where("state = 'NOT_INDEPENDENT'").count() == 4


def test_strict_selection_shuffles_one_set_of_pairs(spark):
    shape = "k string, at int, value decimal(38,9), id string"
    df = spark.createDataFrame([("a", 1, D(9), "z"), ("a", 2, D(1), "y"), ("a", 2, D(1), "x"), ("a", 2, D(1), "x"), ("b", 1, D(1), "p"), ("b", 1, None, "q"), ("c", 1, None, "s"), ("c", 1, None, None), ("d", 1, D(1), None), ("e", 1, D(2), "t"), ("e", 1, D(3), "t"), ("f", None, D(1), "u")], shape)
    got, gaps = pit.select_or_conflict(df, ["k"], available="at")
    assert rows(got, "k", "at", "value", "id", "source_ids") == sorted([("a", 2, D(1), "x", ["x", "y"]), ("c", 1, None, "s", ["s"]), ("d", 1, None, None, [])], key=str)
    assert rows(gaps, "k", "at", "reason") == [("b", 1, "CONFLICTING_SOURCE_VALUES"), ("e", 1, "CONFLICTING_SOURCE_VALUES")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_set") == 1 and "min_by" not in plan  # ids and values went through the shuffle several times


def test_priority_rows_are_shuffled_once_each(spark):
    shape = "k string, p int, filed string, acc string, concept string, v int"
    df = spark.createDataFrame([("a", 1, "d1", "x", "O", 1), ("a", 1, "d2", "x", "O", 2), ("a", 2, "d9", "x", "F", 3), ("b", 2, "d1", None, "F", 4), ("c", None, "d1", "x", "F", 5), ("c", 9, None, "x", "G", 6)], shape)
    want = [("a", 1, "d2", "x", "O", 2, ["F"]), ("b", 2, "d1", None, "F", 4, []), ("c", 9, None, "x", "G", 6, ["F"])]
    got = pit.pick_by_priority(df, ["k"], "p", "filed", "acc")
    assert rows(got, *df.columns, "superseded") == want
    assert "max_by" not in got._jdf.queryExecution().optimizedPlan().toString()  # its order repeats what the row holds
    mapped = pit.pick_by_priority(df.withColumn("m", F.create_map(F.lit("v"), "v")), ["k"], "p", "filed", "acc")
    assert rows(mapped.withColumn("m", F.col("m.v")), "k", "m") == [("a", 2), ("b", 4), ("c", 6)]


def test_reconcile_builds_no_sets_of_values(spark):
    shape = "id string, c string, value decimal(38,9)"
    old = spark.createDataFrame([("a", "x", D(1)), ("b", "x", D(1)), ("c", "y", D(2)), ("d", "z", D(3)), ("e", None, None), (None, "w", D(1)), ("g", "v", D(1)), ("g", "v", None)], shape)
    new = spark.createDataFrame([("a", "x", D(1)), ("c", "y", D(4)), ("f", "q", D(1)), ("e", None, D(1)), (None, "w", D(1)), ("g", "v", D(1))], shape)
    got = releases.reconcile(old, new, "id", ["c"], "value")
    assert rows(got, "kind", "key") == sorted([("REMOVED", "b"), ("REMOVED", "d"), ("ADDED", "f"), ("CHANGED", "y"), ("CHANGED", "~")], key=str)
    assert "collect_set" not in got._jdf.queryExecution().optimizedPlan().toString()
