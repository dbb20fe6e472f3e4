"""Instants, availability and sessions as Column expressions. The session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RFC3339 = r"^(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}:\d{2})(?:[.](\d{1,9}))?([Zz]|[+-]\d{2}:\d{2})$"
NEW_YORK = "America/New_York"


def parse_instant(c: Column) -> Column:
    """F1: struct(ts, epoch_ns, precision) of an RFC 3339 text with an explicit offset; null for anything else.

    A date alone or a time without an offset is no instant. ``ts`` is cut to microseconds; ``epoch_ns`` keeps all.
    """
    part = [F.regexp_extract(c, RFC3339, i) for i in range(1, 5)]
    offset = F.when(F.upper(part[3]) == "Z", "+00:00").otherwise(part[3])
    whole = F.try_to_timestamp(F.concat_ws("", part[0], F.lit("T"), part[1], offset), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    digits = F.length(part[2])
    nanos = F.rpad(F.when(digits == 0, "0").otherwise(part[2]), 9, "0").cast("long")
    ns = F.unix_seconds(whole) * 1_000_000_000 + nanos
    label = F.when(digits == 0, "second").when(digits <= 3, "millisecond").when(digits <= 6, "microsecond").otherwise("nanosecond")
    ts = F.timestamp_micros(F.unix_micros(whole) + F.floor(nanos / 1000))
    good = c.rlike(RFC3339) & whole.isNotNull()
    return F.when(good, F.struct(ts.alias("ts"), ns.alias("epoch_ns"), label.alias("precision")))


def available_at(day: Column, policy: str = "next_day") -> Column:
    """when a fact dated ``day`` may be used. ``next_day``: the next day's midnight in New York; ``end_of_day``:
    the last microsecond of the day in UTC; ``instant``: the given timestamp itself."""
    if policy == "instant":
        return day.cast("timestamp")
    if policy == "end_of_day":
        return F.date_add(day, 1).cast("timestamp") - F.expr("interval 1 microsecond")
    if policy == "next_day":
        return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), NEW_YORK)
    raise ValueError(f"unknown policy {policy!r}")


def iso_from_ns(ns: Column, digits: int = 9) -> Column:
    """UTC text of nanoseconds since 1970 with ``digits`` fractional digits, also before 1970."""
    seconds = F.floor(ns / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long")
    head = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    if not digits:
        return F.concat(head, F.lit("Z"))
    rest = F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0")
    return F.concat(head, F.lit("."), F.substring(rest, 1, digits), F.lit("Z"))


def local_to_utc(local: Column, zone: str) -> Column:
    """struct(utc, status) of a civil time; status is ok, nonexistent (skipped) or ambiguous (repeated)."""
    utc = F.to_utc_timestamp(local, zone)
    back = F.from_utc_timestamp(utc, zone)
    twice = [F.from_utc_timestamp(utc + F.expr(f"interval {h} hour"), zone) == local for h in (-1, 1)]
    status = F.when(back != local, "nonexistent").when(twice[0] | twice[1], "ambiguous").otherwise("ok")
    return F.struct(F.when(status == "ok", utc).alias("utc"), status.alias("status"))


def _nth(year, month, dow, n):
    """The n-th given weekday (Spark's 1 = Sunday) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(dow) - F.dayofweek(first), F.lit(7)) + 7 * (n - 1))


def _observed(day):
    return F.when(F.dayofweek(day) == 7, F.date_sub(day, 1)).when(F.dayofweek(day) == 1, F.date_add(day, 1)).otherwise(day)


def sessions(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """US equity sessions (session_date, open_utc, close_utc, early_close): weekdays without exchange holidays.

    Holidays on a weekend are observed on the nearest weekday, New Year's Day on a Saturday not at all. Good Friday
    follows the Gregorian Easter rule; Juneteenth counts from 2022. Special closures are not covered.
    """
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    y = F.col("y")
    a, c = y % 19, F.floor(y / 100).cast("int")
    h = (c - F.floor(c / 4) - F.floor((8 * c + 13) / 25) + 19 * a + 15) % 30
    i = h - F.floor(h / 28) * (1 - F.floor(F.lit(29) / (h + 1)) * F.floor((21 - a) / 11))
    j = (y + F.floor(y / 4) + i + 2 - c + F.floor(c / 4)) % 7
    shift = (i - j).cast("int")
    month = 3 + F.floor((shift + 40) / 44)
    easter = F.make_date(y, month.cast("int"), (shift + 28 - 31 * F.floor(month / 4)).cast("int"))
    may = F.make_date(y, F.lit(5), F.lit(31))
    new_year = F.make_date(y, F.lit(1), F.lit(1))
    days = [
        F.when(F.dayofweek(new_year) != 7, _observed(new_year)),
        _nth(y, 1, 2, 3),
        _nth(y, 2, 2, 3),
        F.date_sub(easter, 2),
        F.date_sub(may, F.pmod(F.dayofweek(may) - 2, F.lit(7))),
        F.when(y >= 2022, _observed(F.make_date(y, F.lit(6), F.lit(19)))),
        _observed(F.make_date(y, F.lit(7), F.lit(4))),
        _nth(y, 9, 2, 1),
        _nth(y, 11, 5, 4),
        _observed(F.make_date(y, F.lit(12), F.lit(25))),
    ]
    holidays = years.select(F.explode(F.array_compact(F.array(*days))).alias("session_date"))
    thanks = _nth(y, 11, 5, 4)
    early = years.select(F.explode(F.array(F.date_add(thanks, 1), F.make_date(y, F.lit(7), F.lit(3)), F.make_date(y, F.lit(12), F.lit(24)))).alias("session_date")).withColumn("early", F.lit(True))
    all_days = years.select(F.explode(F.sequence(new_year, F.make_date(y, F.lit(12), F.lit(31)))).alias("session_date"))
    open_days = all_days.where(F.dayofweek("session_date").between(2, 6)).join(F.broadcast(holidays), "session_date", "left_anti")
    out = open_days.join(F.broadcast(early), "session_date", "left").withColumn("early_close", F.coalesce("early", F.lit(False)))
    at = lambda hours: F.to_utc_timestamp(F.col("session_date").cast("timestamp") + F.expr(f"interval {hours} minutes"), NEW_YORK)
    return out.select("session_date", at(570).alias("open_utc"), F.when(F.col("early_close"), at(780)).otherwise(at(960)).alias("close_utc"), "early_close")


def classify_period(start: Column, end: Column, form: Column | None = None, long_quarter: Column | None = None) -> Column:
    """P5: instant, annual (330 to 380 days, on an annual form if one is given), quarter (75 to 105 days, up to 120
    with evidence) or null."""
    days = F.datediff(end, start) + 1
    annual = days.between(330, 380)
    if form is not None:
        annual &= form.startswith("10-K")
    most = F.lit(105) if long_quarter is None else F.when(long_quarter, 120).otherwise(105)
    return F.when(start.isNull(), "instant").when(annual, "annual").when(days.between(F.lit(75), most), "quarter")
