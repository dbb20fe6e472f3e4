"""Numbers, labels and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import exact

DECIMAL = "decimal(38,9)"


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], pre_a: str, pre_b: str) -> list[Column]:
    """Null-safe equality of the keys of two tables, named with these prefixes in a join. Where one side has no nulls it
    is plain equality, so rows that are dealt by the key already aren't shuffled once more."""
    plain = lambda k: not (a.schema[k].nullable and b.schema[k].nullable)
    pairs = [(k, F.col(pre_a + k), F.col(pre_b + k)) for k in keys]
    return [x == y if plain(k) else x.eqNullSafe(y) for k, x, y in pairs]


def decimal_token(c: Column) -> Column:
    """true for a finite decimal text, with or without an exponent, that fits decimal(38,9) exactly."""
    shape = r"^-?(0|[1-9][0-9]*)(?:[.]([0-9]+))?(?:[eE]([+-]?[0-9]{1,2}))?$"
    whole, part = F.regexp_extract(c, shape, 1), F.regexp_extract(c, shape, 2)
    power = F.coalesce(F.regexp_extract(c, shape, 3).try_cast("int"), F.lit(0))
    digits = F.concat(whole, part)
    zeros = F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
    places = F.length(part) - power - zeros  # after the point, when written without exponent and closing zeros
    exact = digits.rlike("^0*$") | (places <= 9)
    return F.coalesce(c.rlike(shape) & exact & c.try_cast(DECIMAL).isNotNull(), F.lit(False))


def plain(c: Column) -> Column:
    """a decimal as text without an exponent or trailing zeros; -0 becomes 0."""
    text = F.regexp_replace(F.regexp_replace(c.cast(DECIMAL).cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(text == "-0", "0").otherwise(text)


def parse_number(c: Column) -> Column:
    """decimal of a financial text: currency signs, commas and spaces go, (1,234) and -1,234 are negative, K M B T
    scale, % is hundredths; null where nothing of that kind is found. A lone dash is no number: missing is never zero."""
    shape = r"^([0-9]*\.?[0-9]+|[0-9]+\.)([KMBTkmbt%]?)$"
    power = F.create_map(*[F.lit(x) for x in ("", "E0", "K", "E3", "M", "E6", "B", "E9", "T", "E12", "%", "E-2")])

    def without(t, chars):
        for c in chars:
            t = F.replace(t, F.lit(c), F.lit(""))
        return t

    # each step is let: written out in the next, it would be worked out dozens of times a text
    def inner(t):
        held = t.startswith("(") & t.endswith(")") & (F.length(t) > 1)
        return F.struct(held.alias("held"), F.when(held, t.substr(F.lit(2), F.length(t) - 2)).otherwise(t).alias("t"))

    def digits(s):
        minus = s["t"].startswith("-")
        rest = F.when(minus, s["t"].substr(F.lit(2), F.length(s["t"]))).otherwise(s["t"])
        return F.struct((s["held"] | minus).alias("minus"), without(rest, ", \t\n\x0b\x0c\r").alias("t"))

    def number(s):
        whole = F.concat(F.when(s["minus"], "-").otherwise(""), F.regexp_extract(s["t"], shape, 1), power[F.upper(F.regexp_extract(s["t"], shape, 2))])
        return F.when(s["t"].rlike(shape), whole).try_cast(DECIMAL)

    return exact.let(exact.let(exact.let(F.trim(without(F.trim(c), "$€£¥")), inner), digits), number)


#: What may stand before a scale word, and the scales, in the order in which they are tried.
SCALE_LEADS = [r"\$\s*in\s+", r"\(in\s+", r"\bin\s+"]
SCALE_WORDS = [("billions?", 1_000_000_000), ("millions?", 1_000_000), ("thousands?", 1_000)]


def scale_of(c: Column) -> Column:
    """F8: 1000, 1000000 or 1000000000 by the first phrase that fits, whatever the case, else 1; null counts as empty.

    "$ in millions" goes before "(in thousands)", which goes before a plain "in billions"; only "in" leads to a scale.
    """
    out = F.lit(1)
    for lead in reversed(SCALE_LEADS):
        for word, scale in reversed(SCALE_WORDS):
            close = r"\)" if lead.startswith(r"\(") else ""
            out = F.when(c.rlike(f"(?i){lead}{word}{close}"), scale).otherwise(out)
    return out.cast("long")


def terminating(num: Column, den: Column, digits: int = 9) -> Column:
    """num / den as a decimal if it ends within ``digits`` places, else null; null for a zero denominator."""
    made = exact.lowest(num.try_cast("decimal(38,0)"), den.try_cast("decimal(38,0)"))
    return exact.let(made, lambda f: F.when(exact.ends_within(f, digits), exact.rounded(f, digits)))


def slug(c: Column) -> Column:
    """lower-case words of a label joined by single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def path_role(c: Column) -> Column:
    """struct(namespace, role) of an object path: its first part, and manifest, index, data or other by its end."""
    name = F.element_at(F.split(c, "/"), -1)
    role = F.when(name.rlike(r"manifest.*\.json$"), "manifest").when(name.rlike(r"index.*\.json$"), "index").when(name.rlike(r"\.(parquet|csv|json|jsonl)(\.gz)?$"), "data").otherwise("other")
    return F.struct(F.split(c, "/")[0].alias("namespace"), role.alias("role"))


def data_as_of(df: DataFrame, cols: list[str]) -> DataFrame:
    """F16: one row with the latest date over the named columns; null if all are null."""
    return df.agg(F.max(F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])).alias("data_as_of"))


#: What must not leave with public rows: storage addresses, long digests, bearer tokens, keys and object paths.
PRIVATE = {
    "uri": r"(?i)\b(?:s3|gs|r2|abfss?|hdfs)://",
    "digest": r"\b[0-9a-f]{32,}\b",
    "bearer": r"(?i)\bbearer\s+[a-z0-9._-]{8,}",
    "key": r"\b(?:AKIA[0-9A-Z]{12,}|sk[-_][A-Za-z0-9_-]{16,})",
    "secret": r"(?i)\b(?:api[_-]?key|access[_-]?key|secret|token|password)\b\s*[:=]",
    "path": r"\b[\w-]+/[\w./-]+\.(?:parquet|jsonl?\.gz)\b",
}


def public(df: DataFrame, private: list[str]) -> DataFrame:
    """without the private columns, those that are there."""
    return df.drop(*private)


def leaks(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, marker) for each kind of private marker found in a text column."""
    hits = F.array_compact(F.array(*[F.when(F.col(col).rlike(p), F.lit(k)) for k, p in PRIVATE.items()]))
    return df.select(id_col, F.explode(hits).alias("marker"))


def pad_id(c: Column, width: int = 10) -> Column:
    """an identifier padded with zeros on the left, never cut."""
    t = c.cast("string")
    return F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, "0"))


def row_md5(cols: list[str]) -> Column:
    """MD5 of a row: each value as text after its length, nulls told apart from any text, so that values can't move
    between columns unseen."""
    cell = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~"))
    return F.md5(F.concat_ws("|", *[cell(c) for c in cols]))


def rows_digest(cols: list[str]) -> Column:
    """Aggregate: an order-free digest of rows as text, two sums of 60 bits each of ``row_md5``."""
    half = lambda at: F.sum(F.conv(F.substring(row_md5(cols), at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.concat_ws("-", half(1), half(16))
