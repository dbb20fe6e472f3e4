"""Reading, flattening and admitting facts, bars and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = T.StructType([T.StructField(c, T.StringType()) for c in ("val", "start", "end", "filed", "accn", "form", "fy", "fp", "frame")])
UNITS = T.MapType(T.StringType(), T.ArrayType(ROW))
TAG = T.StructType([T.StructField("label", T.StringType()), T.StructField("description", T.StringType()), T.StructField("units", UNITS)])
#: A filing-facts document; values stay text, so that no digit is lost before they are admitted.
FACTS = T.StructType([T.StructField("cik", T.StringType()), T.StructField("entityName", T.StringType()), T.StructField("facts", T.MapType(T.StringType(), T.MapType(T.StringType(), TAG)))])


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A Parquet table with only the columns asked for; filters go down to the reader."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def describe(df: DataFrame) -> DataFrame:
    """(column, type, rows, nulls) of a table, counted in one pass."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("rows"), F.col(f"n{i}").alias("nulls")) for i, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def flatten_all(raw: DataFrame, namespace: str | None = None, concept: str | None = None) -> DataFrame:
    """One row for every fact of nested filing facts, optionally of namespaces and concepts that contain a text,
    whatever the case. Entities without facts give no rows."""
    out = raw.select("cik", "entityName", F.explode("facts").alias("taxonomy", "tags"))
    if namespace:
        out = out.where(F.lower("taxonomy").contains(namespace.lower()))
    out = out.select("cik", "entityName", "taxonomy", F.explode("tags").alias("concept", "t"))
    if concept:
        out = out.where(F.lower("concept").contains(concept.lower()))
    out = out.select("cik", "entityName", "taxonomy", "concept", "t.label", F.explode("t.units").alias("unit", "rows"))
    return out.select("cik", "entityName", "taxonomy", "concept", "label", "unit", F.explode("rows").alias("r")).select("cik", "entityName", "taxonomy", "concept", "label", "unit", "r.*")


def namespace_counts(flat: DataFrame) -> DataFrame:
    """(taxonomy, n) of flattened facts, and their total in the row without a taxonomy."""
    return flat.rollup("taxonomy").agg(F.count("*").alias("n"))


def flatten_facts(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Facts of the registry's concepts with metric and priority. The registry (taxonomy, concept, metric,
    concept_priority, unit kind...) is a small reference table."""
    return flatten_all(raw).join(F.broadcast(registry.drop("unit")) if "unit" in registry.columns else F.broadcast(registry), ["taxonomy", "concept"])


def admit(df: DataFrame, units: list[str], forms: list[str], value: str = "val", start: str = "start", end: str = "end", filed: str = "filed", unit: str = "unit", form: str = "form") -> tuple[DataFrame, DataFrame]:
    """S3: (accepted, rejected): accepted rows have decimal ``value`` and date columns; rejected ones a ``reason``:
    MISSING_VALUE, UNSUPPORTED_UNIT, UNSUPPORTED_FORM, INCOMPLETE_CONTEXT, END_AFTER_FILING or NON_FINITE_VALUE.

    Nothing is dropped: every row is in one of the two. A value that doesn't fit decimal(38,9) is not finite here.
    """
    num = F.col(value).cast("string").try_cast("decimal(38,9)")
    day = lambda c: F.col(c).cast("string").try_cast("timestamp").cast("date")
    e, f = day(end), day(filed)
    reason = (
        F.when(F.col(value).isNull(), "MISSING_VALUE")
        .when(~F.coalesce(F.col(unit).isin(units), F.lit(False)), "UNSUPPORTED_UNIT")
        .when(~F.coalesce(F.col(form).isin(forms), F.lit(False)), "UNSUPPORTED_FORM")
        .when(e.isNull() | f.isNull() | (F.col(start).isNotNull() & day(start).isNull()), "INCOMPLETE_CONTEXT")
        .when(e > f, "END_AFTER_FILING")
        .when(num.isNull(), "NON_FINITE_VALUE")
    )
    marked = df.withColumn("reason", reason)
    good = marked.where("reason is null").withColumns({"value": num, "period_start": day(start), "period_end": e, "filed_date": f}).drop("reason")
    return good, marked.where("reason is not null")


def rejection_counts(rejected: DataFrame, key: str) -> DataFrame:
    """S3: number of rejected rows by key and reason."""
    return rejected.groupBy(key, "reason").agg(F.count("*").alias("n"))


def with_content_id(df: DataFrame, cols: list[str], name: str = "id") -> DataFrame:
    """A content id: SHA-256 of the named columns as JSON in sorted order, nulls kept."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256))


def dedupe_by_id(df: DataFrame, name: str = "id") -> DataFrame:
    """One row for each id; rows of one content id are equal, so it does not matter which."""
    return df.dropDuplicates([name])


def unpivot_series(df: DataFrame, day: str, columns: dict[str, str], missing: tuple[str, ...] = ("", "N/A", "NA", "ND", ".")) -> DataFrame:
    """A wide dated table to (series_id, observation_date, value_decimal, missing_reason). Blank cells stay as rows
    with reason BLANK_OR_NOT_AVAILABLE, texts that are no number with NOT_A_NUMBER. Columns not named are refused."""
    extra = sorted(set(df.columns) - set(columns) - {day})
    if extra:
        raise ValueError(f"unexpected columns: {extra}")
    wide = df.select(F.col(day), *[F.col(f"`{c}`").cast("string").alias(s) for c, s in columns.items()])
    long = wide.unpivot(day, list(columns.values()), "series_id", "cell")
    text = F.trim(F.coalesce("cell", F.lit("")))
    value = text.try_cast("decimal(38,9)")
    reason = F.when(text.isin(*missing), "BLANK_OR_NOT_AVAILABLE").when(value.isNull(), "NOT_A_NUMBER")
    return long.select("series_id", F.col(day).cast("date").alias("observation_date"), F.when(reason.isNull(), value).alias("value_decimal"), reason.alias("missing_reason"))


def monthly_series(cells: DataFrame, month: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Monthly rows (``YYYYMmm``) of a sheet to series with label and unit; columns: name -> (label, unit). Cells
    such as #N/A or #DIV/0! carry CELL_ERROR, blanks BLANK."""
    wide = cells.select(F.to_date(F.concat(F.substring(month, 1, 4), F.lit("-"), F.substring(month, 6, 2), F.lit("-01"))).alias("observation_date"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    long = wide.unpivot("observation_date", list(columns), "series_id", "cell")
    text = F.trim(F.coalesce("cell", F.lit("")))
    value = text.try_cast("decimal(38,9)")
    reason = F.when(text.isin("", "…", ".."), "BLANK").when(text.startswith("#"), "CELL_ERROR").when(value.isNull(), "NOT_A_NUMBER")
    names = F.create_map(*[F.lit(x) for c, (label, _) in columns.items() for x in (c, label)])
    units = F.create_map(*[F.lit(x) for c, (_, unit) in columns.items() for x in (c, unit)])
    return long.select("series_id", names[F.col("series_id")].alias("label"), units[F.col("series_id")].alias("unit"), "observation_date", F.when(reason.isNull(), value).alias("value_decimal"), reason.alias("missing_reason"))


BAR = "bars map<string, array<struct<t:string,o:double,h:double,l:double,c:double,v:double,vw:double,n:long>>>"


def parse_bars(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(bars, gaps) from JSON pages ``{"bars": {symbol: [{t,o,h,l,c,v,vw,n}]}}``; the session date is that of the
    bar's instant in New York. Text that is no such page gives no rows."""
    page = F.from_json(col, BAR)
    rows = df.select(F.explode(page["bars"]).alias("symbol", "b")).select("symbol", F.explode("b").alias("b"))
    ts = F.col("b.t").try_cast("timestamp")
    out = rows.select("symbol", F.from_utc_timestamp(ts, "America/New_York").cast("date").alias("session_date"), ts.alias("source_timestamp"), *[F.col(f"b.{a}").alias(n) for a, n in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)], F.col("b.vw").alias("vwap"), F.col("b.n").alias("transactions"))
    return split_bars(out)


def split_bars(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid bars, gaps): a gap has the first of NULL_FIELD, NON_FINITE, NOT_POSITIVE, LOW_ABOVE, HIGH_BELOW,
    NEGATIVE_VOLUME."""
    price = ["open", "high", "low", "close"]
    every = [F.col(c) for c in price]
    null = every[0].isNull() | every[1].isNull() | every[2].isNull() | every[3].isNull() | F.col("volume").isNull()
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    bad = odd(every[0].cast("double")) | odd(every[1].cast("double")) | odd(every[2].cast("double")) | odd(every[3].cast("double"))
    reason = F.when(null, "NULL_FIELD").when(bad, "NON_FINITE").when(F.least(*every) <= 0, "NOT_POSITIVE").when(F.col("low") > F.least("open", "close"), "LOW_ABOVE").when(F.col("high") < F.greatest("open", "close"), "HIGH_BELOW").when(F.col("volume") < 0, "NEGATIVE_VOLUME")
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def native_price_point(df: DataFrame, price: str, fields: list[str]) -> DataFrame:
    """Price magnitude, whether a negative price stood for a bid/ask average, and a map of missing fields."""
    gone = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.struct(F.lit(c), F.lit("NOT_REPORTED"))) for c in [price, *fields]])))
    return df.withColumns({"magnitude": F.abs(price), "bid_ask_average": F.coalesce(F.col(price) < 0, F.lit(False)), "missing": gone})


def canonical(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns with fixed types, in order; casts that fail give null."""
    return df.select(*[F.col(c).try_cast(t).alias(c) if t != "string" else F.col(c).cast("string").alias(c) for c, t in columns.items()])

