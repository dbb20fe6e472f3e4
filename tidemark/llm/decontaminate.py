"""Benchmark decontamination in DataFrame functions only.

Texts are normalised once to words joined by single spaces. A window of m words (m = ``size``, or fewer for a short
item) must contain, wherever it occurs in a document, one *aligned* gram: g = ceil(m / 2) consecutive words that start
at a multiple of g in the document, since g + (g - 1) <= m. So a document contributes one gram for each g words; its
hash is looked up among the hashes of all grams of the benchmark. Each probable hit carries its neighbouring grams, in
which the windows are then compared word for word. Only the benchmark's own grams and windows are candidates for a
broadcast, and only below ``broadcast_rows``; beyond that the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, read, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _normal(c):
    return F.trim(F.regexp_replace(ascii_lower(c), SEPARATORS, " "))


def _count(normal):
    return F.when(normal == "", 0).otherwise(F.regexp_count(normal, F.lit(" ")) + 1).cast("long")


def benchmark_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(item_id, m, window): every window of every item that has words; a null text has none."""
    words = benchmark.select("item_id", F.split(_normal(F.col("text")), " ").alias("w")).where("w[0] <> ''")
    words = words.withColumn("m", F.least(F.size("w"), F.lit(size)))
    at = words.select("item_id", "m", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
    return at.select("item_id", "m", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("window")).distinct()


def _small(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def hits(docs: DataFrame, windows: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """(keys of docs, pos, m, window) once for every occurrence of a window.

    ``docs`` has key columns and ``normal``, the normalised text. Positions count words from 0.
    """
    keys = [c for c in docs.columns if c != "normal"]
    kinds = windows.select("m", "window").distinct()
    sizes = {r["m"]: r["n"] for r in kinds.groupBy("m").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    found = None
    for m, n in sorted(sizes.items()):
        g = (m + 1) // 2
        ours = kinds.where(F.col("m") == m).select("window", F.split("window", " ").alias("w"))
        starts = F.explode(F.sequence(F.lit(1), F.lit(m - g + 1)))
        grams = ours.select(starts.alias("i"), "w").select(F.xxhash64(F.array_join(F.slice("w", F.col("i"), F.lit(g)), " ")).alias("gram")).distinct()
        cut = F.regexp_extract_all("normal", F.lit(rf"[^ ]+(?: [^ ]+){{0,{g - 1}}}"), F.lit(0))
        arr = docs.select(*keys, cut.alias("g"))
        each = arr.select(*keys, F.posexplode(F.arrays_zip(
            F.col("g").alias("b"),
            F.concat(F.array(F.lit(None).cast("string")), F.slice("g", F.lit(1), F.greatest(F.size("g") - 1, F.lit(0)))).alias("a"),
            F.concat(F.slice("g", F.lit(2), F.greatest(F.size("g") - 1, F.lit(0))), F.array(F.lit(None).cast("string"))).alias("c"),
        )))
        near = each.select(*keys, "pos", F.col("col.a").alias("a"), F.col("col.b").alias("b"), F.col("col.c").alias("c"), F.xxhash64("col.b").alias("gram"))
        near = near.join(_small(grams, n * m, broadcast_rows), "gram").where(F.col("b").isNotNull())
        words = F.split(F.concat_ws(" ", "a", "b", "c"), " ")
        near = near.select(*keys, words.alias("w"), F.when(F.col("a").isNull(), 0).otherwise(F.lit(g)).alias("before"), (F.col("pos") * g).alias("at"))
        # a window is taken by the first aligned gram in it, so that it is taken once: it starts at most g - 1 words before
        start = F.explode(F.sequence(F.greatest(F.col("before") - (g - 1), F.lit(0)), F.col("before"))).alias("s")
        near = near.select(*keys, "w", "at", "before", start).where(F.col("s") + m <= F.size("w"))
        near = near.select(*keys, (F.col("at") - F.col("before") + F.col("s")).cast("long").alias("start"), F.array_join(F.slice("w", F.col("s") + 1, F.lit(m)), " ").alias("window"))
        mine = near.join(_small(ours.select("window"), n, broadcast_rows), "window").select(*keys, "start", F.lit(m).alias("m"), "window")
        found = mine if found is None else found.unionByName(mine)
    return found


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_rows: int = 200_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words, null item ids are ignored when items are listed; repeated rows each get the same answer;
    an empty benchmark hits nothing.
    """
    base = documents.select("doc_id", F.xxhash64("text").alias("k"), F.hash("text").alias("k2"), _normal(F.coalesce("text", F.lit(""))).alias("normal"))
    whole = base.select("doc_id", "k", "k2", _count(F.col("normal")).alias("n_words"))
    windows = written(benchmark_windows(benchmark, size), "windows")
    found = hits(base, windows, broadcast_rows)
    if found is None:
        return whole.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    found = written(found.distinct(), "hits")
    keys = ["doc_id", "k", "k2"]
    covered = found.select(*keys, F.explode(F.sequence("start", F.col("start") + F.col("m") - 1)).alias("p")).distinct().groupBy(*keys).agg(F.count("*").alias("n_hit"))
    n = windows.count()
    items = found.select(*keys, "window").distinct().join(_small(windows.where("item_id is not null").select("window", "item_id"), n, broadcast_rows), "window").select(*keys, F.col("item_id").cast("string").alias("i")).distinct()
    items = items.groupBy(*keys).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("i")), ",").alias("l"))  # at most one entry for each benchmark item
    per = covered.join(items, [covered[c].eqNullSafe(items[c]) for c in keys], "left").select(*[covered[c].alias("_" + c) for c in keys], "n_hit", "n_items", "l")
    out = whole.join(per, [whole[c].eqNullSafe(per["_" + c]) for c in keys], "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("l", F.lit("")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``documents`` without the contaminated ones, columns as they were; repeated rows stay repeated."""
    keyed = documents.withColumns({"__k": F.xxhash64("text"), "__k2": F.hash("text")})
    base = documents.select(F.xxhash64("text").alias("k"), F.hash("text").alias("k2"), _normal(F.coalesce("text", F.lit(""))).alias("normal"))
    found = hits(base, written(benchmark_windows(benchmark, size), "windows"))
    if found is None:
        return documents
    bad = written(found.select("k", "k2").distinct(), "contaminated")
    return keyed.join(bad, (F.col("__k") == bad.k) & (F.col("__k2") == bad.k2), "left_anti").drop("__k", "__k2")


def op8_decontaminate(spark, sf_dir):
    """Words of every document, how many are in benchmark windows, and the items hit. Null texts have no words; repeated
    rows get the same answer; an empty benchmark hits nothing; no documents give no rows."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
