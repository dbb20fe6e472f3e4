"""Shared pieces: written intermediate tables and distributed union-find."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        base = spark.sparkContext.getCheckpointDir()
    return base


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Actions inside leave no shuffle files behind; the session's own setting is put back at the end.

    Otherwise they stay until the driver happens to collect garbage, and those of many steps lie on disk together.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back. Its shuffles are dropped."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}-{tag}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``written`` tables that nothing will read again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows for whole texts in Python workers, unless the session has a size of its own.

    The setting stays in the session. It bounds what a worker holds at once; results don't depend on it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(rows))


def ascii_lower(c):
    """Lower-case A-Z only; ``lower`` does that for pure ASCII text and is much faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def with_range(df: DataFrame, id_col: str, out: str) -> tuple[DataFrame, int]:
    """``df`` with an int column of id ranges, cut at approximate quantiles, and their number; null ids are in a last one.

    There are four ranges for each shuffle partition, so that dealing them by hash stays even.
    """
    from pyspark.ml.feature import Bucketizer

    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = [i / (4 * parts) for i in range(1, 4 * parts)]
    found = df.select(F.percentile_approx(id_col, cuts, 40 * parts)).first()[0] or []
    splits = [float("-inf"), *sorted({float(x) for x in found}), float("inf")]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    rows = df.withColumn("__v", F.col(id_col).cast("double"))
    rows = Bucketizer(splits=splits, inputCol="__v", outputCol="__b", handleInvalid="keep").transform(rows)
    return rows.withColumn(out, F.coalesce(F.col("__b").cast("int"), F.lit(len(splits) - 1))).drop("__v", "__b"), len(splits)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node reachable.

    Alternating large-star and small-star steps: each is an aggregation to the smallest neighbour (combined
    before the shuffle) and a join that Spark can split when one node has very many links. Every round is
    written to the shared folder and replaces the one before. Self-links and repeated links are ignored; no edges give an
    empty result. The number of rounds grows with the logarithm of the longest chain; ``max_rounds`` is a guard.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    state, seen = written(pairs, "links"), None
    for _ in range(max_rounds):
        with shuffles_dropped(state.sparkSession):
            now = state.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first()
        if now == seen or now[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                state.select(F.col("v"), F.col("v")).distinct()
            )
        seen = now
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, state = state, written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(before)
    raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")


def merged_components(parts: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of ``parts`` after further edges, which are few and may name nodes that ``parts`` lacks."""
    name = parts.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    for c in ("a", "b"):
        ends = ends.join(name, ends[c] == F.col("__n"), "left").withColumn(c, F.coalesce("__c", c)).drop("__n", "__c")
    top = connected_components(ends, "a", "b").select(F.col("node").alias("__t"), F.col("component").alias("__top"))
    moved = parts.join(top, parts.component == F.col("__t"), "left").select("node", F.coalesce("__top", "component").alias("component"))
    new = top.join(name, F.col("__t") == F.col("__n"), "left_anti").select(F.col("__t").alias("node"), F.col("__top").alias("component"))
    return moved.union(new)
