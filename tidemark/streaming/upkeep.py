"""Incremental ingest and upkeep of tables with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.releases import replace_snapshot

BUCKETS = 64  # of a maintained table; a batch rewrites only those its keys fall in


def ingest(spark: SparkSession, path: str, schema: T.StructType, ident: str, event_time: str, late: str = "30 days", fmt: str = "parquet") -> DataFrame:
    """A stream of new files, each content id once within the watermark, so the state stays bounded. An id that comes
    again after the watermark has passed is let through once more; ``ingest_once`` keeps ids for good."""
    stream = spark.readStream.schema(schema).format(fmt).load(path)
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([ident])


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None if nothing has been written there; what can't be read is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of a checkpoint: another one, should the folder be made anew."""
    return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def _merge(df: DataFrame, epoch: int, table: str, keys: list[str], buckets: int, merge: Callable[[DataFrame, DataFrame], DataFrame], query: str = "") -> None:
    """Put a batch into the table: only the buckets that its keys fall in are read, merged and overwritten.

    The merged buckets are first written beside the table and marked with the query and the batch's number. A batch of
    this query that is tried again after the mark only publishes them once more, so an interrupted publication loses
    nothing. Queries may take turns at a table, each with a checkpoint of its own; two must not run at once.
    """
    spark = df.sparkSession
    batch = df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    staged, mark = f"{table}-staged", f"{table}-mark"
    done = _there(spark, mark)
    last = done and done.first()
    if not last or (last["query"], last["epoch"]) != (query, epoch):
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # at most ``buckets`` rows
        prev = _there(spark, table)
        merged = batch if prev is None else merge(prev.where(F.col("bucket").isin(touched)).select(*batch.columns), batch)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(staged)
        spark.createDataFrame([(query, epoch)], "query string, epoch long").coalesce(1).write.mode("overwrite").parquet(mark)
    kept = _there(spark, staged)
    if kept is not None:
        kept.select(*batch.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)


def current(spark: SparkSession, table: str) -> DataFrame:
    """A maintained table as it stands."""
    return spark.read.parquet(table).drop("bucket")


def ingest_once(stream: DataFrame, table: str, checkpoint: str, ident: str, buckets: int = BUCKETS):
    """Keep a table of the first row that arrived with each content id, however late the id comes again. What is
    known of an id is in the table itself, so a batch reads the buckets of its own ids and streaming state isn't needed.
    Of rows with one id in one batch any one is taken, the smallest by content; rows without an id are one id."""

    def merged(prev: DataFrame, df: DataFrame) -> DataFrame:
        known = prev.select(F.col(ident).alias("_known")).distinct()
        return prev.unionByName(df.join(known, F.col(ident).eqNullSafe(F.col("_known")), "left_anti"))

    def batch(df: DataFrame, epoch: int) -> None:
        rest = [c for c in df.columns if c != ident]
        one = df.groupBy(ident).agg(F.min(F.struct(*rest)).alias("_r")).select(ident, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)
        _merge(one, epoch, table, [ident], buckets, merged, query_id(df.sparkSession, checkpoint))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, key: str, buckets: int = BUCKETS):
    """Keep a table in which a key that arrives in a batch takes the batch's rows in full. A null key is a key."""

    def replaced(prev: DataFrame, df: DataFrame) -> DataFrame:
        return replace_snapshot(prev, df, key)

    def batch(df: DataFrame, epoch: int) -> None:
        _merge(df, epoch, table, [key], buckets, replaced, query_id(df.sparkSession, checkpoint))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def latest_stream(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = BUCKETS):
    """Keep the latest revision of each context; a maximum does not mind late or repeated rows."""

    def best(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        return got.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)

    def batch(df: DataFrame, epoch: int) -> None:
        _merge(best(df), epoch, table, keys, buckets, lambda prev, new: best(prev.unionByName(new)), query_id(df.sparkSession, checkpoint))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
