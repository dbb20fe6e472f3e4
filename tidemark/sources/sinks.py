"""Immutable releases and clustered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import rows_digest


def manifest(df: DataFrame, key: str, day: str) -> DataFrame:
    """Per key: rows, date range and an order-free digest of the rows."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.count("*").alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), rows_digest(rest).alias("digest"))


def release_id(manifest_rows: DataFrame, key: str) -> DataFrame:
    """One row with the release's id, the same for the same content whatever the order of its rows."""
    line = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in manifest_rows.columns]), 256)
    total = manifest_rows.select(F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)").alias("x"))
    return total.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum("x").cast("string")), 256).alias("release_id"))


def write_release(df: DataFrame, path: str, key: str, day: str) -> None:
    """Write data and manifest under a path that must not exist; a release is never changed.

    Rows are dealt by key and Spark splits what is more than a task should write, so a hot key has several files.
    """
    df.hint("rebalance", F.col(key)).write.mode("errorifexists").partitionBy(key).parquet(f"{path}/data")
    manifest(df.sparkSession.read.parquet(f"{path}/data"), key, day).write.mode("errorifexists").parquet(f"{path}/manifest")


def with_group(df: DataFrame, key: str, n: int = 16, name: str = "g") -> DataFrame:
    """The table with the cluster group of its key: crc32 of its text modulo ``n``."""
    return df.withColumn(name, (F.crc32(F.col(key).cast("string")) % n).cast("int"))


def write_clustered(df: DataFrame, path: str, key: str, n: int = 16, sort: list[str] = ()) -> None:
    """Partitioned by group and sorted inside; a group that is more than one task should write is split by Spark.
    Readers add the group to their filter to prune."""
    grouped = with_group(df, key, n).hint("rebalance", F.col("g"))
    grouped.sortWithinPartitions("g", *(sort or [key])).write.mode("errorifexists").partitionBy("g").parquet(path)
