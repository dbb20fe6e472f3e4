"""Blocked Bloom filter of bounded size: built by Spark, probed in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shuffles_dropped

WORDS = 8  # of 64 bits: a block is one 512-bit line
PROBES = 8


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def hash_longs(x: np.ndarray, seed) -> np.ndarray:
    """XXH64 of 64-bit numbers, as ``xxhash64`` of a bigint column gives it."""
    h = seed + _P5 + np.uint64(8) ^ _turn(x.view(np.uint64) * _P2, 31) * _P1
    h = _turn(h, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _second(c):
    """The hash whose bytes choose the bits of a block."""
    return F.xxhash64(c, F.lit(1).cast("long"))


def build_filter(keys: DataFrame, col: str, bits_per_key: int = 12, max_bytes: int = 16 << 20) -> np.ndarray:
    """Blocked Bloom filter of a column: an array (blocks, 8) of uint64 of at most ``max_bytes``.

    Spark hashes the keys and combines bits per block and word; only the filter itself, whose size is bounded whatever
    the list holds, comes to the driver. A longer list only raises the share of probable hits that the exact join drops.
    """
    with shuffles_dropped(keys.sparkSession):
        n = keys.count()
    blocks = int(min(max(1, -(-n * bits_per_key // (64 * WORDS))), max_bytes // (8 * WORDS)))
    h, g = F.xxhash64(col), _second(F.col(col))
    at = F.explode(F.array(*[F.pmod(F.shiftrightunsigned(g, 8 * i), F.lit(512)) for i in range(PROBES)]))
    bits = keys.select(F.pmod(h, F.lit(blocks)).alias("block"), at.alias("bit"))
    words = bits.groupBy("block", F.floor(F.col("bit") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("v"))
    out = np.zeros((blocks, WORDS), np.int64)
    for r in words.toLocalIterator():
        out[r["block"], r["w"]] = r["v"]
    return out.view(np.uint64)


def _probe(t: np.ndarray, block: np.ndarray, g: np.ndarray) -> np.ndarray:
    ok = np.ones(len(block), bool)
    for i in range(PROBES):
        bit = (g >> np.uint64(8 * i)) % np.uint64(512)
        ok &= (t[block, (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def holds(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """As ``might_hold`` for int64 numbers inside a task: false only where the filter shows that one is not listed."""
    h = hash_longs(numbers, np.uint64(42))
    return _probe(table, np.mod(h.view(np.int64), len(table)), hash_longs(np.ones(len(h), np.int64), h))


def might_hold(spark, table: np.ndarray, col):
    """Column: false only if the filter shows that the key (a column or its name) is not listed."""
    sent, c = spark.sparkContext.broadcast(table), F.col(col) if isinstance(col, str) else col

    @F.pandas_udf("boolean")
    def probe(block: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series(_probe(sent.value, block.to_numpy(np.int64), g.to_numpy(np.int64).view(np.uint64)))

    return probe(F.pmod(F.xxhash64(c), F.lit(len(table))), _second(c))


def map_listed(df: DataFrame, table: np.ndarray, col: str, task, schema: str) -> DataFrame:
    """``df.mapInArrow(task, schema)`` over the rows whose key the filter may hold, probed in the task's own worker."""
    sent = df.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        def kept():
            for b in batches:
                n = b.num_columns - 2
                ok = _probe(sent.value, b.column(n).to_numpy(zero_copy_only=False), b.column(n + 1).to_numpy(zero_copy_only=False).view(np.uint64))
                if ok.any():
                    yield pa.RecordBatch.from_arrays(b.columns[:n], b.schema.names[:n]).filter(pa.array(ok))

        yield from task(kept())

    return df.select(*df.columns, F.pmod(F.xxhash64(col), F.lit(len(table))).alias("__block"), _second(F.col(col)).alias("__bits")).mapInArrow(run, schema)
