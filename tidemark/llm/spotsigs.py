"""SpotSigs document fingerprints.

A spot signature is an anchor (a very common word) with the chain of content words that follow it. Common words never
enter a chain. A document's fingerprint is the multiset of its signatures, kept as a set of 64-bit hashes in which the
k-th repeat of a signature has a hash of its own, so that the Jaccard of two sets is that of the multisets.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bloom import build_filter, map_listed
from tidemark.llm.common import connected_components, discard, read, small_batches, with_range, written
from tidemark.llm.prefix import joined_parts, likely, pivot_pairs, postings_of, prefix_sets

# Anchors and further common words, in English, German, French and Spanish.
ANCHORS = frozenset("a an is the das der die ist la le les un una el los est es".split())
COMMON = ANCHORS | frozenset(
    """and are as at be by for from has have he his in it not of on or that this to was were which with you
    auch auf aus bei dem den ein eine einer für im in mit nicht sich und von wird zu
    au aux avec ce dans de des du elle en et il ne par pas pour que qui se sur une
    al con como del lo las más no para pero por se su sus y""".split()
)
WORD = re.compile(r"\w+")


def spot_signatures(text: str | None, chain: int = 2) -> frozenset[int]:
    """Hashes of the spot signatures. A text with words but no full chain has one signature, its whole word sequence;
    a text without words has none."""
    from xxhash import xxh64_intdigest

    words = WORD.findall((text or "").lower())
    if not words:
        return frozenset()
    spots, content = [], []
    for w in words:
        if w not in COMMON:
            content.append(w)
        elif w in ANCHORS:
            spots.append((w, len(content)))
    last = len(content) - chain
    seen: dict[str, int] = {}
    out = set()
    for w, at in spots:
        if at <= last:
            sig = f"{w} {' '.join(content[at : at + chain])}"
            k = seen.get(sig, 0)
            seen[sig] = k + 1
            out.add(xxh64_intdigest(sig, k))
    return frozenset(out) if out else frozenset((xxh64_intdigest(" ".join(words), 1 << 32),))


def jaccard(a: frozenset[int], b: frozenset[int], at_least: float = 0.0) -> float:
    """Jaccard of two sets, two empty ones being alike; 0 as soon as their sizes show that it is below ``at_least``."""
    if not a and not b:
        return 1.0
    small, large = sorted((len(a), len(b)))
    if small == 0 or small < at_least * large:
        return 0.0
    both = len(a & b)
    return both / (small + large - both)


def digest(sigs: frozenset[int]) -> str:
    """The fingerprint as text: its sorted hashes, 16 hex digits each."""
    return np.array(sorted(sigs), ">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(df: DataFrame, id_col: str, text_col: str, run, schema: str, told: DataFrame | None = None) -> DataFrame:
    """Apply ``run(iterator of (id, text, next text))`` in descending id order, the first row following the last.

    With ``told``, (id, key, class_id) rows with the md5 of each text as key, the iterator's rows also have the class.

    Ranges of ids are cut at approximate quantiles, each range also gets the first row of the range after it, and the
    texts are shuffled once. Rows of one id are ordered by text; null ids come last.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    if told is not None:  # few bytes each: they travel with the texts, so that these are dealt once
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        rows = rows.select("id", "text", none("binary", "key"), none("long", "class_id")).unionByName(told.select("id", none("string", "text"), "key", "class_id"))
    more = [c for c in rows.columns if c not in ("id", "text")]
    rows, n = with_range(rows, "id", "b")
    rows = rows.select("id", "text", *more, F.when(F.col("b") == n - 1, n).otherwise(n - F.col("b")).alias("r"))
    tops = rows.groupBy("r").agg(F.max("id").alias("top")).collect()  # one row a range
    ranges = sorted(r["r"] for r in tops)
    if not ranges:
        return rows.mapInArrow(lambda batches: iter(()), schema)
    before = dict(zip(ranges, [ranges[-1], *ranges[:-1]], strict=True))
    kind = df.schema[id_col].dataType.simpleString()
    first = F.broadcast(spark.createDataFrame([(r["r"], r["top"], before[r["r"]]) for r in tops], f"r2 int, top {kind}, b int"))
    heads = rows.join(first, (F.col("r") == F.col("r2")) & F.col("id").eqNullSafe(F.col("top")))
    heads = heads.groupBy("b").agg(F.min("text").alias("text")).select(F.lit(None).cast(kind).alias("id"), "text", F.col("b").alias("r"), F.lit(1).alias("head"))
    dealt = rows.withColumn("head", F.lit(0)).unionByName(heads, allowMissingColumns=True).repartition(parts, "r")
    dealt = dealt.sortWithinPartitions("r", "head", F.col("id").desc_nulls_last(), F.col("text").asc_nulls_first())

    carried = told is not None

    def pairs(batches):
        pending, of, known = None, None, {}
        for b in batches:
            extra = [b.column(c).to_pylist() for c in more] or [[None] * b.num_rows] * 2
            for r, i, t, head, key, c in zip(*(b.column(c).to_pylist() for c in ("r", "id", "text", "head")), *extra, strict=True):
                if t is None:  # what is told about the texts of an id comes before them
                    if (r, i) != of:
                        of, known = (r, i), {}
                    known[key] = c
                    continue
                if pending:
                    yield (*pending[:2], t, *pending[2:])
                pending = None if head else (i, t) if not carried else (i, t, known.get(hashlib.md5(t.encode()).digest()) if (r, i) == of else None)

    def task(batches):
        yield from run(pairs(batches))

    return dealt.mapInArrow(task, schema)


OP1_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows):
    names = [c.split()[0] for c in OP1_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out: list[tuple] = []

    def batch(out):
        n = len(out[0])  # with the class or without
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [*kinds, pa.int64()][:n], strict=True)], [*names, "class_id"][:n])

    text = sigs = None
    for i, t, following, *more in rows:
        own = sigs if t is text else spot_signatures(t)
        new = edited(t, following)
        text, sigs = following, spot_signatures(following)
        new_sigs = spot_signatures(new)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), digest(own), digest(new_sigs), jaccard(own, new_sigs), jaccard(own, sigs), *more))
        if len(out) == 1000:
            yield batch(out)
            out = []
    if out:
        yield batch(out)


def _as_sets(chain: int):
    """(key, text) -> (key, s): the sorted signature hashes of a text as bytes."""

    def run(batches):
        for b in batches:
            sigs = [np.array(sorted(spot_signatures(t, chain)), np.uint64).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigs, pa.binary())], ["key", "s"])

    return run


def _alike(threshold: float):
    """(key, m, s, s2) -> (key, m) where the pruned Jaccard of the two sets reaches the threshold."""

    def run(batches):
        for b in batches:
            ok, last, held = [], None, frozenset()
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if y != last:  # rows come in runs of one partner
                    last, held = y, frozenset(np.frombuffer(y, np.uint64).tolist())
                small, large = sorted((len(x) // 8, len(held)))
                ok.append(small >= threshold * large - 1e-9 and jaccard(frozenset(np.frombuffer(x, np.uint64).tolist()), held) >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["key", "m"]).filter(pa.array(ok, pa.bool_()))

    return run


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, chain: int = 2) -> DataFrame:
    """(id, key, class_id), key being the md5 of the text: rows whose fingerprints have a Jaccard of at least ``threshold``, or a chain of such rows, share
    a class.

    Equal texts take part once. Fingerprints are partitioned by set length, so that a partition's sets can only match
    those of their own and the adjacent one; within these, two sets that match share one of their first (rarest)
    signatures. First each set meets some pivots of its partition with such a signature; groups found so are joined by a
    few likely pairs of each two, and between those left all pairs are compared whose lengths, prefixes and sketches allow it. Every pair is verified by the pruned Jaccard.
    class_id is the smallest id of the class. Texts without words, null ones among them, form one class. Null ids take
    part but name no class; a repeated row is of the class of the other. No rows give none.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    small_batches(spark)
    ids = written(base.select("id", "key"), "ids")
    texts = base.select("key", "text")
    fingerprints = prefix_sets(texts, lambda t: [s.to_bytes(8, "little") for s in spot_signatures(t, chain)] or [b""], threshold)
    posts = postings_of(fingerprints)

    def verified(near: DataFrame) -> DataFrame:
        near = written(near, "candidates")
        sent = build_filter(near.select("key").union(near.select("m")).distinct().select("key"), "key")
        sets = map_listed(texts, sent, "key", _as_sets(chain), "key binary, s binary")
        sets = written(sets.dropDuplicates(["key"]), "sets")
        both = near.join(sets, "key").join(sets.select(F.col("key").alias("m"), F.col("s").alias("s2")), "m")
        found = written(both.select("key", "m", "s", "s2").mapInArrow(_alike(threshold), "key binary, m binary"), "links")
        discard(near, sets)
        return found

    links = verified(likely(pivot_pairs(posts, threshold), fingerprints, threshold))
    discard(fingerprints)
    parts = written(connected_components(links, "key", "m"), "parts")
    parts = joined_parts(posts, parts, threshold, verified, by_length=True)
    discard(posts, links)
    least = ids.groupBy("key").agg(F.min("id").alias("least"))
    each = least.join(parts, least.key == parts.node, "left").select("key", "least", F.coalesce("component", "key").alias("part"))
    named = each.join(each.groupBy("part").agg(F.min("least").alias("class_id")), "part").select(F.col("key").alias("k"), "class_id")
    return written(ids.join(named, F.col("key") == F.col("k")).select("id", "key", "class_id"), "spot-classes")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, chain: int = 2) -> DataFrame:
    """(id, class_id) of every row, as of ``classes``."""
    return classes(df, id_col, text_col, threshold, chain).select("id", "class_id")


def op1_spotsigs(spark, sf_dir):
    """Fingerprints of every text and its edited text, and the class of near duplicates by fingerprint.

    Null texts are empty; texts without words have an empty fingerprint and are alike. Repeated rows stay repeated, with
    the next row in order as theirs; null ids come last and have no class of their own. No rows give none.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    told = classes(docs).distinct()
    return with_next(docs, "doc_id", "text", _compare, f"{OP1_SCHEMA}, class_id long", told)
