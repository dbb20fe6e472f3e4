"""Exact candidates for a Jaccard join of sets of shingles, by prefixes and positions.

Shingles have one order for all sets: those seen often in a sample of the sets come last, the others lie by hash. Two
sets of n and m >= n shingles with a Jaccard of t or more have a = ceil(t / (1 + t) * (n + m)) in common, so that the first
one they share lies among the first n - ceil(2 t / (1 + t) * n) + 1 of the smaller set and the first m - ceil(t * m) + 1 of
the larger one. Only these are joined: what many sets share is at the end and links none that differ before it. The order
only decides how much is compared; no pair is lost by it.

A set also carries a parity sketch: a bit for each of SKETCH hash values, set if an odd number of its shingles has the
value. Two sketches differ in at most as many bits as the sets differ in shingles, so a pair whose sketches differ in more
than (1 - t) / (1 + t) * (n + m) bits can't have a Jaccard of t and never leaves the join. Sets may be joined by length partition:
n and m of such a pair lie in the same or in adjacent ones.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bloom import build_filter, might_hold
from tidemark.llm.common import discard, merged_components, shuffles_dropped, written

SAMPLE = 16  # one of so many sets is looked at for common shingles
COMMON, MOST = 3, 1 << 19  # a shingle is common if so many sampled sets hold it; so many of these are told apart
SKETCH = 512  # bits
LARGE, PIVOTS = 32, 4
NAMED = 1 << 17  # rows of (node, component) that are broadcast
GROUP = 256  # texts whose prefixes are sent at once


def _hashes(grams) -> np.ndarray:
    """Sorted distinct hashes of shingles given as bytes; an array is taken for such hashes."""
    if isinstance(grams, np.ndarray):
        return grams
    from xxhash import xxh64_digest

    return np.unique(np.frombuffer(b"".join([xxh64_digest(g) for g in grams]), np.int64))


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount(hashes & (SKETCH - 1), minlength=SKETCH) & 1).view(np.int64)


def long_sketch(hashes: np.ndarray) -> bytes:
    """A parity sketch of two bits or more for each shingle; it is folded to compare it with a shorter one."""
    bits = max(SKETCH, 1 << (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount(hashes.view(np.int64) & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def sketches_near(a: bytes, b: bytes, n: int, m: int, threshold: float) -> bool:
    """Whether sets of n and m shingles with these long sketches can have a Jaccard of ``threshold``."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= int((1 - threshold) / (1 + threshold) * (n + m) + 1e-9)


def _common(texts: DataFrame, grams) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and the rank of each, 1 and more."""

    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(grams(t)))], ["sig"])

    some = texts.where(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "sig long")
    counts = some.groupBy("sig").agg(F.count("*").alias("f")).where(F.col("f") >= COMMON)
    found = counts.orderBy(F.desc("f"), "sig").limit(MOST).select("sig").toPandas()["sig"].to_numpy(np.int64)
    by_hash = np.argsort(found)
    return found[by_hash], len(found) - by_hash


def prefixes(texts: DataFrame, grams, threshold: float) -> DataFrame:
    """(key, n, sigs, sketch) for (key, text): the shingles in order as far as any partner can ask for them."""
    sent = texts.sparkSession.sparkContext.broadcast(_common(texts, grams))

    def run(batches):
        common, ranks = sent.value
        for b in batches:
            keys, every = b.column(0), b.column(1).to_pylist()
            for lo in range(0, len(every), GROUP):
                n, sigs, sketch = [], [], []
                for t in every[lo : lo + GROUP]:
                    h = _hashes(grams(t))
                    sketch.append(parity_sketch(h))
                    if len(common):
                        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                        h = h[np.lexsort((h, np.where(common[at] == h, ranks[at], 0)))]
                    n.append(len(h))
                    sigs.append(h[: len(h) - max(1, int(np.ceil(threshold * len(h) - 1e-9))) + 1])
                ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sigs))), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(np.concatenate(sketch)))]
                yield pa.RecordBatch.from_arrays([keys.slice(lo, len(n)), pa.array(np.array(n, np.int32)), *lists], ["key", "n", "sigs", "sketch"])

    return texts.select("key", "text").mapInArrow(run, "key binary, n int, sigs array<bigint>, sketch array<bigint>")


def prefix_sets(texts: DataFrame, grams, threshold: float) -> DataFrame:
    """``prefixes`` of the (key, text) rows, each key once, written."""
    return written(prefixes(texts, grams, threshold).dropDuplicates(["key"]), "prefixes")


def postings_of(sets: DataFrame) -> DataFrame:
    """(key, n, sketch, p, sig): the shingles of ``prefix_sets`` that several of them may have, written."""
    each = sets.select("key", "n", "sketch", F.posexplode("sigs").alias("p", "sig"))
    h = F.xxhash64("key")
    met = written(each.groupBy("sig").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b").select("sig"), "met")
    posts = written(each.where(might_hold(sets.sparkSession, build_filter(met, "sig"), "sig")), "postings")
    discard(met)
    return posts


def postings(texts: DataFrame, grams, threshold: float) -> DataFrame:
    """(key, n, sketch, p, sig): the prefix shingles that several of the (key, text) rows may have, written.

    ``grams`` gives the set of shingles of a text as bytes, or as a sorted array of distinct hashes; a text without any
    has no rows. Repeated rows of a key count once.
    """
    sets = prefix_sets(texts, grams, threshold)
    posts = postings_of(sets)
    discard(sets)
    return posts


def likely(near: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (key, m) rows of ``near`` but those that sizes and sketches of ``prefix_sets`` show to be unlike, each once.

    Texts or whole sets then travel for pairs only that may be links; no link is left out.
    """
    sides = sets.select("key", "n", "sketch"), sets.select(F.col("key").alias("m"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"))
    return near.distinct().join(sides[0], "key").join(sides[1], "m").where(near_enough(threshold)).select("key", "m")


def length_partition(n, threshold: float):
    """Partition by set length: sets that can be alike are in the same or in adjacent ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(1 / threshold))) + 1e-12)


def pivot_pairs(posts: DataFrame, threshold: float) -> DataFrame:
    """(key, m): each set with the smallest key of its length partition that shares a prefix shingle with it, and in
    partitions of more than LARGE sets with those that PIVOTS hashed orders put first and last.

    That joins large groups with few pairs; ``join_postings`` then looks at what is between the groups.
    """
    rows = posts.select("key", "sig", length_partition(F.col("n"), threshold).alias("lp"))
    orders = [F.xxhash64(F.lit(seed), "key") for seed in range(PIVOTS)]
    more = F.array(*[x for h in orders for x in (F.min_by("key", h), F.max_by("key", h))])
    ends = rows.groupBy("sig", "lp").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"), more.alias("more")).where("lo <> hi")
    pivots = F.when(F.col("n") > LARGE, F.array_distinct(F.concat(F.array("lo", "hi"), "more"))).otherwise(F.array("lo"))
    near = rows.join(ends.select("sig", "lp", pivots.alias("pivots")), ["sig", "lp"]).select("key", F.explode("pivots").alias("m")).where("key <> m")
    return near.select(F.least("key", "m").alias("key"), F.greatest("key", "m").alias("m")).distinct()


def _with_parts(posts: DataFrame, parts: DataFrame) -> DataFrame:
    """``posts`` with the node and component of their key, where it has one. Keys that are joined already are few beside
    the postings: up to NAMED of them, some 8 MB, are sent to the postings, more are joined by a shuffle."""
    with shuffles_dropped(posts.sparkSession):
        small = parts.limit(NAMED + 1).count() <= NAMED
    return posts.join(F.broadcast(parts) if small else parts, F.col("key") == F.col("node"), "left")


def near_enough(threshold: float):
    """Whether sets of n and n2 shingles with ``sketch`` and ``sketch2`` can have a Jaccard of ``threshold``."""
    n, m = F.col("n"), F.col("n2")
    differ = reduce(add, [F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch2")[i])) for i in range(SKETCH // 64)])
    sizes = F.least(n, m) >= F.ceil(F.lit(threshold) * F.greatest(n, m) - 1e-9)
    return sizes & (differ <= F.floor(F.lit((1 - threshold) / (1 + threshold)) * (n + m) + 1e-9))


def contract(posts: DataFrame, parts: DataFrame, threshold: float, verified, rounds: int = 3) -> DataFrame:
    """``parts`` joined as far as a few likely pairs of them show.

    Only shingles of sets that are joined already take part; two sets that are parts of their own have one pair, which is
    left to ``join_postings``. In a round each shingle and length partition names up to four of its sets, two by a hash of
    the set and two by a hash of the part, so that small parts are named too. Its other sets meet these where part, size
    and sketch allow it; of each two parts that meet so the nearest pair and one more are verified, and parts with a link
    become one. Two parts with many links are joined after a few pairs instead of one for each link. ``verified`` takes
    (key, m) rows and returns those that are links.
    """
    spark = posts.sparkSession
    members = posts.where(might_hold(spark, build_filter(parts, "node"), "key")).select("sig").distinct()
    work = written(posts.where(might_hold(spark, build_filter(written(members, "members"), "sig"), "sig")), "work")
    for r in range(rounds):
        named = _with_parts(work, parts).withColumns({"part": F.coalesce("component", "key"), "several": F.col("node").isNotNull()}).drop("node", "component")
        named = written(named.withColumn("lp", length_partition(F.col("n"), threshold)), "named")
        h = F.xxhash64("part")
        several = named.groupBy("sig").agg(F.min(h).alias("a"), F.max(h).alias("b"), F.max("several").alias("s")).where("a <> b and s").select("sig")
        met = written(named.join(several, "sig"), "met")
        discard(work, named)
        work = met.select("key", "n", "sketch", "p", "sig")
        one, by_set, by_part = F.struct("key", "n", "sketch", "part", "several"), F.xxhash64(F.lit(r), "key"), F.xxhash64(F.lit(r), "part")
        order = F.struct(by_part, by_set)
        named = F.array(F.min_by(one, by_set), F.max_by(one, by_set), F.min_by(one, order), F.max_by(one, order))
        pivots = met.groupBy("sig", "lp").agg(F.array_distinct(named).alias("q"))
        pivots = pivots.select("sig", F.explode(F.array("lp", F.col("lp") + 1)).alias("lp"), "q").select("sig", "lp", F.explode("q").alias("q"))
        pivots = pivots.select("sig", "lp", F.col("q.key").alias("m"), F.col("q.n").alias("n2"), F.col("q.sketch").alias("sketch2"), F.col("q.part").alias("part2"), F.col("q.several").alias("several2"))
        joined = F.col("several") | F.col("several2")
        near = met.join(pivots, ["sig", "lp"]).where((F.col("part") != F.col("part2")) & joined & near_enough(threshold))
        differ = reduce(add, [F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch2")[i])) for i in range(SKETCH // 64)])
        pair = F.struct(F.least("key", "m").alias("key"), F.greatest("key", "m").alias("m"))
        near = near.select(F.least("part", "part2").alias("x"), F.greatest("part", "part2").alias("y"), pair.alias("pair"), differ.alias("d"))
        best = near.groupBy("x", "y").agg(F.min_by("pair", "d").alias("a"), F.min_by("pair", F.xxhash64(F.lit(r), "pair")).alias("b"))
        links = written(verified(best.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("pair")).select("pair.key", "pair.m")), "links")
        if links.isEmpty():
            break
        parts = written(merged_components(parts, links, "key", "m"), "parts")
    discard(work)
    return parts


def join_postings(posts: DataFrame, parts: DataFrame, threshold: float, by_length: bool = False) -> DataFrame:
    """(key, m): every pair of ``postings`` sets that can have a Jaccard of ``threshold``, unless it is of one part.

    ``parts`` is (node, component) as of ``connected_components``; other keys are parts of their own. ``by_length`` first
    tells by length partition which sets of a shingle can match. Pairs are yet to be verified.
    """
    each = _with_parts(posts, parts).withColumn("part", F.xxhash64(F.coalesce("component", "key"))).drop("node", "component")
    # parts that meet; pairs are never taken within the largest part of a shingle, which may hold most sets
    tops = each.groupBy("sig").agg(F.mode("part").alias("top"), (F.min("part") < F.max("part")).alias("several")).where("several").select("sig", "top")
    rows = written(each.join(tops, "sig").withColumn("lp", length_partition(F.col("n"), threshold)), "meeting")
    names = ["key", "part", "n", "p", "sketch"]
    half = (1 - threshold) / (1 + threshold)
    x = rows.where(F.col("p") <= F.col("n") - F.ceil(F.lit(2 * threshold / (1 + threshold)) * F.col("n") - 1e-9))
    y = rows.select("sig", F.col("lp").alias("lp2"), *[F.col(c).alias(f"{c}2") for c in names], F.col("top").alias("top2"))
    n, m = F.col("n"), F.col("n2")
    order = (n < m) | ((n == m) & (F.col("key") < F.col("key2")))
    sizes = (F.col("part") != F.col("part2")) & order & (n >= F.ceil(F.lit(threshold) * m - 1e-9))
    enough = F.least(n - F.col("p"), m - F.col("p2")) >= F.ceil(F.lit(threshold / (1 + threshold)) * (n + m) - 1e-9)
    differ = [F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch2")[i])) for i in range(SKETCH // 64)]
    near = sizes & enough & (reduce(add, differ) <= F.floor(F.lit(half) * (n + m) + 1e-9))
    if by_length:
        near = F.col("lp2").between(F.col("lp"), F.col("lp") + 1) & near
    on = "sig"
    found = x.where("part <> top").join(y, on).where(near).unionByName(x.where("part = top").join(y.where("part2 <> top2"), on).where(near))
    return found.select(F.least("key", "key2").alias("key"), F.greatest("key", "key2").alias("m")).distinct()


def joined_parts(posts: DataFrame, parts: DataFrame, threshold: float, verified, by_length: bool = False, more: DataFrame | None = None, rounds: int = 3) -> DataFrame:
    """``parts`` (node, component) joined by every link between sets of ``posts``, and by those of the ``more`` pairs:
    first parts as wholes by ``contract``, then each pair that is left."""
    parts = contract(posts, parts, threshold, verified, rounds)
    rest = join_postings(posts, parts, threshold, by_length)
    rest = rest if more is None else rest.unionByName(more).distinct()
    return written(merged_components(parts, verified(written(rest, "rest")), "key", "m"), "parts")
