"""Fuzzy line dedup over the whole corpus by MinHash.

Lines are compared as sets of 5-character shingles. For candidates every line's 8-character shingles, which unrelated
lines hardly share, are hashed once: they fall into bins by hash and each bin keeps its smallest hash (one-permutation
MinHash, empty bins borrow from the next). Bands of four bins find candidates with high recall (98.7 % of pairs with a
similarity of 0.80 to 0.85 when measured). A band's lines first meet its smallest and largest key, those of a large band
some further pivots; bands that then still hold lines of several components, lines of one template for instance, have all pairs of these compared, large bands by an
exact prefix join, so that no pair of a band is left out. Each candidate is verified by the exact Jaccard; distributed union-find joins what
is alike, and one line of each component, the first by document id and position, stays.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bloom import build_filter, holds, might_hold
from tidemark.llm.common import connected_components, read, written
from tidemark.llm.prefix import joined_parts, postings

SHINGLE = 5
WIDE = 8  # characters of a shingle in signatures
BANDS, ROWS = 12, 4
BINS = 48
GROUP_CHARS = 1 << 16  # characters of the lines whose signatures are computed at once: arrays of 0.5 MB
LARGE_BAND, PIVOTS = 256, 4  # lines of a band beyond which it has so many pairs of further pivots, of which a line meets one
SMALL_BAND = 32  # lines of a band that are paired with one another; larger bands take the prefix join
MIN_CHARS = 10  # unless a caller asks for shorter lines too, as the query and the pipeline do; empty lines always stay
_M = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
# a bin that borrows from the one n places on takes its hash after n steps of x * _M + 1
_FACTOR = np.array([pow(int(_M), n, 1 << 64) for n in range(BINS)], np.uint64)
_SHIFT = np.array([sum(pow(int(_M), i, 1 << 64) for i in range(n)) % (1 << 64) for n in range(BINS)], np.uint64)


def bands(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) of int64 band hashes; every line has at least WIDE characters."""
    chars = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(x) for x in lines])
    ends = np.cumsum(sizes)
    # polynomial hash of every WIDE characters: runs of 1, 2, 4 and 8 are joined pairwise
    h, base = chars, 0x100000001B3
    h += np.uint64(1)
    for run in (1, 2, 4):
        joined = h[:-run] * np.uint64(pow(base, run, 1 << 64))
        joined += h[run:]
        h = joined
    h ^= h >> np.uint64(31)
    h *= _M
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    whole = np.ones(len(h), bool)
    whole[(ends[:-1, None] - np.arange(WIDE - 1, 0, -1)).ravel()] = False  # these reach into the next line
    h = h[whole]
    at = ((h >> np.uint64(44)).astype(np.uint32) * np.uint32(BINS) >> np.uint32(20)).astype(np.int64)
    at += np.repeat(np.arange(len(lines)) * BINS, sizes - (WIDE - 1))
    sig = np.full(len(lines) * BINS, _NONE, np.uint64)
    np.minimum.at(sig, at, h & np.uint64((1 << 44) - 1))
    sig = sig.reshape(-1, BINS)
    short = np.flatnonzero((sig == _NONE).any(axis=1))
    if len(short):
        part = sig[short]
        filled = np.where(np.tile(part != _NONE, 2), np.arange(2 * BINS), 2 * BINS)
        step = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1][:, :BINS] - np.arange(BINS)
        lender = np.take_along_axis(part, (step + np.arange(BINS)) % BINS, axis=1)
        sig[short] = lender * _FACTOR[step] + _SHIFT[step]
    out = np.empty((len(lines), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(lines), b + 1, np.uint64)
        for r in range(ROWS):
            x = (x ^ sig[:, b * ROWS + r]) * _M
            x ^= x >> np.uint64(32)
        out[:, b] = x
    return out.view(np.int64)


def shingles(s: str) -> set[str]:
    return {s[i : i + SHINGLE] for i in range(max(1, len(s) - SHINGLE + 1))}


def _grams(s: str) -> list[bytes]:
    return [x.encode() for x in shingles(s)]


def similarity(a: str, b: str) -> float:
    return _jaccard(shingles(a), shingles(b))


def _jaccard(x: set[str], y: set[str]) -> float:
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def normal(c):
    """What is compared: lower case, without spaces at the ends."""
    return F.trim(F.lower(c))


def _groups(lines: list[str]):
    """(from, to) of runs of lines of about GROUP_CHARS characters."""
    group = np.cumsum([len(x) for x in lines]) // GROUP_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lines)]
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False) if lo < hi]


def _band_task(batches):
    """(key, line) -> (key, bands), each key once a batch."""
    for b in batches:
        keys = b.column(0)
        b = b.take(pa.array(np.unique(np.array(keys.to_pylist(), "S16"), return_index=True)[1]))
        keys, lines = b.column(0), b.column(1).to_pylist()
        for lo, hi in _groups(lines):
            ends = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.ListArray.from_arrays(ends, pa.array(bands(lines[lo:hi]).ravel()))], ["key", "bands"])


def _mark_task(sent):
    """(key, bands) -> (key, band) for the bands that the filter may hold."""

    def run(batches):
        for b in batches:
            at = np.flatnonzero(holds(sent.value, flat := b.column(1).flatten().to_numpy()))
            if len(at):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at // BANDS)), pa.array(flat[at])], ["key", "band"])

    return run


def shingle_hashes(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each line's shingles; every line has at least SHINGLE characters."""
    chars = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    base = 0x100000001B3
    h = chars[: len(chars) - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        h = h * np.uint64(base) + chars[i : len(chars) - SHINGLE + 1 + i]
    h ^= h >> np.uint64(29)
    h *= _M
    h ^= h >> np.uint64(32)
    out, at = [], 0
    for x in lines:
        s = np.sort(h[at : at + len(x) - SHINGLE + 1])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        at += len(x)
    return out


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two arrays of ``shingle_hashes`` have a Jaccard of ``threshold``."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < threshold * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both) >= threshold


def _verify_task(threshold: float):
    def run(batches):
        for b in batches:
            a, m, x, y = (b.column(i) for i in range(4))
            x, y, ok = x.to_pylist(), y.to_pylist(), []
            for lo, hi in _groups(x):
                pivots = list(dict.fromkeys(y[lo:hi]))
                held = dict(zip(pivots, shingle_hashes(pivots), strict=True))
                ok += [alike(p, held[q], threshold) for p, q in zip(shingle_hashes(x[lo:hi]), y[lo:hi], strict=True)]
            yield pa.RecordBatch.from_arrays([a, m], ["key", "m"]).filter(pa.array(ok, pa.bool_()))

    return run


def same_sets(lines: DataFrame) -> DataFrame:
    """(key, m): lines too short for a signature, or of a period of three characters at most, and the smallest key of
    those with the very same shingles. Lines with so few shingles are alike only if they have the same ones."""
    line = F.col("line")
    begins = reduce(or_, [F.substring(line, p + 1, WIDE - p) == F.substring(line, 1, WIDE - p) for p in (1, 2, 3)])  # cheap, and false for most
    periodic = begins & reduce(or_, [F.substring(line, p + 1, 1 << 30) == line.substr(F.lit(1), F.length(line) - p) for p in (1, 2, 3)])
    few = lines.where((F.length(line) >= SHINGLE) & ((F.length(line) < WIDE) | periodic)).select("key", "line").distinct()
    head = F.substring(line, 1, WIDE - 1)  # holds every shingle of such a line
    cut = F.transform(F.sequence(F.lit(1), F.length(head) - SHINGLE + 1), lambda i: F.col("line").substr(i, F.lit(SHINGLE)))
    sets = few.select("key", F.to_json(F.array_sort(F.array_distinct(cut))).alias("set"))
    first = sets.groupBy("set").agg(F.min("key").alias("m"), F.max("key").alias("last")).where("m <> last")
    return sets.join(first, "set").where("key <> m").select("key", "m")


def further_pivots(marks: DataFrame, large: DataFrame) -> DataFrame:
    """(key, m): each (band, key) row of the ``large`` bands with one of their further pivots, which are first and last
    in PIVOTS hashed orders; a line meets another pivot in each of its bands."""
    orders = [F.xxhash64(F.lit(seed), "key") for seed in range(PIVOTS)]
    more = F.array(*[x for h in orders for x in (F.min_by("key", h), F.max_by("key", h))])
    pivots = marks.join(large, "band").groupBy("band").agg(more.alias("pivots"))
    one = F.col("pivots")[F.pmod(F.xxhash64("key", "band"), F.lit(2 * PIVOTS)).cast("int")]
    return marks.join(pivots, "band").select("key", one.alias("m"))


def removed_lines(docs: DataFrame, threshold: float = 0.8, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, k, n_lines, gone): ``gone`` is the sorted array of positions of a document's lines that go.

    A document is an (id, text) pair, k being a hash of the text: repeated rows are one document and keep the same
    lines. Null texts have one empty line. Lines of fewer than ``min_chars`` characters stay, and empty ones. Lines of
    fewer than WIDE characters have three shingles at most and are repeats only of lines with the same ones, lines of
    fewer than SHINGLE characters only of equal ones.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("k"))
    split = base.select("doc_id", "k", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = split.select("doc_id", "k", "pos", normal(F.col("line")).alias("line")).where(F.length("line") >= max(min_chars, 1))
    where = written(lines.withColumn("key", F.unhex(F.md5("line"))), "lines")
    signed = written(where.where(F.length("line") >= WIDE).select("key", "line").mapInArrow(_band_task, "key binary, bands array<bigint>"), "signatures")
    # first only which bands hold several lines, on short hashes; most bands hold one and are not dealt again
    each = signed.select(F.xxhash64("key").alias("h"), F.explode("bands").alias("band"))
    full = each.groupBy("band").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("band")
    sent = spark.sparkContext.broadcast(build_filter(written(full, "full"), "band"))
    marks = written(signed.mapInArrow(_mark_task(sent), "key binary, band long"), "bands")
    ends = marks.groupBy("band").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    near = marks.join(ends.select("band", "lo", "hi"), "band").select("key", F.explode(F.array("lo", "hi")).alias("m"))
    # large bands have further pivots, so that more of what is alike in them is joined before the exact search
    near = near.union(further_pivots(marks, ends.where(F.col("n") > LARGE_BAND).select("band"))).where("key <> m")
    near = written(near.select(F.least("key", "m").alias("key"), F.greatest("key", "m").alias("m")).distinct(), "candidates")
    names = near.select("key").union(near.select("m")).distinct()
    sent = build_filter(names, "key")
    texts = where.select("key", "line").where(might_hold(spark, sent, "key")).dropDuplicates(["key"])
    texts = written(texts, "texts")

    def verified(near):
        both = near.join(texts, "key").join(texts.select(F.col("key").alias("m"), F.col("line").alias("other")), "m")
        return both.select("key", "m", "line", "other").mapInArrow(_verify_task(threshold), "key binary, m binary")

    parts = written(connected_components(verified(near).unionByName(same_sets(where)), "key", "m"), "parts")
    # bands of more than two lines whose lines are not all of one component have pairs that nobody has looked at
    named = marks.distinct().join(parts, marks.key == parts.node, "left").select("band", "key", F.coalesce("component", "key").alias("part"))
    sizes = named.groupBy("band").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count("*").alias("n")).where("a <> b and n > 2")
    rest = written(named.join(sizes.select("band", "n"), "band"), "open")
    few = rest.where(F.col("n") <= SMALL_BAND)
    other = few.select("band", F.col("key").alias("m"), F.col("part").alias("part2"))
    more = few.join(other, "band").where((F.col("key") < F.col("m")) & (F.col("part") != F.col("part2"))).select("key", "m")
    many = texts.join(rest.where(F.col("n") > SMALL_BAND).select("key").distinct(), "key")
    posts = postings(many.select("key", F.col("line").alias("text")), _grams, threshold)
    parts = joined_parts(posts, parts, threshold, verified, more=more, rounds=2)
    placed = where.drop("line").join(parts, where.key == parts.node, "left").select("doc_id", "k", "pos", F.coalesce("component", "key").alias("part"))
    placed = written(placed, "placed")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k", "pos")
    first = placed.groupBy("part").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").select("part", "first")
    out = placed.join(first, "part").where(order != F.col("first")).select("doc_id", "k", "pos").distinct()
    gone = out.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list("pos")).alias("gone"))  # a document's own lines
    sizes = base.select("doc_id", "k", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    on = sizes.doc_id.eqNullSafe(gone.doc_id) & (sizes.k == gone.k)
    return sizes.join(gone, on, "left").select(sizes.doc_id, sizes.k, "n_lines", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))


def clean(docs: DataFrame, threshold: float = 0.8, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text`` and ``n_chars`` counted anew, where it is a column.

    A document all of whose lines went has become empty and goes too; one that was empty before stays.
    """
    gone = removed_lines(docs, threshold, min_chars).where("size(gone) > 0").dropDuplicates(["doc_id", "k"]).select(F.col("doc_id").alias("__id"), F.col("k").alias("__k"), F.col("gone").alias("__gone"))
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__k")), "left")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda _, i: ~F.array_contains("__gone", i))
    out = out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    out = out.where(F.col("__gone").isNull() | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*docs.columns)


def op7_line_dedup(spark, sf_dir):
    """Lines of every document, how many stay and which go. Null texts have one empty line; empty lines stay; of equal
    rows both keep the same lines; rows without an id come last in order; no rows give none."""
    found = removed_lines(read(spark, sf_dir, "documents"), min_chars=1)
    return found.select("doc_id", "n_lines", (F.col("n_lines") - F.size("gone")).alias("n_kept"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed"))
