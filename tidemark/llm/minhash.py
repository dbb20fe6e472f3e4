"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped links.

A document is the set of its distinct word shingles. One hash of each shingle deals it to one of BINS ranges, and a
range keeps its smallest hash; an empty range takes the value of the first range that is not empty in a random order of
its own, the same order for all documents (optimal densification), so that ranges stay independent however few shingles
there are. BANDS bands of ROWS ranges make buckets. A bucket of k documents gives k - 1 links, all to one of them: pairs
never grow with the square of a bucket. Links are verified on the full sets of shingles.

A star misses a pair both of whose members are unlike its centre. So between the components found, an exact prefix join
(``prefix.py``) looks for what is left: first for few likely pairs of any two groups that meet, which join large groups
with few rows, then for all pairs that are not yet of one group. No link is lost but by equal 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bloom import build_filter, holds, map_listed
from tidemark.llm.common import connected_components, discard, read, small_batches, written
from tidemark.llm.prefix import SKETCH, joined_parts, long_sketch, near_enough, parity_sketch, postings, sketches_near
from tidemark.llm.words import WordHashes, prefix_polynomials, run_hashes

BANDS, ROWS = 20, 6
BINS = BANDS * ROWS
GROUP_CHARS = 1 << 20  # bytes of the texts whose signatures are computed at once
_M = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: For each range the order in which it asks the others, itself last.
LENDERS = np.array([np.append((o := np.random.default_rng(1000 + i).permutation(BINS))[o != i], i) for i in range(BINS)])
_words: dict[int, WordHashes] = {}


def shingle_set(text: bytes, size: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text, A-Z lower-cased; fewer words are one shingle."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    n = min(size, len(w))
    h = _words.setdefault(size, WordHashes(size)).of(w)
    return np.unique(run_hashes(prefix_polynomials(h), np.arange(len(w) - n + 1), n))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS values for each set, none of which is empty."""
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)) * BINS, [len(s) for s in sets])
    at = of + ((flat >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # sets are sorted and ranges follow the order
    out = np.full(len(sets) * BINS, _NONE, np.uint64)
    out[at[first]] = flat[first]
    out = out.reshape(-1, BINS)
    row, col = np.nonzero(out == _NONE)
    found = out.copy()
    for t in range(BINS):
        if not len(row):
            break
        v = out[row, LENDERS[col, t]]
        found[row, col] = v
        row, col = row[v == _NONE], col[v == _NONE]
    return found


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS) int64."""
    x = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _M
    x = np.repeat(x, len(sig), axis=0)
    for r in range(ROWS):
        x = (x ^ sig[:, r::ROWS]) * _M
        x ^= x >> np.uint64(29)
    return x.view(np.int64)


def _distinct(b):
    """The rows of a (key, text) batch with each key once, texts as bytes, in groups of about GROUP_CHARS bytes."""
    keys = np.array(b.column(0).to_pylist(), "S16") if b.num_rows else np.zeros(0, "S16")
    b = b.take(pa.array(np.sort(np.unique(keys, return_index=True)[1])))
    texts = b.column(1).cast(pa.binary()).to_pylist()
    group = np.cumsum([len(t) for t in texts]) // GROUP_CHARS if texts else np.zeros(0, int)
    for g in np.unique(group):
        rows = np.flatnonzero(group == g)
        yield b.column(0).take(pa.array(rows)), texts[rows[0] : rows[-1] + 1]


def _sign(size: int):
    """(key, text) -> (key, n, bands, sketch), texts without words left out."""

    def run(batches):
        for b in batches:
            for keys, texts in _distinct(b):
                sets = [shingle_set(t, size) for t in texts]
                some = [i for i, s in enumerate(sets) if len(s)]
                if not some:
                    continue
                sets = [sets[i] for i in some]
                marks = band_keys(signatures(sets))
                sketch = np.concatenate([parity_sketch(s.view(np.int64)) for s in sets])
                ends = lambda k, n=len(some): pa.array(np.arange(n + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(some)), pa.array(np.array([len(s) for s in sets], np.int32)),
                    pa.ListArray.from_arrays(ends(BANDS), pa.array(marks.ravel())), pa.ListArray.from_arrays(ends(SKETCH // 64), pa.array(sketch)),
                ], ["key", "n", "bands", "sketch"])

    return run


def _mark(sent):
    """(key, n, bands, sketch) -> (band, key, n, sketch) for the bands that the filter may hold."""

    def run(batches):
        for b in batches:
            flat = b.column(2).flatten().to_numpy()
            at = np.flatnonzero(holds(sent.value, flat))
            if len(at):
                rows = pa.array(at // BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(flat[at]), *[b.column(i).take(rows) for i in (0, 1, 3)]], ["band", "key", "n", "sketch"])

    return run


def _as_sets(size: int):
    def run(batches):
        for b in batches:
            for keys, texts in _distinct(b):
                sets = [shingle_set(t, size) for t in texts]
                cols = [pa.array([len(s) for s in sets], pa.int32()), pa.array(map(long_sketch, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([keys, *cols], ["key", "n", "sketch", "s"])

    return run


def _sieve(threshold: float):
    """(key, m, n, sketch, n2, sketch2) -> (key, m) unless the long sketches show that a pair is unlike."""

    def run(batches):
        for b in batches:
            ok = [sketches_near(x, y, n, m, threshold) for n, x, m, y in zip(*[b.column(i).to_pylist() for i in range(2, 6)], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["key", "m"]).filter(pa.array(ok, pa.bool_()))

    return run


def _alike(percent: int):
    """(key, m, s, s2) -> (key, m) where 100 * common >= percent * all."""

    def run(batches):
        for b in batches:
            ok, last, held = [], None, np.zeros(0, np.uint64)
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if y != last:
                    last, held = y, np.frombuffer(y, np.uint64)
                own = np.frombuffer(x, np.uint64)
                small, large = sorted((own, held), key=len)
                if 100 * len(small) < percent * len(large):
                    ok.append(False)
                    continue
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                ok.append(100 * both >= percent * (len(small) + len(large) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["key", "m"]).filter(pa.array(ok, pa.bool_()))

    return run


def star_links(marks: DataFrame, threshold: float) -> DataFrame:
    """(key, m): every row of ``marks`` (band, key, n, sketch) with the smallest key of its band, unless their set sizes or
    sketches show that they are unlike. A band of k keys gives k - 1 rows at most."""
    centre = marks.groupBy("band").agg(F.min(F.struct("key", "n", "sketch")).alias("c"), F.max("key").alias("hi")).where(F.col("c.key") < F.col("hi"))
    both = marks.join(centre.select("band", F.col("c.key").alias("key2"), F.col("c.n").alias("n2"), F.col("c.sketch").alias("sketch2")), "band")
    return both.where((F.col("key") != F.col("key2")) & near_enough(threshold)).select(F.col("key2").alias("key"), F.col("key").alias("m")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id): documents in a chain of links with 100 * intersection >= percent * union.

    Equal texts take part once. Null texts and texts without words have no shingles and are linked with nothing, not
    even with one another. component_id is the smallest id reachable; null ids name none, and a row without an id that
    has no partner has none. Repeated rows stay repeated and are of one component. No rows give none.
    """
    spark, threshold = df.sparkSession, percent / 100
    small_batches(spark)
    base = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    ids, texts = written(base.select("id", "key"), "ids"), base.select("key", "text")
    signed = written(texts.mapInArrow(_sign(size), "key binary, n int, bands array<bigint>, sketch array<bigint>").dropDuplicates(["key"]), "signatures")
    # which bands hold several documents, on short hashes; most hold one and are not dealt again
    each = signed.select(F.xxhash64("key").alias("h"), F.explode("bands").alias("band"))
    full = written(each.groupBy("band").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("band"), "full")
    sent = spark.sparkContext.broadcast(build_filter(full, "band"))
    marks = written(signed.mapInArrow(_mark(sent), "band long, key binary, n int, sketch array<bigint>"), "bands")

    def verified(near: DataFrame) -> DataFrame:
        near = written(near, "candidates")
        listed = build_filter(near.select("key").union(near.select("m")).distinct(), "key")
        sets = map_listed(texts, listed, "key", _as_sets(size), "key binary, n int, sketch binary, s binary")
        sets = written(sets.dropDuplicates(["key"]), "sets")
        other = sets.select(F.col("key").alias("m"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"), F.col("s").alias("s2"))
        both = near.join(sets.select("key", "n", "sketch"), "key").join(other.select("m", "n2", "sketch2"), "m")
        left = written(both.select("key", "m", "n", "sketch", "n2", "sketch2").mapInArrow(_sieve(threshold), "key binary, m binary"), "sieved")
        both = left.join(sets.select("key", "s"), "key").join(other.select("m", "s2"), "m")
        found = written(both.select("key", "m", "s", "s2").mapInArrow(_alike(percent), "key binary, m binary"), "links")
        discard(near, sets, left)
        return found

    links = verified(star_links(marks, threshold))
    discard(full, marks)
    parts = written(connected_components(links, "key", "m"), "parts")
    posts = postings(texts, lambda t: shingle_set(t.encode(), size).view(np.int64), threshold)
    parts = joined_parts(posts, parts, threshold, verified)
    discard(links, posts)
    each = ids.groupBy("key").agg(F.min("id").alias("least")).join(signed.select("key", "n"), "key").join(parts, F.col("key") == F.col("node"), "left")
    each = written(each.select("key", "n", "least", F.coalesce("component", "key").alias("part")), "named")
    named = each.join(each.groupBy("part").agg(F.min("least").alias("component_id")), "part").select("key", "n", "component_id")
    out = ids.join(named, "key", "left")
    return out.select("id", F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n_shingles"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller id; columns and repeated rows as they were."""
    found = near_duplicates(docs, size=size, percent=percent).where("id <=> component_id").select(F.col("id").alias("__kept")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


def op11_minhash(spark, sf_dir):
    """Shingles and component of near copies of every document. Null and word-less texts have no shingles and are
    components of their own; repeated rows share a component; a row without an id is kept only where its component has
    no id; no documents give no rows."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS c FROM sides UNION SELECT doc_id, y FROM reach JOIN sides ON c = x)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r.c, doc_id) AS component_id, coalesce(r.c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY 1) r USING (doc_id)
"""
