"""Ranked lexical search by bit-sliced Bloom signatures.

Every document sets bits in a signature: for each of its terms, and again for terms that it holds at least twice and at
least four times (TIERS), HASHES bits each. Documents of similar numbers of terms are laid side by side in blocks, and a block is
stored by bit: a row of it has a bit for each document. The rows of a term's bits, anded, are a bitmap of the documents
that hold the term, with some that don't: presence is overestimated, never underestimated. For an item the weights of its
terms, summed over these bitmaps tier by tier, bound the score of each document from above.

A search first rescores the documents with the highest bounds of each item. The 20th best of their exact scores is a
threshold; every document whose bound reaches it is then rescored exactly from its text, so that only documents that
provably lack a place are left out. Items are taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bloom import build_filter, might_hold
from tidemark.llm.common import discard, read, small_batches, written
from tidemark.llm.words import WordHashes

TIERS = (1, 2, 4)
HASHES = 2
BITS_PER_ENTRY = 8
BLOCK, BLOCK_BYTES = 1024, 1 << 21  # documents of a block at most, and bytes of its rows
FIRST = 40  # documents an item rescored for the threshold
ITEM_TERMS = 200_000  # terms, repeats included, of a block of items
#: Bytes that stay in terms, A-Z as a-z; all others are spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_hashes = WordHashes(12)


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERMS).split()


def counted(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for w in words:
        out[w] = out.get(w, 0) + 1
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def share(tf, m):
    """What w is multiplied by; grows with tf."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _size_class(entries: int) -> int:
    """Bits of the signature of a document: BITS_PER_ENTRY for each entry, rounded up to a power of two."""
    return max(64, 1 << (BITS_PER_ENTRY * entries - 1).bit_length())


def _bits(h: np.ndarray, tier: int, n_bits: int) -> np.ndarray:
    """(len(h), HASHES) bit numbers of terms by their hashes in a tier."""
    x = (h + np.uint64(tier)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return np.stack([(x >> np.uint64(20 * i)) % np.uint64(n_bits) for i in range(HASHES)], axis=1).astype(np.int64)


class _Blocks:
    """Documents of one signature size, gathered until a block is full."""

    def __init__(self, n_bits: int):
        self.n_bits, self.most = n_bits, max(8, min(BLOCK, BLOCK_BYTES * 8 // n_bits) // 8 * 8)
        self.docs, self.at, self.cols = [], [], []

    def add(self, doc_id, n: int, top: int, bits: np.ndarray) -> None:
        self.at.append(bits)
        self.cols.append(np.full(len(bits), len(self.docs)))
        self.docs.append((doc_id, n, top))

    def taken(self) -> tuple:
        rows = np.zeros((self.n_bits, -(-len(self.docs) // 8) * 8), np.uint8)
        rows[np.concatenate(self.at), np.concatenate(self.cols)] = 1
        out = (self.n_bits, *zip(*self.docs, strict=True), np.packbits(rows, axis=1).tobytes())
        self.docs, self.at, self.cols = [], [], []
        return out


INDEX = "n_bits int, ids array<bigint>, n array<bigint>, top array<bigint>, rows binary"
_KINDS = pa.schema([("n_bits", pa.int32()), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("top", pa.list_(pa.int64())), ("rows", pa.binary())])


def _index(batches):
    """(id, text) -> blocks; documents without a term are in none."""
    open_blocks: dict[int, _Blocks] = {}

    def out(b: _Blocks):
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(b.taken(), _KINDS, strict=True)], schema=_KINDS)

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            words = terms(t)
            if not words:
                continue
            held = counted(words)
            h, tf = _hashes.of(list(held)), np.fromiter(held.values(), np.int64, len(held))
            tiers = [h[tf >= k] for k in TIERS]
            n_bits = _size_class(sum(map(len, tiers)))
            bits = np.unique(np.concatenate([_bits(x, k, n_bits).ravel() for x, k in zip(tiers, TIERS, strict=True)]))
            block = open_blocks.setdefault(n_bits, _Blocks(n_bits))
            block.add(i, len(words), int(tf.max()), bits)
            if len(block.docs) == block.most:
                yield out(block)
    for block in open_blocks.values():
        if block.docs:
            yield out(block)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of bit-sliced signatures of all documents that have a term, one pass and no shuffle."""
    small_batches(docs.sparkSession)
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).mapInArrow(_index, INDEX)


class _Queries:
    """A block of items as sent to tasks: names, and for each its terms with what w times repeats comes to."""

    def __init__(self, names: list, words: list[dict[bytes, int]], weights: dict[bytes, int], n_docs: int, n_terms: int):
        self.names, self.n_docs, self.n_terms = names, n_docs, n_terms
        self.index = {t: i for i, t in enumerate(weights)}
        self.w = np.array(list(weights.values()), np.int64)
        self.terms = [np.array([self.index[t] for t in q], np.int64) for q in words]
        self.sums = [np.array([weights[t] * k for t, k in q.items()], np.int64) for q in words]
        self.hash = _hashes.of(list(weights))

    def length(self, n):
        return 100 - 25 + 25 * n * self.n_docs // self.n_terms

    def bounds(self, n_bits: int, n: np.ndarray, top: np.ndarray, rows: bytes):
        """For each item the upper bound of the score of each document of a block."""
        table = np.frombuffer(rows, np.uint8).reshape(n_bits, -1)
        m = self.length(n)
        upto = [share(np.minimum(top, k - 1), m) for k in TIERS[1:]] + [share(top, m)]
        steps = [upto[0], *[b - a for a, b in zip(upto, upto[1:], strict=False)]]
        held = []
        for k in TIERS:
            at = _bits(self.hash, k, n_bits)
            bits = table[at[:, 0]]
            for i in range(1, HASHES):
                bits = bits & table[at[:, i]]
            held.append(bits)
        for t, s in zip(self.terms, self.sums, strict=True):
            total = np.zeros(len(n), np.int64)
            for bits, step in zip(held, steps, strict=True):
                present = np.unpackbits(bits[t], axis=1, count=len(n))
                total += (s.astype(np.float64) @ present).astype(np.int64) * step  # whole numbers below 2^53
            yield total

    def score(self, held: dict[bytes, int], n: int, item: int) -> int:
        m = int(self.length(n))
        total = 0
        for t, s in zip(self.terms[item].tolist(), self.sums[item].tolist(), strict=True):
            if tf := held.get(t):
                total += s * share(tf, m)
        return total


def _statistics(wanted):
    """(text) -> (term, df) partial sums; term -1 counts documents with a term, -2 all terms."""

    def run(batches):
        listed = wanted.value
        df, n_docs, n_terms = np.zeros(len(listed), np.int64), 0, 0
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                if words := terms(t):
                    n_docs, n_terms = n_docs + 1, n_terms + len(words)
                    for w in listed.keys() & set(words):
                        df[listed[w]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n_docs, n_terms]))], ["term", "k"])

    return run


def _rescore(sent):
    """(id, text, items) -> (item, id, score) with score above 0."""

    def run(batches):
        q: _Queries = sent.value
        for b in batches:
            out: list[tuple] = []
            for i, t, items in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = terms(t)
                held = {q.index[w]: k for w, k in counted(words).items() if w in q.index}
                out += [(j, i, s) for j in items if held and (s := q.score(held, len(words), j))]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "id", "score"])

    return run


def _candidates(sent, least: dict[int, int] | None):
    """Blocks -> (item, id, bound): without thresholds each item's FIRST best of a block, else all that reach them."""

    def run(batches):
        q: _Queries = sent.value
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for n_bits, ids, n, top, rows in zip(*cols, strict=True):
                items, at, bound = [], [], []
                for j, total in enumerate(q.bounds(n_bits, np.array(n, np.int64), np.array(top, np.int64), rows)):
                    if least is None:
                        best = np.argpartition(-total, FIRST)[:FIRST] if len(total) > FIRST else np.arange(len(total))
                        best = best[total[best] > 0]
                    else:
                        best = np.flatnonzero(total >= max(1, least.get(j, 1)))
                    items.append(np.full(len(best), j, np.int32))
                    at.append(best)
                    bound.append(total[best])
                at = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), pa.array(ids, pa.int64()).take(at), pa.array(np.concatenate(bound))], ["item", "id", "bound"])

    return run


def _best(df: DataFrame, by: str, k: int) -> DataFrame:
    """Each item's first k rows by ``by`` descending and id; limits are applied before the shuffle too."""
    order = Window.partitionBy("item").orderBy(F.desc(by), F.col("id").asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item, rank, id, score): each item's k documents with the highest scores above 0, equal ones by ascending id.

    Items are the query set; each of their rows is a query of its own. Null and term-less texts are in no statistic and
    rank nowhere. Rows without an id rank after all ids of the same score, in no order of their own; repeated rows rank
    each. No documents or no items give no rows.
    """
    spark = docs.sparkSession
    base = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    index = written(build_index(base, "id", "text"), "signatures")
    kind = items.schema[item_col].dataType.simpleString()
    out = []
    block, size = [], 0
    for r in items.select(item_col, F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():  # the query set, a block at a time
        words = terms(r[1].encode())
        if block and size + len(words) > ITEM_TERMS:
            out.append(_block(spark, base, index, block, k))
            block, size = [], 0
        block.append((r[0], counted(words)))
        size += len(words)
    if block:
        out.append(_block(spark, base, index, block, k))
    discard(index)
    found = [(f, names) for f, names in out if f is not None]
    result = None
    for f, names in found:
        named = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"item int, name {kind}"))  # of at most ITEM_TERMS items
        f = f.join(named, "item").select(F.col("name").alias("item"), "rank", "id", "score")
        result = f if result is None else result.unionByName(f)
    return spark.createDataFrame([], f"item {kind}, rank int, id long, score long") if result is None else result


def _block(spark, base: DataFrame, index: DataFrame, block: list[tuple], k: int):
    names, words = [b[0] for b in block], [b[1] for b in block]
    listed = {t: i for i, t in enumerate(dict.fromkeys(t for q in words for t in q))}
    if not listed:
        return None, names
    wanted = spark.sparkContext.broadcast(listed)
    sums = base.select("text").mapInArrow(_statistics(wanted), "term long, k long").groupBy("term").agg(F.sum("k").alias("k"))
    sums = {r["term"]: r["k"] for r in sums.collect()}  # one row a term of the items, at most ITEM_TERMS
    n_docs, n_terms = sums.get(-1, 0), sums.get(-2, 0)
    if not n_docs:
        return None, names
    sent = spark.sparkContext.broadcast(_Queries(names, words, {t: weight(n_docs, sums.get(i, 0)) for t, i in listed.items()}, n_docs, n_terms))

    def exact(near: DataFrame) -> DataFrame:
        of = near.groupBy("id").agg(F.collect_set("item").alias("items"))  # items of this block only
        some = base.where(F.col("id").isNull() | might_hold(spark, build_filter(of.where("id is not null"), "id"), "id"))
        some = some.withColumn("__id", F.col("id")).join(of.withColumnRenamed("id", "__of"), F.col("__id").eqNullSafe(F.col("__of")))
        return some.select("id", "text", "items").mapInArrow(_rescore(sent), "item int, id long, score long")

    likely = written(_best(index.mapInArrow(_candidates(sent, None), "item int, id long, bound long"), "bound", FIRST).select("item", "id"), "likely")
    first = _best(exact(likely), "score", k)
    least = {r["item"]: r["s"] for r in first.groupBy("item").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") == k).collect()}
    near = written(index.mapInArrow(_candidates(sent, least), "item int, id long, bound long").select("item", "id").distinct(), "not-excluded")
    found = written(_best(exact(near), "score", k).select("item", "rank", "id", "score"), "ranked")
    discard(likely, near)
    return found, names


def op12_lexical_search(spark, sf_dir):
    """The 20 best documents of every benchmark item. Null texts have no terms; repeated rows rank each; rows without an
    id come last among equal scores; an item without terms, no items or no documents give no rows."""
    found = search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(DISTINCT doc_id) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, n_docs),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN df USING (t), total GROUP BY 1, 2),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
