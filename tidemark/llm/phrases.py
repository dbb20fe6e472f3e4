"""Phrase collocation mining with Rabin-Karp fingerprints.

Words are counted first. A longer phrase can only be frequent if all its words and all its pairs of words are, so that
the second pass hashes pairs of frequent words, and the third phrases of three to five words whose pairs are frequent;
"frequent" is asked of a Bloom filter of bounded size, whose errors only cost work. In a pass numpy builds prefix
polynomials of the word hashes of many texts at once, from which the fingerprint of every run of words is a difference
and a product. A task sums equal fingerprints before the shuffle, which in these passes carries them and their counts
alone. The last pass meets the fingerprints that were frequent once more, now with a pointer to one occurrence (hash of
the text and position) and with 64 bits of an independent polynomial over independent word hashes; rows are summed by
both, so that phrases that collide in one are told apart and counted apart. Only of frequent phrases is the text cut out
where the pointer leads, and both hashes are verified against it. Scores are then joined by the phrases themselves.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bloom import build_filter, holds, might_hold
from tidemark.llm.common import discard, read, small_batches, written
from tidemark.llm.words import WordHashes, prefix_polynomials, run_hashes

LONGEST = 5
GROUP_WORDS = 1 << 18  # words of the texts that are hashed at once
HELD = 1 << 20  # fingerprints a task sums up before it sends them
HELD_WORDS = 1 << 18  # and words
CACHED = 1 << 16  # word hashes that a worker remembers, for each language and kind
#: A-Z as a-z, tabs as spaces, and the signs between pieces as a byte that UTF-8 never has.
_CUT = b"\xff"
_SIGNS = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))
_known: dict[tuple[str, int], WordHashes] = {}


def pieces_and_words(text: bytes) -> list[bytes]:
    """Words in order, with ``_CUT`` between pieces."""
    return text.translate(_SIGNS).replace(_CUT, b" \xff ").split()


def _seed(lang: str, which: int) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(lang.encode(), 42 + which)  # what Spark's xxhash64(lang, word) goes on from, if ``which`` is 0


def _hashes(lang: str, which: int) -> WordHashes:
    if len(_known) > 64:
        _known.clear()
    return _known.setdefault((lang, which), WordHashes(_seed(lang, which), CACHED))


def _texts(b):
    """(lang, text as bytes) of a batch whose first columns are lang and text."""
    return zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True)


def _count_words(batches):
    """(lang, text) -> (lang, word, f), summed in the task."""
    held: dict[str, Counter] = defaultdict(Counter)

    def out():
        for lang, counts in held.items():
            counts.pop(_CUT, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "f"])
        held.clear()

    for b in batches:
        for lang, t in _texts(b):
            held[lang].update(pieces_and_words(t))
        if sum(map(len, held.values())) >= HELD_WORDS:
            yield from out()
    yield from out()


class _Group:
    """The words of some texts as hashes, side by side: h, and with ``second`` the independent ones in g; the piece and
    the text of each word."""

    def __init__(self, texts: list[tuple], second: bool):
        h = [_hashes(lang, 0).of(w) for lang, w, *_ in texts]
        cut = np.concatenate([np.append(x == _hashes(lang, 0)[_CUT], True) for x, (lang, *_) in zip(h, texts, strict=True)])  # a text ends its last piece
        keep = np.flatnonzero(~cut)
        flat = lambda parts: np.concatenate([np.append(x, np.uint64(0)) for x in parts])[keep]
        self.h = flat(h)
        self.g = flat([_hashes(lang, 1).of(w) for lang, w, *_ in texts]) if second else None
        self.piece = np.cumsum(cut)[keep]
        self.text = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in h])[keep]
        self.first = np.searchsorted(self.text, np.arange(len(texts)))
        self.polynomials = [prefix_polynomials(x, i) for i, x in enumerate((self.h, self.g)) if x is not None]

    def inside(self) -> np.ndarray:
        """For each word but the last whether the next one is of its piece."""
        return self.piece[1:] == self.piece[:-1]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and fingerprints of pairs of words within a piece."""
        at = np.flatnonzero(self.inside())
        return at, self.fingerprints(at, 2)

    def fingerprints(self, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        return run_hashes(self.polynomials[which], at, n, which)

    def runs(self, n: int, follow: np.ndarray) -> np.ndarray:
        """Positions of runs of n words each of which may be followed by the next."""
        chain = np.append(0, np.cumsum(follow))
        return np.flatnonzero(chain[n - 1 :] - chain[: max(0, len(chain) - n + 1)] == n - 1)

    def following(self, table: np.ndarray) -> np.ndarray:
        """For each word but the last whether it and the next are a pair that the filter may hold."""
        out = np.zeros(max(0, len(self.h) - 1), bool)
        at, fp = self.pairs()
        out[at] = holds(table, fp.view(np.int64))
        return out


def _groups(batches, second: bool):
    """Groups of about GROUP_WORDS words of (lang, text, ...) rows, with the last column of each row."""
    group, size = [], 0
    for b in batches:
        for (lang, t), k in zip(_texts(b), b.column(b.num_columns - 1).to_pylist(), strict=True):
            w = pieces_and_words(t)
            group.append((lang, w, k))
            size += len(w)
            if size >= GROUP_WORDS:
                yield _Group(group, second), [x[2] for x in group]
                group, size = [], 0
    if group:
        yield _Group(group, second), [x[2] for x in group]


def _sums(fp: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(fp)
    fp = fp[order]
    first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
    return fp[first], np.add.reduceat(f[order], first)


def _counts(sent, lengths: tuple[int, ...]):
    """(lang, text) -> (fp, f). The filter holds frequent words if ``lengths`` are (2,), else frequent pairs."""

    def run(batches):
        table, held, size = sent.value, [], 0

        def out():
            fp, f = _sums(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(f)], ["fp", "f"])

        for group, _ in _groups(batches, False):
            if lengths == (2,):
                known, of = np.unique(group.h, return_inverse=True)
                ok = holds(table, known.view(np.int64))[of] if len(known) else np.zeros(0, bool)
                follow = group.inside() & ok[1:] & ok[:-1]
            else:
                follow = group.following(table)
            fp = np.concatenate([group.fingerprints(group.runs(n, follow), n) for n in lengths])
            if len(fp):
                held.append(_sums(fp, np.ones(len(fp), np.int64)))
                size += len(held[-1][0])
            if size >= HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


FOUND = "fp long, alt long, n byte, f long, k long, pos int"


def _pointed(pairs, listed):
    """(lang, text, k) -> FOUND rows of the phrases that the filter ``listed`` may hold; ``pairs`` is that of pairs."""

    def run(batches):
        held, size = [], 0

        def out():
            fp, alt, n, k, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((alt, fp))
            fp, alt = fp[order], alt[order]
            first = np.flatnonzero(np.append(True, (fp[1:] != fp[:-1]) | (alt[1:] != alt[:-1])))
            at, f = order[first], np.diff(np.append(first, len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[first].view(np.int64), alt[first].view(np.int64), n[at], f.astype(np.int64), k[at], pos[at])], ["fp", "alt", "n", "f", "k", "pos"])

        for group, keys in _groups(batches, True):
            keys, follow = np.array(keys, np.int64), group.following(pairs.value)
            for n in range(2, LONGEST + 1):
                at = group.runs(n, follow)
                fp = group.fingerprints(at, n)
                ok = holds(listed.value, fp.view(np.int64))
                at, fp = at[ok], fp[ok]
                of = group.text[at]
                if len(at):
                    held.append((fp, group.fingerprints(at, n, 1), np.full(len(at), n, np.int8), keys[of], (at - group.first[of]).astype(np.int32)))
                    size += len(at)
            if size >= HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def _materialise(batches):
    """(lang, text, pointers) -> (lang, phrase, n, f) where the words at a pointer have its hashes."""
    at = np.zeros(1, np.int64)
    for b in batches:
        out: list[tuple] = []
        for (lang, t), pointers in zip(_texts(b), b.column(2).to_pylist(), strict=True):
            words = [w for w in pieces_and_words(t) if w != _CUT]
            for p in pointers:
                w = words[p["pos"] : p["pos"] + p["n"]]
                same = all(int(run_hashes(prefix_polynomials(_hashes(lang, i).of(w), i), at, len(w), i).view(np.int64)[0]) == p[c] for i, c in enumerate(("fp", "alt"))) if len(w) == p["n"] else False
                if same:
                    out.append((lang, b" ".join(w), p["n"], p["f"]))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.binary(), pa.int8(), pa.int64())
        cols = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([cols[0], cols[1].cast(pa.string()), *cols[2:]], ["lang", "phrase", "n", "f"])


def frequent_phrases(docs: DataFrame, least: int = 100, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, words), and (lang, phrase, n, f) of every phrase of 1 to LONGEST words that occurs ``least`` times or more,
    both written."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    counts = written(base.mapInArrow(_count_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")), "word-counts")
    totals = written(counts.groupBy("lang").agg(F.sum("f").alias("words")), "totals")
    words = written(counts.where(F.col("f") >= least), "words")
    discard(counts)
    keyed = base.select("lang", "text", F.xxhash64("lang", "text").alias("k"))

    def mined(filter_of: DataFrame, col: str, lengths: tuple[int, ...]):
        sent = spark.sparkContext.broadcast(build_filter(filter_of, col))
        found = base.mapInArrow(_counts(sent, lengths), "fp long, f long").groupBy("fp").agg(F.sum("f").alias("f"))
        return sent, written(found.where(F.col("f") >= least).select("fp"), "fingerprints")

    _, pairs = mined(words.select(F.xxhash64("lang", "word").alias("h")), "h", (2,))
    sent, longer = mined(pairs, "fp", tuple(range(3, LONGEST + 1)))
    listed = spark.sparkContext.broadcast(build_filter(pairs.union(longer), "fp"))
    both = keyed.mapInArrow(_pointed(sent, listed), FOUND).groupBy("fp", "alt", "n").agg(F.sum("f").alias("f"), F.min("k").alias("k"), F.min_by("pos", "k").alias("pos"))
    both = written(both.where(F.col("f") >= least), "phrases")
    pointers = written(both.groupBy("k").agg(F.collect_list(F.struct("fp", "alt", "n", "f", "pos")).alias("pointers")), "pointers")  # a text's own phrases
    listed = build_filter(pointers, "k")
    some = keyed.where(might_hold(spark, listed, "k")).groupBy("k", F.md5("text")).agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    cut = some.join(pointers, "k").select("lang", "text", "pointers").mapInArrow(_materialise, "lang string, phrase string, n byte, f long").dropDuplicates(["lang", "phrase"])
    out = written(words.select("lang", F.col("word").alias("phrase"), F.lit(1).cast("byte").alias("n"), "f").unionByName(cut), "frequent")
    n, m = out.where(F.col("n") > 1).count(), both.count()
    if n != m:
        raise RuntimeError(f"{m - n} phrases were not found where their pointers lead")
    discard(words, pairs, longer, both, pointers)
    return totals, out


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of 2 to LONGEST words of each language.

    Null texts are empty, and texts without words count nothing; a null language is ``und``. Repeated rows count each
    time. No rows give none.
    """
    totals, found = frequent_phrases(docs, least, text_col, lang_col)
    cand = found.where(F.col("n") > 1).select("lang", "phrase", F.col("f").alias("a"), F.col("n").cast("int").alias("m"), F.split("phrase", " ").alias("w"))
    cuts = cand.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", whole("a") * whole("words") * F.lit(1000).cast("decimal(4,0)"), whole("l") * whole("r"))
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", F.col("words").alias("n"))).alias("x")).select("lang", "phrase", "x.*")
    inner = cand.where(F.col("m") > 2).select("lang", "a", "m", "w", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("k"))
    inner = inner.select("lang", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("k") + 1)).alias("i"))
    inside = inner.select("lang", part(F.col("i"), F.col("k")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir):
    """Each language's 2000 best collocations. Null texts are empty and a null language is ``und``; repeated rows count
    each time; no rows give none."""
    return collocations(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m))),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, k, a, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lp JOIN f r ON r.lang = cuts.lang AND r.phrase = rp JOIN total ON total.lang = cuts.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM c)) GROUP BY ALL),
kept AS (SELECT * FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR longer < a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept) WHERE rank <= 2000
"""
