"""Token ids in a compact file format: an adaptive context-mixing range coder in independent blocks.

For every id, an order-2 and an order-1 context each predict one id with a confidence. Whether a prediction holds is
coded as a binary decision whose probability mixes adaptive estimates of both contexts in the logistic domain; what none
predicts is coded under order-0 counts of the high and the low byte, which are summed up anew every few ids. All state is
integer and starts anew in each block, so a block can be read alone; its ids and its bytes are checksummed.

A task codes many blocks side by side: one numpy step handles one decision of all of them, and a block that has nothing to
decide codes a certainty, which takes no space. The coder keeps 48 bits and writes 16 at a time; carries are added to the
words already written and settled at the end.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import read, shared_dir, small_batches, with_range

BLOCK = 1024  # ids
LANES = 4096  # blocks that are coded together
SLOTS = 512  # of each context table
END = 2
MAGIC = b"TMR2"

_STRETCH = np.round(256 * np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096)))).astype(np.int32)
_SQUASH = np.clip(np.round(4096 / (1 + np.exp(-(np.arange(4096) - 2048) / 256))), 1, 4095).astype(np.int32)
_MASK, _LEAST = np.uint64((1 << 48) - 1), np.uint64(1 << 32)
_U16, _U32, _U48 = np.uint64(16), np.uint64(32), np.uint64(48)


class _Lanes:
    """Range coders side by side; without ``data`` they write, with it they read. All totals are powers of two."""

    def __init__(self, lanes: int, data: list[bytes] | None = None):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
        self.reading = data is not None
        width = max(map(len, data), default=0) // 2 + 4 if self.reading else 2 * BLOCK + 8
        self.words = np.zeros((lanes, width), np.uint32)
        self.row = np.arange(lanes, dtype=np.int64) * width
        self.at = self.row + (0 if self.reading else 1)  # the first word written takes the first carry
        if self.reading:
            for i, d in enumerate(data):
                self.words[i, : len(d) // 2] = np.frombuffer(d, ">u2")
            self.x = np.zeros(lanes, np.uint64)
            for _ in range(3):
                self.x = self.x << _U16 | self.words.ravel()[self.at]
                self.at += 1

    def target(self, bits: int) -> np.ndarray:
        """While reading: where in 0..2^bits - 1 the next symbol of each lane lies."""
        return np.minimum(self.x // (self.range >> np.uint64(bits)), np.uint64((1 << bits) - 1)).astype(np.int64)

    def take(self, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        """Narrow every lane to [start, start + size) of 2^bits and move a whole word on where one is settled."""
        r = self.range >> np.uint64(bits)
        off = start.astype(np.uint64) * r
        rng = size.astype(np.uint64) * r
        short = rng < _LEAST
        shift = short.astype(np.uint64) << np.uint64(4)
        flat = self.words.reshape(-1)
        if self.reading:
            self.x = self.x - off << shift | np.where(short, flat[self.at], 0).astype(np.uint64)
        else:
            low = self.low + off
            flat[self.at - 1] += (low >> _U48).astype(np.uint32)
            low &= _MASK
            flat[self.at] = low >> _U32  # overwritten unless it is settled
            self.low = low << shift & _MASK
        self.range = rng << shift
        self.at += short

    def finish(self) -> list[bytes]:
        ends = self.at - self.row
        # 48 bits of low remain; its carry was added, and no further symbol can add one
        flat = self.words.reshape(-1)
        for k in (32, 16, 0):
            flat[self.at] = self.low >> np.uint64(k) & np.uint64(0xFFFF)
            self.at += 1
        for k in range(int(ends.max(initial=1)) + 2, 0, -1):  # settle the carries from the right
            inside = k < ends + 3
            over = self.words[:, k] >> 16
            self.words[:, k] &= 0xFFFF
            self.words[:, k - 1] += np.where(inside, over, 0).astype(np.uint32)
        return [w[1 : n + 3].astype(">u2").tobytes() for w, n in zip(self.words, ends.tolist(), strict=True)]


class _Mixer:
    """A binary decision: two adaptive estimates mixed in the logistic domain, with weights of each lane's own."""

    def __init__(self, lanes: int, first: int, second: int):
        self.a, self.b = np.full(lanes * first, 32768, np.int32), np.full(lanes * second, 32768, np.int32)
        self.first, self.second = np.arange(lanes) * first, np.arange(lanes) * second
        self.u, self.v = np.full(lanes, 26000, np.int32), np.full(lanes, 26000, np.int32)

    def code(self, coder: _Lanes, on, x, y, bit):
        """Code ``bit`` where ``on``; elsewhere nothing is coded and False returned."""
        i, j = self.first + x, self.second + y
        one, two = self.a[i], self.b[j]
        sa, sb = _STRETCH[one >> 4], _STRETCH[two >> 4]
        p = _SQUASH[np.clip((self.u >> 4) * sa + (self.v >> 4) * sb >> 12, -2047, 2047) + 2048]
        bit = on & (coder.target(12) < p if coder.reading else bit)
        coder.take(np.where(on & ~bit, p, 0), np.where(on, np.where(bit, p, 4096 - p), 4096), 12)
        err = np.where(on, (bit.astype(np.int32) << 12) - p, 0)
        self.u = np.clip(self.u + (sa * err >> 11), -65536, 131072)
        self.v = np.clip(self.v + (sb * err >> 11), -65536, 131072)
        full = bit.astype(np.int32) * 65535
        self.a[i] = np.where(on, one + (full - one >> 4), one)
        self.b[j] = np.where(on, two + (full - two >> 4), two)
        return bit


class _Bytes:
    """A byte under adaptive order-0 counts, which are summed up at the steps that ``due`` names."""

    def __init__(self, lanes: int):
        self.n = np.ones((lanes, 256), np.int32)
        self.at = np.arange(lanes, dtype=np.int64)
        self.sum_up()

    @staticmethod
    def due(t: int) -> bool:
        return t % 64 == 0 or t in (8, 16, 32)

    def sum_up(self) -> None:
        ends = np.cumsum(self.n, axis=1, dtype=np.int64)
        cum = np.zeros((len(ends), 257), np.int32)
        cum[:, 1:] = ends * 65280 // ends[:, -1:] + np.arange(1, 257)  # every byte has one of the 65536 parts at least
        self.cum = cum.reshape(-1)

    def code(self, coder: _Lanes, on, value):
        base = self.at * 257
        if coder.reading:
            want, value = coder.target(16), np.zeros(len(base), np.int64)
            for step in (128, 64, 32, 16, 8, 4, 2, 1):
                value += np.where(self.cum[base + value + step] <= want, step, 0)
        lo = self.cum[base + value]
        coder.take(np.where(on, lo, 0), np.where(on, self.cum[base + value + 1] - lo, 65536), 16)
        self.n.reshape(-1)[self.at * 256 + value] += np.where(on, 24, 0).astype(np.int32)
        return value


def _code(coder: _Lanes, sizes: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
    """Run the model over all lanes; ``ids`` (longest, lanes) when writing. Returns the ids."""
    n = len(sizes)
    writing = ids is not None
    out = ids if writing else np.zeros((int(sizes.max(initial=0)), n), np.int32)
    # a slot holds a guessed id and how often it held, eight times the id plus the confidence
    tables = [np.zeros(n * SLOTS, np.int32) for _ in range(2)]
    lane = np.arange(n, dtype=np.int64) * SLOTS
    hit2, hit1, high, low = _Mixer(n, 8, 16), _Mixer(n, 8, 8), _Bytes(n), _Bytes(n)
    one, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
    none = np.zeros(n, bool)
    for t in range(int(sizes.max(initial=0))):
        if t and _Bytes.due(t):
            high.sum_up()
            low.sum_up()
        on = sizes > t
        s1 = lane + (one * 40503 >> 4 & SLOTS - 1)
        s2 = lane + ((one * 40503 + two * 60493 + 17) >> 3 & SLOTS - 1)
        x2, x1 = tables[1][s2], tables[0][s1]
        g2, g1, c2, c1 = x2 >> 3, x1 >> 3, x2 & 7, x1 & 7
        new = out[t] if writing else None
        m2 = on & (c2 > 0)
        b2 = hit2.code(coder, m2, c2, c1 * 2 + (g1 == g2), new == g2 if writing else none)
        m1 = on & ~b2 & (c1 > 0) & ((g1 != g2) | ~m2)
        b1 = hit1.code(coder, m1, c1, c2, new == g1 if writing else none)
        rest = on & ~b2 & ~b1
        top = high.code(coder, rest, new >> 8 if writing else None)
        end = low.code(coder, rest, new & 255 if writing else None)
        if not writing:
            new = out[t] = np.where(b2, g2, np.where(b1, g1, np.where(rest, top << 8 | end, 0)))
        for table, s, g, c in ((tables[1], s2, g2, c2), (tables[0], s1, g1, c1)):
            good = (g == new) & (c > 0)
            table[s] = np.where(good, np.where(c < 7, (g << 3) + c + 1, g << 3 | c), np.where(c <= 1, new << 3 | 1, (g << 3) + (c >> 1)))
        two, one = one, new.astype(np.int64)
    return out


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of at most BLOCK ids below 65,536 as bytes: magic, number, checksum of ids, payload, its checksum."""
    out = []
    for lo in range(0, len(blocks), LANES):
        some = blocks[lo : lo + LANES]
        sizes = np.array([len(b) for b in some])
        ids = np.zeros((int(sizes.max(initial=0)), len(some)), np.int32)
        for i, b in enumerate(some):
            if len(b) and (b.max() > 65535 or b.min() < 0):
                raise ValueError("ids must be 0 to 65535")
            ids[: len(b), i] = b
        coder = _Lanes(len(some))
        _code(coder, sizes, ids)
        for b, payload in zip(some, coder.finish(), strict=True):
            head = MAGIC + len(b).to_bytes(4, "little") + zlib.crc32(b.astype("<u4").tobytes()).to_bytes(4, "little")
            out.append(head + payload + zlib.crc32(head + payload).to_bytes(4, "little"))
    return out


def decode_blocks(data: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; damaged bytes or ids raise ValueError."""
    out = []
    for lo in range(0, len(data), LANES):
        some = data[lo : lo + LANES]
        for d in some:
            if d[:4] != MAGIC or zlib.crc32(d[:-4]) != int.from_bytes(d[-4:], "little"):
                raise ValueError("damaged block")
        sizes = np.array([int.from_bytes(d[4:8], "little") for d in some])
        ids = _code(_Lanes(len(some), [d[12:-4] for d in some]), sizes, None)
        each = np.ascontiguousarray(ids.T).astype("<u4")
        for d, row, n in zip(some, each, sizes.tolist(), strict=True):
            got = row[:n]
            if zlib.crc32(got.tobytes()) != int.from_bytes(d[8:12], "little"):
                raise ValueError("ids do not match their checksum")
            out.append(got)
    return out


class Words:
    """Ids of texts by the tokenizers library, which a worker asks once for each word that it still remembers.

    Byte-level vocabularies cut texts before merging. Texts of Latin letters, digits, white space and signs whose classes
    no version of Unicode doubts are cut here; all others, and those with a special token in them, go to the library whole.
    """

    def __init__(self, path: str, keep: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and spec["post_processor"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        self.special = [t["content"] for t in spec["added_tokens"]]
        space = r"\t\n\x0b\x0c\r \x85\xa0"
        # fixed values: the pattern by which byte-level vocabularies cut texts
        self.cut = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}]+|[{space}]+(?![^{space}])|[{space}]+") if plain else None
        self.odd = regex.compile("[^\\x00-\\x1b\\x20-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20c0]")
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.keep = keep

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens."""
        easy = [self.cut is not None and not self.odd.search(t) and not any(x in t for x in self.special) for t in texts]
        whole = iter(self._ask([t for t, e in zip(texts, easy, strict=True) if not e]))
        words = [self.cut.findall(t) if e else None for t, e in zip(texts, easy, strict=True)]
        if len(self.known) > self.keep:
            self.before, self.known = self.known, {}
        new = set().union(*[w for w in words if w]).difference(self.known)
        again = {w: self.before[w] for w in new if w in self.before}
        self.known |= again
        ask = list(new.difference(again))
        self.known.update(zip(ask, self._ask(ask), strict=True))
        return [np.frombuffer(next(whole) if w is None else b"".join(map(self.known.__getitem__, w)), "<u4") for w in words]


def _write_task(tokenizer: str):
    """(part, id, text), sorted -> rows of blocks. A row lists the documents that begin in its block."""

    def run(batches):
        tok = Words(tokenizer)
        part, first, held, docs, size = None, 0, [], [], 0
        ready: list = []  # finished blocks, of any part, that wait to be coded together

        def cut(last: bool) -> None:
            nonlocal first, held, docs, size
            if not size:
                return
            ids = np.concatenate(held)
            full, at = len(ids) if last else len(ids) // BLOCK * BLOCK, 0
            for k in range(0, full, BLOCK):
                b, mine = ids[k : min(k + BLOCK, full)], []
                while at < len(docs) and docs[at][1] < first + k + len(b):
                    mine.append(docs[at])
                    at += 1
                ready.append((part, first + k, len(b), *([d[j] for d in mine] for j in range(3)), b))
            first, held, docs, size = first + full, [ids[full:]], docs[at:], len(ids) - full

        def coded(most: int):
            while len(ready) > most:
                some = ready[:LANES]
                del ready[:LANES]
                data = encode_blocks([r[6] for r in some])
                cols = [*zip(*(r[:6] for r in some), strict=True), data]
                kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "first", "n", "docs", "starts", "sizes", "data"])

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for lo in range(0, len(rows), 256):
                some = rows[lo : lo + 256]
                for (p, i, _), ids in zip(some, tok.encode([t for _, _, t in some]), strict=True):
                    if p != part:
                        cut(True)
                        part, first, held, docs, size = p, 0, [], [], 0
                    ids = np.append(ids, np.uint32(END)).astype(np.int32)
                    docs.append((i, first + size, len(ids)))
                    held.append(ids)
                    size += len(ids)
                    if size >= 64 * BLOCK:
                        cut(False)
                yield from coded(LANES - 1)
        cut(True)
        yield from coded(0)

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty), append END to each, and write blocks in ascending id order.

    Parts are ranges of ids, null ids last; rows of one id are ordered by text. Each part starts a block of its own.
    """
    rows, _ = with_range(docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")), "id", "part")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("part", "id", "text").repartition(parts, "part").sortWithinPartitions("part", F.col("id").asc_nulls_last(), "text")
    small_batches(docs.sparkSession)
    blocks = dealt.mapInArrow(_write_task(tokenizer), "part int, first long, n int, docs array<bigint>, starts array<bigint>, sizes array<bigint>, data binary")
    blocks.write.option("compression", "none").parquet(path)


def _read_task(batches):
    """Blocks sorted by part and place -> (part, doc_id, first, n_tokens, ids_crc32)."""
    todo: list = []  # [part, doc, start, size, crc, ids still to come]
    for batch in batches:
        rows, done = batch.to_pylist(), []
        for lo in range(0, len(rows), LANES):
            some = rows[lo : lo + LANES]
            for r, ids in zip(some, decode_blocks([r["data"] for r in some]), strict=True):
                todo += [[r["part"], d, s, n, 0, n] for d, s, n in zip(r["docs"], r["starts"], r["sizes"], strict=True)]
                at, k = 0, 0
                while at < len(ids) and k < len(todo):
                    x = todo[k]
                    take = min(x[5], len(ids) - at)
                    x[4], x[5], at = zlib.crc32(ids[at : at + take].tobytes(), x[4]), x[5] - take, at + take
                    k += x[5] == 0
                done += [x[:5] for x in todo[:k]]
                del todo[:k]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), [pa.int32(), *[pa.int64()] * 4], strict=True)], ["part", "doc_id", "first", "n_tokens", "ids_crc32"])


def read_index(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, every id being decoded and every checksum verified."""
    blocks = spark.read.parquet(path)
    sizes = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row a range
    base, total = [], 0
    for p, n in sizes:
        base.append((p, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(parts, "part").sortWithinPartitions("part", "first")
    docs = dealt.mapInArrow(_read_task, "part int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op9_range_coder(spark, sf_dir):
    """Place, number and checksum of every document's ids, as read back from the files. Null texts have only the end id;
    rows of one id are in order of text; rows without an id come last; no rows give none."""
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_index(spark, path)
