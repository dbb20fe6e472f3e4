"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Text is escaped (a dummy leading mark, spaces to marks) and cut where no merge can cross: before a run of marks if no
piece has a mark inside, and around characters that occur in no longer piece. Each segment is merged by a score-ordered
agenda of adjacent symbol pairs: short segments side by side, their agendas being rows of one matrix, long ones with a
heap. Segments recur, so a worker keeps the ids of those it met last, up to a stated number; every newly met segment is
checked against the sentencepiece library, batch by batch.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import read, small_batches

MARK = "▁"
KEEP = 300_000  # segments after which a worker starts a new generation; it remembers this one and the one before
WIDE = 24  # characters of segments that are merged side by side; longer ones have a heap of their own
OWN = 1 << 18  # a character that is no piece is the symbol OWN + its code point
CUT = "\x01"
NEVER = np.int32((1 << 31) - 1)
GROUP_CHARS = 1 << 19  # characters of the texts that are cut at once, or one text


class Pieces:
    """A merge-type model: identity normalisation, dummy prefix, byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with identity normalisation, dummy prefix and byte fallback")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == 1]
        self.ids = {p.piece: i for i, p in normal}
        self.score = {p.piece: -p.score for _, p in normal}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.bytes = [p.piece.replace(MARK, " ").encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b" \xe2\x81\x87 " if p.type == 2 else b"" for p in model.pieces]
        long = [p.piece for _, p in normal if len(p.piece) > 1]
        if any("\n" in p for p in self.ids):
            raise ValueError("a piece holds a new line")
        inside = any(MARK in p[1:] and p.strip(MARK) for p in long)
        used = set("".join(long))
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in used)
        lone = f"[{alone}]|" if alone else ""
        self.cut = re.compile("(?s).+" if inside else f"{lone}{MARK}*[^{MARK}{alone}]+|{MARK}+")
        self.plain = not inside and alone.startswith("\\\n")  # then spaces and new lines can be cut by plain replacement
        self.odd = re.compile(f"[{MARK}{CUT}{alone[2:]}]")
        self.pairs = self._pairs()
        self.first = np.arange(OWN, OWN + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.first[ord(p)] = i
        self.spelling = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.spell_size = np.array([len(b) for b in self.bytes])
        self.spell_at = np.cumsum(self.spell_size) - self.spell_size
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment: always the pair of best score, the leftmost of equals, until none is in the vocabulary."""
        sym: list[str | None] = list(segment)
        n, score = len(sym), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(score[p], i, p) for i, p in enumerate(map("".join, zip(segment, segment[1:], strict=False))) if p in score]
        heapq.heapify(agenda)
        while agenda:
            _, i, p = heapq.heappop(agenda)
            j = after[i]
            if sym[i] is None or j >= n or sym[i] + sym[j] != p:
                continue
            sym[i], sym[j] = p, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := p + sym[k]) in score:
                    heapq.heappush(agenda, (score[q], i, q))
            if (h := before[i]) >= 0 and (q := sym[h] + p) in score:
                heapq.heappush(agenda, (score[q], h, q))
        out = []
        for s in sym:
            if s is not None:
                if s in self.ids:
                    out.append(self.ids[s])
                else:
                    out += [self.byte[b] for b in s.encode()]
        return out

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted keys, places by score, symbols made) of all pairs of symbols that make a piece; a symbol is an id or OWN + character."""
        symbol = lambda s: self.ids.get(s, OWN + ord(s) if len(s) == 1 else None)
        rows = []
        for piece, made in self.ids.items():
            for i in range(1, len(piece)):
                a, b = symbol(piece[:i]), symbol(piece[i:])
                if a is not None and b is not None:
                    rows.append((a << 21 | b, self.score[piece], made))
        rows.sort()
        keys, scores, made = zip(*rows, strict=True)
        return np.array(keys, np.int64), np.unique(scores, return_inverse=True)[1].astype(np.int32), np.array(made, np.int32)

    def _scored(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place by score and symbol of each pair; a pair that makes no piece is at NEVER."""
        keys, scores, made = self.pairs
        key = a.astype(np.int64) << 21 | b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, scores[at], NEVER), made[at]

    def merge_many(self, segments: list[str]) -> list[bytes]:
        """Little-endian ids of segments of at most WIDE characters; one step merges the best pair of each of them.

        A row of the agenda has the scores of a segment's adjacent pairs; the smallest entry, leftmost of equals, is next.
        """
        n = len(segments)
        sizes = np.array([len(s) for s in segments])
        sym = np.full((n, int(sizes.max(initial=1)) + 1), -1, np.int32)
        sym[np.arange(sym.shape[1]) < sizes[:, None]] = self.first[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        agenda = np.full((n, sym.shape[1] - 1), NEVER)
        at = np.nonzero(sym[:, 1:] >= 0)
        agenda[at] = self._scored(sym[:, :-1][at], sym[:, 1:][at])[0]
        live = np.arange(n)
        column = np.arange(sym.shape[1])
        while len(live):
            best = agenda[live].argmin(axis=1)
            on = agenda[live, best] < NEVER
            live, best = live[on], best[on]
            if not len(live):
                break
            s, g = sym[live], agenda[live]
            k = np.arange(len(live))
            s[k, best] = self._scored(s[k, best], s[k, best + 1])[1]
            s = np.take_along_axis(s, np.minimum(column + (column > best[:, None]), s.shape[1] - 1), axis=1)
            s[:, -1] = -1
            g = np.take_along_axis(g, np.minimum(column[:-1] + (column[:-1] > best[:, None]), g.shape[1] - 1), axis=1)
            g[:, -1] = NEVER
            right = np.where(s[k, best + 1] >= 0, self._scored(s[k, best], s[k, best + 1])[0], NEVER)
            g[k, best] = right
            k = np.flatnonzero(best > 0)
            g[k, best[k] - 1] = self._scored(s[k, best[k] - 1], s[k, best[k]])[0]
            sym[live], agenda[live] = s, g
        here = sym >= 0
        flat, ends = sym[here], np.cumsum(here.sum(axis=1))
        raw = flat.astype("<u4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for i in np.flatnonzero((sym >= OWN).any(axis=1)).tolist():  # characters without a piece become their bytes
            ids: list[int] = []
            for x in np.frombuffer(out[i], "<u4").tolist():
                ids += [x] if x < OWN else [self.byte[b] for b in chr(x - OWN).encode()]
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def learn(self, segments) -> None:
        """Merge segments not met before and hold each against the library's answer."""
        new = sorted(segments, key=len)
        short = [s for s in new if len(s) <= WIDE]
        ours = []
        for lo in range(0, len(short), 4096):
            ours += self.merge_many(short[lo : lo + 4096])
        ours += [np.array(self.merge(s), "<u4").tobytes() for s in new[len(short) :]]
        # the library puts one mark in front; other segments follow a new line, which no piece holds
        plain = [s[0] == MARK and s[1:2] not in ("", MARK) for s in new]
        theirs = self.library.encode([(s[1:] if p else "\n" + s).replace(MARK, " ") for s, p in zip(new, plain, strict=True)], num_threads=1)
        lead = len(self.library.encode("\n"))
        told = [b if p else b[lead:] for b, p in zip(theirs, plain, strict=True)]
        sizes = [len(b) for b in told]
        if [len(a) // 4 for a in ours] != sizes or b"".join(ours) != np.fromiter(chain.from_iterable(told), "<u4", sum(sizes)).tobytes():
            for s, a, b in zip(new, ours, told, strict=True):
                if np.frombuffer(a, "<u4").tolist() != b:
                    raise RuntimeError(f"segment {s!r}: {np.frombuffer(a, '<u4').tolist()}, but the library has {b}")
        self.known.update(zip(new, ours, strict=True))

    def segments(self, text: str) -> list[str]:
        """The text cut where no merge can cross; empty segments are of no account."""
        if not text:
            return []
        if self.plain and "  " not in text and not text.startswith(" ") and not self.odd.search(text):
            return (MARK + text.replace(" ", CUT + MARK).replace("\n", CUT + "\n" + CUT)).split(CUT)
        return self.cut.findall(MARK + text.replace(" ", MARK))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with begin and end ids."""
        first, last = np.array([self.begin], "<u4").tobytes(), np.array([self.end], "<u4").tobytes()
        group = np.cumsum([len(t) for t in texts]) // GROUP_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        out = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            some = [self.segments(t) for t in texts[lo:hi]]
            if len(self.known) > KEEP:
                self.before, self.known = self.known, {"": b""}
            new = set(chain.from_iterable(some)).difference(self.known)
            again = {s: self.before[s] for s in new if s in self.before}
            self.known |= again
            self.learn(new.difference(again))
            out += [first + b"".join(map(self.known.__getitem__, segments)) + last for segments in some]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: control ids are silent, one leading mark is dropped, byte pieces are joined to UTF-8."""
        x = np.frombuffer(ids, "<u4")
        sizes = self.spell_size[x]
        ends = np.cumsum(sizes)
        at = np.repeat(self.spell_at[x] - ends + sizes, sizes) + np.arange(ends[-1] if len(x) else 0)
        return self.spelling[at].tobytes().removeprefix(b" ").decode("utf-8", "replace")


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text, begin and end ids included; a null text is the empty one: [1, 2]."""

    def run(batches):
        m = model(path)
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in m.encode_batch([t or "" for t in b.column(1).to_pylist()])]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from an array of ids; null gives null, unknown ids fail."""

    def run(batches):
        m = model(path)
        for b in batches:
            text = [None if x is None else m.decode(np.array(x, "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col)).mapInArrow(run, f"id {kind}, text string")


def with_ids(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, n_tokens, ids array<int> and decoded_sha256 of every row; null texts are empty."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        m = model(path)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                raw = m.encode_batch([t or "" for t in part.column(0).to_pylist()])
                sizes = np.array([len(x) // 4 for x in raw], np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(raw), "<i4")))
                text = pa.array([hashlib.sha256(m.decode(x).encode()).hexdigest() for x in raw], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(sizes), ids, text], [*keep, "n_tokens", "ids", "decoded_sha256"])

    small_batches(docs.sparkSession)
    chosen = docs.select(F.col("text").alias("__text"), *keep)
    return chosen.mapInArrow(run, f"{schema}, n_tokens long, ids array<int>, decoded_sha256 string")


OP6_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of each text's ids and of the text decoded from them."""

    def run(batches):
        m = model(path)
        for b in batches:
            ids = m.encode_batch([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(m.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, OP6_SCHEMA)


def op6_sentencepiece(spark, sf_dir):
    """Number and digest of the ids of every text and the digest of what they decode to. Null texts are empty; repeated
    rows stay repeated; no rows give none."""
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
