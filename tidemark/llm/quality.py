"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of every document is encoded (byte classes and word repetition, then a
learned layer); learned gated attention, tanh(V h) * sigmoid(U h), weighs the passages; the weighted representation is
scored. Only document labels are learned from. The encoder reads the text and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import read, small_batches

PASSAGE = 1024  # bytes
SAMPLE_DOCS = 4000  # labelled documents that are learned from, at most: the first by a hash of the id
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """Byte to class: letters by case, digits, space, new line, every ASCII sign by itself, other controls, lead and
    continuation bytes."""
    out = np.zeros(256, np.int64)
    sign = 7
    for b in range(256):
        if b >= 0xC0:
            out[b] = 5
        elif b >= 0x80:
            out[b] = 6
        elif chr(b).isupper():
            out[b] = 0
        elif chr(b).islower():
            out[b] = 1
        elif chr(b).isdigit():
            out[b] = 2
        elif chr(b) in " \n":
            out[b] = 3 + (b == 10)
        elif 33 <= b < 127:
            out[b], sign = sign, sign + 1
        else:
            out[b] = sign if b == 127 else 6
    return out


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
N_FEATURES = N_CLASSES + 4


def features(text: str | None) -> np.ndarray:
    """(passages, features); an empty text is one passage of zeros."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    n = max(1, -(-len(raw) // PASSAGE))
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(raw):
        return out
    at = np.arange(len(raw)) // PASSAGE
    counts = np.bincount(at * N_CLASSES + CLASS[raw], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    size = counts.sum(axis=1, keepdims=True)
    out[:, :N_CLASSES] = np.sqrt(counts / size)
    data = raw.tobytes()
    for i in range(n):
        words = data[i * PASSAGE : (i + 1) * PASSAGE].split()
        k = max(1, len(words))
        out[i, N_CLASSES:] = (sum(map(eq, words, words[1:])) / k, len(set(words)) / k, min(1.0, size[i, 0] / k / 20), size[i, 0] / PASSAGE)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, bags: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return _forward(self.weights, (bags - self.mean) / self.scale, starts)["p"]


def _forward(w, x, starts):
    n = np.diff(np.append(starts, len(x)))
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
    s = (t * g) @ w["w"]
    s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), n))
    a = s / np.repeat(np.add.reduceat(s, starts), n)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
    return {"n": n, "h": h, "t": t, "g": g, "a": a, "z": z, "p": p}


def gradient(w, x, starts, y) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of whole bags, by each weight."""
    f = _forward(w, x, starts)
    dz = (f["p"] - y)[:, None] / len(y)
    dh_bag = np.repeat(dz * w["c"], f["n"], axis=0)
    da = (dh_bag * f["h"]).sum(axis=1)
    ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["n"]))
    dtg = ds[:, None] * w["w"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dh_bag + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
    return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dz[:, 0], "b": dz.sum(axis=0)}


def fit(x: np.ndarray, starts: np.ndarray, y: np.ndarray, hidden: int = 16, gates: int = 8, steps: int = 300, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Adam on the cross-entropy of whole bags; the same input gives the same model."""
    rng = np.random.default_rng(7)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.05
    x = ((x - mean) / scale).astype(np.float64)
    d = x.shape[1]
    w = {"E": rng.normal(0, d**-0.5, (d, hidden)), "e": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gates)), "U": rng.normal(0, 0.3, (hidden, gates)), "w": rng.normal(0, 0.3, gates), "c": rng.normal(0, 0.3, hidden), "b": np.zeros(1)}
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        grad = gradient(w, x, starts, y)
        for k, g in grad.items():
            g = g + decay * w[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def held_out(doc_id):
    """True for the fifth of the rows that is never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Fit on at most ``sample_docs`` labelled rows outside the held-out fifth; None if there are none.

    Every passage of such a document counts. Repeated labels of a document are averaged and rounded up; null labels and
    labels without a document are ignored.
    Of repeated rows of a document one is learned from, whatever their order: that of the smallest features.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    small_batches(docs.sparkSession)
    bags = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def run(batches):
        for b in batches:
            out = [features(t).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "y", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = bags.mapInArrow(run, f"doc_id {kind}, y double, f binary")
    rows = found.groupBy("doc_id", "y").agg(F.min("f").alias("f")).collect()  # at most sample_docs
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["f"]))
    each = [np.frombuffer(r["f"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    starts = np.concatenate([[0], np.cumsum([len(f) for f in each])[:-1]])
    return fit(np.concatenate(each), starts, np.array([r["y"] for r in rows]))


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Columns ``keep`` and score double; without a model every score is 0.5. Null texts score as empty ones.

    ``with_text`` says that ``keep`` has the text itself, which is then read once.
    """
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias("score"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text_at = keep.index("text") if with_text else len(keep)

    def run(batches):
        for b in batches:
            texts, out = b.column(text_at).to_pylist(), []
            for lo in range(0, len(texts), 512):
                bags = [features(t) for t in texts[lo : lo + 512]]
                starts = np.concatenate([[0], np.cumsum([len(f) for f in bags])[:-1]])
                out.append(sent.value.score(np.concatenate(bags), starts))
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(p)], [*keep, "score"])

    chosen = docs.select(*keep) if with_text else docs.select(*keep, F.col("text").alias("__text"))
    return chosen.mapInArrow(run, schema)


def op10_quality(spark, sf_dir):
    """Held out or not, score and prediction of every row. Null and empty texts are scored like any others; repeated rows
    get the same score; without usable labels every score is 0.5; no documents give no rows."""
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
