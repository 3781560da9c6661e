"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of 64 words. Every passage is encoded from its character-class bigrams and word shares;
gated attention weights, learnt from document labels alone, make one passage vector of a document's passages, and a
logistic unit scores it. Everything is numpy; fitting runs on the driver over a bounded sample of labelled documents.

Defined cases: a null or empty text is one empty passage, so it has a score; repeated rows get equal scores; rows whose
label or id is null aren't learnt from; with no labels every score is 0.5. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh32_intdigest

from .common import pick, refuse, ship

PASSAGE_WORDS = 64
#: Bags longer than this are scored by running sums over slices of so many passages.
SLICE = 2048


def _classes() -> np.ndarray:
    """The class of each byte: lower, upper, digit, white space, lead or tail byte beyond ASCII; other signs stand for themselves."""
    out = np.zeros(256, dtype=np.int64)
    signs = [b for b in range(256) if b < 128 and not chr(b).isalnum() and chr(b) not in " \t\n\r\x0b\x0c" and b >= 32 and b < 127]
    for b in range(256):
        out[b] = 0 if chr(b).islower() and b < 128 else 1 if chr(b).isupper() and b < 128 else 2 if 48 <= b < 58 else 3 if b in b" \t\r\x0b\x0c" else 4 if b == 10 else 5 if b >= 192 else 6 if b >= 128 else 7 + signs.index(b) if b in signs else 7
    return out


CLASS = _classes()
N_CLASS = int(CLASS.max()) + 1
WORD_CELLS = 256
N_FEATURES = N_CLASS * N_CLASS + WORD_CELLS + 6


def passages(text: str) -> Iterator[np.ndarray]:
    """Feature matrices (passages x N_FEATURES) of slices of a text; at least one row in all."""
    found = text.encode("utf-8", "surrogatepass").split(b" ")  # keeps line ends, which tell cells and headings apart
    if not any(x.strip() for x in found):
        yield np.zeros((1, N_FEATURES), dtype=np.float32)
        return
    ends = range(0, len(found), PASSAGE_WORDS)
    for at in range(0, len(ends), SLICE):
        yield np.stack([encode_passage(found[k : k + PASSAGE_WORDS]) for k in ends[at : at + SLICE]])


def encode_passage(found: Sequence[bytes]) -> np.ndarray:
    out = np.zeros(N_FEATURES, dtype=np.float32)
    data = CLASS[np.frombuffer(b" ".join(found), dtype=np.uint8)]
    if len(data) > 1:
        out[: N_CLASS * N_CLASS] = np.sqrt(np.bincount(data[:-1] * N_CLASS + data[1:], minlength=N_CLASS * N_CLASS) / (len(data) - 1))
    cells = np.fromiter((xxh32_intdigest(x) & WORD_CELLS - 1 for x in found), dtype=np.int64, count=len(found))
    out[N_CLASS * N_CLASS : -6] = np.sqrt(np.bincount(cells, minlength=WORD_CELLS) / len(found))
    distinct, pairs = len(set(found)), len(set(zip(found, found[1:], strict=False)))
    out[-6:] = (len(data) / len(found) / 10, distinct / len(found), pairs / max(len(found) - 1, 1), float((data == 1).mean()) if len(data) else 0, float((data > 6).mean()) if len(data) else 0, np.log1p(len(found)) / 4)
    return out


@dataclass
class AttentionMIL:
    """h = tanh(x E + e); a = softmax(w (tanh(h V) * sigmoid(h U))); score = sigmoid(c . sum(a h) + d)."""

    E: np.ndarray
    e: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    d: np.ndarray

    @staticmethod
    def new(seed: int, hidden: int = 24, gate: int = 12) -> AttentionMIL:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
        return AttentionMIL(draw(N_FEATURES, hidden) * 2, np.zeros(hidden), draw(hidden, gate), draw(hidden, gate), draw(gate), draw(hidden), np.zeros(1))

    def parts(self) -> list[np.ndarray]:
        return [self.E, self.e, self.V, self.U, self.w, self.c, self.d]

    def score(self, text: str) -> float:
        """Softmax by running sums, so memory is bounded whatever the number of passages."""
        top, mass, vector = -np.inf, 0.0, np.zeros(len(self.c))
        for x in passages(text):
            h = np.tanh(x @ self.E + self.e)
            s = (np.tanh(h @ self.V) / (1 + np.exp(-(h @ self.U)))) @ self.w
            new = max(top, float(s.max()))
            a = np.exp(s - new)
            keep = np.exp(top - new) if mass else 0.0
            mass, vector, top = mass * keep + float(a.sum()), vector * keep + a @ h, new
        return float(1 / (1 + np.exp(-np.clip(self.c @ (vector / mass) + self.d[0], -30, 30))))

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss; x holds the passages of all bags, bag[i] the bag of passage i, in order."""
        n = len(y)
        h = np.tanh(x @ self.E + self.e)
        t, g = np.tanh(h @ self.V), 1 / (1 + np.exp(-(h @ self.U)))
        s = (t * g) @ self.w
        peak = np.full(n, -np.inf)
        np.maximum.at(peak, bag, s)
        a = np.exp(s - peak[bag])
        a /= np.bincount(bag, a, n)[bag]
        z = np.zeros((n, h.shape[1]))
        np.add.at(z, bag, a[:, None] * h)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c + self.d[0], -30, 30)))
        dlogit = (p - y) / n
        dz = dlogit[:, None] * self.c
        da = (h * dz[bag]).sum(axis=1)
        ds = a * (da - np.bincount(bag, a * da, n)[bag])
        dt, dg = ds[:, None] * self.w * g * (1 - t * t), ds[:, None] * self.w * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ self.V.T + dg @ self.U.T) * (1 - h * h)
        return [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ dg, (ds[:, None] * t * g).sum(axis=0), z.T @ dlogit, np.array([dlogit.sum()])]


def fit(texts: Sequence[str], labels: Sequence[int], *, epochs: int = 12, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> AttentionMIL:
    """Adam over bags; the same texts in the same order give the same model."""
    model = AttentionMIL.new(seed)
    if not len(texts):
        model.c[:] = 0
        return model
    bags = [np.concatenate(list(passages(t))) for t in texts]
    y = np.asarray(labels, dtype=np.float64)
    rng = np.random.default_rng(seed)
    first, second, step = [np.zeros_like(p) for p in model.parts()], [np.zeros_like(p) for p in model.parts()], 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            x = np.concatenate([bags[k] for k in chosen])
            bag = np.repeat(np.arange(len(chosen)), [len(bags[k]) for k in chosen])
            step += 1
            for k, (p, grad) in enumerate(zip(model.parts(), model.gradients(x, bag, y[chosen]), strict=True)):
                grad = grad + decay * p
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                p -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_documents: int = 3000) -> AttentionMIL:
    """Fits on a bounded sample, about max_documents labelled documents, chosen by a hash of the id; texts are whole."""
    labels = pick(labels, [id_col, label_col]).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    n = labels.count()
    cell = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 30))
    sample = labels.where(cell < F.lit(min(1.0, max_documents / max(n, 1)) * (1 << 30)))
    docs = pick(docs, [id_col, text_col])
    rows = docs.join(F.broadcast(sample), id_col).select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("y")).collect()
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    return fit([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, model: AttentionMIL, *, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Returns the carried columns and score: one row for each input row."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    refuse(carry, ["score", "__text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            found = [own.score(t or "") for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(found, pa.float64())], names=[*carry, "score"])

    used = pick(docs, list(dict.fromkeys([*carry, text_col])))
    given = used.select(*carry, F.col(text_col).alias("__text"))
    return given.mapInArrow(run, T.StructType([*[given.schema[c] for c in carry], T.StructField("score", T.DoubleType())]))
