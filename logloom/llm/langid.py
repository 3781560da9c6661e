"""Language identification by error-correcting output codes.

Every language has a codeword; a binary n-gram classifier for each of its bits weighs hashed byte bigrams and trigrams
by their log-odds between the languages with and without the bit, and is calibrated on the sample. Decoding sums each
codeword's logistic losses, weighted by how well a bit's classifier did, and takes the nearest; where the runner-up is
close, the text is flagged as ambiguous.

Fitting reads a bounded sample: about `per_language` documents of each language, chosen by a hash of the id.

Defined cases: a text that is null or has no letter is `und` with score 0; with no language learned every text is; a carried column named like an output column is refused;
equal codeword losses go to the first language by code point; rows are independent, so repeated rows get equal results.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, refuse, ship

GRAMS = 1 << 16
STEP = 1 << 16


def grams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of a text: bigrams 0 .. GRAMS-1, then hashed trigrams; in steps of bounded length."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8).astype(np.uint32)
    for at in range(0, len(data) - 1, STEP):
        part = data[at : at + STEP + 2]
        two = part[:-1] << 8 | part[1:]
        three = (two[:-1] << 8 | part[2:]) * np.uint32(2654435761) >> np.uint32(16)
        yield np.concatenate([two[:STEP], three + np.uint32(GRAMS)])


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n codewords of -1 and 1: every split of the languages while they are few, else the best of random codes."""
    if n <= 7:
        splits = range(1, 1 << max(n - 1, 1)) if n > 1 else [1]
        return np.array([[1 if s >> k & 1 else -1 for s in splits] for k in range(n)])[:, : (1 << n - 1) - 1 or 1]
    rng, wide = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(n)))
    tries = [rng.choice([-1, 1], (n, wide)) for _ in range(50)]
    return max(tries, key=lambda c: min((wide - c[i] @ c[j]) // 2 for i in range(n) for j in range(i)))


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    code: np.ndarray | None = None  # languages x bits
    odds: np.ndarray | None = None  # features x bits
    slope: np.ndarray | None = None
    offset: np.ndarray | None = None
    weight: np.ndarray | None = None

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.odds.shape[1]), 0
        for g in grams(text):
            total += self.odds[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return total / max(n, 1)

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score and whether the text is ambiguous."""
        m = self.slope * self.margins(text) + self.offset
        losses = (self.weight * np.logaddexp(0, -self.code * m)).sum(axis=1)
        p = np.exp(losses.min() - losses)
        p /= p.sum()
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), bool(np.partition(p, -2)[-2] > 0.5 * p[best]) if len(p) > 1 else False


def fit(texts: list[str], languages: list[str], *, smoothing: float = 0.1, rounds: int = 200) -> LanguageModel:
    names = sorted(set(languages))
    if not names:
        return LanguageModel()
    counts = np.full((len(names), GRAMS * 2), smoothing)
    for text, lang in zip(texts, languages, strict=True):
        for g in grams(text):
            counts[names.index(lang)] += np.bincount(g, minlength=GRAMS * 2)
    share = counts / counts.sum(axis=1, keepdims=True)
    code = codewords(len(names))
    odds = np.zeros((GRAMS * 2, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]):
        yes, no = share[code[:, b] > 0], share[code[:, b] < 0]
        if len(yes) and len(no):
            odds[:, b] = np.log(yes.mean(axis=0) / no.mean(axis=0))
    model = LanguageModel(names, code, odds, np.ones(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    x = np.array([model.margins(t) for t in texts])
    y = code[[names.index(v) for v in languages]]
    for _ in range(rounds):  # a logistic fit of slope and offset for each bit
        pull = y / (1 + np.exp(np.clip(y * (model.slope * x + model.offset), -30, 30)))
        model.slope += 2.0 * (pull * x).mean(axis=0)
        model.offset += 0.5 * pull.mean(axis=0)
    right = ((model.slope * x + model.offset) * y > 0).mean(axis=0)
    model.weight = np.maximum(right - 0.5, 0.01) * 2
    return model


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500) -> LanguageModel:
    """Fits a model on a bounded sample of labelled rows; the bound is about per_language documents of each language."""
    docs = pick(docs, [id_col, text_col, lang_col]).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in docs.groupBy(lang_col).count().collect()}  # a row for each language
    if not sizes:
        return LanguageModel()
    cell, span = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 30)), float(1 << 30)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    rows = docs.where(cell < share * span).select(id_col, lang_col, text_col).collect()
    rows = sorted(rows, key=lambda r: (r[1], r[0] is None, r[0], r[2]))
    return fit([r[2] for r in rows], [r[1] for r in rows])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Returns the carried columns, lang_pred, score and ambiguous: one row for each input row."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on languages and GRAMS only
    carry = tuple(carry)
    refuse(carry, ["lang_pred", "score", "ambiguous", "__text", "__letter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            found = [own.predict(t) if ok and own.languages else ("und", 0.0, False) for t, ok in zip(batch.column("__text").to_pylist(), batch.column("__letter").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], names=[*carry, "lang_pred", "score", "ambiguous"])

    used = pick(docs, list(dict.fromkeys([*carry, text_col])))
    given = used.select(*carry, F.col(text_col).alias("__text"), has_letter(F.col(text_col)).alias("__letter"))
    schema = T.StructType([*[given.schema[c] for c in carry], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return given.mapInArrow(run, schema)
