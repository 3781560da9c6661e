"""Fill-in-middle over an index of distinct texts.

Documents are dealt out and sorted by a hash of their text, so identical texts follow each other. Each run's first text is
kept and every further row's text is compared with it in full, so texts that share a hash but not their content
are never taken for one. The boundaries of a text's units are listed once for a run, as an Elias-Fano list of their
ends in code points; each document of the run then selects its two seeded cuts from that list, without reading the
text again. A group of copies of any size is a stream: one text and one list are held at a time. Where such a group
outgrows a partition, adaptive execution splits it (REBALANCE), and each part lists the boundaries once.

The output puts a text's parts behind sentinels: psm is `<P>`prefix`<S>`suffix`<M>`middle, spm is
`<S>`suffix`<P>`prefix`<M>`middle, plain is the text. `restore` rebuilds the text from output and form.

Defined cases: a null text counts as empty, and an empty text is plain; a text that holds a sentinel is plain; a null id
draws as the empty string does; rows that repeat an id draw the same numbers, and all of them stay. Extra columns are
ignored; a carried column named like an output column is refused. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash128, pick, refuse, ship

#: The sentinels of the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def unit_ends(text: str) -> np.ndarray:
    """The ends, in code points, of the units of a text: runs of A-Z and a-z, and every other code point alone."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((points | 32) - 97) < 26  # unsigned: what is below wraps round
    inside = letter[1:] & letter[:-1]
    return np.append(np.flatnonzero(~inside) + 1, len(points)) if len(points) else np.zeros(0, np.int64)


class EliasFano:
    """A rising list of n numbers up to `most`, in about 2 + log2(most / n) bits each, with random access."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.width = max(0, (int(values[-1]) // self.n).bit_length() - 1) if self.n else 0
        low = values & ((1 << self.width) - 1)
        self.low = np.packbits((low[:, None] >> np.arange(self.width)) & 1) if self.width else np.zeros(0, np.uint8)
        ones = (values >> self.width) + np.arange(self.n)
        bits = np.zeros((int(ones[-1]) // 64 + 1) * 64 if self.n else 64, np.uint8)
        bits[ones] = 1
        self.high = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.cumsum(np.bitwise_count(self.high)).astype(np.int64)

    def select(self, k: int) -> int:
        """The k-th number, from 0."""
        word = int(np.searchsorted(self.before, k, side="right"))
        left = k - (int(self.before[word - 1]) if word else 0)
        bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        high = 64 * word + (bits & -bits).bit_length() - 1 - k
        low = 0
        for b in range(self.width):
            at = k * self.width + b
            low |= (int(self.low[at >> 3]) >> (7 - (at & 7)) & 1) << b
        return high << self.width | low

    def end(self, k: int) -> int:
        """Where the first k units end."""
        return self.select(k - 1) if k else 0


CUTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("prefix_end", T.LongType()), T.StructField("middle_end", T.LongType())])


@F.pandas_udf(CUTS)
def cuts(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """(n, end of the prefix, end of the middle) of each text; rows with equal texts should follow each other."""
    key, held, index = None, None, EliasFano(np.zeros(0, np.int64))
    for k1, k2, texts, first, second in parts:
        out = np.empty((len(texts), 3), np.int64)
        for row, (k, text, x, y) in enumerate(zip(zip(k1, k2, strict=True), texts, first, second, strict=True)):
            if k != key or text != held:
                key, held, index = k, text, EliasFano(unit_ends(text))
            a, b = sorted((x % (index.n + 1), y % (index.n + 1)))
            out[row] = index.n, index.end(a), index.end(b)
        yield pd.DataFrame(out, columns=["n", "prefix_end", "middle_end"])


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits, drawn by seed and id: the first groups of eight hex digits of a SHA-256."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(told, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, *, seed: int = 1, percent: int = 90, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row for each input row: id_col, text_col, the carried columns, n (units of the text), form, prefix_chars, middle_chars, output.

    `percent` of the documents are cut, `spm_percent` of these with the suffix first; prefix_chars and middle_chars count
    code points and are null for plain ones.
    """
    ship(docs.sparkSession)
    carry = [c for c in carry if c not in (id_col, text_col)]
    refuse([id_col, text_col, *carry], MADE)
    used = pick(docs, [id_col, text_col, *carry])
    whole = F.coalesce(F.col("row.text"), F.lit(""))
    row = F.struct(used[f"`{id_col}`"].alias("id"), used[f"`{text_col}`"].alias("text"), *[used[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(carry)])
    told = used.select(row.alias("row")).select("row", *hash128(whole))
    runs = told.hint("rebalance", "h1", "h2").sortWithinPartitions("h1", "h2")
    h1, h2, h3, h4 = draws(F.col("row.id"), seed)
    runs = runs.withColumn("cut", cuts("h1", "h2", whole, h1, h2))
    plain = (F.length(whole) == 0) | whole.rlike(SENTINEL) | (h3 % 100 >= percent)
    form = F.when(plain, F.lit("plain")).when(h4 % 100 < spm_percent, F.lit("spm")).otherwise(F.lit("psm"))
    runs = runs.select("row", whole.alias("whole"), form.alias("form"), F.col("cut.n").alias("n"), F.col("cut.prefix_end").alias("a"), F.col("cut.middle_end").alias("b"))
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    prefix, middle, suffix = F.substring("whole", F.lit(1), a), F.substring("whole", a + 1, b - a), F.substring("whole", b + 1, F.length("whole") - b)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    is_cut = F.col("form") != "plain"
    return runs.select(
        F.col("row.id").alias(id_col), F.col("row.text").alias(text_col), *[F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)], "n", "form",
        F.when(is_cut, F.col("a")).alias("prefix_chars"), F.when(is_cut, F.col("b") - F.col("a")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("whole")).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form; no part holds a sentinel, so the three split it."""
    parts = F.split(output, SENTINEL, -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
