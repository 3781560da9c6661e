"""Packing into windows by an order-preserving dynamic program.

Documents are tokenised where they are read, in the table's order, and a partition's tokens are one stream. Windows are
cut out of it at document ends, at sentence ends, and, where no such place comes for `gap` tokens, at every gap-th token.
A cut inside a document costs a penalty; a window costs its padding up to `window` tokens, or only `short` if its length is a
smaller power of two, since it isn't padded then. The program finds the cuts of least cost over the whole stream: the padding is linear in a window's begin,
so the best begin is the front of a monotone queue of those in reach, and the few begins a power of two away are tried
besides.

Streams are as long as partitions, but only their unsettled end is held: all begins that a later window can have descend
from one cut, as a rule a few windows back, and everything before that cut is final and goes out. If `horizon` tokens come
without such a cut, the path to the latest document end is taken.

There is no shuffle: a partition's windows depend on its rows alone, so a lost task gives the same pieces again. A
sequence's id is its partition's number and its own in it, so ids are unique, not dense.

Defined cases: a null text counts as empty; every document ends with `end_id`, so an empty one is a piece of that id alone;
null and repeated ids are carried like others, each row being a document. Extra columns are ignored; a carried column
named like an output column is refused. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import pick, refuse, ship

MADE = {"start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary()}
#: What ends a sentence if a blank or nothing follows; a line break always does.
ENDS = (".", "!", "?", "…", "。", "！", "？")


def sentence_tables(vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token id: does it hold a line break, end with a sentence's end, begin with a blank."""
    told = json.loads(vocabulary)
    spelt = bpe.labels(told["vocab"], told["added"])
    ends = tuple(x.encode() for x in ENDS)
    of = lambda test: np.array([test(x) for x in spelt], bool)
    return of(lambda x: b"\n" in x), of(lambda x: x.endswith(ends)), of(lambda x: x[:1].isspace())


class Windows:
    """The program over one stream of positions: candidates come in by add(), settled cuts go out by settle() and finish()."""

    def __init__(self, window: int, short: int, shortest: int) -> None:
        self.window, self.short = window, short
        self.powers = [1 << k for k in range(window.bit_length()) if shortest <= 1 << k < window]
        self.pos, self.cost, self.key, self.parent = [0], [0], [0], [-1]
        self.queue, self.front = [0], 0

    def add(self, positions: np.ndarray, penalties: np.ndarray) -> None:
        """Further candidates, rising; none further than a window from the one before."""
        known = len(self.pos)
        every = np.concatenate([np.array(self.pos, np.int64), positions])
        hits: dict[int, list[int]] = {}
        for power in self.powers:
            wanted = positions - power
            at = np.searchsorted(every, wanted)
            for j in np.flatnonzero(every[at] == wanted).tolist():
                hits.setdefault(known + j, []).append(int(at[j]))
        window, short, pos, cost, key, parent, queue, front = self.window, self.short, self.pos, self.cost, self.key, self.parent, self.queue, self.front
        for j, (p, penalty) in enumerate(zip(positions.tolist(), penalties.tolist(), strict=True), known):
            while pos[queue[front]] < p - window:
                front += 1
            i = queue[front]
            best = key[i] + window - p
            if j in hits:
                for other in hits[j]:  # of equal costs the shortest last window, so that paths share their beginning
                    if (found := cost[other] + short) < best or (found == best and other > i):
                        best, i = found, other
            best += penalty
            pos.append(p), cost.append(best), key.append(best + p), parent.append(i)
            while len(queue) > front and key[queue[-1]] >= best + p:
                queue.pop()
            queue.append(j)
        self.queue, self.front = queue[front:], 0

    def cuts_to(self, end: int) -> np.ndarray:
        """The positions of the cuts of the cheapest path to a candidate, from the first."""
        out = []
        while end >= 0:
            out.append(self.pos[end])
            end = self.parent[end]
        return np.array(out[::-1], np.int64)

    def forget(self, before: int) -> None:
        self.pos, self.cost, self.key = self.pos[before:], self.cost[before:], self.key[before:]
        self.parent = [-1, *[i - before for i in self.parent[before + 1 :]]]
        self.queue = [i - before for i in self.queue if i >= before] or [0]

    def settle(self) -> np.ndarray:
        """The cuts that no further candidate can change."""
        last = self.pos[-1]
        alive = {j for j in range(max(0, len(self.pos) - self.window - 1), len(self.pos)) if self.pos[j] >= last - self.window}
        heap = [-j for j in alive]
        heapq.heapify(heap)
        while len(alive) > 1:
            j = -heapq.heappop(heap)
            alive.remove(j)
            if (i := self.parent[j]) not in alive:
                if i < 0:
                    return self.cuts_to(0)
                alive.add(i), heapq.heappush(heap, -i)
        (common,) = alive
        cuts = self.cuts_to(common)
        self.forget(common)
        return cuts

    def finish(self) -> np.ndarray:
        """The cuts to the last candidate, which begins a new stream."""
        cuts = self.cuts_to(len(self.pos) - 1)
        self.forget(len(self.pos) - 1)
        return cuts


def candidates(ids: np.ndarray, ends: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray], sentence: int, forced: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the documents that end at `ends` may be cut, rising, and the penalties."""
    newline, stops, blank = tables
    follows = np.append(blank[ids[1:]], True)
    inside = newline[ids] | (stops[ids] & follows)
    inside[ends - 1] = True  # a document's last token
    at = np.flatnonzero(inside) + 1
    wide = np.diff(at, prepend=0)
    more = (wide - 1) // gap
    begins = np.repeat(at - wide, more)
    steps = np.arange(len(begins)) - np.repeat(np.cumsum(more) - more, more) + 1
    positions = np.concatenate([at, begins + gap * steps])
    penalties = np.concatenate([np.full(len(at), sentence), np.full(len(begins), forced)])
    penalties[: len(at)][np.isin(at, ends, assume_unique=True)] = 0
    order = np.argsort(positions, kind="stable")
    return positions[order], penalties[order]


class Stream:
    """A partition's documents on their way to pieces."""

    def __init__(self, part: int, windows: Windows, carried: pa.Schema) -> None:
        self.part, self.windows, self.sequence = part, windows, 0
        self.ids, self.begin = np.zeros(0, np.int32), 0  # the tokens from position `begin` on
        self.starts, self.sizes, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), carried.empty_table()

    def add(self, ids: np.ndarray, sizes: np.ndarray, rows: pa.Table, positions: np.ndarray, penalties: np.ndarray) -> None:
        at = self.begin + len(self.ids)
        self.windows.add(at + positions, penalties)
        self.ids = np.concatenate([self.ids, ids])
        self.starts, self.sizes, self.rows = np.concatenate([self.starts, at + np.cumsum(sizes) - sizes]), np.concatenate([self.sizes, sizes]), pa.concat_tables([self.rows, rows])

    def pieces(self, cuts: np.ndarray) -> pa.Table:
        """What lies between the first cut and the last, cut further where documents begin."""
        end = int(cuts[-1])
        bounds = np.union1d(cuts, self.starts[(self.starts > self.begin) & (self.starts < end)])
        first = bounds[:-1]
        doc = np.searchsorted(self.starts, first, side="right") - 1
        window = np.searchsorted(cuts, first, side="right") - 1
        taken = np.ascontiguousarray(self.ids[: end - self.begin].astype("<u4"))
        offsets = pa.py_buffer((4 * (bounds - self.begin)).astype(np.int32))
        made = [first - self.starts[doc], np.diff(bounds), self.sizes[doc], (self.part << 33) + self.sequence + window, first - cuts[window]]
        out = self.rows.take(pa.array(doc)).columns + [pa.array(x, pa.int64()) for x in made] + [pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(taken)])]
        self.sequence += len(cuts) - 1
        self.ids, self.begin = self.ids[end - self.begin :], end
        keep = int(np.searchsorted(self.starts + self.sizes, end, side="right"))
        self.starts, self.sizes, self.rows = self.starts[keep:], self.sizes[keep:], self.rows.slice(keep).combine_chunks()
        return pa.table(out, names=[*self.rows.column_names, *MADE])


def pack(docs: DataFrame, vocabulary: str, *, window: int = 2048, end_id: int = 1, sentence: int = 16, forced: int = 128, gap: int = 256, short: int = 256, shortest: int = 256, horizon: int = 1 << 23, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row for each piece: the carried columns, start (the document's tokens before it), length, doc_tokens (end_id included),
    sequence_id, offset (in that sequence), ids (unsigned 32-bit numbers, little-endian).

    `sentence` and `forced` are the penalties, in tokens of padding, of a cut at a sentence end and elsewhere in a document;
    `short` that of a window whose length is a power of two from `shortest` on but less than `window`, for the place it takes in a batch.
    """
    if gap > window:
        raise ValueError("gap must not exceed window")
    spark = docs.sparkSession
    ship(spark)
    carry = [c for c in carry if c != text_col]
    refuse(carry, list(MADE))
    held = spark.sparkContext.broadcast((bpe.compiled(vocabulary), sentence_tables(vocabulary)))  # its size depends on the vocabulary only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, breaks = held.value
        own, stream = bpe.Codec(*tables), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.table([batch.column(k) for k in range(len(carry))], names=carry) if carry else pa.table({"": pa.nulls(batch.num_rows)})
            if stream is None:
                stream = Stream(batch.column(len(carry) + 1)[0].as_py(), Windows(window, short, shortest), rows.schema)
            found, counts, _ = own.encode([t or "" for t in batch.column(len(carry)).to_pylist()])
            sizes = counts + 1
            ends = np.cumsum(sizes)
            ids = np.full(int(ends[-1]), end_id, np.int32)
            is_text = np.ones(len(ids), bool)
            is_text[ends - 1] = False
            ids[is_text] = found
            stream.add(ids, sizes, rows, *candidates(ids, ends, breaks, sentence, forced, gap))
            cuts = stream.windows.settle()
            if len(cuts) < 2 and len(stream.ids) > horizon:
                cuts = stream.windows.finish()
            if len(cuts) > 1:
                yield from stream.pieces(cuts).select([*carry, *MADE]).to_batches()
        if stream is not None and len(cuts := stream.windows.finish()) > 1:
            yield from stream.pieces(cuts).select([*carry, *MADE]).to_batches()

    used = pick(docs, [*carry, text_col])
    schema = T.StructType([*[used.schema[c] for c in carry], *[T.StructField(c, T.BinaryType() if c == "ids" else T.LongType()) for c in MADE]])
    return used.select(*[used[f"`{c}`"] for c in carry], used[f"`{text_col}`"], F.spark_partition_id().cast("long").alias("in part")).mapInArrow(run, schema)
