"""Term statistics of a corpus as a stored index, and top-k search over it.

The corpus is tokenised once. Its postings (ref, term, tf, len) are written in buckets of refs, so all terms of a ref lie together
and a query's scores are summed where they are read: neither corpus nor postings are shuffled again. A row with an empty
term stands for each ref, so that the number of refs and their mean length come from the index too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.workers import importable, kept_once
from .retrieval import MMR, K1, B, contenders, mmr

EVERY = ""


def counted(terms: Column) -> Column:
    """Each term of an array with how often it stands there, without a shuffle; the terms are sorted once."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        first = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        return bound(F.array_append(first, n), lambda ends: F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda i, k: F.struct(F.get(s, i).alias("term"), (F.get(ends, k + 1) - i).alias("tf"))))

    return bound(F.array_sort(terms), runs)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Postings:
    """An index in the session's catalogue, below the shared folder; use it in a `with` block, which drops it."""

    def __init__(self, corpus: DataFrame, ref: str, text: str, wanted: DataFrame | None = None, buckets: int | None = None) -> None:
        """wanted: (term), the only terms to keep, if it is given. A ref should have one row; those of several add up. A null text has no terms."""
        self.spark, self.ref, self.name = corpus.sparkSession, ref, f"postings_{uuid.uuid4().hex}"
        n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        told = corpus.select(F.col(ref), bound(tokens(F.col(text)), lambda ts: F.struct(F.size(ts).alias("len"), counted(ts).alias("terms"))).alias("d"))
        each = told.select(ref, "d.len", F.inline(F.array_append("d.terms", F.struct(F.lit(EVERY).alias("term"), F.lit(1).alias("tf")))))
        if wanted is not None:
            each = each.join(wanted.select("term").union(self.spark.range(1).select(F.lit(EVERY).alias("term"))).distinct(), "term", "left_semi")
        # dealt out as the buckets are, so that a task writes one file
        rows = each.select(ref, "term", "tf", "len").repartition(n, ref).sortWithinPartitions(ref)
        rows.write.format("parquet").bucketBy(n, ref).sortBy(ref).saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def __enter__(self) -> Postings:
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.sql(f"drop table if exists {self.name}")

    def facts(self) -> DataFrame:
        """(n_docs, avg_len), one row."""
        return self.table.where(F.col("term") == EVERY).agg(F.count("*").cast("double").alias("n_docs"), F.greatest(F.coalesce(F.avg("len"), F.lit(0.0)), F.lit(1.0)).alias("avg_len"))

    def weights(self, asked: DataFrame, query: str) -> DataFrame:
        """asked (query, term) with idf and the corpus facts; terms that no ref has are left out."""
        df = self.table.where(F.col("term") != EVERY).groupBy("term").agg(F.count("*").cast("double").alias("df"))
        met = asked.select(query, "term").distinct().join(df, "term").crossJoin(F.broadcast(self.facts()))  # one row
        return met.select(query, "term", "avg_len", F.ln(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    def scores(self, asked: DataFrame, query: str) -> DataFrame:
        """(query, ref, score) of every positive BM25 score, to six digits."""
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1.0 - B + B * F.col("len") / F.col("avg_len")))
        met = self.table.join(kept_once(self.weights(asked, query)), "term").select(query, self.ref, part.alias("part"))
        return met.groupBy(query, self.ref).agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")

    def ranked(self, asked: DataFrame, query: str, k: int) -> DataFrame:
        """(query, ref, score, rank) of the k best refs of each query, by score, then ref. Each task gives k rows a query at most."""
        order = Window.partitionBy(query).orderBy(F.col("score").desc(), self.ref)
        return self.scores(asked, query).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def numbers(text: Column) -> Column:
    """The distinct tokens as hashes of 64 bits."""
    return F.transform(F.array_distinct(tokens(text)), lambda t: F.xxhash64(t))


def asked_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, term): the distinct tokens of each query's text."""
    return queries.select(query, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).distinct()


class Greedy:
    """One query's choice among candidates that come in falling order of score, as far as they are known.

    terms holds the numbers of all candidates' terms, one candidate after the other, and ends where each one's end.
    """

    BLOCK = 256

    def __init__(self, scores: np.ndarray, sames: np.ndarray, terms: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> None:
        self.scores, self.sames, self.terms, self.sizes = scores, sames, terms, sizes
        self.ends, self.begins = ends, np.concatenate([[0], ends[:-1]])
        self.top = max(float(scores[0]), 1e-12)  # the first is the best
        self.worth = MMR * scores / self.top
        self.bound = self.worth.copy()  # what a candidate is worth at most
        self.seen = np.zeros(len(scores), np.int64)  # the choices that its bound takes in
        self.near = np.zeros(len(scores))
        self.chosen: list[int] = []

    def likeness(self, rows: np.ndarray, c: int) -> np.ndarray:
        """Of candidates to one of them: 1 for equal `same`, else the Jaccard likeness of their terms."""
        own = np.sort(self.terms[self.begins[c] : self.ends[c]])
        n = self.ends[rows] - self.begins[rows]
        upto = np.cumsum(n)
        flat = self.terms[np.repeat(self.begins[rows] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        hit = np.zeros(len(flat) + 1, np.int64)
        if len(own):
            hit[1:] = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        hit = np.cumsum(hit)
        both = hit[upto] - hit[upto - n]
        return np.where(self.sames[rows] == self.sames[c], 1.0, both / np.maximum(n + len(own) - both, 1))

    def run(self, most: int, room: int, unseen: float | None) -> bool:
        """Chooses until `most` are chosen or one exceeds the room; False if a candidate that isn't known might lead.

        Candidates are compared with the choices since their last comparison only when their bounds lead, a block at a time.
        """
        live = np.ones(len(self.scores), bool)
        limit = None if unseen is None else MMR * unseen / self.top
        while live.any() and len(self.chosen) < most:
            rows = np.flatnonzero(live)
            rows = rows[np.argsort(-self.bound[rows], kind="stable")]
            lead = -1.0
            for at in range(0, len(rows), self.BLOCK):
                block = rows[at : at + self.BLOCK]
                if self.bound[block[0]] < lead:
                    break  # no candidate behind one that is up to date can lead
                for n in range(int(self.seen[block].min()), len(self.chosen)):
                    late = block[self.seen[block] <= n]
                    self.near[late] = np.maximum(self.near[late], self.likeness(late, self.chosen[n]))
                self.seen[block] = len(self.chosen)
                self.bound[block] = self.worth[block] - (1 - MMR) * self.near[block]
                lead = max(lead, float(self.bound[block].max()))
            best = int(rows[np.lexsort((rows, -self.bound[rows]))[0]])
            if limit is not None and self.bound[best] < limit:
                return False
            if self.sizes[best] + 1 > room:
                return True
            room -= int(self.sizes[best]) + 1
            self.chosen.append(best)
            live[best] = False
        return len(self.chosen) == most or unseen is None


def chooser(by: str, ref: str, n: int, most: int, room: int) -> Callable[[pa.Table], pa.Table]:
    """What chooses among a query's first n candidates, the next one told besides; rank 0 asks for more, -1 tells that nothing fits."""

    def choose(table: pa.Table) -> pa.Table:
        rows = table.sort_by("rank")
        cut = rows.slice(0, n).combine_chunks()
        unseen = rows.column("score")[n].as_py() if rows.num_rows > n else None
        plain = lambda c: cut.column(c).to_numpy(zero_copy_only=False)
        lists = cut.column("terms").combine_chunks() if cut.num_rows else None
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        sames = cut.column("same").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        g = Greedy(plain("score"), sames, lists.flatten().to_numpy(zero_copy_only=False), ends, plain("size"))
        done = g.run(most, room, unseen)
        chosen = g.chosen if done and g.chosen else [0]
        rank = list(range(1, len(chosen) + 1)) if done and g.chosen else [-1 if done else 0]
        picked = cut.take(pa.array(chosen, pa.int64()))
        return pa.table([picked.column(by), picked.column(ref), pa.array(rank, pa.int64())], names=[by, ref, "rank"])

    return choose


def diverse(pages: Callable[[DataFrame | None, int], DataFrame], by: str, ref: str, *, k: int = 1 << 30, budget: int = 1 << 60, base: int = 2, first: int = 64, most: int = 4096, exact: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(by, ref, rank): a greedy diverse choice per query, MMR * score / best - (1 - MMR) * likeness, until k are chosen or one exceeds the budget.

    pages(open, n) gives (by, ref, score, rank, same, terms (numbers, each once), size) of the n best candidates of the queries in open (by), or of all. A round
    chooses among them; a query where a candidate behind them might lead goes on to the next, four times as many. Queries
    that aren't settled among `most` go to `exact`, which keeps candidates in tables. Most queries are settled by the first page.
    """
    out, live, n = [], None, first
    while True:
        page = pages(live, n + 1)
        importable(page.sparkSession)
        keys = {by: page.schema[by].dataType.simpleString(), ref: page.schema[ref].dataType.simpleString()}

        told = kept_once(page.groupBy(by).applyInArrow(chooser(by, ref, n, k, budget - base), f"{by} {keys[by]}, {ref} {keys[ref]}, rank long"))
        out.append(told.where("rank > 0"))
        live = told.where("rank = 0").select(by)
        n *= 4
        if live.isEmpty():
            break
        if n > most:
            if exact is None:
                raise ValueError("candidates beyond the last page need `exact`")
            out.append(exact(live).select(by, ref, F.col("rank").cast("long").alias("rank")))
            break
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def diverse_refs(index: Postings, corpus: DataFrame, asked: DataFrame, query: str, text: str, same: str, k: int, first: int = 64, most: int = 4096) -> DataFrame:
    """(query, ref, rank): the k diverse refs of each query over an index of the corpus; refs of equal `same` are alike in full."""
    ref, held = index.ref, [0, None]  # how far the kept ranking reaches, and it

    def with_terms(best: DataFrame) -> DataFrame:
        few = best.select(ref).distinct()
        texts = corpus.join(few, ref, "left_semi").select(ref, F.col(same).alias("same"), numbers(F.col(text)).alias("terms")).dropDuplicates([ref])
        return best.join(texts, ref).withColumn("size", F.lit(0))

    def pages(live: DataFrame | None, n: int) -> DataFrame:
        own = asked if live is None else asked.join(live, query, "left_semi")
        if held[0] < n:  # the postings are read once for two pages
            reach = min(4 * n, max(most + 1, n))
            held[:] = [reach, kept_once(index.ranked(own, query, reach))]
        best = held[1].where(F.col("rank") <= n)
        return with_terms(best if live is None else best.join(live, query, "left_semi"))

    def exact(live: DataFrame) -> DataFrame:
        whole = index.scores(asked.join(live, query, "left_semi"), query)
        near = contenders(whole.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), ref))), query, "score", k)
        return mmr(with_terms(near.select(query, ref, "score")), query, ref, "score", "terms", "same", k)

    return diverse(pages, query, ref, k=k, first=first, most=most, exact=exact)

