"""Byte-addressed spans of a log: cutting by rendered size or by tokens, reading back by address, excerpts around a match."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..functions.workers import importable
from . import segment

#: What a span's rendering may take beyond its bytes, and how far an excerpt starts before its match.
RENDERING, BEFORE_SIGNAL, BEFORE_TERM = 350, 50, 90
SPAN = "array<struct<ref:string,start_byte:int,end_byte:int,sha256:string,rendered_bytes:int,piece:string>>"
PIECE = "array<struct<start_char:int,end_char:int,n_tokens:int,piece:string>>"


def halved(text: str, fits: Callable[[str, int], bool]) -> Iterator[tuple[int, str]]:
    """(start, part) in order; a part that does not fit is halved by characters, down to one character, which stands alone."""
    todo = [(0, text)]
    while todo:
        at, part = todo.pop()
        if len(part) <= 1 or fits(part, at):
            yield at, part
        else:
            middle = len(part) // 2
            todo += [(at + middle, part[middle:]), (at, part[:middle])]


def rendered(step: int, name: str, role: str, start: int, piece: str) -> dict:
    """A span as it is shown, its address and digest included."""
    raw = piece.encode()
    end = start + len(raw)
    return {"id": f"s{step}:{start}:{end}", "step": step, "start_byte": start, "end_byte": end, "sha256": hashlib.sha256(raw).hexdigest(), "name": name, "role": role, "content": piece}


def rendered_bytes(record: dict) -> int:
    return len(json.dumps(record, ensure_ascii=False, separators=(",", ":")).encode())


def record_spans(step: int, name: str, role: str, text: str, span_bytes: int, most: int) -> list[tuple]:
    """A record's spans; what is shown of each takes at most `most` bytes, single characters aside."""
    out, at = [], 0
    for _, _, _, piece in segment.split_utf8(text, span_bytes):
        start = at
        for _, part in halved(piece, lambda p, k: rendered_bytes(rendered(step, name, role, start + len(piece[:k].encode()), p)) <= most):
            shown = rendered(step, name, role, at, part)
            out.append((shown["id"], at, shown["end_byte"], shown["sha256"], rendered_bytes(shown), part))
            at = shown["end_byte"]
    return out


def span_index(steps: DataFrame, step: str = "step", name: str = "name", role: str = "role", text: str = "content", span_bytes: int = 2200, segment_bytes: int = 15000) -> DataFrame:
    """Every step's spans: the other columns with ref, start_byte, end_byte, sha256, rendered_bytes, piece.

    A null text, name or role is empty; an empty text has one empty span. Steps are cut one by one, without a shuffle.
    """
    importable(steps.sparkSession)
    most = min(segment_bytes - 2, span_bytes + RENDERING)

    @F.pandas_udf(SPAN)
    def cut(at: pd.Series, who: pd.Series, kind: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([record_spans(int(a), w, k, b, span_bytes, most) for a, w, k, b in zip(at, who, kind, body, strict=True)])

    own = [F.coalesce(F.col(c), F.lit("")) for c in (name, role, text)]
    kept = [c for c in steps.columns if c != text]
    return steps.select(*kept, F.explode(cut(F.col(step), *own)).alias("__s")).select(*kept, "__s.*")


def boundary(name: Column, role: Column, start: Column) -> Column:
    """Where a segment may well begin: the first span of a hand-off or of a message from outside."""
    return (start == 0) & (name.contains("(->") | role.isin("user", "system"))


def span_segments(spans: DataFrame, case: str = "conv_id", step: str = "step", segment_bytes: int = 15000, records: int = 16) -> DataFrame:
    """spans with batch, the number of the segment that holds each, exactly one."""
    soft = boundary(F.col("name"), F.col("role"), F.col("start_byte"))
    return segment.greedy_pack(spans, [case], [step, "start_byte"], F.col("rendered_bytes"), segment_bytes, records, separator=1, base=2, boundary=soft)


def read_back(pointers: DataFrame, steps: DataFrame, by: list[str], text: str = "content") -> DataFrame:
    """pointers with `bytes`, read from the original at start_byte to end_byte, and `valid`, whether they have the pointer's sha256.

    A pointer to a step that isn't there is invalid and reads null.
    """
    source = steps.select(*by, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    read = pointers.join(source, by, "left").withColumn("bytes", segment.read_span(F.col("__text"), F.col("start_byte"), F.col("end_byte")))
    return read.withColumn("valid", F.coalesce(F.sha2("bytes", 256) == F.col("sha256"), F.lit(False))).drop("__text")


def token_pieces(steps: DataFrame, text: str, budget: int, count: Callable[[str], int]) -> DataFrame:
    """Every text in pieces of at most budget tokens by halving: the other columns with start_char, end_char, n_tokens, piece."""
    importable(steps.sparkSession)

    @F.pandas_udf(PIECE)
    def cut(body: pd.Series) -> pd.Series:
        return pd.Series([[(at, at + len(p), count(p), p) for at, p in halved(t, lambda p, _: count(p) <= budget)] for t in body])

    kept = [c for c in steps.columns if c != text]
    return steps.select(*kept, F.explode(cut(F.coalesce(F.col(text), F.lit("")))).alias("__s")).select(*kept, "__s.*")


def token_chunks(steps: DataFrame, case: str, step: str, text: str, budget: int, count: Callable[[str], int], most_steps: int = 16) -> DataFrame:
    """token_pieces with batch: chunks within the token budget and of at most most_steps different steps."""
    pieces = token_pieces(steps, text, budget, count)
    return segment.greedy_pack(pieces, [case], [step, "start_char"], F.col("n_tokens"), budget, most_steps, distinct=step)


def excerpt_at(text: Column, start: Column, budget: int) -> tuple[Column, Column, Column]:
    """(start_byte, end_byte, content) of whole characters from a 0-based character on, within a byte budget."""
    content = segment.clip_bytes(F.substring(text, start + 1, F.length(text)), budget)
    first = F.octet_length(F.substring(text, F.lit(1), start))
    return first, first + F.octet_length(content), content


def signal_start(text: Column, patterns: list[str]) -> Column:
    """A little before the first match of the first pattern that matches; 0 without any."""
    before = [F.when(text.rlike(f"(?iu){p}"), F.length(F.regexp_extract(text, f"(?isu)^(.*?)(?:{p})", 1))) for p in patterns]
    return F.greatest(F.coalesce(*before, F.lit(0)) - BEFORE_SIGNAL, F.lit(0)).cast("int")


_EDGE = "[^a-zA-Z0-9_./:-]"


def term_start(text: Column, term: Column) -> Column:
    """A little before the term's first occurrence as a whole token; 0 for a null term."""
    whole = F.concat(F.lit(f"(?si)^((?:.*?{_EDGE})??)\\Q"), term, F.lit(f"\\E(?:{_EDGE}|$)"))
    found = F.length(F.call_function("regexp_extract", text, whole, F.lit(1)))
    return F.greatest(F.coalesce(found, F.lit(0)) - BEFORE_TERM, F.lit(0)).cast("int")


def rarest_term(steps: DataFrame, asked: DataFrame, case: str, step: str, text: str) -> DataFrame:
    """(case, step, term): the asked term (case, term) that the fewest steps of the case hold; of equals the one that comes first.

    That is the one of greatest idf, without comparing logarithms. A step's row meets its case's asked terms whole, and only those
    that it holds become rows. An excerpt is anchored on a whole
    Latin token; a bigram of a CJK run, which is a term of retrieval, is none.
    """
    words = asked.groupBy(case).agg(F.collect_set("term").alias("__asked"))
    own = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0))
    told = steps.join(words, case).select(case, step, own.alias("__own"), "__asked")
    hits = F.transform(F.array_intersect("__own", "__asked"), lambda t: F.struct(t.alias("term"), F.array_position("__own", t).alias("pos")))
    # all by case: steps that are dealt out by case aren't moved
    met = told.select(case, step, F.inline(hits)).groupBy(case, step, "term").agg(F.min("pos").alias("pos"))
    df = F.count("*").over(Window.partitionBy(case, "term"))
    return met.withColumn("df", df).groupBy(case, step).agg(F.min_by("term", F.struct("df", "pos")).alias("term"))


def outline(cards: DataFrame, case: str, meta: Column, text: str, budget: int, least: int = 80, frame: int = 32) -> DataFrame:
    """cards with extract (null: omitted) and whole_omitted: every card of a case gets the same share of the budget.

    meta is the size of what a card says besides its extract. Where even this exceeds the budget, the whole outline is omitted.
    """
    sized = cards.withColumn("__meta", meta.cast("long"))
    counts = sized.groupBy(case).agg(F.count("*").alias("__n"))
    room = F.floor(F.lit(budget) / F.col("__n")) - F.col("__meta") - frame
    shown = sized.join(counts, case).withColumn("extract", F.when(room >= least, segment.clip_middle(F.coalesce(F.col(text), F.lit("")), room)))
    total = shown.groupBy(case).agg((F.sum(F.col("__meta") + frame + F.coalesce(F.octet_length("extract"), F.lit(0))) > budget).alias("whole_omitted"))
    return shown.join(total, case).drop("__meta", "__n")


def shrink_rounds(records: DataFrame, case: str, size: Column, budget: int, keep: float = 0.75, least: int = 80, rounds: int = 30) -> DataFrame:
    """(case, rounds, total): how often each record's allowance shrinks to `keep` of it, `least` at least, until the case fits.

    rounds is null where the case doesn't fit after all rounds. All rounds are sums of one aggregation, combined before its shuffle.
    """
    level = records.select(case, size.cast("long").alias("r0"))
    for k in range(1, rounds + 1):
        level = level.withColumn(f"r{k}", F.least(F.col(f"r{k - 1}"), F.greatest(F.lit(least), F.floor(F.col(f"r{k - 1}") * keep))))
    sums = level.groupBy(case).agg(*[F.sum(f"r{k}").alias(f"r{k}") for k in range(rounds + 1)])
    first = F.coalesce(*[F.when(F.col(f"r{k}") <= budget, F.struct(F.lit(k).alias("rounds"), F.col(f"r{k}").alias("total"))) for k in range(rounds + 1)])
    return sums.select(case, first.alias("f")).select(case, "f.rounds", "f.total")
