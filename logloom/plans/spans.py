"""Registered queries of spans, packing, excerpts and outlines; with the DuckDB SQL that they are held against, where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.workers import dealt_once, kept_once
from ..operators import search, segment, spans
from . import adapters as A
from .catalogue import query
from .evidence import SIGNALS

#: Small budgets, so that the tables' short texts are cut, halved and packed as long logs are.
SPAN_BYTES, SEGMENT_BYTES, RECORDS = 64, 1800, 6
#: Bytes of text that a task of query_excerpt takes, about.
SHARE = 16_000_000
_JSON = "to_json({'step': step, 'name': name, 'role': role, 'content': content})::varchar"
_MARK = "chr(10) || '" + segment.MARK.strip("\n") + "' || chr(10)"
_WITH = "with recursive " + A.CTES["steps"]


def _spans(spark, d) -> DataFrame:
    s = A.steps(spark, d).select("conv_id", "step", "name", "role", "content")
    return spans.span_index(s, span_bytes=SPAN_BYTES, segment_bytes=SEGMENT_BYTES)


@query()
def evidence_spans(spark, d):
    return _spans(spark, d).drop("piece", "name", "role")


@query()
def evidence_segments(spark, d):
    return spans.span_segments(_spans(spark, d), segment_bytes=SEGMENT_BYTES, records=RECORDS).select("conv_id", "step", "ref", "batch")


@query(_WITH + " select conv_id, step, n_bytes as end_byte, sha256(content) as text_sha256, not (conv_id % 7 = 3 and step = 1) as valid from steps")
def span_read_hash(spark, d):
    """Every span is read back by its address and joined to its step's text; spans of some steps carry a forged digest."""
    forged = (F.col("conv_id") % 7 == 3) & (F.col("step") == 1)
    pointers = _spans(spark, d).select("conv_id", "step", "start_byte", "end_byte", F.when(forged, F.lit("forged")).otherwise(F.col("sha256")).alias("sha256"))
    read = spans.read_back(pointers, A.steps(spark, d), ["conv_id", "step"])
    parts = F.transform(F.sort_array(F.collect_list(F.struct("start_byte", F.col("bytes").cast("string").alias("t")))), lambda x: x["t"])
    return read.groupBy("conv_id", "step").agg(F.max("end_byte").cast("long").alias("end_byte"), F.sha2(F.array_join(parts, ""), 256).alias("text_sha256"), F.bool_and("valid").alias("valid"))


@query(_WITH + """, w as (select conv_id, count(*)::bigint as steps, sum(n_bytes)::bigint as n_bytes from steps group by 1) select *, true as once from w""")
def segment_coverage(spark, d):
    """Whether the segments hold every byte of a case exactly once, counted from the packed spans."""
    packed = spans.span_segments(_spans(spark, d), segment_bytes=SEGMENT_BYTES, records=RECORDS)
    g = packed.groupBy("conv_id").agg(F.countDistinct("step").alias("steps"), F.sum(F.col("end_byte") - F.col("start_byte")).alias("n_bytes"), F.count("*").alias("n"), F.countDistinct("ref").alias("u"), F.countDistinct("batch").alias("b"), F.max("batch").alias("last"))
    return g.select("conv_id", "steps", "n_bytes", ((F.col("n") == F.col("u")) & (F.col("b") == F.col("last") + 1)).alias("once"))


def _packed(size: str, budget: int, most: int, soft: str) -> str:
    full = f"p.cur + 1 + r.n > {budget} or p.k >= {most} or ({soft} and p.cur >= {budget // 2})"
    return f""", r as (select *, {size} as n, row_number() over (partition by conv_id order by step) as i from steps), p as (
      select conv_id, i, 0 as batch, (2 + n)::bigint as cur, 1 as k from r where i = 1
      union all select r.conv_id, r.i, case when {full} then p.batch + 1 else p.batch end, case when {full} then 2 + r.n else p.cur + 1 + r.n end, case when {full} then 1 else p.k + 1 end
      from p join r on r.conv_id = p.conv_id and r.i = p.i + 1) select r.conv_id, r.step, p.batch from p join r using (conv_id, i)"""


@query(_WITH + _packed(f"strlen({_JSON})::bigint", 900, 60, "false"))
def chunk_pack_json(spark, d):
    """Records as JSON in an array: brackets, commas, names and escapes count."""
    s = A.steps(spark, d).select("conv_id", "step", F.octet_length(F.to_json(F.struct("step", "name", "role", "content"))).alias("n"))
    return segment.greedy_pack(s, ["conv_id"], ["step"], F.col("n"), 900, 60, separator=1, base=2).select("conv_id", "step", "batch")


@query(_WITH + _packed("n_bytes", 900, 5, "(contains(r.name, '(->') or r.role in ('user', 'system'))"))
def boundary_pack(spark, d):
    s = A.steps(spark, d).select("conv_id", "step", "n_bytes", spans.boundary(F.col("name"), F.col("role"), F.lit(0)).alias("soft"))
    return segment.greedy_pack(s, ["conv_id"], ["step"], F.col("n_bytes"), 900, 5, separator=1, base=2, boundary=F.col("soft")).select("conv_id", "step", "batch")


def _words(text: str) -> int:
    return len(text.split())


@query()
def token_chunks(spark, d):
    s = A.steps(spark, d).select("conv_id", "step", "content")
    return spans.token_chunks(s, "conv_id", "step", "content", 20, _words, 3).select("conv_id", "step", "start_char", "end_char", "n_tokens", "batch")


def _fit(side: str, text: str, budget: str, most: int) -> str:
    """The longest prefix (left) or suffix (right) within a byte budget of at most `most`, by trying every length."""
    return f"{side}({text}, coalesce(list_max(list_filter(range(0, {most} + 1), lambda k: strlen({side}({text}, k)) <= {budget})), 0)::bigint)"


_HIT = "case " + " ".join(f"when regexp_matches(lower(content), '{p}') then strpos(lower(content), regexp_extract(lower(content), '{p}')) - 1" for p in SIGNALS.values()) + " else 0 end"


@query(_WITH + f" select conv_id, step, strlen(left(content, c))::bigint as start_byte, sha256({_fit('left', 'substr(content, c + 1)', '90', 90)}) as sha256 from (select *, greatest({_HIT} - 50, 0)::bigint as c from steps)")
def signal_excerpt(spark, d):
    text = F.col("content")
    at = A.steps(spark, d).select("conv_id", "step", "content", spans.signal_start(text, list(SIGNALS.values())).alias("c"))
    first, _, content = spans.excerpt_at(text, F.col("c"), 90)
    return at.select("conv_id", "step", first.cast("long").alias("start_byte"), F.sha2(content, 256).alias("sha256"))


_TERMS = """, tok as (select conv_id, step, unnest(l) as term, unnest(range(1, len(l) + 1)) as pos from (select conv_id, step, regexp_extract_all(lower(content), '[a-z0-9_./:-]{2,}') as l from steps)),
met as (select conv_id, step, term, min(pos) as pos from tok semi join (select conv_id, term from tok where step = 0) a using (conv_id, term) group by 1, 2, 3),
df as (select conv_id, term, count(*) as df from met group by 1, 2),
best as (select conv_id, step, arg_min(term, (df, pos)) as term from met join df using (conv_id, term) group by 1, 2),
x as (select s.conv_id, s.step, content, term, case when term is null then 0 else greatest(length(regexp_extract(content, '(?si)^((?:.*?[^a-zA-Z0-9_./:-])??)' || regexp_escape(term) || '(?:[^a-zA-Z0-9_./:-]|$)', 1)) - 90, 0) end as c from steps s left join best b on b.conv_id = s.conv_id and b.step = s.step where s.step > 0) """


@query(_WITH + _TERMS + f"select conv_id, step, term, strlen(left(content, c::bigint))::bigint as start_byte, sha256({_fit('left', 'substr(content, c::bigint + 1)', '120', 120)}) as sha256 from x")
def query_excerpt(spark, d):
    """An excerpt of each later step, around the rarest word that the case's task asks for."""
    own = A.steps(spark, d).select("conv_id", "step", "content", "n_bytes")
    shares = math.ceil((own.agg(F.sum("n_bytes")).first()[0] or 0) / SHARE)
    s = dealt_once(own.drop("n_bytes"), ["conv_id"], shares)
    asked = s.where("step = 0").select("conv_id", F.explode(tokens(F.col("content"))).alias("term"))
    best = kept_once(spans.rarest_term(s, asked, "conv_id", "step", "content"))
    n = max(shares, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = lambda df: df.repartition(n, "conv_id", "step")
    met = both(s.where("step > 0")).join(both(best), ["conv_id", "step"], "left")
    at = met.withColumn("c", spans.term_start(F.col("content"), F.col("term")))
    first, _, content = spans.excerpt_at(F.col("content"), F.col("c"), 120)
    return at.select("conv_id", "step", "term", first.cast("long").alias("start_byte"), F.sha2(content, 256).alias("sha256"))


_ROOM = "700 // n - strlen(m) - 32"
_HALF = f"(({_ROOM} - {len(segment.MARK)}) // 2)::bigint"


@query(_WITH + f""", c as (select conv_id, step, content, to_json({{'step': step, 'role': role}})::varchar as m, count(*) over (partition by conv_id) as n from steps),
x as (select *, case when {_ROOM} < 80 then null when strlen(content) <= {_ROOM} then content else {_fit('left', 'content', _HALF, 350)} || {_MARK} || {_fit('right', 'content', _HALF, 350)} end as extract from c)
select conv_id, step, sha256(extract) as sha256, sum(strlen(m) + 32 + coalesce(strlen(extract), 0)) over (partition by conv_id) > 700 as whole_omitted from x""")
def outline_cards(spark, d):
    cards = A.steps(spark, d).select("conv_id", "step", "content", F.octet_length(F.to_json(F.struct("step", "role"))).alias("m"))
    return spans.outline(cards, "conv_id", F.col("m"), "content", 700).select("conv_id", "step", F.sha2("extract", 256).alias("sha256"), "whole_omitted")


@query(_WITH + """, k as (select conv_id, step, n_bytes::bigint as a, 0 as rounds from steps union all select conv_id, step, least(a, greatest(20, floor(a * 0.75::double)))::bigint, rounds + 1 from k where rounds < 30),
t as (select conv_id, rounds, sum(a)::bigint as total from k group by 1, 2), f as (select conv_id, arg_min(rounds, rounds) as rounds, arg_min(total, rounds) as total from t where total <= 250 group by 1)
select c.conv_id, rounds, total from (select distinct conv_id from steps) c left join f using (conv_id)""")
def shrink_to_fit(spark, d):
    return spans.shrink_rounds(A.steps(spark, d), "conv_id", F.col("n_bytes"), 250, least=20)


@query()
def adaptive_tournament(spark, d):
    """Steps are candidates, their bytes the score and the room that they take; a system message is never sure."""
    s = A.steps(spark, d).select("conv_id", "step", "n_bytes", (F.col("n_bytes") + 100).alias("room"), (F.col("role") == "system").alias("unsure"))
    return search.adaptive_tournament(s, "conv_id", "step", "n_bytes", "room", "unsure", 600, 80)
