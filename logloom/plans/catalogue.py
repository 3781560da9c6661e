"""Registered queries of the log-analysis operators, each with the DuckDB SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SECRET, jaccard, normalize_role, recipient, terms, tokens, wilson
from ..functions.workers import kept_once
from ..operators import fusion, joins, metrics, policy, postings, ranks, retrieval, search, segment
from . import adapters as A
from .adapters import ctes

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


_TAIL = r"\s*\(\s*->.*$"


@query(ctes("steps") + rf"select conv_id, step, trim(regexp_replace(lower(name), '{_TAIL}', '')) as role_key, lower(regexp_extract(name, '\(\s*->\s*(.*?)\)', 1)) as recipient from steps")
def role_normalize(spark, d):
    return A.steps(spark, d).select("conv_id", "step", normalize_role(F.col("name")).alias("role_key"), recipient(F.col("name")).alias("recipient"))


@query(ctes("steps") + f"select conv_id, regexp_replace(lower(name), '{_TAIL}', '') as role_key, arg_min(name, step) as display from steps group by 1, 2")
def roles_per_case(spark, d):
    return A.steps(spark, d).groupBy("conv_id", normalize_role(F.col("name")).alias("role_key")).agg(F.min_by("name", "step").alias("display"))


@query(ctes("steps", "handoff") + "select conv_id, step, handoff_step::bigint as handoff_step, addressed from handoff")
def handoff_asof(spark, d):
    return joins.handoff_asof(A.steps(spark, d)).select("conv_id", "step", "handoff_step", "addressed")


@query(ctes("steps") + "select conv_id, step, lag(step) over w as previous_step, lead(step) over w as next_step from steps window w as (partition by conv_id order by step)")
def neighbours(spark, d):
    return joins.neighbours(A.steps(spark, d)).select("conv_id", "step", "previous_step", "next_step")


@query(ctes("steps") + "select a.conv_id, a.step as start, b.step, b.n_bytes from steps a join steps b on a.conv_id = b.conv_id and b.step between a.step - 3 and a.step - 1")
def overlap_context(spark, d):
    s = A.steps(spark, d)
    return joins.overlap_context(s.select("conv_id", F.col("step").alias("start")), s.select("conv_id", "step", "n_bytes"), "conv_id", "start", "step")


@query(ctes("steps") + "select conv_id, step, f = 1 as is_first from (select *, row_number() over (partition by conv_id order by step) as f, row_number() over (partition by conv_id order by step desc) as l from steps) where f = 1 or l <= 4")
def context_rows(spark, d):
    up, down = Window.partitionBy("conv_id").orderBy("step"), Window.partitionBy("conv_id").orderBy(F.desc("step"))
    s = A.steps(spark, d).withColumn("f", F.row_number().over(up)).withColumn("l", F.row_number().over(down))
    return s.where("f = 1 or l <= 4").select("conv_id", "step", (F.col("f") == 1).alias("is_first"))


@query(ctes("steps") + "select conv_id, count(*) as n_steps, min(step) = 0 and max(step) = count(*) - 1 and count(distinct step) = count(*) as contiguous from steps group by 1")
def step_contiguity_check(spark, d):
    return A.steps(spark, d).groupBy("conv_id").agg(F.count("*").alias("n_steps"), ((F.min("step") == 0) & (F.max("step") == F.count("*") - 1) & (F.countDistinct("step") == F.count("*"))).alias("contiguous"))


def _pack(source: str, key: str, order: str, size: str, budget: int, most: int | None = None, sep: int = 0) -> str:
    full = f"p.cur + {sep} + r.n > {budget}" + (f" or p.k >= {most}" if most else "")
    return f"""r as (select *, {size} as n, row_number() over (partition by {key} order by {order}) as i from {source}), p as (
      select {key}, i, 0 as batch, n::bigint as cur, 1 as k from r where i = 1
      union all select r.{key}, r.i, case when {full} then p.batch + 1 else p.batch end, case when {full} then r.n else p.cur + {sep} + r.n end, case when {full} then 1 else p.k + 1 end
      from p join r on r.{key} = p.{key} and r.i = p.i + 1)"""


@query("with recursive " + A.CTES["steps"] + ", " + _pack("steps", "conv_id", "step", "n_bytes", 1500, 4) + " select r.conv_id, r.step, p.batch from p join r using (conv_id, i)")
def chunk_pack_sum(spark, d):
    return segment.greedy_pack(A.steps(spark, d).select("conv_id", "step", "n_bytes"), ["conv_id"], ["step"], F.col("n_bytes"), 1500, 4).select("conv_id", "step", "batch")


@query("with recursive " + A.CTES["steps"] + ", " + _pack("steps", "conv_id", "step", "n_bytes", 2400, 60, 1) + " select r.conv_id, r.step, p.batch from p join r using (conv_id, i)")
def chunk_pack_joined(spark, d):
    return segment.greedy_pack(A.steps(spark, d).select("conv_id", "step", "n_bytes"), ["conv_id"], ["step"], F.col("n_bytes"), 2400, 60, 1).select("conv_id", "step", "batch")


@query("with recursive li as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem), " + _pack("li", "l_orderkey", "l_linenumber, l_partkey, l_suppkey, l_quantity", "l_quantity::bigint", 60) + " select l_orderkey, batch, count(*) as n_lines, sum(n)::bigint as quantity from p join r using (l_orderkey, i) group by 1, 2")
def line_pack_volume(spark, d):
    li = A.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    packed = segment.greedy_pack(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], F.col("l_quantity").cast("long"), 60)
    return packed.groupBy("l_orderkey", "batch").agg(F.count("*").alias("n_lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query()
def span_index(spark, d):
    return segment.utf8_pieces(A.load(spark, d, "documents").select("doc_id", "text"), "text", 2200).select("doc_id", "part", "start_byte", "end_byte", "sha256")


@query("select doc_id, sha256(coalesce(text, '')) as text_sha256, strlen(coalesce(text, ''))::bigint as n_bytes from documents")
def text_reassembly(spark, d):
    p = segment.utf8_pieces(A.load(spark, d, "documents").select("doc_id", "text"), "text", 2200)
    whole = p.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_byte", "piece"))).alias("ps"), F.max("end_byte").cast("long").alias("n_bytes"))
    return whole.select("doc_id", F.sha2(F.array_join(F.transform("ps", lambda x: x["piece"]), ""), 256).alias("text_sha256"), "n_bytes")


@query("select doc_id, sha256(text) as sha256, strlen(text)::bigint as n_bytes, sha256(left(text, 20)) as head_sha256 from documents")
def content_sha(spark, d):
    return A.load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.substring("text", 1, 20), 256).alias("head_sha256"))


@query("select doc_id, source, used_bytes from (select doc_id, source, (2 + sum(strlen(text) + 1) over (partition by source order by doc_id rows unbounded preceding))::bigint as used_bytes from documents) where used_bytes <= 9000")
def prefix_fit_packet(spark, d):
    docs = A.load(spark, d, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("n"))
    return segment.prefix_fit(docs, ["source"], "doc_id", F.col("n"), 9000).select("doc_id", "source", "used_bytes")


@query("select source, coalesce(max(w) filter (total <= 30000), -1)::bigint as width from (select source, w, sum(least(strlen(text), w)) as total from documents, (values (1800), (900), (300), (80)) as t(w) group by 1, 2) group by 1")
def width_ladder(spark, d):
    docs = A.load(spark, d, "documents").select("source", F.octet_length("text").alias("n"))
    sums = docs.groupBy("source").agg(*[F.sum(F.least("n", F.lit(w))).alias(f"w{w}") for w in (1800, 900, 300, 80)])
    pick = F.coalesce(*[F.when(F.col(f"w{w}") <= 30000, F.lit(w)) for w in (1800, 900, 300, 80)], F.lit(-1))
    return sums.select("source", pick.cast("long").alias("width"))


_TREE = "with recursive c as (select source, count(*)::bigint as n from documents group by 1), t as (select source, 0::bigint as start_seg, n as end_seg, 0 as depth from c union all select source, s, least(s + ceil((end_seg - start_seg) / 6.0)::bigint, end_seg), depth + 1 from (select *, unnest(range(start_seg, end_seg, ceil((end_seg - start_seg) / 6.0)::bigint)) as s from t where end_seg - start_seg > 1)) "


@query(_TREE + "select source, start_seg, end_seg, depth from t")
def segment_tree(spark, d):
    c = A.load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return segment.segment_tree(c, "source", "n")


@query(_TREE + "select source, count(*)::bigint as n_leaves, count(distinct start_seg) = count(*) and min(start_seg) = 0 and max(end_seg) = max(n) as covers from t join c using (source) where end_seg - start_seg = 1 group by 1")
def tree_audit(spark, d):
    c = A.load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    leaves = segment.segment_tree(c, "source", "n").where("end_seg - start_seg = 1")
    return leaves.groupBy("source").agg(F.count("*").alias("n_leaves"), F.countDistinct("start_seg").alias("u"), F.min("start_seg").alias("lo"), F.max("end_seg").alias("hi")).select("source", "n_leaves", ((F.col("u") == F.col("n_leaves")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n_leaves"))).alias("covers"))


@query(ctes("steps") + "select conv_id, count(*) as n_steps, sum(n_bytes)::bigint as n_bytes, case when sum(n_bytes) <= 3000 and count(*) <= 255 then 'full_context' else 'segmented' end as route from steps group by 1")
def route_full_vs_segmented(spark, d):
    return A.steps(spark, d).groupBy("conv_id").agg(F.count("*").alias("n_steps"), F.sum("n_bytes").alias("n_bytes")).withColumn("route", F.when((F.col("n_bytes") <= 3000) & (F.col("n_steps") <= 255), "full_context").otherwise("segmented"))


@query("select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_./:-]{2,}'))::bigint as n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_./:-]{3,}')))::bigint as n_terms from documents")
def token_counts(spark, d):
    return A.load(spark, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(terms(F.col("text"))).cast("long").alias("n_terms"))


_BM25 = """with tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]{2,}')) as term from documents), tf as (select doc_id, term, count(*)::double as tf from tok group by 1, 2),
len as (select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_./:-]{2,}'))::double as n from documents), f as (select count(*)::double as nd, greatest(avg(n), 1) as av from len), df as (select term, count(*)::double as df from tf group by 1),
q as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]{2,}')) as term from benchmark),
s as (select item_id, doc_id, round(sum(ln(1 + (nd - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * n / av))), 6) as score from q join tf using (term) join df using (term) join len using (doc_id), f group by 1, 2),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) """


def _asked(spark, d) -> DataFrame:
    return postings.asked_terms(A.load(spark, d, "benchmark"), "item_id", "text")


def _indexed(spark, d) -> postings.Postings:
    """The documents' postings of the terms that the benchmark asks for."""
    return postings.Postings(A.load(spark, d, "documents"), "doc_id", "text", _asked(spark, d))


@query(_BM25 + "select item_id, doc_id, score, rank from r where rank <= 10")
def bm25_multi_query(spark, d):
    with _indexed(spark, d) as index:
        return kept_once(index.ranked(_asked(spark, d), "item_id", 10).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank")))


@query(_BM25 + "select doc_id, round(sum(1.0::double / (60 + rank)), 9) as score, row_number() over (order by round(sum(1.0::double / (60 + rank)), 9) desc, doc_id) as rank from r where rank <= 10 group by 1")
def rrf_fuse(spark, d):
    """The first ten rows of each ranking, as many as the queries in all, fused."""
    return retrieval.fuse(bm25_multi_query(spark, d).withColumn("all", F.lit(0)), ["all"], "doc_id", source="item_id").select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(_BM25 + """, l as (select item_id, list(doc_id order by rank) as l from r group by 1), one as (select min(item_id) as item_id from l group by l),
fused as (select doc_id, round(sum(1.0::double / (60 + rank)), 9) as score from r semi join one using (item_id) group by 1 union all select distinct doc_id, 1.0::double from documents where not exists (select 1 from r))
select doc_id, score, row_number() over (order by score desc, doc_id) as rank from fused""")
def rrf_fuse_whole(spark, d):
    """Complete rankings, equal ones once."""
    out = fusion.fused_whole(A.load(spark, d, "documents"), "doc_id", "text", _asked(spark, d), "item_id")
    return out.select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query()
def evidence_retrieve(spark, d):
    """The first five spans of each kind for the predicted step of each case; idf_overlap_retrieve is the part that its SQL says."""
    spans = segment.utf8_pieces(A.steps(spark, d), "content", 2200).select("conv_id", "step", "name", "start_byte", F.col("piece").alias("text"), F.format_string("s%d:%d:%d", "step", "start_byte", "end_byte").alias("ref"))
    kinds = F.explode(F.array(*[F.lit(k) for k in ("upstream", "repair", "challenge")])).alias("kind")
    asked = A.predictions(spark, d).select("conv_id", F.col("predicted_step").alias("step"), kinds)
    return retrieval.evidence(spans, asked).where("rank <= 5").withColumn("rank", F.col("rank").cast("long"))


_T = "'[\\p{L}\\p{N}\\p{M}_./:-]{3,}'"


@query(f"with own as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), {_T}))) as term from documents), q as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), {_T}))) as term from benchmark), idf as (select term, ln(1 + (select count(*) from documents)::double / count(*)) as idf from own group by 1), s as (select item_id, doc_id, round(sum(idf), 6) as score from q join own using (term) join idf using (term) group by 1, 2) select * from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s) where rank <= 5")
def idf_overlap_retrieve(spark, d):
    out = retrieval.overlap_idf(A.load(spark, d, "documents"), A.load(spark, d, "benchmark").withColumnRenamed("text", "query_text"), "doc_id", "text", "item_id", "query_text")
    return out.where("rank <= 5").withColumn("rank", F.col("rank").cast("long"))


@query(ctes("steps") + f", t as (select conv_id, step, list_distinct(regexp_extract_all(lower(content), {_T})) as ts from steps) select a.conv_id, a.step, b.step as other, round(len(list_intersect(a.ts, b.ts))::double / greatest(len(list_distinct(list_concat(a.ts, b.ts))), 1), 6) as likeness from t a join t b on a.conv_id = b.conv_id and a.step < b.step")
def jaccard_pairs(spark, d):
    t = A.steps(spark, d).select("conv_id", "step", terms(F.col("content")).alias("ts"))
    b = t.select("conv_id", F.col("step").alias("other"), F.col("ts").alias("us"))
    return t.join(b, "conv_id").where("step < other").select("conv_id", "step", "other", F.round(jaccard(F.col("ts"), F.col("us")), 6).alias("likeness"))


@query()
def clip_excerpt(spark, d):
    out = segment.clip(A.steps(spark, d), "content", 200, "excerpt")
    return out.select("conv_id", "step", "excerpt", F.octet_length("excerpt").alias("excerpt_bytes"))


@query()
def mmr_select(spark, d):
    """Five documents for each query, alike ones put back; documents of one source count as alike in full."""
    docs = A.load(spark, d, "documents")
    with _indexed(spark, d) as index:
        return postings.diverse_refs(index, docs, _asked(spark, d), "item_id", "text", "source", 5)


@query(ctes("answers") + "select question, option, rank from (select *, row_number() over (partition by question order by (option = choice) desc, p desc, option) as rank from answers) where rank <= 3")
def topk_forced_winner(spark, d):
    return policy.top_k_forced(A.answers(spark, d), 3).select("question", "option", F.col("rank").cast("long").alias("rank"))


@query(ctes("answers") + "select question, option, round(p, 6) as p from answers a where (select coalesce(sum(p), 0) from answers b where b.question = a.question and b.p > a.p) < 0.7::double - 1e-12")
def adaptive_set(spark, d):
    return policy.adaptive_set(A.answers(spark, d), 0.7).select("question", "option", F.round("p", 6).alias("p"))


@query(ctes("answers") + "select question, count(*) = count(distinct option) and min(p) >= 0 and abs(sum(p) - 1) <= 0.025 as valid from answers group by 1")
def distribution_validate(spark, d):
    return policy.valid_distributions(A.answers(spark, d))


@query(ctes("answers") + "select question, count(*) as n_options, (list(option order by p desc, option))[1] as best, round(max(p), 6) as best_p, round(case when count(*) = 1 then 0 else -sum(p * ln(p)) / ln(count(*)::double) end, 6) as entropy from answers group by 1")
def entropy_argmax(spark, d):
    return policy.entropy_argmax(A.answers(spark, d)).withColumn("entropy", F.round("entropy", 6)).withColumn("best_p", F.round("best_p", 6))


_CONF = ctes("answers", "truth") + """, j as (select kind, question, option, p, truth, coalesce(max(case when option = truth then p end) over (partition by question), 0) as t, row_number() over (partition by question order by p desc, option) as r from answers join truth using (question)),
e as (select kind, question, least(1.0::double, sum(case when p >= t then p else 0 end)) as s, max(case when r = 1 and option = truth then 1 else 0 end) as hit, max(p) as top, sum(power(p - case when option = truth then 1 else 0 end, 2)) as b from j group by 1, 2),
k as (select *, row_number() over (partition by kind order by s, question) as rank, count(*) over (partition by kind) as n from e)
select kind, count(*) as n, round(coalesce(max(case when rank = ceil((n + 1) * 0.9::double) then s end), 1), 6) as mass, round(avg(hit), 6) as top1_accuracy, round(avg(top), 6) as mean_max_probability, round(avg(b), 6) as brier from k group by 1"""


@query(_CONF)
def conformal_calibration(spark, d):
    out = policy.conformal_calibration(A.answers(spark, d), A.truth(spark, d))
    return out.select("kind", "n", *[F.round(c, 6).alias(c) for c in ("mass", "top1_accuracy", "mean_max_probability", "brier")])


@query(_CONF.replace("select kind, count(*) as n, round(coalesce(", ", cal as (select kind, coalesce(", 1).replace("then s end), 1), 6) as mass, round(avg(hit), 6) as top1_accuracy, round(avg(top), 6) as mean_max_probability, round(avg(b), 6) as brier from k group by 1", "then s end), 1) as mass from k group by 1) select a.question, a.option from answers a join truth using (question) join cal using (kind) where mass >= 1 or (select coalesce(sum(p), 0) from answers b where b.question = a.question and b.p > a.p) < mass - 1e-12"))
def thresholded_set(spark, d):
    cal, truth = policy.conformal_calibration(A.answers(spark, d), A.truth(spark, d)).select("kind", "mass"), A.truth(spark, d)
    a = A.answers(spark, d).join(truth.join(cal, "kind", "left").select("question", F.coalesce("mass", F.lit(0.9)).alias("mass")), "question")
    return policy.adaptive_set(a, "mass").select("question", "option")


@query(ctes("steps") + "select conv_id, step from (select *, row_number() over (partition by conv_id, g order by n_bytes desc, step) as r from (select *, (row_number() over (partition by conv_id order by step) - 1) // 4 as g from steps)) where r <= 2")
def tournament_round(spark, d):
    return search.tournament_round(A.steps(spark, d), "conv_id", "step", "n_bytes", 4, 2).select("conv_id", "step")


@query()
def tournament_full(spark, d):
    docs = A.load(spark, d, "documents").select("source", "doc_id", "n_chars")
    return search.tournament(docs, "source", "doc_id", "n_chars").select("source", "doc_id")


@query(ctes("steps", "handoff") + ", t as (select conv_id, step, step as reached, 0 as hops from steps union all select t.conv_id, t.step, h.handoff_step, t.hops + 1 from t join handoff h on h.conv_id = t.conv_id and h.step = t.reached where t.hops < 2 and h.handoff_step is not null) select conv_id, step, reached, min(hops) as hops from t group by 1, 2, 3")
def handoff_trace_depth2(spark, d):
    h = joins.handoff_asof(A.steps(spark, d)).select("conv_id", "step", "handoff_step")
    return joins.trace(h, h.select("conv_id", "step"), "conv_id", "step", "handoff_step")


def _scored(spark, d):
    return metrics.score_rows(A.gold(spark, d), A.predictions(spark, d))


_SCORED = ctes("steps", "gold", "pred", "scored")
_METRICS = "count(*) as n, round(avg(role_correct::int), 6) as role, round(avg(step_exact::int), 6) as exact, round(avg(step_near::int), 6) as near, round(avg(step_error), 6) as mae"


@query(_SCORED + "select conv_id, role_correct, step_exact, step_near, step_error::bigint as step_error from scored")
def score_rows(spark, d):
    return _scored(spark, d).select("conv_id", "role_correct", "step_exact", "step_near", "step_error")


@query(_SCORED + f"select {_METRICS} from scored")
def metrics_overall(spark, d):
    return metrics.metrics(_scored(spark, d))


@query(_SCORED + f", m as (select *, case when predicted_step is null then 'missing' else 'longest' end as method from scored) select source, method, {_METRICS} from m group by grouping sets ((), (source), (method))")
def metrics_grouping_sets(spark, d):
    s = _scored(spark, d).withColumn("method", F.when(F.col("predicted_step").isNull(), "missing").otherwise("longest"))
    return s.groupingSets([[], ["source"], ["method"]], "source", "method").agg(*metrics.metric_columns())


@query(_SCORED + "select case when count(*) filter (mae is null) = 0 then round(sum(n * mae) / sum(n), 6) end as weighted_mae from (select source, count(*) as n, avg(step_error) as mae from scored group by 1)")
def weighted_mae(spark, d):
    return metrics.weighted_mae(_scored(spark, d), "source")


_FUNNEL = _SCORED.replace("with recursive ", "with recursive ", 1) + ", ranked as (select conv_id, step, row_number() over (partition by conv_id order by n_bytes desc, step) as r from steps), cand as (select conv_id, list(step) filter (r <= 3) as recall, list(step) filter (r <= 2) as final from ranked group by 1), f as (select s.*, list_contains(recall, mistake_step) as recalled, list_contains(final, mistake_step) as reduced from scored s join cand using (conv_id)) "


def _funnel(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("n_bytes"), "step")
    c = A.steps(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("conv_id").agg(F.collect_list("step").alias("recall"), F.collect_list(F.when(F.col("r") <= 2, F.col("step"))).alias("final"))
    return _scored(spark, d).join(c, "conv_id").withColumn("recalled", F.array_contains("recall", F.col("mistake_step"))).withColumn("reduced", F.array_contains("final", F.col("mistake_step")))


@query(_FUNNEL + "select count(*) as n, count(*) filter (recalled) as recalled, count(*) filter (reduced) as reduced, count(*) filter (step_exact) as exact from f")
def funnel(spark, d):
    return _funnel(spark, d).agg(F.count("*").alias("n"), F.count_if("recalled").alias("recalled"), F.count_if("reduced").alias("reduced"), F.count_if("step_exact").alias("exact"))


@query(_FUNNEL + "select source, round(avg(recalled::int), 6) as recall_rate, round(avg(reduced::int), 6) as final_rate from f group by 1")
def candidate_recall(spark, d):
    return _funnel(spark, d).groupBy("source").agg(metrics.share("recalled").alias("recall_rate"), metrics.share("reduced").alias("final_rate"))


@query(_FUNNEL + "select source, case when step_exact then 'correct' when n_steps <= 2 then 'direct_wrong' when not recalled then 'recall_miss' when not reduced then 'reduction_drop' else 'final_wrong' end as stage, count(*) as n from f group by 1, 2")
def loss_stage(spark, d):
    stage = metrics.loss_stage(F.col("recalled"), F.col("reduced"), F.col("step_exact"), F.col("n_steps") <= 2)
    return _funnel(spark, d).groupBy("source", stage.alias("stage")).agg(F.count("*").alias("n"))


@query(_SCORED + "select * from (select mistake_agent, predicted_role, count(*) as n from scored where predicted_role is not null and not role_correct group by 1, 2) order by n desc, mistake_agent, predicted_role limit 20")
def confusion_topk(spark, d):
    return _scored(spark, d).where("predicted_role is not null and not role_correct").groupBy("mistake_agent", "predicted_role").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mistake_agent", "predicted_role").limit(20)


@query(_SCORED + "select role_correct, step_exact, count(*) as n from scored group by 1, 2")
def joint_table(spark, d):
    return _scored(spark, d).groupBy("role_correct", "step_exact").agg(F.count("*").alias("n"))


@query(_SCORED + "select count(*) filter (predicted_step < mistake_step) as early, count(*) filter (predicted_step > mistake_step) as late, count(*) filter (step_near and not step_exact) as close from scored")
def error_direction(spark, d):
    return _scored(spark, d).agg(F.count_if(F.col("predicted_step") < F.col("mistake_step")).alias("early"), F.count_if(F.col("predicted_step") > F.col("mistake_step")).alias("late"), F.count_if(F.col("step_near") & ~F.col("step_exact")).alias("close"))


@query(_SCORED + f"select case when n_steps <= 2 then '1-2' when n_steps <= 4 then '3-4' when n_steps <= 6 then '5-6' else '>6' end as bucket, {_METRICS} from scored group by 1")
def length_buckets(spark, d):
    n = F.col("n_steps")
    return metrics.metrics(_scored(spark, d).withColumn("bucket", F.when(n <= 2, "1-2").when(n <= 4, "3-4").when(n <= 6, "5-6").otherwise(">6")), "bucket")


@query(_SCORED + ", m as (select avg(role_correct::int) as p, count(*)::double as n from scored) select round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as high from m, (select 1.959963984540054::double as z)")
def wilson_ci(spark, d):
    m = _scored(spark, d).agg(F.avg(F.col("role_correct").cast("double")).alias("p"), F.count("*").cast("double").alias("n"))
    low, high = wilson(F.col("p"), F.col("n"))
    return m.select(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(ctes("steps", "gold") + "select round(avg(1.0::double / n_steps), 6) as exact_chance, round(avg((least(mistake_step + 5, n_steps - 1) - greatest(mistake_step - 5, 0) + 1)::double / n_steps), 6) as near_chance from gold")
def chance_level(spark, d):
    g, n, at = A.gold(spark, d), F.col("n_steps").cast("double"), F.col("mistake_step")
    return g.agg(F.round(F.avg(1.0 / n), 6).alias("exact_chance"), F.round(F.avg((F.least(at + 5, F.col("n_steps") - 1) - F.greatest(at - 5, F.lit(0)) + 1) / n), 6).alias("near_chance"))


@query("select event_type, round(median(value), 6) as median, round(max(case when r = ceil(0.95::double * n) then value end), 6) as p95_nearest_rank, round(max(case when r = floor(0.95::double * (n - 1)) + 1 then value end), 6) as p95_floor_index from (select event_type, value::double as value, row_number() over (partition by event_type order by value, event_id) as r, count(*) over (partition by event_type) as n from events) group by 1")
def median_p95(spark, d):
    v = A.load(spark, d, "events").select("event_type", F.col("value").cast("double").alias("v"))
    at = ranks.value_at_ranks(v, ["event_type"], "v", {"lo": lambda n: F.floor((n + 1) / 2), "hi": lambda n: F.ceil((n + 1) / 2), "p95": lambda n: F.ceil(0.95 * n), "p95_floor": lambda n: F.floor(0.95 * (n - 1)) + 1})
    return at.select("event_type", F.round((F.col("lo") + F.col("hi")) / 2, 6).alias("median"), F.round("p95", 6).alias("p95_nearest_rank"), F.round("p95_floor", 6).alias("p95_floor_index"))


@query(_SCORED + "select source, conv_id, step_error::bigint as step_error from scored where step_error is not null qualify row_number() over (partition by source order by step_error desc, conv_id) = 1")
def worst_per_source(spark, d):
    return _scored(spark, d).where("step_error is not null").groupBy("source").agg(F.max(F.struct("step_error", -F.col("conv_id"))).alias("w")).select("source", (-F.col("w.col2")).alias("conv_id"), "w.step_error")


_CASES = ctes("steps") + ", c as (select conv_id, conv_id % 5 as source, sum(n_bytes) as b from steps group by 1), k as (select *, row_number() over (partition by source order by b, conv_id) as r, count(*) over (partition by source) as n from c) "


def _cases(spark, d):
    c = A.steps(spark, d).groupBy("conv_id").agg(F.sum("n_bytes").alias("b"))
    return c.withColumn("source", F.pmod("conv_id", F.lit(5)))


def _ranked_cases(spark, d):
    return ranks.grouped_rank(_cases(spark, d), ["source"], "b", "conv_id", "r")


@query(_CASES + "select source, conv_id from k where r = 1")
def smoke_sample(spark, d):
    return _cases(spark, d).groupBy("source").agg(F.min_by("conv_id", F.struct("b", "conv_id")).alias("conv_id"))


@query(_CASES + "select source, conv_id from k where r = n // 2 + 1")
def pilot_sample(spark, d):
    n = _cases(spark, d).groupBy("source").agg((F.floor(F.count("*") / 2) + 1).alias("middle"))
    return ranks.null_safe_join(_ranked_cases(spark, d), n, ["source"]).where("r = middle").select("source", "conv_id")


@query(_CASES + "select source, conv_id, (r - 1) % 4 as shard from k")
def shard_assign(spark, d):
    return _ranked_cases(spark, d).select("source", "conv_id", F.pmod(F.col("r") - 1, F.lit(4)).cast("long").alias("shard"))


@query(ctes("calls") + "select case_id, count(*) as calls, sum(tokens)::bigint as tokens, case when count(cost) = count(*) then round(sum(cost), 4) end as cost, count(*) filter (phase = 'error') as errors, round(sum(tokens) * 0.042::double / 1e6, 9) as list_price from calls group by 1")
def usage_accounting(spark, d):
    return A.calls(spark, d).groupBy("case_id").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.when(F.count("cost") == F.count("*"), F.round(F.sum("cost"), 4)).alias("cost"), F.count_if(F.col("phase") == "error").alias("errors"), F.round(F.sum("tokens") * F.lit(0.042) / 1e6, 9).alias("list_price"))


@query(ctes("calls") + "select case_id, arg_max(cost, (ts, event_id)) as balance from calls group by 1")
def latest_balance(spark, d):
    return A.calls(spark, d).groupBy("case_id").agg(F.max_by("cost", F.struct("ts", "event_id")).alias("balance"))


@query(ctes("calls") + "select phase, count(*) as n, count(distinct case_id) as cases from calls group by 1")
def calls_by_phase(spark, d):
    return A.calls(spark, d).groupBy("phase").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


def _stop(calls: int, toks: int, why1: str, why2: str) -> str:
    return ctes("calls") + f", w as (select *, row_number() over (partition by case_id order by ts, event_id) as n, sum(tokens) over (partition by case_id order by ts, event_id rows unbounded preceding) as used from calls), y as (select *, case when n > {calls} then '{why1}' when used > {toks} then '{why2}' end as why from w) select case_id, min(n) filter (why is not null) as stop_at, arg_min(why, n) filter (why is not null) as reason from y group by 1"


@query(_stop(24, 2000, "call_budget", "input_token_budget"))
def budget_running_stop(spark, d):
    return search.budget_stop(A.calls(spark, d), "case_id", ["ts", "event_id"], "tokens", 24, 2000)


@query(_stop(22, 1500, "reserved_final_calls", "reserved_final_tokens"))
def reserved_budget_stop(spark, d):
    return search.budget_stop(A.calls(spark, d), "case_id", ["ts", "event_id"], "tokens", 24, 2000, 2, 500)


@query(ctes("calls") + "select case_id, event_id, ceil(100 * greatest(0.5::double, 1.25::double * coalesce(max(tokens / 100.0::double) over (partition by case_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)))::bigint + 512 as estimate from calls")
def token_estimate(spark, d):
    w = Window.partitionBy("case_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    ratio = F.coalesce(F.max(F.col("tokens") / 100.0).over(w), F.lit(0.0))
    return A.calls(spark, d).select("case_id", "event_id", (F.ceil(100 * F.greatest(F.lit(0.5), 1.25 * ratio)) + 512).alias("estimate"))


@query(_SCORED + f", base as (select conv_id, step_exact as base_exact from scored where predicted_step is not null) select count(*) as n, round(avg(step_exact::int), 6) as exact, round(avg(base_exact::int), 6) as base_exact, count(*) = (select count(*) from base) as complete from scored join base using (conv_id)")
def cohort_match(spark, d):
    s = _scored(spark, d)
    base = s.where("predicted_step is not null").select("conv_id", F.col("step_exact").alias("base_exact"))
    return s.join(base, "conv_id").agg(F.count("*").alias("n"), metrics.share("step_exact").alias("exact"), metrics.share("base_exact").alias("base_exact")).join(F.broadcast(base.agg(F.count("*").alias("want")))).select("n", "exact", "base_exact", (F.col("n") == F.col("want")).alias("complete"))


@query(_SCORED + "select round(avg(step_exact::int) filter (predicted_step is not null), 6) as exact_completed, round(avg(step_exact::int), 6) as exact_all, count(*) filter (predicted_step is null) as missing from scored")
def missing_as_wrong(spark, d):
    return _scored(spark, d).agg(F.round(F.avg(F.when(F.col("predicted_step").isNotNull(), F.col("step_exact").cast("double"))), 6).alias("exact_completed"), metrics.share("step_exact").alias("exact_all"), F.count_if(F.col("predicted_step").isNull()).alias("missing"))


@query(ctes("steps", "gold", "pred") + "select conv_id from gold where conv_id not in (select conv_id from pred)")
def resume_antijoin(spark, d):
    return joins.resume_todo(A.gold(spark, d), A.predictions(spark, d), "conv_id").select("conv_id")


@query("select count(*) as subset_rows, 0::bigint as mismatches from documents where doc_id % 3 = 0")
def subset_hash_join(spark, d):
    docs = A.load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    part = docs.where("doc_id % 3 = 0")
    bad = joins.subset_mismatch(part, docs, "doc_id", "h")
    return part.agg(F.count("*").alias("subset_rows")).join(F.broadcast(bad.agg(F.count("*").alias("mismatches"))))


@query(ctes("calls") + "select 'tokens_negative' as check, count(*) filter (tokens < 0) as violations from calls union all select 'case_missing', count(*) filter (case_id is null) from calls union all select 'repeated_event', count(*) - count(distinct event_id) from calls")
def audit_violations(spark, d):
    c = A.calls(spark, d)
    row = c.agg(F.count_if(F.col("tokens") < 0).alias("tokens_negative"), F.count_if(F.col("case_id").isNull()).alias("case_missing"), (F.count("*") - F.countDistinct("event_id")).alias("repeated_event"))
    return row.select(F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in row.columns]), F.array(*row.columns))).alias("check", "violations"))


@query(ctes("steps", "pred") + "select count(*) as n, 0::bigint as mismatches from pred")
def replay_mismatch(spark, d):
    """The method run again, over a different plan, against the stored predictions."""
    s = A.steps(spark, d).where("conv_id % 10 <> 0")
    again = s.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n_bytes"), "step"))).where("r = 1").select("conv_id", F.col("step").alias("again"))
    j = A.predictions(spark, d).join(again, "conv_id", "left")
    return j.agg(F.count("*").alias("n"), F.count_if(~F.col("predicted_step").eqNullSafe(F.col("again"))).alias("mismatches"))


@query(f"select doc_id, regexp_matches(text, '{SECRET}') as has_secret from documents")
def secret_scan(spark, d):
    return A.load(spark, d, "documents").select("doc_id", F.col("text").rlike(SECRET).alias("has_secret"))
