"""The baseline attribution from end to end, driven by the lexical choice model, with the DuckDB SQL that it is held against.

A case whose whole log fits a request is asked directly. Of the others, each segment names its likeliest steps, the hand-offs before
these join them, and a tournament leaves as many as one last question offers; it names the step and the responsible role.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import evidence_terms, normalize_role
from ..operators import choice, joins, metrics, policy, search, segment
from . import adapters as A
from .catalogue import _METRICS, _TAIL, query
from .directories import _FLAGS, _SCORE, _terms
from .evidence import SIGNALS

#: Bytes of a whole log that is asked directly, bytes and steps of a segment, steps that a segment names, and the size of a tournament's group.
DIRECT, SEGMENT, STEPS, RECALL, GROUP = 1000, 1500, 4, 2, 4


def _suspects(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, step, role, name, n_bytes, score: what each step scores as the cause, given the case's task and outcome."""
    s = A.steps(spark, d)
    ends = s.groupBy("conv_id").agg(F.min_by("content", "step").alias("first"), F.max_by("content", "step").alias("last"))
    asked = ends.select("conv_id", evidence_terms(F.concat_ws(" ", "first", "last")).alias("asked"))
    overlap = F.size(F.array_intersect(evidence_terms(F.col("content")), F.col("asked")))
    return s.join(asked, "conv_id").select("conv_id", "step", "role", "name", "n_bytes", choice.suspicion(choice.signals(F.col("content"), SIGNALS), overlap).alias("score"))


def attributed(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, method, segments, recalled, expanded, final (steps), predicted_step, step_p, predicted_role, role_p."""
    s = _suspects(spark, d)
    case = Window.partitionBy("conv_id")
    s = s.withColumn("direct", (F.sum("n_bytes").over(case) <= DIRECT) & (F.count("*").over(case) <= 255))
    packed = segment.greedy_pack(s.where("not direct").select("conv_id", "step", "n_bytes", "score"), ["conv_id"], ["step"], F.col("n_bytes"), SEGMENT, STEPS)
    told = choice.distribution(packed, ["conv_id", "batch"], "step", "score")
    named = policy.top_k_forced(told.withColumn("question", F.struct("conv_id", "batch")), RECALL, option="step")
    handoffs = joins.handoff_asof(A.steps(spark, d)).select("conv_id", "step", "handoff_step")
    expanded = named.join(handoffs, ["conv_id", "step"]).select("conv_id", F.explode(F.array_compact(F.array("step", "handoff_step"))).alias("step")).distinct()
    # within a group likelier means of a higher score
    final = search.tournament(expanded.join(s.select("conv_id", "step", "score"), ["conv_id", "step"]), "conv_id", "step", "score", limit=GROUP, group=GROUP, keep=RECALL)
    direct = s.where("direct").select("conv_id", "step", "score")
    last = choice.distribution(final.select("conv_id", "step", "score").unionByName(direct), ["conv_id"], "step", "score")
    steps = lambda df, name: df.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("step")).cast("array<string>"), ",").alias(name))
    roles = last.join(s.select("conv_id", "step", normalize_role(F.col("name")).alias("role_key")), ["conv_id", "step"]).groupBy("conv_id", "role_key").agg(F.round(F.sum("p"), 6).alias("role_p"))
    who = roles.groupBy("conv_id").agg(F.min_by(F.struct("role_key", "role_p"), F.struct(-F.col("role_p"), "role_key")).alias("r"))
    where = last.groupBy("conv_id").agg(F.max(F.when(F.col("step") == F.col("choice"), F.struct("step", F.round("p", 6).alias("p")))).alias("b"))
    batches = packed.groupBy("conv_id").agg((F.max("batch") + 1).cast("long").alias("segments"))
    out = where.join(who, "conv_id").join(steps(last, "final"), "conv_id").join(batches, "conv_id", "left").join(steps(named, "recalled"), "conv_id", "left").join(steps(expanded, "expanded"), "conv_id", "left")
    is_direct = F.col("segments").isNull()
    return out.select(
        "conv_id", F.when(is_direct, "full_context").otherwise("segmented_choice").alias("method"), F.coalesce("segments", F.lit(1).cast("long")).alias("segments"),
        F.coalesce("recalled", "final").alias("recalled"), F.coalesce("expanded", "final").alias("expanded"), "final",
        F.col("b.step").alias("predicted_step"), F.col("b.p").alias("step_p"), F.col("r.role_key").alias("predicted_role"), F.col("r.role_p").alias("role_p"),
    )


def _round(source: str, out: str) -> str:
    """A tournament's round over (conv_id, step, score) in SQL."""
    return f"""{out}g as (select *, (row_number() over (partition by conv_id order by step) - 1) // {GROUP} as g, count(*) over (partition by conv_id) as n from {source}),
{out} as (select conv_id, step, score from (select *, row_number() over (partition by conv_id, g order by score desc, step) as r from {out}g) where n <= {GROUP} or r <= {RECALL})"""


_KEY = f"trim(regexp_replace(lower(name), '{_TAIL}', ''))"
_ATTRIBUTED = f"""with recursive {A.CTES["steps"]}, {A.CTES["handoff"]},
q as (select conv_id, {_terms("arg_min(content, step) || ' ' || arg_max(content, step)")} as asked from steps group by 1),
f as (select *, {_FLAGS}, len(list_intersect({_terms("content")}, asked)) as overlap from steps join q using (conv_id)),
s as (select conv_id, step, name, n_bytes, {_SCORE} as score, sum(n_bytes) over (partition by conv_id) <= {DIRECT} as direct, row_number() over (partition by conv_id order by step) as i
  from (select * exclude ("constraint"), "constraint" as constraint_ from f)),
pack as (select conv_id, i, step, score, 0 as batch, n_bytes::bigint as cur, 1 as k from s where i = 1 and not direct
  union all select s.conv_id, s.i, s.step, s.score, case when full_ then batch + 1 else batch end, case when full_ then n_bytes else cur + n_bytes end, case when full_ then 1 else k + 1 end
  from (select p.conv_id as c, p.i as j, p.batch, p.cur, p.k, p.cur + x.n_bytes > {SEGMENT} or p.k >= {STEPS} as full_ from pack p join s x on x.conv_id = p.conv_id and x.i = p.i + 1) p join s on s.conv_id = p.c and s.i = p.j + 1),
named as (select conv_id, step, score from pack qualify row_number() over (partition by conv_id, batch order by score desc, step) <= {RECALL}),
expanded as (select distinct e.conv_id, e.step, s.score from (select conv_id, step from named union all select n.conv_id, handoff_step from named n join handoff h on h.conv_id = n.conv_id and h.step = n.step where handoff_step is not null) e join s using (conv_id, step)),
{_round("expanded", "t1")}, {_round("t1", "t2")}, {_round("t2", "t3")},
final as (select * from t3 union all select conv_id, step, score from s where direct),
told as (select *, round(exp(score - mx) / sum(exp(score - mx)) over (partition by conv_id), 9) as p from (select *, max(score) over (partition by conv_id) as mx from final)),
roles as (select conv_id, {_KEY} as role_key, round(sum(p), 6) as role_p from told join s using (conv_id, step) group by 1, 2),
who as (select * from roles qualify row_number() over (partition by conv_id order by role_p desc, role_key) = 1),
spot as (select * from told qualify row_number() over (partition by conv_id order by p desc, step) = 1),
lists as (select conv_id, string_agg(step::varchar, ',' order by step) as final from told group by 1),
attributed as (select spot.conv_id, case when b.n is null then 'full_context' else 'segmented_choice' end as method, coalesce(b.n, 1)::bigint as segments, coalesce(r.l, lists.final) as recalled, coalesce(e.l, lists.final) as expanded, lists.final,
  spot.step as predicted_step, round(spot.p, 6) as step_p, who.role_key as predicted_role, who.role_p from spot join who using (conv_id) join lists using (conv_id)
  left join (select conv_id, max(batch) + 1 as n from pack group by 1) b using (conv_id) left join (select conv_id, string_agg(step::varchar, ',' order by step) as l from named group by 1) r using (conv_id)
  left join (select conv_id, string_agg(step::varchar, ',' order by step) as l from expanded group by 1) e using (conv_id))"""


@query(_ATTRIBUTED + " select * from attributed")
def attributed_cases(spark, d):
    return attributed(spark, d)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The attribution of every case, scored against the labels by source."""
    return metrics.metrics(metrics.score_rows(A.gold(spark, d), attributed(spark, d).select("conv_id", "predicted_step", "predicted_role")), "source")


@query(_ATTRIBUTED + f", {A.CTES['gold']}" + rf""", scored as (select g.source, coalesce(a.predicted_role = trim(regexp_replace(lower(g.mistake_agent), '{_TAIL}', '')), false) as role_correct,
coalesce(a.predicted_step = g.mistake_step, false) as step_exact, coalesce(abs(a.predicted_step - g.mistake_step) <= 5, false) as step_near, abs(a.predicted_step - g.mistake_step) as step_error
from gold g left join attributed a using (conv_id)) select source, {_METRICS} from scored group by 1""")
def flagship_by_source(spark, d):
    return flagship(spark, d)
