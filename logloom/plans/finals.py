"""Registered queries of final decisions over the lexical choice model's answers, with the DuckDB SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import evidence_terms, normalize_role
from ..functions.workers import kept_once
from ..operators import choice, finals
from . import adapters as A
from .attribution import _KEY
from .catalogue import query
from .directories import _FLAGS, _SCORE, _terms
from .evidence import CHECKS, SIGNALS

#: Finalists of a case, the least score of one, what "unknown" scores, a finalist's frame and the request in bytes, what counts as sure, and the width that leaves room for a check.
MOST, LEAST, UNKNOWN, FRAME, REQUEST, SURE, ROOM = 3, 1.0, 2.0, 60, 1500, 0.4, 900


def _facts(spark, d) -> DataFrame:
    s = A.steps(spark, d)
    ends = s.groupBy("conv_id").agg(F.min_by("content", "step").alias("first"), F.max_by("content", "step").alias("last"))
    asked = ends.select("conv_id", evidence_terms(F.concat_ws(" ", "first", "last")).alias("asked"))
    shown = choice.signals(F.col("content"), SIGNALS)
    overlap = F.size(F.array_intersect(evidence_terms(F.col("content")), F.col("asked")))
    return s.join(asked, "conv_id").select("conv_id", "step", normalize_role(F.col("name")).alias("role"), "n_bytes", *[c.alias(k) for k, c in shown.items()], overlap.alias("overlap"), choice.suspicion(shown, overlap).alias("score"))


def _answer(frame: DataFrame, options: dict, name: str) -> DataFrame:
    """(conv_id, name, name_p): the choice among options (name -> score) for each row."""
    listed = F.array(*[F.struct(F.lit(k).alias("option"), v.cast("double").alias("score")) for k, v in options.items()])
    told = choice.distribution(frame.select("conv_id", F.inline(listed)), ["conv_id"], "option", "score").where("option = choice")
    return told.select("conv_id", F.col("option").alias(name), F.col("p").alias(f"{name}_p"))


def _asked(spark, d) -> DataFrame:
    """Every case's root, and the answers about it: one row a case."""
    facts = kept_once(_facts(spark, d))
    ends = facts.groupBy("conv_id").agg(F.max("step").alias("outcome"))
    ranked = facts.join(ends, "conv_id").where((F.col("score") >= LEAST) & (F.col("step") < F.col("outcome"))).groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "step"))), 1, MOST).alias("few"))
    named = ranked.select("conv_id", F.explode("few").alias("f")).select("conv_id", F.col("f.step").alias("step"), (-F.col("f.s")).alias("score"))
    room = finals.ladder(named.join(facts.select("conv_id", "step", "n_bytes"), ["conv_id", "step"]), "conv_id", "n_bytes", FRAME, REQUEST)
    options = named.select("conv_id", "step", F.lpad(F.col("step").cast("string"), 9, "0").alias("option"), "score")
    options = options.unionByName(named.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("step"), F.lit("unknown").alias("option"), F.lit(UNKNOWN).alias("score")))
    root = choice.distribution(options, ["conv_id"], "option", "score").where("option = choice").select("conv_id", F.col("step").alias("root"), F.col("p").alias("root_p"))
    met = facts.join(root.where("root is not null"), "conv_id")
    at = F.col("step") == F.col("root")
    seen = kept_once(met.groupBy("conv_id").agg(
        F.max(F.when(at, F.col("failure").cast("int"))).alias("f"), F.max(F.when(at, F.col("constraint").cast("int"))).alias("c"), F.max(F.when(at, F.col("role"))).alias("role"), F.max(F.when(at, F.col("overlap"))).alias("own"),
        F.coalesce(F.max(F.when(F.col("step") == F.col("root") - 1, F.col("overlap"))), F.lit(0)).alias("before"), F.coalesce(F.max(F.when(F.col("step") > F.col("root"), F.col("repair").cast("int"))), F.lit(0)).alias("later"),
        F.max_by(F.col("failure").cast("int"), "step").alias("ends"), F.count("*").alias("n"), F.max("root").alias("root"),
    ))
    f, c, later = F.col("f"), F.col("c"), F.col("later")
    origin = {"local": 2 * f + c + 1.5, "upstream": F.col("before") / 16, "no_violation": F.lit(0.75), "unknown": F.lit(0.5)}
    outcome = {"persists": 1 + 2 * F.col("ends"), "repaired": 2 * later, "unlinked": F.lit(0.25), "unknown": F.lit(0.5)}
    support = {"supported": 2 * f + c, "refuted": 2 * later, "unknown": F.lit(1.0)}
    told = room.join(root, "conv_id", "left").join(seen.drop("root"), "conv_id", "left")
    for name, listed in (("origin", origin), ("outcome", outcome), ("support", support)):
        told = told.join(_answer(seen, listed, name), "conv_id", "left")
    everyone = facts.select("conv_id").distinct()
    # a case whose finalists leave the request little room has none for a check
    return everyone.join(told, "conv_id", "left").select(
        "*", (F.col("width") >= ROOM).alias("verified"), F.when((f + c > 0) | (F.col("own") >= F.col("before")), F.col("root")).otherwise(F.col("root") - 1).alias("cited_step"),
        (0.5 + F.col("f") / 4 + F.col("c") / 4).alias("role_p"), ((f + c > 0) | (F.col("own") >= F.col("before"))).alias("role_cited"),
        F.slice(F.array(*[F.lit(x) for x in CHECKS]), F.lit(1), (F.pmod("n", F.lit(4))).cast("int")).alias("attempted"), (F.col("origin") == "local").alias("relations"),
    )


def _choice(name: str, options: str) -> str:
    """A question's answer in SQL: (conv_id, name, name_p)."""
    return f"""{name}_o as (select conv_id, unnest([{options}]) as x from seen), {name}_e as (select conv_id, x.o as o, exp(x.s - max(x.s) over (partition by conv_id)) as e from {name}_o),
{name}_a as (select conv_id, o as {name}, p as {name}_p from (select conv_id, o, round(e / sum(e) over (partition by conv_id), 9) as p from {name}_e) qualify row_number() over (partition by conv_id order by p desc, o) = 1)"""


_o = lambda **options: ", ".join(f"{{'o': '{k}', 's': ({v})::double}}" for k, v in options.items())
_FINALS = f"""with recursive {A.CTES["steps"]},
q as (select conv_id, {_terms("arg_min(content, step) || ' ' || arg_max(content, step)")} as asked from steps group by 1),
g as (select *, {_FLAGS}, len(list_intersect({_terms("content")}, asked)) as overlap from steps join q using (conv_id)),
facts as (select conv_id, step, {_KEY} as role, n_bytes, failure, repair, constraint_, overlap, {_SCORE} as score from (select * exclude ("constraint"), "constraint" as constraint_ from g)),
named as (select * from facts join (select conv_id, max(step) as outcome from facts group by 1) using (conv_id) where score >= {LEAST} and step < outcome qualify row_number() over (partition by conv_id order by score desc, step) <= {MOST}),
room as (select conv_id, count(*) as n_candidates, case {" ".join(f"when sum(least(n_bytes, {w}) + {FRAME}) <= {REQUEST} then {w}" for w in finals.WIDTHS)} else {finals.WIDTHS[-1]} end as width from named group by 1),
ro as (select conv_id, step, lpad(step::varchar, 9, '0') as o, score from named union all select distinct conv_id, null, 'unknown', {UNKNOWN}::double from named),
re as (select *, exp(score - max(score) over (partition by conv_id)) as e from ro),
root as (select conv_id, step as root, p as root_p from (select conv_id, step, o, round(e / sum(e) over (partition by conv_id), 9) as p from re) qualify row_number() over (partition by conv_id order by p desc, o) = 1),
seen as (select conv_id, max(root) as root, max(case when step = root then failure::int end) as f, max(case when step = root then constraint_::int end) as c, max(case when step = root then role end) as role, max(case when step = root then overlap end) as own,
  coalesce(max(case when step = root - 1 then overlap end), 0) as before, coalesce(max(case when step > root then repair::int end), 0) as later, arg_max(failure::int, step) as ends, count(*) as n from facts join root using (conv_id) where root is not null group by 1),
{_choice("origin", _o(local="2 * f + c + 1.5", upstream="before / 16.0::double", no_violation="0.75", unknown="0.5"))},
{_choice("outcome", _o(persists="1 + 2 * ends", repaired="2 * later", unlinked="0.25", unknown="0.5"))},
{_choice("support", _o(supported="2 * f + c", refuted="2 * later", unknown="1"))},
j as (select c.conv_id, coalesce(n_candidates, 0) as k, width, root.root, root_p, f, c, role, n, origin, origin_p, outcome, outcome_p, support, support_p, coalesce(width >= {ROOM}, false) as asked,
  case when f + c > 0 or own >= before then root.root else root.root - 1 end as cited, coalesce(f + c > 0 or own >= before, false) as role_cited, 0.5::double + f / 4.0::double + c / 4.0::double as role_p
  from (select distinct conv_id from steps) c left join room using (conv_id) left join root using (conv_id) left join seen using (conv_id) left join origin_a using (conv_id) left join outcome_a using (conv_id) left join support_a using (conv_id)),
v as (select *, %(refuted)s as refuted, %(supported)s as supported from j),
w as (select *, k = 0 or root is null or (asked and refuted) as gone from v), x as (select *, not gone and asked and supported and coalesce(root_p >= {SURE}, false) as holds from w)
select conv_id, case when not gone then root end as predicted_step, case when not gone and asked then role end as predicted_role, case when holds then root end as verified_step,
  case when holds and coalesce(role_p >= {SURE}, false) and role_cited then role end as verified_role, case when gone then 'abstained' when holds then 'supported' else 'best_effort' end as decision_status,
  case when k = 0 then 'no_inspected_viable_candidate' when root is null then 'no_final_candidate' when not asked then 'verification_budget_exhausted' when refuted then 'independent_evidence_refuted' when holds then '%(reason)s' else 'point_prediction_unverified' end as decision_reason, width from x"""
_is = lambda name, option: f"coalesce({name} = '{option}' and {name}_p >= {SURE}, false)"


@query(_FINALS % {"refuted": _is("support", "refuted"), "supported": f"{_is('support', 'supported')} and coalesce(cited = root and n % 4 >= 3 and origin = 'local', false)", "reason": "retrieved_evidence_checked"})
def final_joint(spark, d):
    """Point predictions, checked by one question about their support."""
    asked = kept_once(_asked(spark, d))
    return finals.decide(asked, finals.joint_verdict(SURE), least=SURE).join(asked.select("conv_id", "width"), "conv_id")


@query(_FINALS % {"refuted": f"{_is('origin', 'no_violation')} or {_is('outcome', 'repaired')} or {_is('outcome', 'unlinked')}", "supported": f"{_is('origin', 'local')} and {_is('outcome', 'persists')} and coalesce(cited = root, false)", "reason": "fresh_origin_and_outcome_checked"})
def final_factored(spark, d):
    """Point predictions, checked by independent questions about their origin and outcome."""
    asked = kept_once(_asked(spark, d))
    return finals.decide(asked, finals.factored_verdict(SURE), least=SURE).join(asked.select("conv_id", "width"), "conv_id")
