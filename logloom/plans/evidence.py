"""Registered queries of answer handling, sets, audits and reports; each with the DuckDB SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_role
from ..operators import joins, metrics, policy, ranks, search, segment
from . import adapters as A
from .adapters import ctes
from .catalogue import _METRICS, _SCORED, _TAIL, _pack, _scored, _stop, query

#: What tells a failure, a repair and a constraint in a text.
SIGNALS = {
    "failure": "error|fail|exception|mismatch|missing|失败|错误|缺失",
    "repair": "fix|repair|correct|validat|修复|验证",
    "constraint": "must|required|should|constraint|必须|要求",
}
#: What tells a spent balance in an error's body.
SPENT = "insufficient_balance|insufficient balance|insufficient credit|insufficient_credit|out of credits|not enough credits|credits exhausted|balance exhausted|exhausted your credits|balance is zero|insufficient_quota|billing_hard_limit|余额不足|额度用尽"
#: The checks of a candidate, in order.
CHECKS = ("upstream", "repair", "challenge")
#: Published results in percent (role, exact, within five) and mean step error.
PUBLISHED = (("All-at-once", 26.2, 7.6, 19.9, 55.9), ("Step-by-step", 22.2, 5.3, 16.9, 52.3), ("Binary", 23.0, 3.4, 13.3, 61.7), ("ECHO", 27.5, 13.2, 24.7, 50.4), ("FALAT", 19.0, 2.8, 12.5, 66.6), ("RCTA", 51.1, 24.1, 37.4, 38.6))


@query(ctes("steps") + "select conv_id, step, sha256(j) as json_sha256, strlen(j)::bigint as json_bytes from (select conv_id, step, to_json({'step': step, 'name': name, 'role': role, 'content': content})::varchar as j from steps)")
def canonical_record(spark, d):
    j = F.to_json(F.struct("step", "name", "role", "content"))
    return A.steps(spark, d).select("conv_id", "step", F.sha2(j, 256).alias("json_sha256"), F.octet_length(j).cast("long").alias("json_bytes"))


@query(ctes("steps") + f"select conv_id, array_to_string(list_sort(list(distinct lpad(step::varchar, 4, '0'))), ',') as step_options, array_to_string(list_sort(list(distinct regexp_replace(lower(name), '{_TAIL}', ''))), ',') as role_options from steps group by 1")
def question_options(spark, d):
    sorted_set = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return A.steps(spark, d).groupBy("conv_id").agg(sorted_set(F.lpad(F.col("step").cast("string"), 4, "0")).alias("step_options"), sorted_set(normalize_role(F.col("name"))).alias("role_options"))


@query(ctes("steps", "pred") + "select conv_id, count(*) filter (step < predicted_step) as upstream, count(*) filter (step > predicted_step) as repair, count(*) filter (step <> predicted_step) as challenge from steps join pred using (conv_id) group by 1")
def temporal_directions(spark, d):
    s = A.steps(spark, d).join(A.predictions(spark, d), "conv_id")
    at, p = F.col("step"), F.col("predicted_step")
    return s.groupBy("conv_id").agg(F.count_if(at < p).alias("upstream"), F.count_if(at > p).alias("repair"), F.count_if(at != p).alias("challenge"))


_ASKED = "(0), (3), (7), (999999999), (-5)"


@query(ctes("steps", "gold") + f"select asked as conv_id, g.conv_id is not null as known from (values {_ASKED}) as v(asked) left join gold g on g.conv_id = asked")
def case_selection(spark, d):
    asked = spark.sql(f"select cast(col1 as bigint) as conv_id from values {_ASKED}")
    return asked.join(A.gold(spark, d).select("conv_id", F.lit(True).alias("k")), "conv_id", "left").select("conv_id", F.col("k").isNotNull().alias("known"))


@query(ctes("steps") + ", c as (select conv_id, conv_id % 5 as source, sum(n_bytes)::bigint as b from steps group by 1) select source, conv_id, (b, conv_id) = (min((b, conv_id)) over (partition by source)) as is_smoke from c")
def preflight_waves(spark, d):
    """The shortest case of each source runs first; found by one aggregate, not by ranking a source."""
    c = A.steps(spark, d).groupBy("conv_id").agg(F.sum("n_bytes").alias("b")).withColumn("source", F.pmod("conv_id", F.lit(5)))
    first = c.groupBy("source").agg(F.min(F.struct("b", "conv_id")).alias("m")).select("source", F.col("m.conv_id").alias("first"))
    return c.join(first, "source").select("source", "conv_id", (F.col("conv_id") == F.col("first")).alias("is_smoke"))


_CHOSEN = ctes("answers") + ", sel as (select *, (select coalesce(sum(p), 0) from answers b where b.question = a.question and b.p > a.p) < 0.7::double - 1e-12 as selected from answers a) "


def _chosen(spark, d) -> DataFrame:
    a = A.answers(spark, d)
    kept = policy.adaptive_set(a, 0.7).select("question", "option", F.lit(True).alias("selected"))
    return a.join(kept, ["question", "option"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


@query(_CHOSEN + "select question, option, selected, row_number() over (partition by question order by selected desc, p desc, option) as position from sel")
def ordered_options(spark, d):
    w = Window.partitionBy("question").orderBy(F.col("selected").desc(), F.col("p").desc(), "option")
    return _chosen(spark, d).select("question", "option", "selected", F.row_number().over(w).cast("long").alias("position"))


@query(_CHOSEN + ", u as (select *, bool_or(selected and option <> 'error') over (partition by question) as found, bool_or(selected and option = 'error') over (partition by question) as unsure from sel) select question, option from u where option <> 'error' and (selected or (not found and unsure))")
def selected_refs(spark, d):
    """Here the option `error` is the unknown one; a segment whose winner is unknown keeps all its refs."""
    q = Window.partitionBy("question")
    ref, unknown = F.col("option") != "error", F.col("option") == "error"
    u = _chosen(spark, d).withColumn("found", F.bool_or(F.col("selected") & ref).over(q)).withColumn("unsure", F.bool_or(F.col("selected") & unknown).over(q))
    return u.where(ref & (F.col("selected") | (~F.col("found") & F.col("unsure")))).select("question", "option")


@query(ctes("answers") + "select question, count(*) > 1 as asked, case when count(*) > 1 then round(max(p) filter (option = choice), 6) end as confidence, count(*) = 1 or coalesce(max(p) filter (option = choice), 0) >= 0.8 as confident from answers group by 1")
def confident_choice(spark, d):
    """A question with one option is answered without a call and has no confidence."""
    own = F.max(F.when(F.col("option") == F.col("choice"), F.col("p")))
    a = A.answers(spark, d).groupBy("question").agg(F.count("*").alias("n"), own.alias("p"))
    return a.select("question", (F.col("n") > 1).alias("asked"), F.when(F.col("n") > 1, F.round("p", 6)).alias("confidence"), ((F.col("n") == 1) | (F.coalesce("p", F.lit(0.0)) >= 0.8)).alias("confident"))


def evidence_status(root: Column, support: Column, cited: Column, checks: Column) -> Column:
    """supported: a sure root, sure support, a citation among the direct spans, all checks made; abstained where support is surely refuted."""
    return F.when(support == "refuted", "abstained").when(root & (support == "supported") & cited & (checks >= len(CHECKS)), "supported").otherwise("best_effort")


@query(ctes("answers", "truth") + ", g as (select question, max(p) as top, max(p) filter (option = truth) as own, max(p) filter (option = choice) as said, count(*) as n from answers join truth using (question) group by 1) select question, case when coalesce(own, 0) < 0.1 then 'abstained' when top >= 0.3 and coalesce(own, 0) >= 0.2 and coalesce(said, 0) > 0 and n >= 3 then 'supported' else 'best_effort' end as status from g")
def evidence_gate(spark, d):
    p = lambda c: F.coalesce(F.max(F.when(F.col("option") == F.col(c), F.col("p"))), F.lit(0.0))
    g = A.answers(spark, d).join(A.truth(spark, d), "question").groupBy("question").agg(F.max("p").alias("top"), p("truth").alias("own"), p("choice").alias("said"), F.count("*").alias("n"))
    support = F.when(F.col("own") < 0.1, "refuted").when(F.col("own") >= 0.2, "supported").otherwise("unknown")
    return g.select("question", evidence_status(F.col("top") >= 0.3, support, F.col("said") > 0, F.col("n")).alias("status"))


def error_class(status: Column, body: Column) -> Column:
    return F.when(status == 200, "ok").when((status == 402) | F.lower(body).rlike(SPENT), "balance").when(status.isin(408, 409, 425, 429) | (status >= 500), "transient").otherwise("fatal")


_STATUS = "case when tokens % 7 = 0 then 402 when tokens % 7 = 1 then 503 when tokens % 7 = 2 then 403 when tokens % 7 = 3 then 429 else 200 end"
_BODY = "case when event_id % 5 = 0 then 'Insufficient Credit left' else 'refused' end"


@query(ctes("calls") + f", e as (select event_id, {_STATUS} as status, {_BODY} as body from calls) select event_id, case when status = 200 then 'ok' when status = 402 or regexp_matches(lower(body), '{SPENT}') then 'balance' when status in (408, 409, 425, 429) or status >= 500 then 'transient' else 'fatal' end as class from e")
def error_classes(spark, d):
    return A.calls(spark, d).select("event_id", error_class(F.expr(_STATUS), F.expr(_BODY)).alias("class"))


#: What tells a block that concerns one case only.
BLOCKED, BLOCKER = 403, "Cloudflare"
_BLOCK = f"case when event_id % 4 = 1 then 'blocked by {BLOCKER}' else {_BODY} end"


@query(ctes("calls") + f""", e as (select case_id, row_number() over (partition by case_id order by ts, event_id) as n, {_STATUS} as status, {_BLOCK} as body from calls),
k as (select *, status = {BLOCKED} and contains(body, '{BLOCKER}') as blocked, status = 402 or (status <> 200 and regexp_matches(lower(body), '{SPENT}')) as spent from e)
select case_id, min(n) filter (blocked) as blocked_at, min(n) filter (spent) as spent_at, case when min(n) filter (spent) < coalesce(min(n) filter (blocked), 1e18) then 'run_stopped' when min(n) filter (blocked) is not null then 'isolated' else 'finished' end as outcome from k group by 1""")
def isolated_blocks(spark, d):
    """A block sets its own case aside and the others go on; a spent balance stops the run, unless the case was set aside before."""
    calls = A.calls(spark, d).select("case_id", F.row_number().over(Window.partitionBy("case_id").orderBy("ts", "event_id")).cast("long").alias("n"), F.expr(_STATUS).alias("status"), F.expr(_BLOCK).alias("body"))
    blocked = (F.col("status") == BLOCKED) & F.col("body").contains(BLOCKER)
    spent = error_class(F.col("status"), F.col("body")) == "balance"
    g = calls.groupBy("case_id").agg(F.min(F.when(blocked, F.col("n"))).alias("blocked_at"), F.min(F.when(spent, F.col("n"))).alias("spent_at"))
    first = F.coalesce(F.col("spent_at") < F.col("blocked_at"), F.col("spent_at").isNotNull())
    return g.withColumn("outcome", F.when(first, "run_stopped").when(F.col("blocked_at").isNotNull(), "isolated").otherwise("finished"))


_ODD = "case when question % 11 = 3 and option = 'view' then 1.5::double else p end"


@query(ctes("answers") + f", a as (select question, option, choice, {_ODD} as p from answers), v as (select * from a where question not in (select question from a where p < 0 or p > 1)) select question, option, row_number() over (partition by question order by (option = choice) desc, p desc, option) as rank from v where option <> 'error' qualify rank <= 3")
def ranked_numeric(spark, d):
    """Options ranked within their question; `error` names nothing, and questions with an impossible probability are left out."""
    odd = A.answers(spark, d).withColumn("p", F.expr(_ODD.replace("::double", "D")))
    return policy.ranked_choices(odd, F.col("option") != "error", 3).withColumn("rank", F.col("rank").cast("long"))


@query(ctes("steps") + "select conv_id, string_agg(role, ',' order by first) as roles from (select conv_id, role, min(step) as first from steps group by 1, 2) group by 1")
def ordered_dedupe(spark, d):
    each = F.transform(F.sort_array(F.collect_list(F.struct("step", "role"))), lambda x: x["role"])
    return A.steps(spark, d).groupBy("conv_id").agg(F.array_join(F.array_distinct(each), ",").alias("roles"))


@query(ctes("calls") + "select case_id, phase, arg_min(event_id, (ts, event_id)) as first_event, arg_max(tokens, (ts, event_id)) as last_tokens from calls group by 1, 2")
def merge_by_id(spark, d):
    at = F.struct("ts", "event_id")
    return A.calls(spark, d).groupBy("case_id", "phase").agg(F.min_by("event_id", at).alias("first_event"), F.max_by("tokens", at).alias("last_tokens"))


@query(ctes("steps", "pred") + "select conv_id, count(*) filter (step <> predicted_step) as remaining, count(distinct step) = max(step) + 1 and min(step) = 0 as whole from steps join pred using (conv_id) group by 1")
def set_difference(spark, d):
    g = A.steps(spark, d).join(A.predictions(spark, d), "conv_id").groupBy("conv_id").agg(F.collect_set("step").alias("s"), F.array(F.first("predicted_step")).alias("p"))
    every = F.sequence(F.lit(0).cast("long"), F.array_max("s").cast("long"))
    return g.select("conv_id", F.size(F.array_except("s", "p")).cast("long").alias("remaining"), (F.sort_array(F.col("s").cast("array<bigint>")) == every).alias("whole"))


@query(ctes("steps") + ", f as (select *, bool_or(n_bytes > 300) over (partition by conv_id) as any_suspect, step = 0 or step = max(step) over (partition by conv_id) as anchor from steps) select conv_id, step from f where case when any_suspect then n_bytes > 300 else anchor end")
def fallback_union(spark, d):
    w = Window.partitionBy("conv_id")
    s = A.steps(spark, d).withColumn("any_suspect", F.bool_or(F.col("n_bytes") > 300).over(w)).withColumn("anchor", (F.col("step") == 0) | (F.col("step") == F.max("step").over(w)))
    return s.where(F.when(F.col("any_suspect"), F.col("n_bytes") > 300).otherwise(F.col("anchor"))).select("conv_id", "step")


@query(ctes("steps", "handoff") + ", r as (select *, row_number() over (partition by conv_id order by n_bytes desc, step) as r from steps), t as (select conv_id, step from r where r <= 2) select conv_id, step::bigint as step from t union select t.conv_id, handoff_step::bigint from t join handoff h on h.conv_id = t.conv_id and h.step = t.step where handoff_step is not null")
def recall_union(spark, d):
    s = A.steps(spark, d)
    top = s.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n_bytes"), "step"))).where("r <= 2").select("conv_id", "step")
    h = joins.handoff_asof(s).select("conv_id", "step", "handoff_step")
    return top.join(h, ["conv_id", "step"]).select("conv_id", F.explode(F.array_compact(F.array(F.col("step").cast("long"), "handoff_step"))).alias("step")).distinct()


@query(ctes("truth") + "select question from truth where question % 3 = 0 intersect select question from truth where question % 5 = 0")
def holdout_overlap(spark, d):
    """Calibration cases (every third) that are also held out (every fifth): each is a leak."""
    t = A.truth(spark, d).select("question")
    return t.where("question % 3 = 0").join(t.where("question % 5 = 0"), "question", "left_semi")


def cache_lookup(requests: DataFrame, cache: DataFrame, key: list[str], digest: str) -> DataFrame:
    """The key and a status: hit, miss, or mismatch where the key is stored for another request."""
    held = cache.select(*key, F.col(digest).alias("__stored"))
    status = F.when(F.col("__stored").isNull(), "miss").when(F.col("__stored") == F.col(digest), "hit").otherwise("mismatch")
    return requests.join(held, key, "left").select(*key, status.alias("status"))


@query(ctes("steps") + ", cache as (select conv_id, step, sha256(case when (conv_id + step) % 7 = 0 then content || '!' else content end) as h from steps where (conv_id + step) % 5 <> 0) select s.conv_id, s.step, case when c.h is null then 'miss' when c.h = sha256(s.content) then 'hit' else 'mismatch' end as status from steps s left join cache c using (conv_id, step)")
def replay_cache(spark, d):
    """Stored answers by tag; some are missing and some were given to another request."""
    s, n = A.steps(spark, d), F.col("conv_id") + F.col("step")
    stored = s.where(n % 5 != 0).select("conv_id", "step", F.sha2(F.when(n % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256).alias("digest"))
    return cache_lookup(s.select("conv_id", "step", F.sha2("content", 256).alias("digest")), stored, ["conv_id", "step"], "digest")


@query(ctes("calls") + ", u as (select case_id, count(*) as n, sum(tokens)::bigint as t from calls group by 1), s as (select case_id, n + (case_id % 11 = 0)::int as n, t from u where case_id % 13 <> 0) select coalesce(u.case_id, s.case_id) as case_id, case when s.n is null then 'unclaimed' when s.n <> u.n then 'calls' when s.t <> u.t then 'tokens' else 'ok' end as verdict from u full join s using (case_id)")
def calls_reconciled(spark, d):
    """Claimed totals, some of them wrong or missing, against the archived calls."""
    u = A.calls(spark, d).groupBy("case_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    claimed = u.where("case_id % 13 <> 0").select("case_id", (F.col("n") + (F.col("case_id") % 11 == 0).cast("int")).alias("sn"), F.col("t").alias("st"))
    return u.join(claimed, "case_id", "full").select("case_id", F.when(F.col("sn").isNull(), "unclaimed").when(F.col("sn") != F.col("n"), "calls").when(F.col("st") != F.col("t"), "tokens").otherwise("ok").alias("verdict"))


@query(ctes("steps", "pred", "handoff") + ", n as (select conv_id, step, lag(step) over w as previous_step, lead(step) over w as next_step from steps window w as (partition by conv_id order by step)) select conv_id, predicted_step as step, previous_step, next_step, handoff_step::bigint as handoff_step from pred join n on n.conv_id = pred.conv_id and n.step = predicted_step join handoff h on h.conv_id = pred.conv_id and h.step = predicted_step".replace("select conv_id, predicted_step as step", "select pred.conv_id, predicted_step as step"))
def candidate_evidence(spark, d):
    s = joins.neighbours(joins.handoff_asof(A.steps(spark, d)))
    return s.join(A.predictions(spark, d).select("conv_id", F.col("predicted_step").alias("step")), ["conv_id", "step"], "left_semi").select("conv_id", "step", "previous_step", "next_step", "handoff_step")


_STOPS = _stop(24, 2000, "call_budget", "input_token_budget").replace(" select case_id, min(n)", ", st as (select case_id, min(n)") + ") "


def _stops(spark, d) -> DataFrame:
    return search.budget_stop(A.calls(spark, d), "case_id", ["ts", "event_id"], "tokens", 24, 2000)


@query(_STOPS + "select coalesce(reason, 'frontier_exhausted') as reason, count(*) as n from st group by 1")
def reason_histogram(spark, d):
    return _stops(spark, d).groupBy(F.coalesce("reason", F.lit("frontier_exhausted")).alias("reason")).agg(F.count("*").alias("n"))


@query(_STOPS + ", u as (select case_id, count(*) as c, sum(tokens) as t, count(distinct phase) as ph from calls group by 1) select coalesce(reason, 'frontier_exhausted') as reason, count(*) as n, round(avg(c), 6) as mean_calls, round(avg(t), 6) as mean_tokens, count(*) filter (ph < 5) as incomplete from st join u using (case_id) group by 1")
def diagnostics_by_reason(spark, d):
    u = A.calls(spark, d).groupBy("case_id").agg(F.count("*").alias("c"), F.sum("tokens").alias("t"), F.countDistinct("phase").alias("ph"))
    j = _stops(spark, d).join(u, "case_id").groupBy(F.coalesce("reason", F.lit("frontier_exhausted")).alias("reason"))
    return j.agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean_calls"), F.round(F.avg("t"), 6).alias("mean_tokens"), F.count_if(F.col("ph") < 5).alias("incomplete"))


@query(ctes("steps") + ", c as (select conv_id, conv_id % 5 as source, count(*) as s, sum(n_bytes)::bigint as b from steps group by 1) select source, count(*) as n, median(s)::double as median_steps, max(s) as max_steps, median(b)::double as median_bytes from c group by 1")
def data_audit(spark, d):
    """Medians by counting: five sources hold all cases, and none is sorted whole."""
    c = A.steps(spark, d).groupBy("conv_id").agg(F.count("*").alias("s"), F.sum("n_bytes").alias("b")).withColumn("source", F.pmod("conv_id", F.lit(5)))
    halves = {"lo": lambda n: F.floor((n + 1) / 2), "hi": lambda n: F.floor(n / 2) + 1}
    median = lambda value, name: ranks.value_at_ranks(c, ["source"], value, halves).select("source", ((F.col("lo") + F.col("hi")) / 2).cast("double").alias(name))
    whole = c.groupBy("source").agg(F.count("*").alias("n"), F.max("s").alias("max_steps"))
    return whole.join(median("s", "median_steps"), "source").join(median("b", "median_bytes"), "source").select("source", "n", "median_steps", "max_steps", "median_bytes")


@query("with recursive " + A.CTES["steps"] + ", " + _pack("steps", "conv_id", "step", "n_bytes", 1500, 4) + ", b as (select r.conv_id, r.step, p.batch, row_number() over (partition by r.conv_id order by r.n_bytes desc, r.step) as k from p join r using (conv_id, i)) select conv_id, count(distinct batch) as segments, count(distinct batch) filter (k <= 2) as read, count(distinct batch) - count(distinct batch) filter (k <= 2) as pending, count(*) filter (k <= 2) as steps_shown from b group by 1")
def coverage_summary(spark, d):
    b = segment.greedy_pack(A.steps(spark, d).select("conv_id", "step", "n_bytes"), ["conv_id"], ["step"], F.col("n_bytes"), 1500, 4)
    k = b.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n_bytes"), "step")))
    g = k.groupBy("conv_id").agg(F.countDistinct("batch").alias("segments"), F.countDistinct(F.when(F.col("k") <= 2, F.col("batch"))).alias("read"), F.count_if(F.col("k") <= 2).alias("steps_shown"))
    return g.select("conv_id", "segments", "read", (F.col("segments") - F.col("read")).alias("pending"), "steps_shown")


@query(_SCORED + "select count(*) filter (predicted_step = 0) as predicted_first, count(*) filter (predicted_step = n_steps - 1) as predicted_last, count(*) filter (mistake_step = 0) as truly_first, count(*) as n from scored")
def positional_bias(spark, d):
    return _scored(spark, d).agg(F.count_if(F.col("predicted_step") == 0).alias("predicted_first"), F.count_if(F.col("predicted_step") == F.col("n_steps") - 1).alias("predicted_last"), F.count_if(F.col("mistake_step") == 0).alias("truly_first"), F.count("*").alias("n"))


@query(ctes("steps") + f"select round(avg(1.0::double / n), 6) as role_chance from (select count(distinct regexp_replace(lower(name), '{_TAIL}', '')) as n from steps group by conv_id)")
def role_chance(spark, d):
    n = A.steps(spark, d).groupBy("conv_id").agg(F.countDistinct(normalize_role(F.col("name"))).cast("double").alias("n"))
    return n.agg(F.round(F.avg(1.0 / F.col("n")), 6).alias("role_chance"))


@query(_SCORED.replace("predicted_step, role", "predicted_step, role") + f", v as (select s.*, t.n_bytes > 250 as verified from scored s left join steps t on t.conv_id = s.conv_id and t.step = s.predicted_step), w as (select coalesce(verified, false) and role_correct as role_correct, coalesce(verified, false) and step_exact as step_exact, coalesce(verified, false) and step_near as step_near, case when verified then step_error end as step_error from v) select {_METRICS} from w")
def verified_metrics(spark, d):
    """The metrics of predictions whose evidence (a step of more than 250 bytes) verifies them; all others count as wrong."""
    sure = A.steps(spark, d).where("n_bytes > 250").select("conv_id", F.col("step").alias("predicted_step"))
    return metrics.metrics(metrics.score_rows(A.gold(spark, d), A.predictions(spark, d).join(sure, ["conv_id", "predicted_step"], "left_semi")))


@query("select doc_id, " + ", ".join(f"coalesce(regexp_matches(text, '{v}', 'i'), false) as {k}" for k, v in SIGNALS.items()) + " from documents")
def signal_flags(spark, d):
    return A.load(spark, d, "documents").select("doc_id", *[F.coalesce(F.col("text").rlike(f"(?iu){v}"), F.lit(False)).alias(k) for k, v in SIGNALS.items()])


_HITS = " + ".join(f"coalesce(regexp_matches(text, '{v}', 'i'), false)::int" for v in SIGNALS.values())


@query(f"with h as (select source, doc_id, {_HITS} as hits from documents) select source, count(*) as n, max(hits)::bigint as signals, min(doc_id) filter (hits = m) as best from (select *, max(hits) over (partition by source) as m from h) group by 1")
def directory_preview(spark, d):
    hits = sum((F.coalesce(F.col("text").rlike(f"(?iu){v}"), F.lit(False)).cast("int") for v in SIGNALS.values()), F.lit(0))
    h = A.load(spark, d, "documents").select("source", "doc_id", hits.alias("hits"))
    return h.groupBy("source").agg(F.count("*").alias("n"), F.max("hits").cast("long").alias("signals"), F.max_by("doc_id", F.struct("hits", -F.col("doc_id"))).alias("best"))


@query(ctes("steps") + "select conv_id, step, printf('s%d:%d:%d', step, 0, n_bytes) as address, printf('seg%04d', step) as segment, replace(left(content, 200), 'the', '____') as masked, regexp_extract(printf('%03d_upstream_%d', step, conv_id), '^\\d+_([a-z]+)', 1) as phase from steps")
def address_format(spark, d):
    tag = F.concat(F.lpad(F.col("step").cast("string"), 3, "0"), F.lit("_upstream_"), F.col("conv_id").cast("string"))
    return A.steps(spark, d).select("conv_id", "step", F.concat_ws(":", F.concat(F.lit("s"), F.col("step").cast("string")), F.lit("0"), F.col("n_bytes").cast("string")).alias("address"), F.concat(F.lit("seg"), F.lpad(F.col("step").cast("string"), 4, "0")).alias("segment"), F.replace(F.substring("content", 1, 200), F.lit("the"), F.lit("____")).alias("masked"), F.regexp_extract(tag, r"^\d+_([a-z]+)", 1).alias("phase"))


_NEXT = "case conv_id % 4 when 0 then 'upstream' when 1 then 'repair' when 2 then 'challenge' else 'local' end"


@query(ctes("steps") + f", h as (select conv_id, count(*) as n, {_NEXT} as hint, list_slice(['upstream', 'repair', 'challenge'], 1, (conv_id % 5)::int) as done from steps group by 1) select conv_id, case when hint = 'local' and n > 3 then 'expand' when hint <> 'local' and not list_contains(done, hint) then hint when not list_contains(done, 'upstream') then 'upstream' when not list_contains(done, 'repair') then 'repair' when not list_contains(done, 'challenge') then 'challenge' end as action from h")
def next_action(spark, d):
    """A hint for more of the same step expands it, a hinted check that isn't done is done, else the first missing check."""
    h = A.steps(spark, d).groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("hint", F.expr(_NEXT))
    h = h.withColumn("done", F.slice(F.array(*[F.lit(c) for c in CHECKS]), F.lit(1), F.pmod("conv_id", F.lit(5)).cast("int")))
    missing = [F.when(~F.array_contains("done", c), c) for c in CHECKS]
    return h.select("conv_id", F.when((F.col("hint") == "local") & (F.col("n") > 3), "expand").when((F.col("hint") != "local") & ~F.array_contains("done", F.col("hint")), F.col("hint")).otherwise(F.coalesce(*missing)).alias("action"))


_PAPER = ", ".join(f"('{n}', {a}::double, {b}::double, {c}::double, {e}::double)" for n, a, b, c, e in PUBLISHED)


@query(_SCORED + f", own as (select {_METRICS} from scored) select method, role as published_role, exact as published_exact, near as published_near, mae as published_mae, round(100 * own.exact - p.exact, 4) as exact_gain from (values {_PAPER}) as p(method, role, exact, near, mae), own".replace("role as published_role, exact as published_exact, near as published_near, mae as published_mae", "p.role as published_role, p.exact as published_exact, p.near as published_near, p.mae as published_mae"))
def paper_comparison(spark, d):
    told = spark.createDataFrame(list(PUBLISHED), "method string, published_role double, published_exact double, published_near double, published_mae double")
    own = metrics.metrics(_scored(spark, d)).select(F.col("exact").alias("own"))  # one row
    return told.join(F.broadcast(own)).select(*told.columns, F.round(100 * F.col("own") - F.col("published_exact"), 4).alias("exact_gain"))


@query(_SCORED + ", a as (select source, round(avg(step_exact::int), 6) as e from scored group by 1), s as (select source, e + case when source = 2 then 0.5::double else 0 end as saved from a) select source, e as recomputed, e = saved as equal from a join s using (source)")
def saved_summary_check(spark, d):
    """A saved summary, one source of which was changed, against the scores."""
    again = metrics.metrics(_scored(spark, d), "source").select("source", F.col("exact").alias("recomputed"))
    saved = _scored(spark, d).groupBy("source").agg(F.round(F.sum(F.col("step_exact").cast("double")) / F.count("*"), 6).alias("e")).select("source", F.when(F.col("source") == 2, F.col("e") + 0.5).otherwise(F.col("e")).alias("saved"))
    return again.join(saved, "source").select("source", "recomputed", (F.col("recomputed") == F.col("saved")).alias("equal"))


@query(ctes("steps", "pred") + ", s as (select conv_id, case when conv_id % 9 = 4 then predicted_step + 1 else predicted_step end as saved from pred) select conv_id, predicted_step as again, saved from pred join s using (conv_id) where predicted_step <> saved")
def replay_faults(spark, d):
    """Stored predictions, some of them changed, against the method run again over another plan."""
    stored = A.predictions(spark, d).select("conv_id", F.when(F.col("conv_id") % 9 == 4, F.col("predicted_step") + 1).otherwise(F.col("predicted_step")).alias("saved"))
    again = A.steps(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n_bytes"), "step"))).where("r = 1").select("conv_id", F.col("step").alias("again"))
    return stored.join(again, "conv_id").where("again <> saved").select("conv_id", "again", "saved")


@query("with part as (select doc_id, case when doc_id % 97 = 5 then sha256(coalesce(text, '') || '!') else sha256(coalesce(text, '')) end as h from documents union all select -1, 'x') select doc_id from part except select p.doc_id from part p join (select doc_id, sha256(coalesce(text, '')) as h from documents) f on f.doc_id = p.doc_id and f.h = p.h")
def subset_faults(spark, d):
    """The rows of a copy, with changed texts and an unknown id, that the full table doesn't hold."""
    text = F.coalesce("text", F.lit(""))
    docs = A.load(spark, d, "documents")
    copy = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 97 == 5, F.concat(text, F.lit("!"))).otherwise(text), 256).alias("h")).unionByName(spark.sql("select cast(-1 as bigint) as doc_id, 'x' as h"))
    return joins.subset_mismatch(copy, docs.select("doc_id", F.sha2(text, 256).alias("h")), "doc_id", "h").select("doc_id")
