"""Registered queries of evidence search, routing, byte budgets and whole-run audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.workers import dealt_once, kept_once
from ..operators import clients, frontier, packets, policy, search, segment
from ..operators.ledger import Ledger
from . import adapters as A
from .adapters import ctes
from .catalogue import query
from .evidence import SIGNALS

#: Words that a missing kind of evidence is looked for with.
NEED_TERMS = {
    "upstream": "requirement instruction requested constraint must should plan delegate handoff 要求 指令 约束",
    "local": "implementation edit write execute parameters arguments change 实现 参数 执行",
    "repair": "repair fixed test validation persisted failed 修复 验证 失败",
    "challenge": "contradiction expected actual comparison mismatch alternative conflict 冲突 对比",
}


def _steps(spark, d) -> DataFrame:
    return A.steps(spark, d).withColumn("step", F.col("step").cast("int"))


def _client(spark, d, calls: list | None = None) -> frontier.Client:
    """Answers from the steps' texts; with calls, every call is noted there."""
    own = clients.lexical(dealt_once(clients.facts(_steps(spark, d), SIGNALS), ["conv_id"]))
    return own if calls is None else clients.recorded(own, calls)


def _unread(s: DataFrame) -> DataFrame:
    return s.select("conv_id", "step", F.ceil(F.col("n_bytes") / 200).cast("int").alias("unread"))


def _bytes(unread, length, refs):
    """Bytes of a request: more for what is unread, for a longer question and for each ref."""
    return 100 + 40 * unread + 7 * length + 10 * refs


def _cost():
    return _bytes(F.col("unread"), F.length("action"), F.size("refs"))


def _sizes(spark, d) -> DataFrame:
    """(conv_id, step, n_bytes): all that a search reads of the steps besides its client, without their texts."""
    return kept_once(_steps(spark, d).select("conv_id", "step", "n_bytes"))


#: No budget ends a search; its answers come from the log's own texts, so no request is sent that could be too large.
ENDLESS = {"rounds": None, "max_calls": None, "max_bytes": None, "request_bytes": None}


def _search(spark, d, rounds: int | None = 8, client: frontier.Client | None = None, ledger: Ledger | None = None, sizes: DataFrame | None = None, max_bytes: int | None = 2 * 62_000 + 1700, **budgets):
    """The longest step of each case is suspected; segments of the other steps, eight each, were deferred."""
    s = _sizes(spark, d) if sizes is None else sizes
    ref = F.concat(F.lit("s"), F.col("step").cast("string"))
    longest = s.groupBy("conv_id").agg(F.max_by("step", F.struct("n_bytes", -F.col("step"))).alias("step"))
    found = longest.select("conv_id", "step", ref.alias("ref"), F.lit(None).cast("int").alias("parent"), F.lit("recall").alias("source"))
    rest = s.select("conv_id", "step").join(longest.withColumnRenamed("step", "longest"), "conv_id").where("step <> longest")
    cards = rest.groupBy("conv_id", F.floor(F.col("step") / 8).alias("k")).agg(F.sort_array(F.collect_list(F.struct(ref.alias("ref"), "step"))).alias("refs"))
    cards = cards.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("k")) - 1).cast("long").alias("card"), "refs")
    return frontier.search(found, cards, _unread(s), client or _client(spark, d), _bytes, rounds=rounds, max_bytes=max_bytes, ledger=ledger, **budgets)


@query()
def frontier_search(spark, d):
    """Every case's search to its end: what was done in which order, why it ended and what became of its nodes."""
    return _told(*_search(spark, d))


def _told(nodes: DataFrame, cases: DataFrame, trace: DataFrame) -> DataFrame:
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("acted", "step", "action"))), lambda t: F.concat_ws(":", t["step"].cast("string"), t["action"])), " ")
    n = nodes.groupBy("conv_id").agg(F.count("*").alias("n_nodes"), *[F.count_if(F.col("status") == v).alias(f"n_{v}") for v in ("open", "sidelined", "redirected")])
    return cases.join(trace.groupBy("conv_id").agg(path.alias("path")), "conv_id", "left").join(n, "conv_id", "left").select("conv_id", "acted", "opened", "bytes", "reason", F.coalesce("path", F.lit("")).alias("path"), "n_nodes", "n_open", "n_sidelined", "n_redirected")


#: Every so many calls the replay's archive holds a digest that isn't the request's.
FORGED = 7


@query()
def search_replay(spark, d):
    """A search, and the same search on its archived answers, first as they are and then with forged digests in some cases.

    same: the replay ends as the search did. forged: the first call of the case with a forged digest, null if none. stopped: that
    replay ends there for want of an answer, or as the search did where nothing is forged.
    """
    calls: list[DataFrame] = []
    sizes = _sizes(spark, d)
    told = kept_once(_told(*_search(spark, d, 4, _client(spark, d, calls), sizes=sizes)))
    archive = kept_once(reduce(DataFrame.unionByName, calls))
    is_forged = F.pmod(F.col("conv_id") * 5 + F.col("call"), F.lit(FORGED)) == 0
    # both replays are one search, of twice the cases: a round costs the same time for few cases as for many
    run, case = F.explode(F.array(F.lit(0), F.lit(1))).alias("run"), (F.col("conv_id") * 2 + F.col("run")).alias("conv_id")
    digest = F.when(is_forged & (F.col("run") == 1), F.sha2(F.concat("digest", F.lit("!")), 256)).otherwise(F.col("digest")).alias("digest")
    own = F.shiftright("conv_id", 1)
    client = clients.replayed(archive.select("*", run).select(case, digest, *[c for c in archive.columns if c not in ("conv_id", "digest")]), of=own)
    both = kept_once(_told(*_search(spark, d, 4, client, sizes=sizes.select("*", run).select(case, "step", "n_bytes"))))
    again, forged = (both.where(F.pmod("conv_id", F.lit(2)) == k).withColumn("conv_id", own) for k in (0, 1))
    third = forged.select("conv_id", F.col("reason").alias("forged_reason"), (F.col("acted") - 1).alias("last"))
    same = F.struct(*[F.col(c) for c in told.columns if c != "conv_id"])
    j = told.select("conv_id", "acted", "reason", same.alias("a")).join(again.select("conv_id", same.alias("b")), "conv_id", "full").join(third, "conv_id", "left")
    at = archive.where(is_forged).groupBy("conv_id").agg(F.min("call").alias("forged"))
    stopped = F.when(F.col("forged").isNull(), F.col("forged_reason") == F.col("reason")).otherwise((F.col("forged_reason") == "no_answer") & (F.col("last") == F.col("forged")))
    return j.join(at, "conv_id", "left").select("conv_id", "acted", F.col("a").eqNullSafe(F.col("b")).alias("same"), "forged", stopped.alias("stopped"))


@query()
def finalised_cases(spark, d):
    """The decisions of searches that go on to their end: the root is the first node with most checks done, its support follows from its challenge."""
    nodes, cases, _ = _searched(spark, d)
    return _decided(nodes, cases)


def _searched(spark, d):
    """Every case's search without a budget; a case plays all its rounds in one task, where its facts lie."""
    return _search(spark, d, client=clients.lexical(clients.facts(_steps(spark, d), SIGNALS)), **ENDLESS)


def _decided(nodes: DataFrame, cases: DataFrame) -> DataFrame:
    left = nodes.where("status <> 'sidelined'")
    best = left.groupBy("conv_id").agg(F.max_by(F.struct("step", "labels", "support"), F.struct(F.size("done"), -F.col("step"))).alias("b"))
    said = F.try_element_at("b.labels", F.lit("challenge"))
    own = F.array_contains("b.support", F.concat(F.lit("s"), F.col("b.step").cast("string")))
    finals = best.select("conv_id", F.when(F.col("conv_id") % 9 != 1, F.col("b.step")).alias("root"), F.lit(0.9).alias("root_p"), F.when(said["choice"] == "supports", "supported").when(said["choice"] == "refutes", "refuted").otherwise("unknown").alias("support"), F.coalesce(said["p"], F.lit(0.0)).alias("support_p"), F.when(own, F.col("b.step")).alias("cited_step"))
    return frontier.finalise(nodes, cases.select("conv_id", (F.col("conv_id") % 7 != 2).alias("complete_scan")), finals)


@query()
def hop_search(spark, d):
    """Four hops a case; leads are the steps with most words of the first and last text, of the need and of the latest anchors."""
    return _hops(spark, d)


def _hops(spark, d, hops: int = 4, client: frontier.Client | None = None) -> DataFrame:
    s = _steps(spark, d)
    # dealt out by case once: each hop reads its tokens, the anchors' texts and both ends where they lie
    log = dealt_once(s.select("conv_id", "step", "content", F.array_distinct(tokens(F.col("content"))).alias("own")), ["conv_id"])
    ends = dealt_once(log.groupBy("conv_id").agg(F.min_by("content", "step").alias("first"), F.max_by("content", "step").alias("last")), ["conv_id"])

    def leads(state: DataFrame) -> DataFrame:
        a = state.select("conv_id", F.posexplode("anchors").alias("place", "ref")).withColumn("step", F.substring("ref", 2, 9).cast("int"))
        told = clients.at_step(a, log.select("conv_id", F.col("step").alias("at"), "content")).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]).alias("anchors"))
        full = state.select("conv_id", "need").join(told, "conv_id", "left").withColumn("anchors", F.coalesce("anchors", F.expr("cast(array() as array<string>)")))
        asked = frontier.feedback_queries(full, ends, NEED_TERMS).groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list(tokens(F.col("text"))))).alias("asked"))
        return asked.hint("shuffle_hash").join(log, "conv_id").select("conv_id", "step", F.concat(F.lit("s"), F.col("step").cast("string")).alias("ref"), F.size(F.array_intersect("own", "asked")).alias("score"))

    nodes, cases, trace = frontier.hop_search(leads, s.select("conv_id").distinct(), _unread(s), client or _client(spark, d), hops=hops)
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hop", "turn", "step", "action"))), lambda t: F.concat_ws(":", t["step"].cast("string"), t["action"])), " ")
    counts = nodes.groupBy("conv_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("status") == "sidelined").alias("n_sidelined"))
    return cases.join(trace.groupBy("conv_id").agg(path.alias("path")), "conv_id", "left").join(counts, "conv_id", "left").select("conv_id", "reason", F.array_join(F.col("attempted").cast("array<string>"), ",").alias("attempted"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_sidelined", F.lit(0)).alias("n_sidelined"))


_NEED_SQL = "case need " + " ".join(f"when '{k}' then '{v}'" for k, v in NEED_TERMS.items()) + f" else '{NEED_TERMS['challenge']}' end"


@query(ctes("steps") + f", e as (select conv_id, arg_min(content, step) as first, arg_max(content, step) as last, case conv_id % 5 when 0 then 'upstream' when 1 then 'local' when 2 then 'repair' when 3 then 'none' end as need, list(content order by step) filter (role = 'assistant') as a from steps group by 1), q as (select conv_id, unnest([first, last, {_NEED_SQL}] || coalesce(a[-2:], [])) as text, generate_subscripts([first, last, ''] || coalesce(a[-2:], []), 1) - 1 as query from e) select conv_id, query, text from q")
def feedback_query_rows(spark, d):
    """What the next retrieval asks; the assistant's texts are the anchors."""
    s = _steps(spark, d)
    need = F.expr("case conv_id % 5 when 0 then 'upstream' when 1 then 'local' when 2 then 'repair' when 3 then 'none' end")
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("step", "content")))), lambda x: x["content"])
    g = s.groupBy("conv_id").agg(F.min_by("content", "step").alias("first"), F.max_by("content", "step").alias("last"), texts.alias("anchors")).withColumn("need", need)
    return frontier.feedback_queries(g.select("conv_id", "need", "anchors"), g.select("conv_id", "first", "last"), NEED_TERMS).withColumn("query", F.col("query").cast("long"))


_SCAN = ctes("answers") + ", m as (select question, max(p) as top, any_value(choice) as choice, list(option order by option) as refs from answers group by 1), s as (select a.question, list(option order by option) filter (option <> 'error' and p = top) as sel, bool_or(option = 'error' and p = top) as unsure from answers a join m using (question) group by 1) "


@query(_SCAN + "select question, top >= 0.3 and question % 4 = 0 or (choice = 'error' and top >= 0.25) as deferred, array_to_string(case when sel is null and unsure then refs else coalesce(sel, []) end, ',') as recalled from m join s using (question)")
def scan_deferral(spark, d):
    """Segments that a scan sets aside, and the refs that each recalls; every fourth is called irrelevant, `error` is the unknown option."""
    a = A.answers(spark, d)
    g = a.join(a.groupBy("question").agg(F.max("p").alias("top")), "question").groupBy("question").agg(
        F.max("top").alias("top"), F.max("choice").alias("choice"), F.sort_array(F.collect_list("option")).alias("refs"),
        F.sort_array(F.collect_list(F.when((F.col("option") != "error") & (F.col("p") == F.col("top")), F.col("option")))).alias("selected"),
        F.bool_or((F.col("option") == "error") & (F.col("p") == F.col("top"))).alias("unknown"),
    )
    # the location is outside where the choice is the unknown option; probabilities are lifted to the scale of the threshold
    relevance = F.when(F.col("question") % 4 == 0, "irrelevant").otherwise("cause")
    lifted = g.select("question", "refs", "selected", "unknown", relevance.alias("relevance"), F.when(F.col("top") >= 0.3, 1.0).otherwise(0.0).alias("relevance_p"), F.when(F.col("choice") == "error", "outside").otherwise("inside").alias("location"), F.when(F.col("top") >= 0.25, 1.0).otherwise(0.0).alias("location_p"))
    return frontier.scan(lifted).select("question", "deferred", F.array_join("recalled", ",").alias("recalled"))


_NODES = ", n as (select conv_id, step, case step % 3 when 0 then 'upstream' else 'recall' end as source, case step % 5 when 0 then 'upstream' when 1 then 'repair' when 2 then 'local' else 'none' end as need, case when (conv_id + step) % 7 = 0 then 'sidelined' else 'open' end as status, step % 2 = 1 as looked, case step % 4 when 0 then 'propagates' when 1 then 'unknown' else 'introduces' end as said, (0.5 + (step % 5) / 10)::double as p, ceil(n_bytes / 200)::int as unread, n_bytes from steps)"
_OFFERS = ", o as (select *, 'inspect' as action, case source when 'upstream' then 4 else 2 end::double as worth from n where not looked union all select *, 'expand', 4 from n where looked and unread > 0 and (need = 'local' or said = 'unknown' or p < 0.8) union all select n.*, c, case when c = 'upstream' and said = 'propagates' then 7 when need = c then 5 else 2 end / (1 + step % 3) from n, (values ('upstream'), ('repair'), ('challenge')) as v(c) where looked and not (c = 'repair' and step % 6 = 1))"


@query(ctes("steps") + _NODES + _OFFERS + "select conv_id, step, action from o where status = 'open' qualify row_number() over (partition by conv_id order by worth / (n_bytes + 100) desc, step, action desc) = 1")
def action_choice(spark, d):
    """For each case the action of most worth a byte, over nodes in all states."""
    s, k = _steps(spark, d), F.col("step")
    said = F.struct(F.when(k % 4 == 0, "propagates").when(k % 4 == 1, "unknown").otherwise("introduces").alias("choice"), (F.lit(0.5) + (k % 5) / 10).alias("p"))
    looked, tried = k % 2 == 1, k % 6 == 1
    n = s.select(
        "conv_id", "step", "n_bytes", F.when(k % 3 == 0, "upstream").otherwise("recall").alias("source"), F.when(k % 5 == 0, "upstream").when(k % 5 == 1, "repair").when(k % 5 == 2, "local").otherwise("none").alias("need"),
        F.when((F.col("conv_id") + k) % 7 == 0, "sidelined").otherwise("open").alias("status"),
        F.array_compact(F.array(F.when(looked, "inspect"), F.when(tried, "repair"))).alias("done"),
        F.create_map(F.lit("upstream"), (k % 3).cast("int"), F.lit("repair"), (k % 3).cast("int"), F.lit("challenge"), (k % 3).cast("int")).alias("pages"),
        F.create_map(F.lit("assessment"), said).alias("labels"), F.ceil(F.col("n_bytes") / 200).cast("int").alias("unread"),
    )
    return frontier.choose(n, F.col("n_bytes") + 100).select("conv_id", F.col("step").cast("long").alias("step"), "action")


@query(ctes("steps") + "select conv_id, case when 2 + sum(n_bytes + 1) <= 2000 then 'all_eligible_original_text' else 'global_rrf_mmr_excerpts' end as strategy, count(*) as n_eligible, (2 + sum(n_bytes + 1))::bigint as full_bytes from steps where step <> 1 group by 1")
def retrieval_route(spark, d):
    """Whether all that may be shown fits the view, so that nothing needs to be ranked or clipped; step 1 was attempted."""
    full = 2 + F.sum(F.col("n_bytes") + 1)
    return _steps(spark, d).where("step <> 1").groupBy("conv_id").agg(F.when(full <= 2000, "all_eligible_original_text").otherwise("global_rrf_mmr_excerpts").alias("strategy"), F.count("*").alias("n_eligible"), full.cast("long").alias("full_bytes"))


#: Bytes of a packet, and of an excerpt in it.
PACKET, CARD = 2400, 300


def _packets(spark, d, budget: int = PACKET, excerpt: int = CARD) -> DataFrame:
    """What the next request shows of each case. Attempted steps, the longest and every fifth of case and step, aren't eligible."""
    s = _steps(spark, d)
    longest = s.groupBy("conv_id").agg(F.max_by("step", F.struct("n_bytes", -F.col("step"))).alias("step"))
    tried = longest.unionByName(s.where((F.col("conv_id") + F.col("step")) % 5 == 0).select("conv_id", "step")).distinct()
    asked = feedback_query_rows(spark, d)
    eligible = s.join(tried, ["conv_id", "step"], "left_anti").withColumn("ref", F.col("step").cast("long"))
    return packets.packet(eligible, asked, budget, excerpt)


@query()
def evidence_packet(spark, d):
    """The records that a request shows of each case: all eligible steps where they fit, else excerpts by fused ranks and diversity."""
    return _packets(spark, d)


_SIZE = "(200 + 37 * (event_id % 23))"


@query(ctes("calls") + f", r as (select *, {_SIZE} as size, row_number() over w as i, coalesce(sum({_SIZE}) over (partition by case_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as b, coalesce(sum(tokens) over (partition by case_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as t from calls window w as (partition by case_id order by ts, event_id)), y as (select case_id, i, case when size > 950 then 'request_context_limit' when i > 24 then 'call_budget' when b + size > 9000 then 'request_byte_budget' when t >= 2000 then 'input_token_budget' end as reason from r) select case_id, min(i) filter (reason is not null) as stop_at, arg_min(reason, i) filter (reason is not null) as reason from y group by 1")
def byte_budget_stop(spark, d):
    """The first request that a budget refuses: its own size, then calls, cumulative bytes, and tokens that were already used."""
    c = A.calls(spark, d).withColumn("size", F.expr(_SIZE))
    return search.session_stop(c, "case_id", ["ts", "event_id"], "size", "tokens", max_calls=24, max_bytes=9000, max_tokens=2000, request_bytes=950)


@query(ctes("answers") + ", b as (select question, option, case when question % 17 = 3 then p * 2 when question % 17 = 5 and option = 'error' then -p else p end as p, case when question % 19 = 4 then 'elsewhere' else choice end as choice from answers where not (question % 13 = 6 and option = 'click')), o as (select question, count(*) as n from answers group by 1), g as (select question, count(*) as k, sum(p) as total, min(p) >= 0 and max(p) <= 1 as sane, bool_or(option = choice) as listed from b group by 1) select question, case when coalesce(k, 0) <> n then 'options' when not listed then 'choice' when not sane then 'probability' when abs(total - 1) > 0.025 then 'sum' else 'ok' end as verdict from o left join g using (question)")
def response_validation(spark, d):
    """Answers with planted faults: options that are missing, a choice that isn't offered, impossible probabilities, wrong sums."""
    a, q = A.answers(spark, d), F.col("question")
    p = F.when(q % 17 == 3, F.col("p") * 2).when((q % 17 == 5) & (F.col("option") == "error"), -F.col("p")).otherwise(F.col("p"))
    bad = a.where(~((q % 13 == 6) & (F.col("option") == "click"))).select("question", "option", p.alias("p"), F.when(q % 19 == 4, "elsewhere").otherwise(F.col("choice")).alias("choice"))
    return policy.judge_answers(a.select("question", "option"), bad)


@query(ctes("steps", "pred") + ", n as (select conv_id, max(step) as last, count(*) as n from steps group by 1), p as (select conv_id, case when conv_id % 8 = 3 then n + 2 else predicted_step end as step, case when conv_id % 6 = 1 then 'abstained' else 'supported' end as status, case when conv_id % 12 = 5 then 999 else n end as calls, case when conv_id % 14 = 9 then step_ref + 1 else step_ref end as cited from (select pred.conv_id, predicted_step, predicted_step as step_ref, n, last from pred join n using (conv_id))) select conv_id, array_to_string(list_filter([case when calls > 24 then 'budget' end, case when step > last then 'pointer' end, case when status = 'supported' and cited <> step then 'citation' end, case when status = 'abstained' then 'unsupported_step' end], lambda x: x is not null), ',') as faults from p join n using (conv_id)")
def adaptive_audit(spark, d):
    """Saved predictions with planted faults: budgets exceeded, pointers to no step, citations of another step, a step though abstained."""
    n = _steps(spark, d).groupBy("conv_id").agg(F.max("step").alias("last"), F.count("*").alias("n"))
    j, c = A.predictions(spark, d).join(n, "conv_id"), F.col("conv_id")
    saved = j.select(
        "conv_id", "last", F.when(c % 8 == 3, F.col("n") + 2).otherwise(F.col("predicted_step")).alias("step"), F.when(c % 6 == 1, "abstained").otherwise("supported").alias("status"),
        F.when(c % 12 == 5, 999).otherwise(F.col("n")).alias("calls"), F.when(c % 14 == 9, F.col("predicted_step") + 1).otherwise(F.col("predicted_step")).alias("cited"),
    )
    faults = [F.when(F.col("calls") > 24, "budget"), F.when(F.col("step") > F.col("last"), "pointer"), F.when((F.col("status") == "supported") & (F.col("cited") != F.col("step")), "citation"), F.when((F.col("status") == "abstained") & F.col("step").isNotNull(), "unsupported_step")]
    return saved.select("conv_id", F.array_join(F.array_compact(F.array(*faults)), ",").alias("faults"))


@query(ctes("steps") + ", a as (select conv_id, step, n_bytes, sum(n_bytes) over (partition by conv_id order by step rows unbounded preceding) - n_bytes + case when conv_id % 11 = 2 and step = 2 then 1 else 0 end as start, case when conv_id % 10 = 4 and step = 1 then null else sha256(content) end as h from steps where not (conv_id % 12 = 7 and step = 1)), e as (select conv_id, step, sum(n_bytes) over (partition by conv_id order by step rows unbounded preceding) - n_bytes as start, sha256(content) as h from steps) select e.conv_id, count(*) filter (a.step is null) as missing, count(*) filter (a.step is not null and a.h is distinct from e.h) as changed, count(*) filter (a.start <> e.start) as gaps from e left join a using (conv_id, step) group by 1")
def archive_audit(spark, d):
    """An archive of shown texts against the log: expected pieces that are missing, texts that differ, offsets that don't continue."""
    before = F.sum("n_bytes").over(Window.partitionBy("conv_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_bytes")
    s, c, k = _steps(spark, d), F.col("conv_id"), F.col("step")
    shown = s.where(~((c % 12 == 7) & (k == 1))).select("conv_id", "step", (before + ((c % 11 == 2) & (k == 2)).cast("int")).alias("a_start"), F.when((c % 10 == 4) & (k == 1), None).otherwise(F.sha2("content", 256)).alias("a_hash"), F.lit(True).alias("here"))
    j = s.select("conv_id", "step", before.alias("start"), F.sha2("content", 256).alias("hash")).join(shown, ["conv_id", "step"], "left")
    return j.groupBy("conv_id").agg(F.count_if(F.col("here").isNull()).alias("missing"), F.count_if(F.col("here") & ~F.col("a_hash").eqNullSafe(F.col("hash"))).alias("changed"), F.count_if(F.col("a_start") != F.col("start")).alias("gaps"))


@query(ctes("steps", "pred") + ", h as (select conv_id, sha256(string_agg(sha256(content), '' order by step)) as digest from steps group by 1), k as (select conv_id, case when conv_id % 5 = 2 then 'x' else digest end as digest, case when conv_id % 7 = 3 then 'error' else 'complete' end as status, case when conv_id % 11 = 6 then 'older' else 'current' end as method from pred join h using (conv_id)) select k.conv_id from k join h using (conv_id, digest) where status = 'complete' and method = 'current'")
def cached_predictions(spark, d):
    """Stored predictions that may be used again: same log, finished, same method."""
    s = _steps(spark, d)
    own = s.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", F.sha2("content", 256).alias("h")))), lambda x: x["h"]), ""), 256).alias("digest"))
    c = F.col("conv_id")
    kept = A.predictions(spark, d).select("conv_id").join(own, "conv_id").select("conv_id", F.when(c % 5 == 2, "x").otherwise(F.col("digest")).alias("digest"), F.when(c % 7 == 3, "error").otherwise("complete").alias("status"), F.when(c % 11 == 6, "older").otherwise("current").alias("method"))
    return kept.where("status = 'complete' and method = 'current'").join(own, ["conv_id", "digest"], "left_semi").select("conv_id")


@query("select (select count(*) from lineitem l where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey)) as lines_without_order, (select count(*) from orders o where not exists (select 1 from customer c where c.c_custkey = o.o_custkey)) as orders_without_customer, (select count(*) from supplier s where not exists (select 1 from nation n where n.n_nationkey = s.s_nationkey)) as suppliers_without_nation, (select count(*) from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)) as customers_without_order")
def foreign_keys(spark, d):
    """Rows that name no row of the other table; the last pair isn't a key, so it need not be empty."""
    t = lambda name, key: A.load(spark, d, name).select(F.col(key).alias("k"))
    pairs = {"lines_without_order": (("lineitem", "l_orderkey"), ("orders", "o_orderkey")), "orders_without_customer": (("orders", "o_custkey"), ("customer", "c_custkey")), "suppliers_without_nation": (("supplier", "s_nationkey"), ("nation", "n_nationkey")), "customers_without_order": (("customer", "c_custkey"), ("orders", "o_custkey"))}
    counts = [t(*a).join(t(*b), "k", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, (a, b) in pairs.items()]
    stacked = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    return stacked.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in pairs])


@query(ctes("steps", "pred") + ", l as (select conv_id, list_sort(list(step)) as a from steps group by 1), r as (select conv_id, list_sort(list(step)) as b from steps where not (conv_id % 9 = 4 and step = 0) group by 1) select conv_id, a = coalesce(b, []) as equal from l left join r using (conv_id)")
def set_equality(spark, d):
    """Whether each case's saved steps are the log's, as sets; some lack the first."""
    s = _steps(spark, d)
    saved = s.where(~((F.col("conv_id") % 9 == 4) & (F.col("step") == 0))).select("conv_id", "step", F.lit(1).alias("r"))
    j = s.select("conv_id", "step", F.lit(1).alias("l")).join(saved, ["conv_id", "step"], "full")
    return j.groupBy("conv_id").agg(F.bool_and(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("equal"))


@query(ctes("answers") + "select question, coalesce(max(p) filter (option = 'click'), 0)::double as click, coalesce(max(p) filter (option = 'no such option'), 0)::double as absent, count(*)::bigint + 1 as merged from answers group by 1")
def map_merge(spark, d):
    """Probabilities as a map: read with a default, merged with one more entry."""
    m = A.answers(spark, d).groupBy("question").agg(F.map_from_entries(F.collect_list(F.struct("option", "p"))).alias("m"))
    at = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0.0))
    return m.select("question", at("click").alias("click"), at("no such option").alias("absent"), F.size(F.map_concat("m", F.create_map(F.lit("unknown"), F.lit(0.0)))).cast("long").alias("merged"))


@query(ctes("calls") + "select case_id, count(*) as calls, sum(tokens)::bigint as tokens, sum(1 + event_id % 3)::bigint as attempts, count(*) filter (event_id % 3 > 0) as retried, sum(tokens) filter (phase = 'error')::bigint as control_tokens, case when count(*) filter (event_id % 50 = 7) = 0 then round(sum(cost), 4) end as cost from calls group by 1")
def usage_attempts(spark, d):
    """Calls, tokens, attempts, retries and the share of control calls; a cost only where every call reports one."""
    c = A.calls(spark, d)
    told = F.when(F.col("event_id") % 50 != 7, F.col("cost"))
    tries = 1 + F.col("event_id") % 3
    whole = F.when(F.count(told) == F.count_if(F.col("cost").isNotNull() | (F.col("event_id") % 50 == 7)), F.round(F.sum("cost"), 4))
    return c.groupBy("case_id").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum(tries).alias("attempts"), F.count_if(tries > 1).alias("retried"), F.sum(F.when(F.col("phase") == "error", F.col("tokens"))).alias("control_tokens"), whole.alias("cost"))


@query()
def context_clip(spark, d):
    """The first step in at most 6,000 bytes and the last steps, four at most, sharing 8,000."""
    w = Window.partitionBy("conv_id")
    s = _steps(spark, d).withColumn("n", F.count("*").over(w)).withColumn("back", F.row_number().over(w.orderBy(F.desc("step"))))
    room = F.when(F.col("back") <= 4, F.floor(F.lit(8000) / F.least(F.col("n"), F.lit(4)))).otherwise(F.lit(6000)).cast("int")
    first = s.where("back = n").select("conv_id", "step", F.lit("first").alias("part"), segment.clip_middle(F.col("content"), F.lit(6000)).alias("text"))
    return first.unionByName(s.where("back <= 4").select("conv_id", "step", F.lit("last").alias("part"), segment.clip_middle(F.col("content"), room).alias("text")))
