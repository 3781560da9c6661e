"""Evidence search over candidate steps: all cases act, learn and reopen at once, as updates of one frame of nodes.

A node is a step that is under suspicion: (case, step, status, source, refs, done, pages, labels, need, support, parents, unread).
A round is a handful of joins and aggregations over all cases that still search; cases that stopped are set aside and not
touched again. A client answers a whole round's questions in one frame, so it may be a column rule, a join with stored answers
or a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workers import dealt_once, kept_once
from .ledger import Ledger

#: The probability from which an answer counts as sure, and the checks of a candidate, in order.
SURE, CHECKS = 0.8, ("upstream", "repair", "challenge")
#: What actions are worth: first looks, more of the step, a check that is asked for, one that isn't, the cause of a propagated error.
WORTH = {"inspect": 2, "inspect_upstream": 4, "expand": 4, "hinted": 5, "check": 2, "propagated": 7}
#: The answers after which nothing is left to ask of the only candidate.
SETTLED = {"assessment": "introduces", "upstream": "local", "repair": "persists", "challenge": "supports"}

LABELS = "map<string,struct<choice:string,p:double>>"
EMPTY = {
    "status": "cast('open' as string)", "source": "cast(null as string)", "refs": "cast(array() as array<string>)", "done": "cast(array() as array<string>)",
    "pages": "cast(map() as map<string,int>)", "labels": f"cast(map() as {LABELS})", "need": "cast(null as string)",
    "support": "cast(array() as array<string>)", "parents": "cast(array() as array<int>)", "unread": "cast(0 as int)",
}

Client = Callable[[DataFrame], DataFrame]
#: The bytes of a request by what is unread, the length of the action's name and the number of refs: columns or numbers.
Cost = Callable[[Column | int, Column | int, Column | int], Column | int]


def add_nodes(nodes: DataFrame | None, found: DataFrame, case: str = "conv_id") -> DataFrame:
    """nodes with those of found (case, step, ref, parent, source, unread) added.

    A step that is known gets the refs and parents it lacks; if it was sidelined, a new ref opens it again with nothing done.
    Of several finds of a new step the one with the smallest ref names its source. parent may be null.
    """
    new = found.groupBy(case, "step").agg(
        F.sort_array(F.collect_set("ref")).alias("__refs"), F.sort_array(F.collect_set("parent")).cast("array<int>").alias("__parents"),
        F.min_by("source", "ref").alias("__source"), F.max("unread").cast("int").alias("__unread"),
    )
    blank = {k: F.expr(v) for k, v in EMPTY.items()}
    if nodes is None:
        fresh = {**blank, "source": F.col("__source"), "refs": F.col("__refs"), "parents": F.col("__parents"), "unread": F.col("__unread")}
        return new.select(case, "step", *[v.alias(k) for k, v in fresh.items()])
    met = nodes.join(new, [case, "step"], "full")
    known, more = F.col("status").isNotNull(), F.size(F.array_except(F.col("__refs"), F.coalesce("refs", blank["refs"]))) > 0
    reopened = F.coalesce(more & (F.col("status") == "sidelined"), F.lit(False))
    out = {k: F.coalesce(F.col(k), v) for k, v in blank.items()}
    out["status"] = F.when(reopened, "open").otherwise(out["status"])
    out["done"] = F.when(reopened, blank["done"]).otherwise(out["done"])
    out["source"] = F.when(known, F.col("source")).otherwise(F.col("__source"))
    out["unread"] = F.when(known, F.col("unread")).otherwise(F.col("__unread"))
    for k in ("refs", "parents"):
        out[k] = F.array_union(out[k], F.coalesce(f"__{k}", blank[k]))
    return met.select(case, "step", *[v.alias(k) for k, v in out.items()])


def offers(sure: float = SURE) -> Column:
    """What may be done with a node: an array of (worth, action), empty for one that is sidelined."""
    said = F.try_element_at("labels", F.lit("assessment"))
    looked = F.array_contains("done", "inspect")
    open_question = (F.coalesce(F.col("need"), F.lit("")) == "local") | (said["choice"] == "unknown") | (said["p"] < sure)

    def offer(action: str, worth: Column, where: Column) -> Column:
        return F.when(where, F.struct(worth.cast("double").alias("worth"), F.lit(action).alias("action")))

    first = F.when(F.col("source") == "upstream", WORTH["inspect_upstream"]).otherwise(WORTH["inspect"])
    may = [offer("inspect", first, ~looked), offer("expand", F.lit(WORTH["expand"]), looked & open_question & (F.col("unread") > 0))]
    for c in CHECKS:
        value = F.when(F.col("need") == c, WORTH["hinted"]).otherwise(WORTH["check"])
        if c == "upstream":
            value = F.when(said["choice"] == "propagates", WORTH["propagated"]).otherwise(value)
        asked = F.coalesce(F.try_element_at("pages", F.lit(c)), F.lit(0))
        may.append(offer(c, value / (1 + asked), looked & ~F.array_contains("done", c)))
    return F.when(F.col("status") == "sidelined", F.array().cast("array<struct<worth:double,action:string>>")).otherwise(F.array_compact(F.array(*may)))


def choose(nodes: DataFrame, cost: Column, case: str = "conv_id", sure: float = SURE) -> DataFrame:
    """(case, step, action, cost): for each case the action of most worth for its cost; ties go to the lowest step, then the last name.

    cost is an expression over the node's columns and `action`.
    """
    each = nodes.withColumn("__o", F.explode(offers(sure))).select("*", F.col("__o.action").alias("action"), F.col("__o.worth").alias("worth")).withColumn("cost", F.greatest(cost, F.lit(1)))
    best = F.max_by(F.struct("step", "action", "cost"), F.struct(F.col("worth") / F.col("cost"), -F.col("step"), "action"))
    return each.groupBy(case).agg(best.alias("b")).select(case, "b.*")


def settle(nodes: DataFrame, answers: DataFrame, case: str = "conv_id", sure: float = SURE) -> tuple[DataFrame, DataFrame]:
    """(nodes after the answers, causes found): what an answer changes of its node, and the earlier steps that it blames.

    answers: case, step, action, choice, p, need, citation, cited_step, causes (array of ref and step), external_left, read. A null
    citation cites nothing that was shown. A sure and cited refutation, or a sure repair cited from a later step, sidelines
    the node; a sure upstream answer cited from an earlier step redirects it. A check is done when it is answered with evidence
    from the right side, or when no evidence is left outside. Nodes without an answer stay as they are.
    """
    a = answers.select(case, "step", F.struct("action", "choice", "p", "need", "citation", "cited_step", "causes", "external_left", "read").alias("a"))
    met, act, choice = nodes.join(a, [case, "step"], "left"), F.col("a.action"), F.col("a.choice")
    local, cited = act.isin("inspect", "expand"), F.col("a.citation").isNotNull()
    earlier, later = cited & (F.col("a.cited_step") < F.col("step")), cited & (F.col("a.cited_step") > F.col("step"))
    timely = ((act == "challenge") & cited) | ((act == "upstream") & earlier) | ((act == "repair") & later)
    surely = F.col("a.p") >= sure
    refuted = surely & cited & (choice == "refutes") & (local | (act == "challenge"))
    repaired = surely & later & (act == "repair") & (choice == "repaired")
    blamed = surely & earlier & (act == "upstream") & (choice == "upstream")
    answered = ((choice != "unknown") & timely) | (F.col("a.external_left") == 0)
    key = F.when(local, "assessment").otherwise(act)

    def put(kept: str, at: Column, value: Column) -> Column:
        return F.map_concat(F.map_filter(kept, lambda k, _: k != at), F.create_map(at, value))

    page = F.coalesce(F.try_element_at("pages", act), F.lit(0)) + 1
    changed = {
        "status": F.when(refuted | repaired, "sidelined").when(blamed, "redirected").otherwise(F.col("status")),
        "done": F.when(local, F.array_union("done", F.array(F.lit("inspect")))).when(answered, F.array_union("done", F.array(act))).otherwise(F.col("done")),
        "pages": put("pages", act, page),
        "labels": put("labels", key, F.struct(choice.alias("choice"), F.col("a.p").alias("p"))).cast(LABELS),
        "need": F.coalesce(F.col("a.need"), F.col("need")),
        "support": F.when(cited, F.array_union("support", F.array(F.col("a.citation")))).otherwise(F.col("support")),
        "unread": F.greatest(F.col("unread") - F.coalesce(F.col("a.read"), F.lit(0)), F.lit(0)).cast("int"),
    }
    same = [c for c in nodes.columns if c not in changed]
    asked = F.col("a").isNotNull()
    after = met.select(*same, *[F.when(asked, v).otherwise(F.col(k)).alias(k) for k, v in changed.items()]).select(*nodes.columns)
    found = met.where(blamed).select(case, F.col("step").alias("parent"), F.inline("a.causes")).where("step < parent")
    return after, found.select(case, "step", "ref", "parent", F.lit("upstream").alias("source"))


def settled(nodes: DataFrame, case: str = "conv_id", sure: float = SURE) -> DataFrame:
    """The cases whose only node that isn't sidelined has a sure, confirming answer to every question."""
    said = [F.try_element_at("labels", F.lit(k)) for k in SETTLED]
    confirmed = reduce(Column.__and__, [F.coalesce((s["choice"] == v) & (s["p"] >= sure), F.lit(False)) for s, v in zip(said, SETTLED.values(), strict=True)])
    return nodes.where("status <> 'sidelined'").groupBy(case).agg(F.count("*").alias("n"), F.bool_and(confirmed).alias("ok")).where("n = 1 and ok").select(case)


def scan(answers: DataFrame, sure: float = SURE) -> DataFrame:
    """answers (relevance, relevance_p, location, location_p, selected, unknown, refs) with `deferred` and the refs they recall.

    A segment that is surely irrelevant, or whose location surely lies outside, is deferred. One whose selection names no ref but
    holds the unknown option recalls all its refs.
    """
    outside = ((F.col("relevance") == "irrelevant") & (F.col("relevance_p") >= sure)) | ((F.col("location") == "outside") & (F.col("location_p") >= sure))
    recalled = F.when((F.size("selected") == 0) & F.col("unknown"), F.col("refs")).otherwise(F.col("selected"))
    return answers.withColumn("deferred", F.coalesce(outside, F.lit(False))).withColumn("recalled", recalled)


def search(found: DataFrame, cards: DataFrame, unread: DataFrame, client: Client, cost: Column | Cost, case: str = "conv_id", rounds: int | None = 24, max_calls: int | None = 64, max_bytes: int | None = 1_600_000, request_bytes: int | None = 62_000, sure: float = SURE, ledger: Ledger | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, cases, trace): every case acts until it stops.

    found seeds the nodes; cards (case, card, refs: array of ref and step; card counts from 0) are deferred segments, opened in
    order by a case that has nothing else to do; unread (case, step, unread) says how much a step holds. client answers
    (case, step, action, cost and the node's columns) as settle() reads it. cases: case, acted, opened, calls, bytes, reason, the
    reason being evidence_sufficient, round_budget, search_budget (two requests are kept back), request_context_limit,
    no_answer (the client had none) or frontier_exhausted. A case known only by its cards begins by opening them.

    A budget that is None ends nothing. Without a budget of rounds, a case searches until its evidence suffices or all that it was given
    is opened and asked; such a search goes by case (casewise.search) if the client answers by case, cost is a Cost and no ledger is kept.

    With a ledger every round is kept there, and a run that has rounds in it goes on behind the last whole one; it raises where the run
    was stopped. Seeds, cards and budgets must be those of the run that was cut off.
    """
    if rounds is None and ledger is None and hasattr(client, "alone") and not isinstance(cost, Column):
        from . import casewise  # it has this module's rules

        return casewise.search(found, cards, unread, client, cost, case, rounds, max_calls, max_bytes, request_bytes, sure)
    cost = cost if isinstance(cost, Column) else cost(F.col("unread"), F.length("action"), F.size("refs"))
    if ledger:
        ledger.check()
    # every round reads these two, and moves neither
    cards, unread = dealt_once(cards, [case, "card"]), dealt_once(unread, [case, "step"])
    whole = found.join(unread, [case, "step"], "left").withColumn("unread", F.coalesce("unread", F.lit(0)))
    nodes = kept_once(add_nodes(None, whole, case))
    zero = [F.lit(0).cast("long").alias(c) for c in ("acted", "opened", "calls", "bytes")]
    state = kept_once(found.select(case).unionByName(cards.select(case)).distinct().select(case, *zero))
    most = cards.agg(F.max("card")).first()[0]
    last = None if rounds is None else rounds + (0 if most is None else most + 1) + 1
    finished, ended, trace, first = [], [], [], ledger.rounds() if ledger else 0
    for k in range(first):
        trace.append(ledger.load(k, "asked"))
        ended.append(ledger.load(k, "over"))
        finished.append(ledger.load(k, "finished"))
    if first:
        nodes, state = ledger.load(first - 1, "nodes"), ledger.load(first - 1, "state")
        if state.isEmpty():
            return tuple(reduce(DataFrame.unionByName, x) for x in (finished, ended, trace))
    no = F.lit(False)
    for k in count(first) if last is None else range(first, last):
        spent = (no if max_calls is None else F.col("calls") + 2 >= max_calls) | (no if max_bytes is None else F.col("bytes") + 2 * (request_bytes or 0) >= max_bytes)
        picks = choose(nodes.join(state.where(~spent).select(case), case, "left_semi"), cost, case, sure)
        plan = state.join(picks, case, "left").join(cards.select(case, F.col("card").alias("opened"), F.col("refs").alias("card_refs")), [case, "opened"], "left")
        why = F.when(spent, "search_budget").when(no if request_bytes is None else F.col("cost") > request_bytes, "request_context_limit").when(F.col("action").isNull() & F.col("card_refs").isNull(), "frontier_exhausted")
        plan = kept_once(plan.withColumn("why", why).withColumn("card_refs", F.when(F.col("action").isNull(), F.col("card_refs"))))
        asked = plan.where("why is null and action is not null").select(case, "step", "action", "cost", "acted")
        told = client(asked.join(nodes, [case, "step"]))
        answers = told if getattr(client, "kept", False) else kept_once(told)  # some clients keep what they answer
        after, causes = settle(nodes, answers, case, sure)
        opened = plan.where("why is null and action is null").select(case, F.inline("card_refs")).select(case, "step", "ref", F.lit(None).cast("int").alias("parent"), F.lit("reopened_segment").alias("source"))
        more = causes.unionByName(opened).join(unread, [case, "step"], "left").withColumn("unread", F.coalesce("unread", F.lit(0)))
        nodes = kept_once(add_nodes(after, more, case))
        did, open_card = F.col("why").isNull() & F.col("action").isNotNull(), F.col("why").isNull() & F.col("action").isNull()
        one = did.cast("long")
        moved = plan.select(case, (F.col("acted") + one).alias("acted"), (F.col("opened") + open_card.cast("long")).alias("opened"), (F.col("calls") + one).alias("calls"), (F.col("bytes") + F.when(did, F.col("cost")).otherwise(0)).cast("long").alias("bytes"), "why", did.alias("did"))
        enough = settled(nodes, case, sure).withColumn("enough", F.lit(True))
        heard = answers.select(case).distinct().withColumn("heard", F.lit(True))
        reason = F.coalesce(F.col("why"), F.when(F.col("did") & F.col("heard").isNull(), "no_answer"), F.when(F.col("did") & F.coalesce("enough", F.lit(False)), "evidence_sufficient"), F.when(no if rounds is None else F.col("acted") >= rounds, "round_budget"))
        judged = kept_once(moved.join(enough, case, "left").join(heard, case, "left").withColumn("reason", reason).select(case, "acted", "opened", "calls", "bytes", "reason"))
        over = judged.where("reason is not null")
        told = {
            "asked": asked, "over": over, "finished": nodes.join(over.select(case), case, "left_semi"),
            "state": judged.where("reason is null").drop("reason"), "nodes": nodes.join(over.select(case), case, "left_anti"),
        }
        if ledger:
            told = ledger.save(k, told)
            ledger.check()
        trace.append(told["asked"])
        ended.append(told["over"])
        finished.append(told["finished"])
        state, nodes = told["state"], told["nodes"]
        if state.isEmpty():
            break
    return reduce(DataFrame.unionByName, finished), reduce(DataFrame.unionByName, ended), reduce(DataFrame.unionByName, trace)


def finalise(nodes: DataFrame, cases: DataFrame, finals: DataFrame, case: str = "conv_id", sure: float = SURE) -> DataFrame:
    """(case, predicted_step, decision_status, decision_reason) of every row of cases (case, complete_scan).

    finals: case, root (null: unknown), root_p, support, support_p, cited_step, asked of the nodes that aren't sidelined. A root is
    reported only where it is sure, its support is sure, the citation is of the step itself, all its checks are done and all
    segments were read; else the case abstains and says why.
    """
    left = nodes.where("status <> 'sidelined'")
    any_left = left.select(case).distinct().withColumn("candidates", F.lit(True))
    checked = reduce(Column.__and__, [F.array_contains("done", c) for c in ("inspect", *CHECKS)])
    root = left.select(case, F.col("step").alias("root"), checked.alias("checked"))
    j = cases.join(any_left, case, "left").join(finals, case, "left").join(root, [case, "root"], "left")
    whole = F.coalesce("checked", F.lit(False)) & F.coalesce("complete_scan", F.lit(False))
    holds = whole & (F.col("support") == "supported") & (F.col("support_p") >= sure) & (F.col("root_p") >= sure) & (F.col("cited_step") == F.col("root"))
    holds = F.coalesce(holds, F.lit(False)) & F.col("candidates").isNotNull()
    reason = F.when(F.col("candidates").isNull(), "no_supported_candidates").when(F.col("root").isNull(), "uncertain_final_choice").when(holds, "evidence_checked").when(~whole, "incomplete_evidence_checks").otherwise("uncertain_final_choice")
    return j.select(case, F.when(holds, F.col("root")).alias("predicted_step"), F.when(holds, "supported").otherwise("abstained").alias("decision_status"), reason.alias("decision_reason"))


def hop_search(leads: Callable[[DataFrame], DataFrame], starts: DataFrame, unread: DataFrame, client: Client, case: str = "conv_id", hops: int = 4, checks: int = 2, sure: float = SURE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, cases, trace): a fixed number of hops, each a lead, a look at it and at most two checks of it.

    starts: the cases. leads(state) gives (case, step, ref, score) for the cases of state (case, attempted, need, anchors); the best
    new step is taken, ties by step. A cause that an upstream check finds likely jumps the queue as the next hop's lead, first found
    first, and ends this hop's checks; the blamed step isn't thereby verified. cases: case, attempted, reason (hop_budget or
    no_new_retrieval_lead).
    """
    unread = dealt_once(unread, [case, "step"])
    state = kept_once(starts.select(case).distinct().select(case, F.expr("cast(array() as array<int>)").alias("attempted"), F.lit(None).cast("string").alias("need"), F.expr("cast(array() as array<string>)").alias("anchors"), F.expr("cast(array() as array<struct<ref:string,step:int>>)").alias("queue")))
    nodes, ended, trace = None, [], []
    for hop in range(hops):
        waiting = F.filter("queue", lambda q: ~F.array_contains("attempted", q["step"]))
        ready = state.withColumn("queue", waiting)
        fresh = leads(ready.where(F.size("queue") == 0).drop("queue")).join(ready.select(case, "attempted"), case).where(~F.array_contains("attempted", F.col("step")))
        best = fresh.groupBy(case).agg(F.max_by(F.struct("ref", "step"), F.struct("score", -F.col("step"), "ref")).alias("lead"))
        led = ready.join(best, case, "left")
        take, jumped = F.coalesce(F.try_element_at("queue", F.lit(1)), F.col("lead")), F.size("queue") > 0
        led = kept_once(led.select(case, "attempted", "need", F.when(~jumped & F.col("lead").isNotNull(), F.concat("anchors", F.array(F.col("lead.ref")))).otherwise(F.col("anchors")).alias("anchors"), F.when(jumped, F.slice("queue", F.lit(2), F.size("queue"))).otherwise(F.col("queue")).alias("queue"), take.alias("lead"), F.when(jumped, "upstream_hypothesis").otherwise("global_retrieval").alias("source")))
        ended.append(led.where("lead is null").select(case, "attempted", F.lit("no_new_retrieval_lead").alias("reason")))
        live = led.where("lead is not null").withColumn("attempted", F.array_append("attempted", F.col("lead.step")))
        found = live.select(case, F.col("lead.step").alias("step"), F.col("lead.ref").alias("ref"), F.lit(None).cast("int").alias("parent"), "source").join(unread, [case, "step"], "left").withColumn("unread", F.coalesce("unread", F.lit(0)))
        nodes = kept_once(add_nodes(nodes, found, case))
        state = kept_once(live.select(case, "attempted", "need", "anchors", "queue", F.col("lead.step").alias("step"), F.lit(True).alias("go"), F.expr("cast(array() as array<string>)").alias("tried")))
        for k in range(checks + 1):
            node = state.where("go").select(case, "step", "tried").join(nodes, [case, "step"])
            hint = F.coalesce(F.col("need"), F.lit(""))
            missing = [F.when(~F.array_contains("tried", c), c) for c in CHECKS]
            pick = F.when((hint == "local") & (F.col("unread") > 0), "expand").when(hint.isin(*CHECKS) & ~F.array_contains("tried", hint), hint).otherwise(F.coalesce(*missing))
            asked = node.withColumn("acted", F.lit(hop * (checks + 1) + k).cast("long")).withColumn("action", F.lit("inspect") if k == 0 else pick).where("status <> 'sidelined' and action is not null" if k else "true").drop("tried")
            answers = kept_once(client(asked))
            trace.append(answers.select(case, F.lit(hop).alias("hop"), F.lit(k).alias("turn"), "step", "action"))
            after, causes = settle(nodes, answers, case, sure)
            more = causes.join(unread, [case, "step"], "left").withColumn("unread", F.coalesce("unread", F.lit(0)))
            nodes = kept_once(add_nodes(after, more, case))
            likely = (F.col("action") == "upstream") & (F.col("choice") == "upstream") & (F.col("cited_step") < F.col("step"))
            told = answers.select(case, F.col("action").alias("__did"), F.col("need").alias("__need"), "citation", F.when(likely & F.col("citation").isNotNull(), F.struct(F.col("citation").alias("ref"), F.col("cited_step").cast("int").alias("step"))).alias("__cause"))
            heard = state.join(told, case, "left")
            queue = F.when(F.col("__cause").isNotNull(), F.array_append("queue", F.col("__cause"))).otherwise(F.col("queue"))
            anchors = F.when(F.col("citation").isNotNull() & ~F.array_contains("anchors", F.col("citation")), F.array_append("anchors", F.col("citation"))).otherwise(F.col("anchors"))
            tried = F.when(F.col("__did").isin(*CHECKS), F.array_union("tried", F.array(F.col("__did")))).otherwise(F.col("tried"))
            go = F.col("__did").isNotNull() & ((F.size(queue) == 0) | F.lit(k == 0))
            state = kept_once(heard.select(case, "attempted", F.coalesce("__need", "need").alias("need"), anchors.alias("anchors"), queue.alias("queue"), "step", go.alias("go"), tried.alias("tried")))
        state = state.select(case, "attempted", "need", "anchors", "queue")
        if state.isEmpty():
            break
    ended.append(state.select(case, "attempted", F.lit("hop_budget").alias("reason")))
    return nodes, reduce(DataFrame.unionByName, ended), reduce(DataFrame.unionByName, trace)


def feedback_queries(state: DataFrame, first_last: DataFrame, need_terms: dict[str, str], case: str = "conv_id", most: int = 2) -> DataFrame:
    """(case, query, text): the case's first and last text, words of what it needs, and its latest anchors' texts.

    first_last: case, first, last. state: case, need, anchors (texts, oldest first). An unknown need asks as challenge does.
    """
    words = F.create_map(*[F.lit(x) for kv in need_terms.items() for x in kv])
    need = F.coalesce(F.try_element_at(words, F.col("need")), F.lit(need_terms["challenge"]))
    latest = F.slice("anchors", F.greatest(F.size("anchors") - most + 1, F.lit(1)), F.lit(most))
    j = state.join(first_last, case)
    return j.select(case, F.posexplode(F.concat(F.array("first", "last", need), latest)).alias("query", "text"))
