"""A search by case: the rules of frontier.search as a loop over one case, in the task that holds the case's rows.

A case's rounds follow each other, so a round over all cases costs a few jobs however few of them still search, and a search without
budgets has as many rounds as its longest case. Where a client can answer from a case's own rows (clients.Log), a case plays all its
rounds where they lie, and what a search costs is the sum of its questions.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions.workers import importable, kept_once
from . import frontier

NODE = f"step:int,status:string,source:string,refs:array<string>,done:array<string>,pages:map<string,int>,labels:{frontier.LABELS},need:string,support:array<string>,parents:array<int>,unread:int"
TOLD = f"acted long, opened long, calls long, bytes long, reason string, nodes array<struct<{NODE}>>, trace array<struct<step:int,action:string,cost:long,acted:long>>"


class Node:
    """A step under suspicion, as a row of frontier's nodes."""

    def __init__(self, step: int | None, source: str | None, refs: list[str], parents: list[int], unread: int) -> None:
        self.step, self.source, self.refs, self.parents, self.unread = step, source, refs, parents, unread
        self.status, self.done, self.pages, self.labels, self.need, self.support = "open", [], {}, {}, None, []
        self.turn = 0

    def offers(self, sure: float) -> Iterator[tuple[float, str]]:
        """frontier.offers()."""
        if self.status == "sidelined":
            return
        if "inspect" not in self.done:
            yield frontier.WORTH["inspect_upstream" if self.source == "upstream" else "inspect"], "inspect"
            return
        choice, p = self.labels.get("assessment", (None, 1.0))
        if self.unread > 0 and (self.need == "local" or choice == "unknown" or p < sure):
            yield frontier.WORTH["expand"], "expand"
        for check in frontier.CHECKS:
            if check not in self.done:
                kind = "propagated" if check == "upstream" and choice == "propagates" else "hinted" if self.need == check else "check"
                yield frontier.WORTH[kind] / (1 + self.pages.get(check, 0)), check

    def hear(self, action: str, a: dict, sure: float) -> list[tuple[int, str]]:
        """frontier.settle() of this node's answer; the earlier steps that it blames."""
        local, cited, surely = action in ("inspect", "expand"), a["citation"] is not None, a["p"] >= sure
        at = a["cited_step"] if cited else None
        earlier, later = (at is not None and at < self.step), (at is not None and at > self.step)
        timely = {"challenge": cited, "upstream": earlier, "repair": later}.get(action, False)
        refuted = surely and cited and a["choice"] == "refutes" and (local or action == "challenge")
        repaired = surely and later and action == "repair" and a["choice"] == "repaired"
        blamed = surely and earlier and action == "upstream" and a["choice"] == "upstream"
        self.status = "sidelined" if refuted or repaired else "redirected" if blamed else self.status
        closes = "inspect" if local else action if (a["choice"] != "unknown" and timely) or a["external_left"] == 0 else None
        self.done = _joined(self.done, [closes] if closes else [])
        self.pages[action] = self.pages.get(action, 0) + 1
        self.labels["assessment" if local else action] = (a["choice"], a["p"])
        self.need = self.need if a["need"] is None else a["need"]
        self.support = _joined(self.support, [a["citation"]] if cited else [])
        self.unread = max(self.unread - (a["read"] or 0), 0)
        return [(step, ref) for step, ref in a["causes"] if step < self.step] if blamed else []

    def row(self) -> dict:
        own = ("step", "status", "source", "refs", "done", "need", "support", "parents", "unread")
        return {**{k: getattr(self, k) for k in own}, "pages": [*self.pages.items()], "labels": [(k, {"choice": c, "p": p}) for k, (c, p) in self.labels.items()]}


def _joined(a: list, b: list) -> list:
    return [*a, *[x for x in b if x not in a]]


class Case:
    """One case's search: what it knows of its steps, and its rounds."""

    def __init__(self, found: list[tuple], unread: dict[int, int], cost: Callable, sure: float) -> None:
        self.unread, self.cost, self.sure = unread, cost, sure
        self.nodes: dict[int | None, Node] = {}
        self.left: set[int | None] = set()
        self.heap: list[tuple] = []
        self.add(found)

    def add(self, found: list[tuple]) -> None:
        """frontier.add_nodes() of finds (step, ref, parent, source)."""
        by_step: dict[int | None, list[tuple]] = {}
        for find in found:
            by_step.setdefault(find[0], []).append(find)
        for step, finds in by_step.items():
            refs, parents = sorted({f[1] for f in finds if f[1] is not None}), sorted({f[2] for f in finds if f[2] is not None})
            node = self.nodes.get(step)
            if node is None:
                named = [(f[1], f[3]) for f in finds if f[1] is not None]
                node = self.nodes[step] = Node(step, min(named, key=lambda x: x[0])[1] if named else None, refs, parents, self.unread.get(step, 0))
            else:
                if node.status == "sidelined" and any(r not in node.refs for r in refs):
                    node.status, node.done = "open", []
                node.refs, node.parents = _joined(node.refs, refs), _joined(node.parents, parents)
            self.changed(node)

    def changed(self, node: Node) -> None:
        """Puts what the node offers now in the place of what it offered before."""
        node.turn += 1
        (self.left.discard if node.status == "sidelined" else self.left.add)(node.step)
        each = [(worth, action, max(self.cost(node.unread, len(action), len(node.refs)), 1)) for worth, action in node.offers(self.sure)]
        if each:
            worth, action, cost = max(each, key=lambda o: (o[0] / o[2], o[1]))
            heapq.heappush(self.heap, (-(worth / cost), math.inf if node.step is None else node.step, node.turn, node, action, cost))

    def pick(self) -> tuple[Node, str, int] | None:
        """frontier.choose()."""
        while self.heap and self.heap[0][2] != self.heap[0][3].turn:
            heapq.heappop(self.heap)
        return self.heap[0][3:] if self.heap else None

    def settled(self) -> bool:
        """frontier.settled()."""
        if len(self.left) != 1:
            return False
        said = self.nodes[next(iter(self.left))].labels
        return all(k in said and said[k][0] == v and said[k][1] >= self.sure for k, v in frontier.SETTLED.items())

    def play(self, cards: dict[int, list[tuple]], ask: Callable | None, rounds: int | None, max_calls: int | None, max_bytes: int | None, request_bytes: int | None) -> dict:
        """The rounds until the case stops, in the order of frontier.search; without ask nothing is there to be asked."""
        acted, opened, sent, trace, reason = 0, 0, 0, [], None
        while reason is None:
            best = self.pick() if ask else None
            if (max_calls is not None and acted + 2 >= max_calls) or (max_bytes is not None and sent + 2 * (request_bytes or 0) >= max_bytes):
                reason = "search_budget"
            elif best is None and opened not in cards:
                reason = "frontier_exhausted"
            elif best is None:
                self.add([(step, ref, None, "reopened_segment") for step, ref in cards[opened]])
                opened += 1
            elif request_bytes is not None and best[2] > request_bytes:
                reason = "request_context_limit"
            else:
                node, action, cost = best
                trace.append({"step": node.step, "action": action, "cost": cost, "acted": acted})
                acted, sent = acted + 1, sent + cost
                a = ask(node.step, action, node.pages.get(action, 0), node.unread)
                if a is None:
                    reason = "no_answer"
                else:
                    causes = node.hear(action, a, self.sure)
                    self.changed(node)
                    self.add([(step, ref, node.step, "upstream") for step, ref in causes])
                    reason = "evidence_sufficient" if self.settled() else None
            if reason is None and rounds is not None and acted >= rounds:
                reason = "round_budget"
        return {"acted": acted, "opened": opened, "calls": acted, "bytes": sent, "reason": reason, "trace": trace, "nodes": [n.row() for n in self.nodes.values()] if ask else []}


def search(found: DataFrame, cards: DataFrame, unread: DataFrame, client: frontier.Client, cost: Callable, case: str, rounds: int | None, max_calls: int | None, max_bytes: int | None, request_bytes: int | None, sure: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """frontier.search() for a client with `known`, the rows that it reads of a case, and `alone`, which answers from them."""
    spark, key, alone = found.sparkSession, F.col(case).alias("case"), client.alone
    importable(spark)
    kinds = {
        "known": client.known.where(F.col(case).isNotNull()).select(key, F.struct(*[c for c in client.known.columns if c != case]).alias("known")),
        "unread": unread.where(F.col(case).isNotNull()).select(key, F.struct("step", "unread").alias("unread")),
        "found": found.select(key, F.struct("step", "ref", "parent", "source").alias("found")),
        "cards": cards.select(key, F.struct("card", "refs").alias("cards")),
    }
    rows = None
    for frame in kinds.values():
        rows = frame if rows is None else rows.unionByName(frame, allowMissingColumns=True)
    schema = StructType([StructField("case", found.schema[case].dataType), *StructType.fromDDL(TOLD).fields])
    arrow, names = to_arrow_schema(schema), tuple(kinds)

    def played(of, own: dict[str, list]) -> dict:
        held: dict[int, int] = {}
        for r in own["unread"]:
            held[r["step"]] = max(held.get(r["step"], 0), r["unread"] or 0)
        dealt: dict[int, list[tuple]] = {}
        for r in own["cards"]:
            dealt.setdefault(r["card"], []).extend((x["step"], x["ref"]) for x in r["refs"])
        held.pop(None, None)
        one = Case([(r["step"], r["ref"], r["parent"], r["source"]) for r in own["found"]], held, cost, sure)
        # a null case meets no row of the log
        return {"case": of, **one.play(dealt if of is not None else {}, None if of is None else alone(own["known"]), rounds, max_calls, max_bytes, request_bytes)}

    def run(frames):
        last, own, out = None, None, []
        for frame in frames:
            columns = {k: frame.column(k).to_pylist() for k in ("case", *names)}
            for k, of in enumerate(columns["case"]):
                if own is None or of != last:
                    if own and (own["found"] or own["cards"]):
                        out.append(played(last, own))
                    last, own = of, {kind: [] for kind in names}
                for kind in names:
                    if columns[kind][k] is not None:
                        own[kind].append(columns[kind][k])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if own and (own["found"] or own["cards"]):
            yield pa.RecordBatch.from_pylist([played(last, own)], schema=arrow)

    # a number of partitions, since few bytes may be many questions
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "case").sortWithinPartitions("case")
    told = kept_once(dealt.mapInArrow(run, schema).withColumnRenamed("case", case))
    return told.select(case, F.inline("nodes")), told.select(case, "acted", "opened", "calls", "bytes", "reason"), told.select(case, F.inline("trace"))
