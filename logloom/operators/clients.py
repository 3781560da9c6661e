"""Clients of a search: answers from the texts, from an archive, and what an archive needs to know of each call.

A client answers a frame of questions at once (see frontier.Client). `lexical` scores a question's options in the step's own text and in
the next page of what is retrieved for it, of all cases at once or, as `Log`, of one; `recorded` notes every call with its number in the case and the digest of its request;
`replayed` looks answers up by both, so a request that isn't the one that was answered gets no answer, and its case stops.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import REPAIR, evidence_terms, normalize_role, recipient
from ..functions.workers import dealt_once, kept_once
from . import choice
from .frontier import Client

#: What a question asks for: the step itself, earlier steps, later ones or both.
LOCAL = ("inspect", "expand")
ANSWER = ("action", "choice", "p", "need", "citation", "cited_step", "causes", "external_left", "read")


def digest(case: str = "conv_id", of: Column | None = None) -> Column:
    """Of a request: who asks what about which step, which page, and what is known of the step by then. of: the case, where it goes by another key."""
    return F.sha2(F.to_json(F.struct((F.col(case) if of is None else of).alias(case), "step", "action", "pages", "labels", "need", "refs", "support")), 256)


def facts(steps: DataFrame, patterns: dict[str, str], case: str = "conv_id", step: str = "step", name: str = "name", text: str = "content") -> DataFrame:
    """(case, at, ref, ts, role, to, repairs, the signals) of every step: all that a client reads of a log, without its texts."""
    shown = choice.signals(F.col(text), patterns)
    return steps.select(
        case, F.col(step).cast("int").alias("at"), F.concat(F.lit("s"), F.col(step).cast("string")).alias("ref"), evidence_terms(F.col(text)).alias("ts"),
        normalize_role(F.col(name)).alias("role"), recipient(F.col(name)).alias("to"), F.coalesce(F.col(text).rlike(REPAIR), F.lit(False)).alias("repairs"), *[c.cast("int").alias(k) for k, c in shown.items()],
    )


def at_step(asked: DataFrame, known: DataFrame, case: str = "conv_id") -> DataFrame:
    """asked (case, step) with what is known at its step. Joined by the case alone, so that facts dealt out by case stay where they are.

    A round asks a case one question, so only these few rows are moved, and a case's facts are read past them.
    """
    told = known.withColumnRenamed(case, "__case")
    # a difference, since an equation of both steps would be a second key
    return asked.hint("shuffle_hash").join(told, (F.col(case) == F.col("__case")) & (F.col("at") - F.col("step") == 0)).drop("__case")


def packets(asked: DataFrame, known: DataFrame, page: int, case: str = "conv_id") -> DataFrame:
    """(case, step, action, shown, left): the next page of what is retrieved for each check, best first, and how much is left behind it.

    The cursor is the number of pages that the node has read for this check: a page follows the one before, and nothing is shown twice. Rows score
    the terms that they share with the step, 12 more for an earlier step that addresses its role, 3 more for words of a repair.
    """
    checks = at_step(asked.where(~F.col("action").isin(*LOCAL)).select(case, "step", "action", "page"), known.select(case, "at", F.col("ts").alias("__ts"), F.col("role").alias("__role")), case).drop("at")
    met = checks.hint("shuffle_hash").join(known.drop("role"), case)
    side = F.when(F.col("action") == "upstream", F.col("at") < F.col("step")).when(F.col("action") == "repair", F.col("at") > F.col("step")).otherwise(F.col("at") != F.col("step"))
    more = F.when((F.col("action") == "upstream") & (F.col("to") != "") & (F.col("to") == F.col("__role")), 12).when((F.col("action") != "upstream") & F.col("repairs"), 3).otherwise(0)
    scored = met.where(side).withColumn("score", F.size(F.array_intersect("ts", "__ts")) + more)
    w = Window.partitionBy(case, "step", "action")
    ranked = scored.select("*", F.row_number().over(w.orderBy(F.desc("score"), F.abs(F.col("at") - F.col("step")), "at")).alias("rank"), F.count("*").over(w).alias("n"))
    first = F.col("page") * page
    shown = ranked.where((F.col("rank") > first) & (F.col("rank") <= first + page))
    card = F.struct("rank", "ref", F.col("at").alias("step"), "score", "failure", "repair", "constraint")
    left = ranked.groupBy(case, "step", "action").agg(F.greatest(F.max(F.col("n") - F.col("page") * page - page), F.lit(0)).cast("int").alias("left"))
    return left.join(shown.groupBy(case, "step", "action").agg(F.sort_array(F.collect_list(card)).alias("shown")), [case, "step", "action"], "left")


#: What an unknown answer scores with and without a card.
SEEN, UNSEEN = 0.25, 3.0


def local_options(failure, repair, constraint) -> dict:
    """What the options of a look score by a step's own signals: columns or numbers."""
    return {"introduces": 2 * failure + constraint, "propagates": 0.75, "refutes": 2 * repair, "unknown": 0.5}


def check_options(score, failure, repair, own_failure, unsure) -> dict[str, dict]:
    """What the options of each check score by its best card and the step's own failure: columns or numbers."""
    return {
        "upstream": {"upstream": score / 4 + 2 * failure, "local": 1.5, "unrelated": 0.5, "unknown": unsure},
        "repair": {"persists": 1.5, "repaired": 2 * repair + score / 8, "unknown": unsure},
        "challenge": {"supports": 2 * own_failure + 1, "refutes": 2 * repair, "unknown": unsure},
    }


def lexical(known: DataFrame, page: int = 2, case: str = "conv_id") -> Client:
    """A client over facts(), which are best dealt out by case, since each round reads them. A check's best card is what it cites, if they share a term; without a card the answer is unknown.

    known and alone are for a search by case: Log answers as this does.
    """
    key = [case, "step", "action"]

    def answer(asked: DataFrame) -> DataFrame:
        asked = asked.withColumn("page", F.coalesce(F.try_element_at("pages", F.col("action")), F.lit(0)))
        own = known.select(case, "at", "ref", *[F.col(k).alias(f"own_{k}") for k in choice.WEIGHTS])
        met = at_step(asked.select(*key, "page", "unread"), own, case).drop("at").join(packets(asked, known, page, case), key, "left").withColumn("top", F.get("shown", F.lit(0)))
        own_f, own_r, own_c = (F.col(f"own_{k}") for k in ("failure", "repair", "constraint"))
        score, seen = F.coalesce(F.col("top.score"), F.lit(0)), F.col("top").isNotNull()
        local = local_options(own_f, own_r, own_c)
        checks = check_options(score, F.coalesce(F.col("top.failure"), F.lit(0)), F.coalesce(F.col("top.repair"), F.lit(0)), own_f, F.when(seen, SEEN).otherwise(UNSEEN))
        listed = lambda options: F.array(*[F.struct(F.lit(k).alias("option"), (v if isinstance(v, Column) else F.lit(v)).cast("double").alias("score")) for k, v in options.items()])
        options = F.when(F.col("action").isin(*LOCAL), listed(local))
        for k, v in checks.items():
            options = options.when(F.col("action") == k, listed(v))
        told = choice.distribution(met.select(*key, F.inline(options)), key, "option", "score").where("option = choice").select(*key, "choice", "p")
        is_local = F.col("action").isin(*LOCAL)
        need = F.when(own_r > 0, "repair").when(own_c > 0, "challenge").when(own_f > 0, "upstream").when(F.col("unread") > 1, "local").otherwise("none")
        cites = F.when(is_local, own_f + own_r > 0).otherwise(F.coalesce(F.col("top.score") > 0, F.lit(False)))
        causes = F.transform(F.filter("shown", lambda c: c["score"] > 0), lambda c: F.struct(c["ref"].alias("ref"), c["step"].alias("step")))
        return met.join(told, key).select(
            *key, "choice", "p", F.when(is_local, need).alias("need"), F.when(cites, F.when(is_local, F.col("ref")).otherwise(F.col("top.ref"))).alias("citation"),
            F.when(cites, F.when(is_local, F.col("step")).otherwise(F.col("top.step"))).cast("int").alias("cited_step"),
            F.coalesce(causes, F.array().cast("array<struct<ref:string,step:int>>")).alias("causes"), F.coalesce("left", F.lit(0)).alias("external_left"), F.lit(1).alias("read"),
        )

    answer.known, answer.alone = known, lambda rows: Log(rows, page).answer
    return answer


#: Steps of a log that counts as short.
SHORT = 64
#: Ranked cards that a log holds for checks that may ask for more pages; beyond, they are ranked again.
HELD = 4_000_000


class Log:
    """One case's facts(), asked as lexical() is. Rows that repeat a step are one: its terms are united, its signals are those of any."""

    def __init__(self, rows: list[dict], page: int) -> None:
        self.page, steps = page, {}
        for r in rows:
            if r["at"] is not None:
                steps.setdefault(r["at"], []).append(r)
        self.at = np.array(sorted(steps), np.int64)
        self.place = {step: i for i, step in enumerate(self.at.tolist())}
        parts = [steps[step] for step in self.place]
        self.ref = [max(r["ref"] for r in p) for p in parts]
        self.role, self.to = ([max(r[k] for r in p) for p in parts] for k in ("role", "to"))
        self.own = {k: [max(r[k] for r in p) for p in parts] for k in choice.WEIGHTS}
        self.repairs = np.array([any(r["repairs"] for r in p) for p in parts], bool)
        self.terms = [sorted({t for r in p for t in r["ts"] or ()}) for p in parts]
        met: dict[str, list[int]] = {}
        for i, own in enumerate(self.terms):
            for t in own:
                met.setdefault(t, []).append(i)
        # a short log's lists are joined sooner than many small arrays
        self.met = met if len(parts) <= SHORT else {t: np.array(places) for t, places in met.items()}
        self.addressed: dict[str, list[int]] = {}
        for i, to in enumerate(self.to):
            if to:
                self.addressed.setdefault(to, []).append(i)
        self.shared: tuple[int | None, np.ndarray | None] = (None, None)
        self.held: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}
        self.n_held = 0

    def overlap(self, i: int) -> np.ndarray:
        """How many terms each step shares with step i."""
        if self.shared[0] != i:
            found, n = [self.met[t] for t in self.terms[i]], len(self.at)
            joined = [*chain.from_iterable(found)] if n <= SHORT else np.concatenate(found) if found else []
            self.shared = (i, np.bincount(np.asarray(joined, np.int64), minlength=n))
        return self.shared[1]

    def ranked(self, i: int, action: str) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all that packets() ranks for a check, best first."""
        if (i, action) in self.held:
            return self.held[i, action]
        score, n = self.overlap(i).copy(), len(self.at)
        if action == "upstream":
            score[self.addressed.get(self.role[i], [])] += 12
        else:
            score[self.repairs] += 3
        side = np.arange(i) if action == "upstream" else np.arange(i + 1, n) if action == "repair" else np.concatenate([np.arange(i), np.arange(i + 1, n)])
        side = side[np.lexsort((side, np.abs(self.at[side] - self.at[i]), -score[side]))]
        if self.n_held + len(side) > HELD:
            self.held, self.n_held = {}, 0
        self.held[i, action] = side.astype(np.int32), score[side].astype(np.int32)
        self.n_held += len(side)
        return self.held[i, action]

    def answer(self, step: int | None, action: str, page: int, unread: int) -> dict | None:
        """What frontier.settle() reads of an answer; None for a step that the log doesn't have."""
        if step not in self.place:
            return None
        i = self.place[step]
        failure, repair, constraint = (self.own[k][i] for k in ("failure", "repair", "constraint"))
        if action in LOCAL:
            need = "repair" if repair else "challenge" if constraint else "upstream" if failure else "local" if unread > 1 else "none"
            cited = failure + repair > 0
            said, p = _looked(failure, repair, constraint)
            return {"choice": said, "p": p, "need": need, "citation": self.ref[i] if cited else None, "cited_step": step if cited else None, "causes": [], "external_left": 0, "read": 1}
        places, scores = self.ranked(i, action)
        first = page * self.page
        shown = [*zip(places[first : first + self.page].tolist(), scores[first : first + self.page].tolist(), strict=True)]
        top, score = shown[0] if shown else (None, 0)
        said, p = _checked(action, score, self.own["failure"][top] if shown else 0, self.own["repair"][top] if shown else 0, failure, SEEN if shown else UNSEEN)
        cited = score > 0
        return {
            "choice": said, "p": p, "need": None, "citation": self.ref[top] if cited else None, "cited_step": int(self.at[top]) if cited else None,
            "causes": [(int(self.at[k]), self.ref[k]) for k, s in shown if s > 0], "external_left": max(len(places) - first - self.page, 0), "read": 1,
        }


@lru_cache(maxsize=4096)  # the same few scores come again and again
def _looked(failure: int, repair: int, constraint: int) -> tuple[str, float]:
    return _likeliest(local_options(failure, repair, constraint))


@lru_cache(maxsize=4096)
def _checked(action: str, *scores) -> tuple[str, float]:
    return _likeliest(check_options(*scores)[action])


def _likeliest(options: dict[str, float]) -> tuple[str, float]:
    """choice and p as choice.distribution() tells them."""
    most = max(options.values())
    raised = {k: math.exp(v - most) for k, v in options.items()}
    total = sum(raised.values())
    shares = {k: round(v / total, 9) for k, v in raised.items()}
    said = min(shares, key=lambda k: (-shares[k], k))
    return said, shares[said]


def recorded(client: Client, calls: list[DataFrame], case: str = "conv_id") -> Client:
    """client, with what it was asked and answered added to calls: (case, call, digest, step, the answer). A round is written once."""

    def answer(asked: DataFrame) -> DataFrame:
        asks = asked.select(case, F.col("acted").alias("call"), "step", "action", digest(case).alias("digest"))
        calls.append(kept_once(asks.join(client(asked), [case, "step", "action"]).select(case, "call", "digest", "step", *ANSWER)))
        return calls[-1].select(case, "step", *ANSWER)

    answer.kept = True
    return answer


def replayed(calls: DataFrame, case: str = "conv_id", of: Column | None = None) -> Client:
    """A client that answers from an archive; calls (case, call, digest, step, the answer). Another digest gets no answer.

    A case's calls lie in one row, dealt out by case once, so a round moves its questions only. of: as digest() takes it.
    """
    known = dealt_once(calls.groupBy(case).agg(F.collect_list(F.struct("call", "digest", "step", *ANSWER)).alias("__calls")), [case])

    def answer(asked: DataFrame) -> DataFrame:
        asks = asked.select(case, F.col("acted").alias("__call"), F.col("step").alias("__step"), F.col("action").alias("__action"), digest(case, of).alias("__digest"))
        fits = F.filter("__calls", lambda c: (c["call"] == F.col("__call")) & (c["digest"] == F.col("__digest")) & (c["step"] == F.col("__step")) & (c["action"] == F.col("__action")))
        return asks.hint("shuffle_hash").join(known, case).select(case, F.inline(fits)).select(case, "step", *ANSWER)

    return answer
