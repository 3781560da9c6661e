"""Conversation structure repair by a rank-compressed dynamic program.

A conversation's turns, in order, are kept, re-roled or deleted, and empty turns are inserted, so that what is left is
`(s?(ua)+)?` by role initials (system, user, assistant) at the least cost; of equally cheap edits the sequence of their
initials (Delete, Insert, Keep, Rerole) that is least in ASCII order is taken.

An edit of the program is a run of inserts and the turn behind it, `I*[DKR]`: these codes are prefix-free, so the order of
two sequences of as many codes is that of the first codes that differ. No audit string is held, then: a layer has, for each
of four states, a cost, the rank of its sequence among the layer's, and a pointer to its parent. Sequences are
reconstructed backwards along the pointers. A run of more than two inserts costs more than one of two less and ends in
the same state.

A conversation of any length is spread over tasks: rows are sorted by conversation and turn over all partitions; a partition
sums up its first and last conversation, which others may share, as the costs and ranks from each state to each; the
summaries, two for each partition at most, are joined up, and each partition reconstructs its part between the
states that it begins and ends with.

Defined cases: a null role or text counts as one space; turns are ordered by (turn, role, text), nulls first; rows that repeat
all of them are one row with `copies`, of which all but the first are duplicates; a null conversation id is one conversation;
roles other than the three can't be kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash128, pick, ship, stored

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Blank characters, and what ends a whole turn.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of a role; what isn't listed isn't allowed.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an insert or rerole gives, by state.
GIVES = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
#: Inserts that complete a conversation, by its last state.
CLOSING = {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
INITIALS = ("s", "u", "a", "")
FAULTS = ("", "blank", "duplicate", "truncated")
CODES = sorted("I" * k + edit for k in range(3) for edit in "DKR")
NONE = 1 << 60


def inserted(state: int, n: int) -> tuple[int, str]:
    """The state after n inserts, and the roles that they give."""
    roles = ""
    for _ in range(n):
        roles += GIVES[state]
        state = NEXT[state, roles[-1]]
    return state, roles


def edits_of(initial: str, fault: str) -> list[tuple[int, int, int, int]]:
    """(state, next state, cost, place of the code) of every edit that a turn allows."""
    out = []
    for state, (place, code) in product(range(4), enumerate(CODES)):
        n = len(code) - 1
        at, cost = inserted(state, n)[0], INSERT * n
        if code[-1] == "D":
            out.append((state, at, cost + DELETE, place))
        elif fault not in ("blank", "duplicate"):
            role = initial if code[-1] == "K" else GIVES[at]
            if (at, role) in NEXT:
                out.append((state, NEXT[at, role], cost + REROLE * (code[-1] == "R") + TRUNCATED * (fault == "truncated"), place))
    return out


EDITS = {(i, f): edits_of(INITIALS[i], FAULTS[f]) for i, f in product(range(4), range(4))}


def layers(initials: np.ndarray, faults: np.ndarray, start: int) -> tuple[list[int], list[int], list[tuple[int, ...]]]:
    """Costs and ranks by last state, and for each turn the (parent * 16 + code) by state, of edits that begin in `start`."""
    cost, rank, parents = [NONE] * 4, [0] * 4, []
    cost[start] = 0
    for i, f in zip(initials.tolist(), faults.tolist(), strict=True):
        best = [(NONE, 0, 0, 0)] * 4
        for state, to, more, place in EDITS[i, f]:
            if cost[state] < NONE and (found := (cost[state] + more, rank[state], place, state)) < best[to]:
                best[to] = found
        order = sorted({(b[1], b[2]) for b in best if b[0] < NONE})
        cost, rank = [b[0] for b in best], [order.index((b[1], b[2])) if b[0] < NONE else 0 for b in best]
        parents.append(tuple(b[3] * 16 + b[2] for b in best))
    return cost, rank, parents


def best_end(cost: list[int], rank: list[int]) -> int:
    """The last state of the cheapest whole sequence."""
    return min((z for z in range(4) if cost[z] < NONE), key=lambda z: (cost[z] + INSERT * len(CLOSING[z]), rank[z]))


def reconstruct(parents: list[tuple[int, ...]], end: int) -> list[tuple[str, str, str]]:
    """(code, roles of its inserts, role initial that the turn then has or nothing) of each turn."""
    out = []
    for layer in reversed(parents):
        state, place = divmod(layer[end], 16)
        code = CODES[place]
        at, roles = inserted(state, len(code) - 1)
        kept = "" if code[-1] == "D" else next(r for r in "sua" if NEXT.get((at, r)) == end)
        out.append((code, roles, kept))
        end = state
    return out[::-1]


def runs_of(part: pa.Table) -> tuple[pa.Table, list[tuple[int, int]]]:
    """A partition's rows in order, and where each conversation begins and ends in them."""
    part = part.sort_by("pos")
    starts = np.flatnonzero(part.column("opens").to_numpy(zero_copy_only=False)).tolist()
    bounds = sorted({0, *starts, part.num_rows})
    return part, list(zip(bounds[:-1], bounds[1:], strict=True))


def ints(part: pa.Table, name: str) -> np.ndarray:
    return part.column(name).to_numpy(zero_copy_only=False)


def summaries(part: pa.Table) -> pa.Table:
    """What other partitions must know of the first and the last conversation of this one."""
    part, runs = runs_of(part)
    initials, faults, letters = ints(part, "initial"), ints(part, "fault"), part.column("letter").to_pylist()
    rows = []
    for side, (a, b) in enumerate([runs[0]] + ([runs[-1]] if len(runs) > 1 else [])):
        told = [layers(initials[a:b], faults[a:b], z)[:2] for z in range(4)]
        rows.append((part.column("c")[a], part.column("part")[a], side, letters[b - 1], [x for cost, _ in told for x in cost], [x for _, rank in told for x in rank]))
    columns = list(zip(*rows, strict=True))
    schema = pa.schema([part.schema.field("c"), part.schema.field("part"), ("side", pa.int64()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))])
    return pa.table([pa.array([x.as_py() if isinstance(x, pa.Scalar) else x for x in col], field.type) for col, field in zip(columns, schema, strict=True)], schema=schema)


def joined_up(segments: pa.Table) -> pa.Table:
    """The state that each segment of one conversation begins and ends with."""
    segs = segments.sort_by("part").to_pylist()
    cost, rank, parents = [0, NONE, NONE, NONE], [0] * 4, []
    for s in segs:
        best = [(NONE, 0, 0, 0)] * 4
        for z, to in product(range(4), range(4)):
            more = s["costs"][4 * z + to]
            if cost[z] < NONE and more < NONE and (found := (cost[z] + more, rank[z], s["ranks"][4 * z + to], z)) < best[to]:
                best[to] = found
        order = sorted({(b[1], b[2]) for b in best if b[0] < NONE})
        cost, rank = [b[0] for b in best], [order.index((b[1], b[2])) if b[0] < NONE else 0 for b in best]
        parents.append([b[3] for b in best])
    end, ends = best_end(cost, rank), []
    for layer in reversed(parents):
        ends.append((layer[end], end))
        end = layer[end]
    ends.reverse()
    return pa.table({
        "part": pa.array([s["part"] for s in segs], pa.int64()), "side": pa.array([s["side"] for s in segs], pa.int64()),
        "begin": pa.array([z for z, _ in ends], pa.int64()), "end": pa.array([z for _, z in ends], pa.int64()),
        "before": pa.array([None, *[s["last"] for s in segs[:-1]]], pa.string()), "closes": pa.array([k + 1 == len(segs) for k in range(len(segs))]),
    })


EDITED = "pos long, code string, inserts string, kept string, closing string, row_cost long, unlike boolean, fault int"


def edited(part: pa.Table, known: pa.Table) -> pa.Table:
    """The edits of every row of a partition; `known` tells the states at the seams of its first and last conversation."""
    part, runs = runs_of(part)
    initials, faults, letters = ints(part, "initial"), ints(part, "fault"), part.column("letter").to_pylist()
    seams = {r["side"]: r for r in known.to_pylist()}
    codes, inserts, kept, closing, costs, unlike = [], [], [], [""] * part.num_rows, [], []
    for k, (a, b) in enumerate(runs):
        seam = seams.get(0 if k == 0 else 1 if k + 1 == len(runs) else None) or {"begin": START, "end": None, "before": None, "closes": True}
        cost, rank, parents = layers(initials[a:b], faults[a:b], seam["begin"])
        end = best_end(cost, rank) if seam["end"] is None else seam["end"]
        told = reconstruct(parents, end)
        for row, (code, roles, role) in enumerate(told, a):
            codes.append(code), inserts.append(roles), kept.append(role)
            costs.append(INSERT * (len(code) - 1) + (DELETE if not role else REROLE * (code[-1] == "R") + TRUNCATED * (FAULTS[faults[row]] == "truncated")))
        unlike += [x is not None and x + y not in ("su", "ua", "au") for x, y in zip([seam["before"], *letters[a : b - 1]], letters[a:b], strict=True)]
        if seam["closes"]:
            closing[b - 1] = CLOSING[end]
            costs[-1] += INSERT * len(CLOSING[end])
    return pa.table([part.column("pos"), *[pa.array(x, pa.string()) for x in (codes, inserts, kept, closing)], pa.array(costs, pa.int64()), pa.array(unlike, pa.bool_()), part.column("fault")], names=["pos", "code", "inserts", "kept", "closing", "row_cost", "unlike", "fault"])


def faults_of(text: Column) -> Column:
    """The place in FAULTS of what a text alone shows."""
    solid = F.rtrim(text, F.lit(BLANKS))
    return F.when(solid == "", F.lit(1)).when(~F.substring(solid, -1, 1).isin(*ENDS), F.lit(3)).otherwise(F.lit(0))


def repair(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each different turn: conv_id, pos (rising within a conversation), turn, role, text, copies, fault (of the first copy),
    edits (initials, those of the inserts around it included), repaired (the turns that stand in its place: role and text),
    cost, illegal (pairs of neighbours whose initials don't follow each other, this turn being the second)."""
    spark = turns.sparkSession
    ship(spark)
    used = pick(turns, [conv_col, turn_col, role_col, text_col])
    blank = F.lit(" ")
    rows = used.select(used[f"`{conv_col}`"].alias("c"), used[f"`{turn_col}`"].alias("t"), F.coalesce(used[f"`{role_col}`"], blank).alias("r"), F.coalesce(used[f"`{text_col}`"], blank).alias("x"))
    each = rows.groupBy("c", "t", "r", "x").agg(F.count("*").alias("copies"))
    ordered = each.repartitionByRange("c", "t", "r", "x").sortWithinPartitions("c", "t", "r", "x").withColumn("pos", F.monotonically_increasing_id())
    letter = F.substring("r", 1, 1)
    initial = F.when(letter == "s", F.lit(0)).when(letter == "u", F.lit(1)).when(letter == "a", F.lit(2)).otherwise(F.lit(3))
    kept = stored(ordered.select("*", letter.alias("letter"), initial.alias("initial"), faults_of(F.col("x")).alias("alone"), *hash128(F.col("x"))), "turns")
    # the first row of each conversation, role and text: by position, which is no hot key
    firsts = kept.groupBy("c", "r", "h1", "h2").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    opening = kept.groupBy("c").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("opens"))
    fault = F.when((F.col("alone") != 1) & F.col("is_first").isNull(), F.lit(2)).otherwise(F.col("alone"))
    narrow = kept.select("c", "pos", "letter", "initial", "alone").join(firsts, "pos", "left").join(opening, "pos", "left")
    narrow = stored(narrow.select("c", "pos", F.shiftright("pos", 33).alias("part"), "letter", "initial", fault.alias("fault"), F.coalesce("opens", F.lit(False)).alias("opens")), "turn-kinds")
    kind = narrow.schema["c"].dataType.simpleString()
    segments = narrow.groupBy("part").applyInArrow(summaries, f"c {kind}, part long, side long, last string, costs array<long>, ranks array<long>")
    seams = segments.groupBy("c").applyInArrow(joined_up, "part long, side long, begin long, end long, before string, closes boolean")
    found = narrow.groupBy("part").cogroup(seams.groupBy("part")).applyInArrow(edited, EDITED)
    role = F.when(F.col("code").endswith("K"), F.col("r")).when(F.col("kept") == "a", F.lit("assistant")).otherwise(F.lit("user"))
    turn = lambda r, x: F.struct(r.alias("role"), x.alias("text"))
    empty = lambda roles: F.transform(F.filter(F.split(roles, ""), lambda k: k != ""), lambda k: turn(F.when(k == "a", F.lit("assistant")).otherwise(F.lit("user")), F.lit("")))
    own = F.when(F.col("kept") != "", F.array(turn(role, F.col("x")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    extra = (F.col("copies") - 1).cast("int")
    joined = kept.select("c", "t", "r", "x", "copies", "pos").join(found, "pos")
    return joined.select(
        F.col("c").alias("conv_id"), "pos", F.col("t").alias("turn"), F.col("r").alias("role"), F.col("x").alias("text"), "copies",
        F.get(F.array(*map(F.lit, FAULTS)), F.col("fault")).alias("fault"), F.concat("code", F.repeat(F.lit("D"), extra), F.repeat(F.lit("I"), F.length("closing"))).alias("edits"),
        F.concat(empty(F.col("inserts")), own, empty(F.col("closing"))).alias("repaired"), (F.col("row_cost") + DELETE * (F.col("copies") - 1)).alias("cost"),
        (F.col("unlike").cast("long") + F.col("copies") - 1).alias("illegal"),
    )


def damage(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by crc32 of conversation and turn modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    `[.!?]` out, 3 repeats it, 4 makes its role user. Nulls are one space."""
    blank = F.lit(" ")
    used = pick(turns, ["conv_id", "turn", "role", "text"])
    code = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]).cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    hurt = used.select(
        "conv_id", "turn", F.when(code == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"), code.alias("code"),
    ).where("code <> 0")
    return hurt.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, F.lit(2)).otherwise(F.lit(1)))).alias("copy")).drop("copy")
