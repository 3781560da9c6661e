import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from logloom.llm import queries, turn_repair
from logloom.llm.common import settings

SCHEMA = "conv_id long, turn long, role string, text string, copies long, pos string, c string"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(rows):
    """All edits with at most two inserts in a row, whole sequences spelt out: the cheapest, least one."""
    told, best = faults(rows), None
    options = [[(n, e) for n in range(3) for e in ("D" if f in ("blank", "duplicate") else "DKR")] for f in told]
    for choice in itertools.product(*options, range(3)):
        # an edit string decides the roles: each turn that stays takes the next place
        for roles in itertools.product("ua", repeat=sum(n for n, _ in choice[:-1]) + choice[-1] + sum(e == "R" for _, e in choice[:-1])):
            given, cost, audit, out = iter(roles), 0, "", []
            for (n, e), (role, text), f in zip(choice[:-1], rows, told, strict=True):
                for _ in range(n):
                    out.append(({"u": "user", "a": "assistant"}[next(given)], ""))
                cost += 3 * n + {"D": 4, "K": 0, "R": 3}[e] + (3 if f == "truncated" and e != "D" else 0)
                audit += "I" * n + e
                if e != "D":
                    out.append((role if e == "K" else {"u": "user", "a": "assistant"}[next(given)], text))
            for _ in range(choice[-1]):
                out.append(({"u": "user", "a": "assistant"}[next(given)], ""))
            cost, audit = cost + 3 * choice[-1], audit + "I" * choice[-1]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def by_conversation(df):
    whole = {}
    for r in sorted(df.collect(), key=lambda r: r.pos):
        t = whole.setdefault(r.conv_id, {"cost": 0, "audit": "", "out": [], "faults": [], "illegal": 0, "rows": []})
        t["cost"] += r.cost
        t["illegal"] += r.illegal
        t["audit"] += r.edits
        t["out"] += [(x.role, x.text) for x in r.repaired]
        t["faults"] += [r.fault] + ["blank" if r.fault == "blank" else "duplicate"] * (r.copies - 1)
        t["rows"] += [(r.role, r.text)] * r.copies
    return whole


def test_against_every_repair(spark):
    rng, rows = random.Random(4), []
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["a.", "b!", "c", "", None, "d?\n", "a."]
    for c in range(70):
        for t in range(rng.randint(1, 3)):
            rows += [(c, t if rng.random() > 0.1 else None, rng.choice(roles[: rng.choice([2, 3, 6])]), rng.choice(texts), 1, "p", "c")] * rng.choice([1, 1, 1, 2])
    got = by_conversation(turn_repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert sorted(got) == sorted({r[0] for r in rows})
    for c, t in got.items():
        own = sorted(((r[1] is not None, r[1] or 0, r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in rows if r[0] == c))
        own = [(role, text) for _, _, role, text in own]
        assert t["rows"] == own and t["faults"] == faults(own), c
        assert t["illegal"] == sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(own))
        if len(own) <= 3:
            assert (t["cost"], t["audit"], t["out"]) == every_repair(own), (c, own)


def whole_strings(rows):
    """Layers that hold whole audit strings, for long conversations."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "")}
    for (role, _), f in zip(rows, faults(rows), strict=True):
        new = {}
        for state, (cost, audit) in best.items():
            at = state
            for n in range(3):
                ways = [(at, cost + 4, "D")]
                if f not in ("blank", "duplicate"):
                    more = 3 * (f == "truncated")
                    ways += [(step[at, r], cost + more + add, e) for r, add, e in ((role[:1], 0, "K"), ("u", 3, "R"), ("a", 3, "R")) if (at, r) in step]
                for to, total, e in ways:
                    found = (total + 3 * n, audit + "I" * n + e)
                    new[to] = min(new.get(to, found), found)
                at = step[at, "a" if at == "u" else "u"]
        best = new
    ends = [(best[z][0] + 3 * n, best[z][1] + "I" * n) for z, n in (("", 0), ("s", 2), ("u", 1), ("a", 0)) if z in best]
    return min(ends)


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["x.", "y", f"{t}!", f"{t}?", f"{t}"]), 1, "p", "c") for t in range(900)]
    rows += [(k, 0, "user", "hello.", 1, "p", "c") for k in range(30)] + [(None, None, "user", "hm", 1, "p", "c")] + [rows[5]] * 40
    rows = [r for r in rows if r[0] != 7 or r[2] == "user" or rng.random() < 0.9]
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        found = turn_repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert found.where("conv_id = 7").select(F.shiftright("pos", 33)).distinct().count() > 1
    got = by_conversation(found)
    own = [(x, y) for _, x, y in sorted((r[1], r[2], r[3]) for r in rows if r[0] == 7)]
    assert got[7]["rows"] == own and (got[7]["cost"], got[7]["audit"]) == whole_strings(own)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in got[7]["out"]))
    assert got[7]["illegal"] == sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(own))
    assert got[None]["audit"] == "D" and all(got[k]["audit"] == "KI" for k in range(30) if k != 7)


def test_empty_table(spark):
    assert turn_repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_op13_damages_and_tells_all_conversations(spark, tmp_path):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["one. two.", "three", None])) for c in range(60) for t in range(rng.randint(1, 4))]
    rows += [(k, 0, "user", "gone.") for k in range(1000, 1200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][:3]
    rows += [(None, None, None, None), (99, None, "user", "only."), (99, 5, "assistant", "so.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op13_rank_dp(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    shown = lambda x: " " if x is None else str(x)
    gone = 0
    for c, r in got.items():
        hurt = []
        for _, turn, role, text in (x for x in rows if x[0] == c):
            code = zlib.crc32(f"{shown(c)}:{shown(turn)}".encode()) % 20
            role, text = shown(role), shown(text)
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            hurt += [(turn is not None, turn or 0, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        hurt.sort()
        own = [(x, y) for _, _, x, y in hurt]
        told = faults(own)
        assert (r.blank, r.duplicate, r.truncated) == tuple(told.count(k) for k in ("blank", "duplicate", "truncated"))
        known = [t for some, t, _, _ in hurt if some]
        assert r.gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert (r.cost, r.audit) == (whole_strings(own) if own else (0, ""))
        gone += not own
        if not own:
            assert r.repaired_sha256 == hashlib.sha256(b"").hexdigest()
        elif len(own) <= 3:
            assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{x}:{y}" for x, y in every_repair(own)[2]).encode()).hexdigest()
    assert gone


@pytest.mark.parametrize("start", range(4))
def test_codes_are_prefix_free_and_ordered(start):
    assert turn_repair.CODES == sorted(turn_repair.CODES) and not any(a != b and b.startswith(a) for a in turn_repair.CODES for b in turn_repair.CODES)
    assert turn_repair.inserted(start, 2)[1] in ("ua", "au")
