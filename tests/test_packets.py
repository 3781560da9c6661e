"""The index, the lazy diverse choice and packets against plain loops."""

import math
import os
import random
import re
from collections import Counter

import pytest

from logloom.functions.text import tokens
from logloom.operators import postings
from logloom.plans import catalogue, searches

TABLES = "/root/testdata/sf0.001"


def words(text):
    low = (text or "").lower()
    pairs = [r[i : i + 2] for r in re.findall("[一-鿿]+", low) for i in range(max(len(r) - 1, 1))]
    return re.findall(r"[a-z0-9_./:-]{2,}", low) + pairs


def bm25(texts, asked, digits):
    """{ref: score} of one query over {ref: text}."""
    counts = {r: Counter(words(t)) for r, t in texts.items()}
    average = max(sum(sum(c.values()) for c in counts.values()) / max(len(counts), 1), 1)
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for r, c in counts.items():
        norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / average)
        score = sum(math.log(1 + (len(counts) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + norm) for t in set(words(asked)) if c[t])
        if round(score, digits) > 0:
            out[r] = round(score, digits)
    return out


def greedy(scores, order, same, terms, k=None, fits=lambda _: True):
    """Every candidate compared with every choice, each time; order breaks ties."""
    left, chosen, top = sorted(scores, key=order), [], max(scores.values(), default=1)
    while left and (k is None or len(chosen) < k):
        like = lambda a, b: 1.0 if same[a] == same[b] else len(terms[a] & terms[b]) / max(len(terms[a] | terms[b]), 1)
        best = max(left, key=lambda r: 0.7 * scores[r] / top - (1 - 0.7) * max((like(r, c) for c in chosen), default=0.0))
        if not fits(best):
            break
        chosen.append(best)
        left.remove(best)
    return chosen


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(3)) for _ in range(60)]
    texts = {k: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for k in range(150)} | {150: None, 151: "漢字 漢字仮 abc"}
    asked = {q: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6))) for q in range(6)} | {6: "nowhere", 7: "", 8: "漢字"}
    docs = spark.createDataFrame([(k, t, k % 9) for k, t in texts.items()], "doc long, text string, kind long").repartition(3)
    return texts, asked, docs, postings.asked_terms(spark.createDataFrame(list(asked.items()), "q long, t string"), "q", "t")


def test_index_scores_every_positive_ref(spark, corpus):
    texts, asked, docs, terms = corpus
    for wanted in (None, terms):
        with postings.Postings(docs, "doc", "text", wanted, buckets=4) as index:
            got = {}
            for r in index.scores(terms, "q").collect():
                got.setdefault(r.q, {})[r.doc] = r.score
            best = {(r.q, r.doc): r["rank"] for r in index.ranked(terms, "q", 5).collect()}
        want = {q: scores for q, a in asked.items() if (scores := bm25(texts, a, 6))}
        assert got.keys() == want.keys() and all(got[q] == pytest.approx(want[q], abs=2e-6) for q in want)
        assert best == {(q, d): k for q, s in got.items() for k, d in enumerate(sorted(s, key=lambda d: (-s[d], d))[:5], 1)}
        assert not spark.catalog.tableExists(index.name)


def test_search_of_an_index_shuffles_no_postings(spark, corpus):
    _, _, docs, terms = corpus
    with postings.Postings(docs, "doc", "text", terms, buckets=4) as index:
        plan = index.scores(terms, "q")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(q" not in plan and "hashpartitioning(doc" not in plan


@pytest.mark.parametrize("first,most", [(64, 4096), (2, 4096), (2, 15)])
def test_diverse_choice_equals_a_plain_loop(corpus, first, most):
    texts, _, docs, terms = corpus
    with postings.Postings(docs, "doc", "text", buckets=4) as index:
        scores = {}
        for r in index.scores(terms, "q").collect():
            scores.setdefault(r.q, {})[r.doc] = r.score
        got = {}
        for r in postings.diverse_refs(index, docs, terms, "q", "text", "kind", 6, first, most).collect():
            got.setdefault(r.q, []).append((r["rank"], r.doc))
    own = {d: set(words(t)) for d, t in texts.items()}
    for q, s in scores.items():
        assert [d for _, d in sorted(got[q])] == greedy(s, lambda d: (-s[d], d), {d: d % 9 for d in texts}, own, 6), q  # noqa: B023


def test_a_candidate_that_does_not_fit_ends_the_choice(spark):
    rows = [(1, k, 10.0 - k, k + 1, k, [k], size) for k, size in enumerate([20, 30, 500, 1])] + [(2, 0, 1.0, 1, 0, [], 99)]
    page = spark.createDataFrame(rows, "q long, ref long, score double, rank long, same long, terms array<long>, size long")
    got = postings.diverse(lambda live, n: page, "q", "ref", budget=60)
    assert sorted((r.q, r["rank"], r.ref) for r in got.collect()) == [(1, 1, 0), (1, 2, 1)]


def test_packets_equal_plain_loops(spark):
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    steps, queries = {}, {}
    for r in searches._steps(spark, TABLES).collect():
        steps.setdefault(r.conv_id, {})[r.step] = r
    for r in searches.feedback_query_rows(spark, TABLES).collect():
        queries.setdefault(r.conv_id, {})[r.query] = r.text
    budget, got = 1500, {}
    for r in searches._packets(spark, TABLES, budget, 200).collect():
        got.setdefault(r.conv_id, []).append(r)
    kinds = set()
    for case, own in steps.items():
        longest = min(own, key=lambda s: (-own[s].n_bytes, s))
        texts = {s: r.content for s, r in own.items() if s != longest and (case + s) % 5}
        rows = sorted(got.get(case, []), key=lambda r: r.place)
        if not texts:
            assert not rows
            continue
        kinds.add(rows[0].strategy if rows else None)
        if rows and rows[0].strategy == "all_eligible_original_text":
            assert [r.step for r in rows] == sorted(texts) and 2 + sum(r.size + 1 for r in rows) <= budget
            continue
        rankings = []
        for text in queries[case].values():
            s = bm25(texts, text, 9)
            order = sorted(s, key=lambda d: (-s[d], d))
            if order and order not in rankings:
                rankings.append(order)
        fused = Counter()
        for order in rankings:
            for k, d in enumerate(order, 1):
                fused[d] += 1 / (60 + k)
        scores = {d: round(x, 9) for d, x in fused.items()} or dict.fromkeys(texts, 1.0)
        order = greedy(scores, lambda d: (-scores[d], d), {d: d for d in texts}, {d: set(words(t)) for d, t in texts.items()})  # noqa: B023
        assert [r.step for r in rows] == order[: len(rows)], case
        assert 2 + sum(r.size + 1 for r in rows) <= budget and all(r.n_ranked == len(scores) and r.n_queries == len(rankings) for r in rows)
        assert all(own[r.step].content.encode()[r.start_byte : r.end_byte].decode() for r in rows if r.end_byte > r.start_byte)
    assert {"all_eligible_original_text", "global_rrf_mmr_excerpts"} <= kinds


def test_excerpts_are_anchored_on_latin_tokens(spark):
    from logloom.operators import spans

    steps = spark.createDataFrame([(1, 1, "字漢字 x " + "a " * 60 + "漢字 word")], "c long, s long, t string")
    asked = steps.select("c", tokens(steps.t).alias("ts")).selectExpr("c", "explode(ts) as term")
    assert [r.term for r in spans.rarest_term(steps, asked, "c", "s", "t").collect()] == ["word"]
    assert spans.rarest_term(steps, asked.where("term = '漢字'"), "c", "s", "t").isEmpty()


def test_mmr_select_equals_a_plain_loop(spark):
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    texts, own = {d: r.text for d, r in docs.items()}, {d: set(words(r.text)) for d, r in docs.items()}
    got = {}
    for r in catalogue.mmr_select(spark, TABLES).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id))
    for item in spark.read.parquet(f"{TABLES}/benchmark.parquet").limit(8).collect():
        s = bm25(texts, item.text, 6)
        assert [d for _, d in sorted(got[item.item_id])] == greedy(s, lambda d: (-s[d], d), {d: r.source for d, r in docs.items()}, own, 5)  # noqa: B023


