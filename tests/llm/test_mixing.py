"""Mixes: flows against their bounds, shares, repetition caps, sources that fall short."""

import os

import pytest

from pyspark.sql import functions as F

from thicket.llm import mixing, mixing as m
from thicket.llm.tokens import RANKS

needs = pytest.mark.skipif(not os.path.exists(RANKS), reason="no rank file")
DOCS, TARGET = "doc_id long, source string, text string, tokens string, sources int", "source string, weight double, max_repeats int"


def fs(*x):
    return frozenset(x)


def test_flow_prefers_fresh_documents():
    got = m.route({fs("a"): 10, fs("b"): 10, fs("a", "b"): 10}, {"a": 15, "b": 15}, {"a": 3, "b": 3})
    assert sum(f for (p, s), f in got.items() if s == "a") == 15 and sum(f for (p, s), f in got.items() if s == "b") == 15
    assert sum(f for (p, s), f in got.items() if p == fs("a", "b")) == 10  # nothing is used twice


def test_flow_repeats_up_to_the_cap():
    assert m.route({fs("a"): 10}, {"a": 100}, {"a": 3}) == {(fs("a"), "a"): 30}
    assert m.route({}, {"a": 5}, {"a": 3}) == {} and m.route({fs("a"): 0}, {"a": 5}, {"a": 2}) == {}


def test_selection_by_given_sizes(spark):
    docs = spark.createDataFrame([(i, ["a"], 10) for i in range(500)] + [(1000 + i, ["b"], 7) for i in range(20)], "doc_id long, sources array<string>, tokens long")
    target = spark.createDataFrame([("A", 1.0, 2), ("b", 1.0, 3), ("gone", 2.0, 5)], TARGET)
    plan = m.Plan(docs, target)
    assert plan.total == 5140 and set(plan.short()) == {"b", "gone"}
    rows = m.select_documents(plan).collect()
    got = {s: sum(r["uses"] * r["tokens"] for r in rows if r["source"] == s) for s in "ab"}
    assert abs(got["a"] - 1285) <= 10 and got["b"] == 420 and max(r["uses"] for r in rows) == 3
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, m.select_documents(plan).collect()))


@needs
def test_found_and_shares(spark):
    docs = spark.createDataFrame([(1, " Guide ", "some words here", "x", 1), (2, "guide", None, "x", 1), (3, "other", "not listed", "x", 1), (4, None, "none", "x", 1), (5, "NOTE", "", "x", 1)], DOCS)
    target = spark.createDataFrame([("guide", 1.0, 1), ("Note", 1.0, 4), ("empty", 0.0, 1)], TARGET)
    assert {r["source"] for r in m.short_sources(docs, target).collect()} == {"Note", "empty"}
    s = {r["source"]: r for r in m.shares(docs, target).collect()}
    assert len(s) == 3 and s["guide"]["mixed_tokens"] in (0, 3) and s["Note"]["actual_share"] == 0.0
    none = spark.createDataFrame([], DOCS)
    assert m.mix(none, target).count() == 0 and m.shares(none, target).count() == 3


def _given(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id long, sources array<string>, tokens long")
    return mixing.Plan(d, spark.createDataFrame(targets, "source string, weight double, max_repeats int"))


def test_shared_documents_are_used_in_turn(spark):
    """100 documents of two sources with one use each: every document is used once, by one of them."""
    plan = _given(spark, [(i, ["a", "b"], 10) for i in range(100)], [("a", 1.0, 1), ("b", 1.0, 1)])
    rows = mixing.select_documents(plan).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(100)) and all(r["uses"] == 1 for r in rows) and plan.short() == []
    by = {s: sum(r["tokens"] for r in rows if r["source"] == s) for s in "ab"}
    assert by == {"a": 500, "b": 500}


def test_short_is_what_the_flow_leaves_open(spark):
    """b alone has enough, but a needs what they share."""
    docs = [(i, ["a", "b"], 10) for i in range(100)] + [(200 + i, ["c"], 10) for i in range(10)]
    plan = _given(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1), ("c", 0.0, 1)])
    assert plan.total == 1100 and len(plan.short()) == 1 and plan.short()[0] in "ab"


def test_intervals_wrap_and_many_repeats_have_few_arcs(spark):
    plan = _given(spark, [(i, ["a"], 7 + i % 5) for i in range(50)] + [(100, ["b"], 3)], [("a", 0.3, 5), ("b", 0.7, 1_000_000)])
    uses = {}
    for r in mixing.select_documents(plan).collect():
        uses[r["doc_id"], r["source"]] = r["uses"]
    assert plan.short() == []
    assert abs(uses[100, "b"] * 3 - plan.quotas["b"]) <= 3
    assert abs(sum(uses.get((i, "a"), 0) * (7 + i % 5) for i in range(50)) - plan.quotas["a"]) <= 11


def test_uses_against_brute_force(spark):
    import random

    r = random.Random(4)
    docs = [(i, r.choice([["a"], ["b"], ["a", "b"], ["a", "b", "c"]]), r.randint(0, 30)) for i in range(300)]
    plan = _given(spark, docs, [("a", 2.0, 3), ("b", 5.0, 4), ("c", 1.0, 2)])
    got = {(x["doc_id"], x["source"]): x["uses"] for x in mixing.select_documents(plan).collect()}
    at = {x["doc_id"]: x["_at"] for x in plan.docs.withColumn("_at", F.xxhash64(F.lit(17), "doc_id")).collect()}
    want = {}
    for p in plan.patterns:
        mine = sorted((d for d in docs if frozenset(d[1]) == p and d[2]), key=lambda d: (at[d[0]] % 2**64, d[0]))
        start = 0
        for s in sorted(p):
            f, c = plan.flow.get((p, s), 0), 0
            for d in mine:
                m = c + d[2] / 2
                n = sum(start <= m + j * plan.patterns[p] < start + f for j in range(20))
                if n:
                    want[d[0], s] = n
                c += d[2]
            start += f
    assert got == want
    for p in plan.patterns:
        assert all(sum(got.get((d[0], s), 0) for s in p) <= max(plan.repeats[s] for s in p) for d in docs if frozenset(d[1]) == p)
