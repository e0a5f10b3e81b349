"""Soft parents in blocks: the same in small blocks and large ones, and nothing per common term is shuffled."""

import math
import random
from collections import Counter

import pytest

from thicket.operators import tree

LEAF = "wiki_id string, dir string, leaf_no long, tokens array<string>"
PAGE = "wiki_id string, dir string, focus string, shared_covers array<string>"


def tables(spark, leaves=400, directories=20):
    r = random.Random(5)
    words = [[f"d{i}w{j}" for j in range(6)] for i in range(directories)]
    rows = [("w", f"w/d{i % directories}", i, r.sample(words[i % directories], 3) + r.sample(words[r.randrange(directories)], 3) + ["common"]) for i in range(leaves)]
    rows += [("w", "w/d0", leaves, []), ("other", "other/x", leaves + 1, ["d1w1", "d1w2"])]
    pages = [("w", f"w/d{i}", f"about {words[i][0]}", None) for i in range(directories)] + [("w", "w/empty", None, None)]
    return spark.createDataFrame(rows, LEAF), spark.createDataFrame(pages, PAGE)


def test_blocks_change_nothing(spark, monkeypatch):
    lv, pg = tables(spark)
    one = sorted(map(tuple, tree.soft_parents(lv, pg).collect()))
    monkeypatch.setattr(tree, "SOFT_LEAVES", 90)
    monkeypatch.setattr(tree, "SOFT_BELOW", 120)
    monkeypatch.setattr(tree, "SOFT_WORK", 60)
    assert one and one == sorted(map(tuple, tree.soft_parents(lv, pg).collect()))


def test_no_join_over_terms(spark):
    """A word that all leaves and directories share makes no row for each two of them."""
    lv, pg = tables(spark)
    plan = tree.category_scores(lv, pg)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "term" not in plan.split("FlatMapGroupsInArrow")[0]


@pytest.mark.parametrize("most", (1, 3))
def test_ties_go_to_the_smaller_name(spark, monkeypatch, most):
    monkeypatch.setattr(tree, "SOFT_MOST", most)
    lv = spark.createDataFrame([("w", "w/a", 1, ["one", "two"])] + [("w", f"w/{d}", 10 + i, ["one", "two"]) for i, d in enumerate("edcb")], LEAF)
    pg = spark.createDataFrame([("w", f"w/{d}", None, None) for d in "abcde"], PAGE)
    got = [(x["category"], x["rank"]) for x in tree.soft_parents(lv, pg).where("leaf_no = 1").orderBy("rank").collect()]
    assert got == [("w/b", 1), ("w/c", 2), ("w/d", 3)][:most]


def test_only_the_best_leave_a_block(spark):
    """However many categories a leaf is like, each of its blocks gives three at most."""
    lv = spark.createDataFrame([("w", f"w/d{i}", i, ["one", "two"]) for i in range(30)], LEAF)
    pg = spark.createDataFrame([("w", f"w/d{i}", None, None) for i in range(30)], PAGE)
    assert tree.category_scores(lv, pg).count() == 30 * tree.SOFT_MOST


def written(plan):
    """Bytes that the exchanges of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return written(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return written(plan.plan())
    own = plan.metrics().get("dataSize").get().value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(written(plan.children().apply(i)) for i in range(plan.children().size()))


def test_repeated_pages_write_no_more(spark):
    """A page that is there many times counts its leaves as often, but nothing of them is written again."""
    lv, pg = tables(spark)
    size = []
    for times in (1, 150):
        many = pg.crossJoin(spark.range(times)).drop("id") if times > 1 else pg
        scores = tree.category_scores(lv, many)
        scores._jdf.collectToPython()
        size.append(written(scores._jdf.queryExecution().executedPlan()))
    assert size[1] < 3 * size[0]


@pytest.mark.parametrize("leaves", (20_000, 50))
def test_repeated_pages_against_brute_force(spark, monkeypatch, leaves):
    monkeypatch.setattr(tree, "SOFT_LEAVES", leaves)
    monkeypatch.setattr(tree, "SOFT_PARTS", 3)
    lv, pg = tables(spark, 200, 8)
    pg = pg.unionByName(pg.where("dir <> 'w/d2'")).unionByName(pg.where("dir = 'w/d1'"))
    own, texts = [r for r in lv.collect() if r.wiki_id == "w"], [(r.dir, (r.focus or "").split() * 2) for r in pg.collect()]
    leaf, cat = {r.leaf_no: Counter(r.tokens) for r in own}, {}
    for d, text in texts:
        cat.setdefault(d, Counter()).update(text + [t for r in own if r.dir == d for t in r.tokens])
    n, df = len(own) + len(texts), Counter(t for c in [*leaf.values(), *cat.values()] for t in c)

    def unit(c):
        w = {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    want, cats = [], {d: unit(c) for d, c in cat.items()}
    for r in own:
        u = unit(leaf[r.leaf_no])
        like = [(-round(sum(x * c.get(t, 0) for t, x in u.items()), 6), d) for d, c in cats.items() if d != r.dir]
        want += [(r.leaf_no, d, -s, i + 1) for i, (s, d) in enumerate(sorted(x for x in like if x[0] <= -tree.SOFT_LEAST)[: tree.SOFT_MOST])]
    got = sorted(tuple(x)[:4] for x in tree.soft_parents(lv, pg).select("leaf_no", "category", "cosine", "rank").collect())
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want)]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)], abs=2e-6)
