"""Similar pairs of sets against brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest

from thicket.llm import overlap as o

SCHEMA = "k long, a array<string>, b array<string>, rep int, record string"


def brute(rows, least=4, s=Fraction(3, 5)):
    sets = {}
    for k, a, b, *_ in rows:
        if k is not None:
            v = {" ".join(x.lower().replace("-", " ").replace("_", " ").split()) for x in (a or []) + (b or []) if x} - {""}
            if len(v) >= least:
                sets[k] = v
    return {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= s * len(sets[i] | sets[j])}


def run(spark, rows):
    df = spark.createDataFrame([r + (0, "x") for r in rows], SCHEMA)
    return {tuple(r) for r in o.similar_records(df, "k", ["a", "b"]).collect()}


def test_edges(spark):
    rows = [
        (1, ["a", "b", "c"], ["D-e"]), (2, ["d_E", "c", "b"], ["A", "a"]), (3, ["a", "b", "c", "x", "y"], None),  # 1 = 2; 3 of 6 isn't enough
        (4, ["p", "q", "r"], ["s", "t", "u"]), (5, ["p", "q", "r"], ["v", "w"]), (6, None, None), (7, ["", None, " "], []), (8, ["a", "b", "c"], None), (None, ["a", "b", "c", "d e"], None),
        (9, ["m1", "m2", "m3", "m4"], ["m5"]), (10, ["m1", "m2", "m3"], ["n4"]),  # 3 of 6
        (11, ["z1", "z2", "z3", "z4"], None), (12, ["z1", "z2", "z3", "y4"], None),  # 3 of 5: exactly 0.6
    ]
    assert run(spark, rows) == brute(rows) == {(1, 2), (11, 12)}


def test_empty(spark):
    assert run(spark, []) == set()


def test_random_with_copies_and_hot_values(spark):
    r = random.Random(1)
    base = [[f"v{r.randrange(300)}" for _ in range(r.randint(4, 12))] + ["hot"] * (r.random() < 0.5) for _ in range(60)]
    rows = []
    for k in range(400):
        v = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            v[r.randrange(len(v))] = f"w{r.randrange(50)}"
        rows.append((k, v[::2], v[1::2]))
    assert run(spark, rows) == brute(rows)


def test_crowded_neighbourhoods_deepen_and_end_exactly(spark, monkeypatch):
    monkeypatch.setattr(o, "CROWD", 3)
    monkeypatch.setattr(o, "ROUNDS", 1)
    r = random.Random(2)
    rows = [(k, [f"c{i}" for i in range(8)] + [f"x{r.randrange(6)}" for _ in range(3)], None) for k in range(60)]
    assert run(spark, rows) == brute(rows)


def test_between_tables(spark):
    left = spark.createDataFrame([(1, ["a", "b", "c", "d"], None, 0, ""), (2, ["q"], None, 0, "")], SCHEMA)
    right = spark.createDataFrame([(1, ["a", "b", "c", "d"], None, 0, ""), (5, ["a", "b", "c", "d", "e"], None, 0, "")], SCHEMA)
    assert {tuple(r) for r in o.similar_between(left, right, "k", ["a", "b"]).collect()} == {(1, 1), (1, 5)}


def test_kernels():
    offsets, values = np.array([0, 3, 6, 8]), np.array([1, 2, 3, 2, 3, 4, 3, 9])
    assert list(o.common_counts(offsets, values, np.array([0, 0, 1]), np.array([1, 2, 2]))) == [2, 1, 1]
    assert list(o.similar(offsets, values, np.array([0, 0]), np.array([1, 2]), Fraction(1, 2))) == [True, False]
    p = o.prefixes(np.array([0, 2, 4]), np.array([5, 6, 5, 6]), 0, 4, 3)
    assert (p[0] == p[1]).all()


@pytest.mark.parametrize("s", [0.5, 0.6, 0.8, 1.0])
def test_trees_reach_the_recall(s):
    n = o.trees_for(s)
    assert s == 1.0 or (1 - s**o.SHALLOW) ** n <= 1 - o.RECALL


def test_links_are_the_pairs_of_each_record(spark, monkeypatch):
    """Classes with links tell as many pairs as the expanded form, also with copies in several parts."""
    import random

    from thicket.llm import overlap

    r = random.Random(8)
    pools = [[f"v{i}{chr(97 + k)}" for k in range(8)] for i in range(6)]
    rows = [(i, r.sample(r.choice(pools), r.choice([5, 6, 7])), None, None, None) for i in range(90)] + [(1000 + i, pools[0][:6], ["x"], None, None) for i in range(25)]
    leaf = spark.createDataFrame(rows, "leaf_no long, covers array<string>, tags array<string>, updated_at timestamp, loaded_at timestamp")
    monkeypatch.setattr(overlap, "COPIES", 4)
    pairs = [tuple(x) for x in overlap.leaf_pairs(leaf).collect()]
    sets = {x[0]: set(x[1]) | set(x[2] or []) for x in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 5 >= 3 * len(sets[a] | sets[b])}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    links = {x["leaf_no"]: x["links"] for x in overlap.leaf_links(leaf).collect()}
    assert sum(links.values()) == 2 * len(pairs) and links[1000] == sum(1000 in p for p in pairs)
