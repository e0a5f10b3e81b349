"""Changes between deliveries against brute force: spellings, rescans, unknown hashes, missing deliveries."""

import random
from datetime import datetime as dt

from thicket.operators.snapshots import change_counts, snapshot_changes

SCHEMA = "snapshot_no int, wiki_id string, path string, hash string, scanned_at timestamp_ntz, size_bytes long, hi string, value int"
D = lambda n: dt(2024, 1, n)


def run(spark, rows):
    df = spark.createDataFrame([r + (1, "clash", 2) for r in rows], SCHEMA)
    return {tuple(r) for r in snapshot_changes(df).collect()}


def test_kinds_and_spellings(spark):
    rows = [
        (1, "w", "a/b.md", "sha256:AA", D(1)), (2, "w", ".//a\\\\b.md", "aa", D(2)), (3, "w", "a/b.md", "bb", D(3)),
        (1, "w", "gone", "x", D(1)), (2, "w", "new", None, D(2)), (3, "w", "new", "y", D(3)),
    ]
    assert run(spark, rows) == {(2, "w", "gone", "removed"), (2, "w", "new", "added"), (3, "w", "a/b.md", "changed")}


def test_rescans_and_repeats(spark):
    rows = [(1, "w", "a", "x", D(1)), (2, "w", "a", "y", D(1)), (2, "w", "a", "x", D(5)), (2, "w", "a", "x", D(5)), (2, "w", "a", "z", None)]
    assert run(spark, rows) == set()


def test_missing_delivery(spark):
    rows = [(1, "w", "a", "x", D(1)), (3, "w", "a", "y", D(3)), (2, "v", "a", "q", D(2)), (3, "v", "b", "q", D(3))]
    assert run(spark, rows) == {(3, "w", "a", "changed"), (3, "v", "a", "removed"), (3, "v", "b", "added")}


def test_nulls_and_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [(None, "w", "a", "x", D(1)), (1, None, "a", "x", D(1)), (1, "w", None, "x", D(1))]) == set()
    assert change_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_random_against_brute_force(spark):
    r = random.Random(4)
    rows = [(s, w, f"p{r.randrange(30)}", r.choice(["x", "y", "z", None]), D(s)) for s in range(1, 6) for w in ("u", "v") for _ in range(25) if r.random() < 0.8 and (s, w) != (3, "v")]
    state = {}
    for s, w, p, h, _ in rows:
        state.setdefault((w, s), {}).setdefault(p, []).append(h)
    rows = [(s, w, p, hs[0], D(s)) for (w, s), ps in state.items() for p, hs in ps.items()]
    want = set()
    for w in ("u", "v"):
        given = sorted(s for (x, s) in state if x == w)
        for a, b in zip(given, given[1:]):
            old, new = ({p: hs[0] for p, hs in state[w, s].items()} for s in (a, b))
            want |= {(b, w, p, "added") for p in new.keys() - old.keys()} | {(b, w, p, "removed") for p in old.keys() - new.keys()}
            want |= {(b, w, p, "changed") for p in new.keys() & old.keys() if old[p] and new[p] and old[p] != new[p]}
    assert run(spark, rows) == want
