"""Value counts against a plain counter."""

from collections import Counter

from thicket.llm.frequency import value_frequency

SCHEMA = "k long, x array<string>, y array<string>, value string, field int, record long"


def run(spark, rows, **more):
    df = spark.createDataFrame([r + ("v", 1, 2) for r in rows], SCHEMA)
    return {(r["field"], r["value"]): (r["occurrences"], r["records"], r["mark"]) for r in value_frequency(df, "k", ["x", "y"], **more).collect()}


def test_forms_nulls_repeats_marks(spark):
    rows = [(1, ["A-b", "a_B", None, " "], None), (2, ["a b"], ["a b"]), (3, None, []), (4, ["a  b"], None)]
    got = run(spark, rows, rare_below=2, common_above=0.5)
    assert got == {("x", "a b"): (4, 3, "common"), ("y", "a b"): (1, 1, "rare")}
    assert run(spark, []) == {}


def test_hot_value_over_many_ranges(spark):
    rows = [(i, ["hot", f"v{i % 40}"] + ["hot"] * (i % 3 == 0), None) for i in range(3000)]
    got = run(spark, rows)
    want = Counter(v for r in rows for v in r[1])
    assert {v: n for (_, v), (n, _, _) in got.items()} == dict(want)
    assert got["x", "hot"][1] == 3000 and got["x", "hot"][2] == "common"
