"""Traps of the methodology on literal rows."""

import pytest
from pyspark.sql import functions as F

from thicket.operators import cluster, converge, drafts, history, provenance, similarity, union


def test_coverage_cursor_stays_on_overlap(spark):
    ranges = spark.createDataFrame([("s", 1, 0, 10), ("s", 2, 5, 20), ("s", 3, 20, 30), ("big", 1, 0, 9), ("lost", 1, 0, 1)], "source string, ordinal int, start long, end long")
    sizes = spark.createDataFrame([("s", 30), ("big", 5)], "source string, size long")
    got = {tuple(r) for r in provenance.coverage(ranges, sizes).collect()}
    assert got == {("s", "overlap", 5, 20), ("s", "gap", 10, 20), ("big", "out of bounds", 0, 9), ("lost", "unknown", None, None)}


def test_disambiguation_passes_natural_ids(spark):
    rows = [("w", "a", "1", 1), ("w", "a", "2", 2), ("w", "a-2", "3", 3), ("w", "a", "4", 4), ("v", "a", "5", 5)]
    df = spark.createDataFrame(rows, "wiki_id string, id string, path string, doc_id long")
    got = {r["doc_id"]: r["unique_id"] for r in drafts.disambiguate(df).collect()}
    assert got == {1: "a", 2: "a-3", 3: "a-2", 4: "a-4", 5: "a"}


def test_bands_hold_their_edges(spark):
    df = spark.createDataFrame([(0.85,), (0.30,), (0.5,)], "c double")
    assert [r[0] for r in df.select(similarity.band(F.col("c"), 0.85, 0.30, "escalate")).collect()] == ["same", "different", "escalate"]


def test_idf_counts_entries_without_tokens(spark):
    lv = spark.createDataFrame([("d", 1, ["x"]), ("d", 2, [])], "dir string, leaf_no long, tokens array<string>")
    assert abs(similarity.inverse_frequency(lv).first()["idf"] - 1.4054651081) < 1e-9


def test_components_of_a_chain(spark):
    nodes = spark.createDataFrame([("g", i) for i in range(40)] + [("h", 1), ("h", 2)], "g string, n long")
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(39)], "g string, a long, b long")
    got = {(r["g"], r["n"]): r["label"] for r in cluster.components(nodes, edges).collect()}
    assert {got["g", i] for i in range(40)} == {0} and got["h", 1] == 1 and got["h", 2] == 2


def test_greedy_selection(spark):
    rows = [("d", "a", 0.9, [1, 2]), ("d", "b", 0.8, [2, 3]), ("d", "c", 0.7, [3, 4]), ("d", "e", 0.7, [4, 5])]
    df = spark.createDataFrame(rows, "dir string, proposal string, score double, members array<bigint>")
    assert {r["proposal"] for r in converge.greedy_disjoint(df).collect()} == {"a", "c"}


def test_slug_resolution(spark):
    want = spark.createDataFrame([("w", "a"), ("w", "b"), ("w", "Bad")], "wiki_id string, slug string")
    taken = spark.createDataFrame([("w", "a"), ("w", "a-group"), ("v", "b")], "wiki_id string, id string")
    assert {r["slug"]: r["resolved"] for r in union.resolve_slugs(want, taken).collect()} == {"a": "a-group-2", "b": "b"}


def test_resume(spark):
    c = spark.createDataFrame([("w", "a", "1"), ("w", "b", "1"), ("w", "c", None)], "wiki_id string, path string, hash string")
    e = spark.createDataFrame([("w", "a", "1", 1), ("w", "b", "0", 1), ("w", "b", "2", 2), ("w", "c", None, 1)], "wiki_id string, path string, hash string, updated_at int")
    assert {r["path"]: r["action"] for r in history.resume(c, e).collect()} == {"a": "skip", "b": "update", "c": "skip"}


def test_vector_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(similarity.vector_cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("parts", [1, 7])
def test_order_of_rows_changes_nothing(spark, parts):
    lv = spark.createDataFrame([("d", i, w.split()) for i, w in enumerate(["a1 b1 c1", "a1 b1 d1", "x1 y1", "x1 y1 z1", "q1"])], "dir string, leaf_no long, tokens array<string>").repartition(parts)
    got = {(r["leaf_a"], r["leaf_b"]): r["cosine"] for r in similarity.cosine_pairs(lv).collect()}
    assert set(got) == {(0, 1), (2, 3)} and got[2, 3] > got[0, 1]


def test_absorbed_leaves_lose_nothing(spark):
    from thicket.operators.converge import absorb

    lv = spark.createDataFrame(
        [(1, "a", "one", ["x", "y"], ["t"], None, None, None, [("l", "r")]), (2, "b", "two", ["y", "z", None], ["u"], ["d"], ["was-b"], ["o"], [("m", "r")]), (3, "c", "three", None, None, None, None, None, None)],
        "leaf_no long, id string, focus string, covers array<string>, tags array<string>, domains array<string>, aliases array<string>, overlay_targets array<string>, links array<struct<id:string,relation:string>>",
    ).selectExpr("*", "'' AS text", "array('') AS tokens")
    got = {r["leaf_no"]: r for r in absorb(lv, spark.createDataFrame([(2, 1)], "absorbed long, keeper long")).collect()}
    assert set(got) == {1, 3} and got[3]["covers"] is None
    k = got[1]
    assert k["covers"] == ["x", "y", "z"] and k["tags"] == ["t", "u"] and k["domains"] == ["d"] and set(k["aliases"]) == {"b", "was-b"} and k["overlay_targets"] == ["o"] and [x["id"] for x in k["links"]] == ["l", "m"]
    assert "z" in k["text"]


def test_long_chains_reach_their_end(spark):
    from thicket.operators.cluster import components
    from thicket.operators.converge import on_cycles

    nodes = spark.createDataFrame([("g", i) for i in range(60)], "g string, n long")
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(59)], "g string, a long, b long")
    assert {r["label"] for r in components(nodes, edges).collect()} == {0}
    lv = spark.createDataFrame([("w", f"e{i}", i, [(f"e{i + 1}", "depends-on")]) for i in range(12)] + [("w", "p", 50, [("q", "depends-on")]), ("w", "q", 51, [("p", "depends-on")])], "wiki_id string, id string, leaf_no long, links array<struct<id:string,relation:string>>")
    assert {r["leaf_no"] for r in on_cycles(lv).collect()} == {50, 51}


def test_a_slug_without_a_free_name_is_an_error(spark):
    import pytest

    from thicket.operators.union import resolve_slugs

    wanted = spark.createDataFrame([("w", "x"), ("w", "Not A Slug")], "wiki_id string, slug string")
    taken = spark.createDataFrame([("w", "x"), ("w", "x-group"), ("w", "x-group-2")], "wiki_id string, id string")
    assert [tuple(r) for r in resolve_slugs(wanted, taken).collect()] == [("w", "x", "x-group-3")]
    with pytest.raises(Exception, match="no free name for x"):
        resolve_slugs(wanted, taken, most=2).collect()


def test_routing_reads_the_root_and_what_pages_list(spark):
    from thicket.operators import routing

    kind = "wiki_id string, parent_dir string, dir string, focus string, shared_covers array<string>, entries array<struct<id:string,file:string,type:string,focus:string,tags:array<string>>>"
    deep = "/".join("abcdefghijk")
    pg = spark.createDataFrame(
        [
            ("w", "", "w/", "nothing of it", None, [("x", "x/index.md", "index", "all about vaults", None), ("y", "y/index.md", "index", "other", ["Storage"]), ("z", "z/index.md", "index", "other", None)]),
            ("w", "x", "w/x", "plain", None, None), ("w", "y", "w/y", None, None, None), ("w", "z", "w/z", None, ["a vault for keys"], None), ("w", "u", "w/u", "unlisted", None, None),
            ("w", "u/v", "w/u/v", "vault", None, None), ("w", deep, "w/" + deep, "vault", None, None),
        ],
        kind,
    )
    q = routing.probes(spark, [("one", ["vault"], ["storage"])])
    assert {r["parent_dir"] for r in routing.page_visits(pg, q).collect()} == {"", "x", "y", "z"}
    lv = spark.createDataFrame([(1, "w", "w/x", "Vault door", None, 10), (2, "w", "w/x", "door", None, 10), (3, "w", "w/u/v", "vault", None, 10), (4, "w", "w/", "any", ["STORAGE"], 7)], "leaf_no long, wiki_id string, dir string, focus string, tags array<string>, size_bytes long")
    got = {(r["kind"], r["node"]) for r in routing.visits(lv, pg, q).collect()}
    assert {n for k, n in got if k == "leaf"} == {"1", "4"} and len(got) == 6
