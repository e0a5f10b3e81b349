"""Components and best partitions of small directories are found in one task, without rounds; affinities of small directories without shuffling pairs."""

import os

import pytest
from pyspark.sql import functions as F

from thicket.operators import cluster, similarity
from thicket.sources.entries import leaves
from thicket.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    lv = leaves(spark, FOLDER).localCheckpoint()
    vectors = similarity.bound_vectors(lv, table(spark, FOLDER, "embeddings")).localCheckpoint()
    return lv, vectors, similarity.affinity(lv, vectors).localCheckpoint()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_affinities_of_small_directories(given):
    lv, vectors, aff = given
    few = lv.groupBy("dir").count().where(F.col("count") <= similarity.SMALL)
    cols = ("dir", "leaf_a", "leaf_b", "affinity")
    want = rows(aff.join(few, "dir", "left_semi"), *cols)
    assert want and rows(similarity.small_affinity(lv, vectors), *cols) == want


def test_components_without_rounds(given, monkeypatch):
    lv, _, aff = given
    small = lv.groupBy("dir").count().where(F.col("count").between(cluster.LEAST, cluster.COARSE)).select("dir")
    g = F.concat_ws("@", "dir", F.col("threshold").cast("string")).alias("g")
    nodes = lv.join(small, "dir", "left_semi").select("dir", "leaf_no", F.explode(F.array(*map(F.lit, cluster.THRESHOLDS))).alias("threshold"))
    edges = cluster.threshold_edges(aff).join(small, "dir", "left_semi").select(g, F.col("leaf_a").alias("a"), F.col("leaf_b").alias("b"))
    want = rows(cluster.components(nodes.select(g, F.col("leaf_no").alias("n")), edges), "g", "n", "label")

    def rounds(*_):
        raise AssertionError("components in rounds")

    monkeypatch.setattr(cluster, "components", rounds)
    for block in (cluster.BLOCK, 20):
        monkeypatch.setattr(cluster, "BLOCK", block)
        assert rows(cluster.partitions(lv, aff), g, "leaf_no", "label") == want


def test_best_partitions_in_one_pass(given, monkeypatch):
    lv, _, aff = given
    parts = cluster.partitions(lv, aff).localCheckpoint()
    best = cluster.shape_scores(parts, aff).where("score > 0").groupBy("dir").agg(F.max(F.struct("score", (-F.col("threshold")).alias("t"))).alias("b")).select("dir", (-F.col("b.t")).alias("threshold"))
    sizes = parts.groupBy("dir", "threshold", "label").count().where(F.col("count").between(cluster.LEAST, cluster.MOST))
    cols = ("dir", "label", "leaf_no", "threshold")
    want = rows(parts.join(best, ["dir", "threshold"]).join(sizes, ["dir", "threshold", "label"]), *cols)
    monkeypatch.setattr(cluster, "shape_scores", None)
    assert want and rows(cluster.clusters(lv, aff), *cols) == want


def test_chains(spark):
    n = cluster.COARSE
    lv = spark.createDataFrame([("x", i) for i in range(n)] + [("y", 100 + i) for i in range(n + 1)], "dir string, leaf_no long")
    aff = spark.createDataFrame([(d, o + i, o + i + 1, 0.2) for d, o, k in (("x", 0, n), ("y", 100, n + 1)) for i in range(k - 1)], "dir string, leaf_a long, leaf_b long, affinity double")
    got = cluster.partitions(lv, aff).collect()
    assert len(got) == n * len(cluster.THRESHOLDS) and all(r["dir"] == "x" and r["label"] == (0 if r["threshold"] <= 0.2 else r["leaf_no"]) for r in got)
