"""Rounds look only at directories that changed since they were last looked at, and compare only leaves that can be clustered."""

import os

import pytest
from pyspark.sql import functions as F

from thicket.operators import cluster, converge
from thicket.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_only_directories_that_can_be_clustered_are_compared(spark, monkeypatch):
    sizes, compare = [], converge.affinity

    def watched(lv, vectors):
        sizes.append([r["k"] for r in lv.groupBy("dir").agg(F.count("*").alias("k")).collect()])
        return compare(lv, vectors)

    monkeypatch.setattr(converge, "affinity", watched)
    catalog.QUERIES["q_convergence"](spark, FOLDER)
    assert sizes and all(cluster.LEAST <= k <= cluster.COARSE for ks in sizes for k in ks)


def test_unchanged_directories_are_not_looked_at_again(spark):
    lv = spark.createDataFrame([("a", 1, "x", ["c"], ["t"]), ("a", 2, "y", None, None), ("b", 3, "z", [], None)], "dir string, leaf_no long, text string, covers array<string>, tags array<string>")
    first, seen = converge._unseen(lv, None)
    assert first.count() == 3 and converge._unseen(lv, seen)[0].count() == 0
    changed = lv.withColumn("text", F.when(F.col("leaf_no") == 2, "new").otherwise(F.col("text")))
    assert {r["leaf_no"] for r in converge._unseen(changed, seen)[0].collect()} == {1, 2}
