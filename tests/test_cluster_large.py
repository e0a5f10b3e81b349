"""k-means of a directory of more leaves than were once compared with each other."""

from thicket.operators import cluster


def test_alike_leaves_of_a_large_directory_stay_together(spark):
    rows = [("d", i, [f"w{i % 300}x", f"w{i % 300}y"]) for i in range(2_400)]
    got = cluster.coarse_clusters(spark.createDataFrame(rows, "dir string, leaf_no long, tokens array<string>")).collect()
    assert len(got) == 2_400 and all(r["label"] == r["leaf_no"] % 300 for r in got)


def test_large_directories_are_clustered_too(spark):
    """Leaves of a directory above the limit of the threshold scan come out of it as clusters of their own."""
    from pyspark.sql import functions as F

    from thicket.operators import cluster

    rows = [(i, "big", [f"word{chr(97 + i // 4 // 26)}{chr(97 + i // 4 % 26)}", f"term{chr(97 + i // 4 % 26)}{chr(97 + i // 4 // 26)}"]) for i in range(240)] + [(1000 + i, "small", ["one", "two"]) for i in range(3)]
    lv = spark.createDataFrame(rows, "leaf_no long, dir string, tokens array<string>")
    aff = spark.createDataFrame([("small", a, b, 0.9) for a in (1000, 1001) for b in (1001, 1002) if a < b], "dir string, leaf_a long, leaf_b long, affinity double")
    got = {(r["dir"], r["threshold"] is None) for r in cluster.detect(lv, aff).groupBy("dir", "threshold").agg(F.count("*").alias("n")).collect()}
    assert ("big", True) in got
    size = cluster.detect(lv, aff).where("dir = 'big'").count()
    assert size >= 30
