"""Orphan references on small tables: nulls, spellings, removals, reuse, repeats and clashing columns."""

from datetime import datetime as dt

from pyspark.sql import types as T

from thicket.operators.references import orphan_report, orphans

LEAF = "leaf_no long, wiki_id string, id string, path string, links array<struct<id:string,relation:string>>, overlay_targets array<string>, aliases array<string>, updated_at timestamp_ntz, loaded_at timestamp_ntz, target string, key string, since int"
PAGE = "wiki_id string, path string, id string, updated_at timestamp_ntz"
GONE = "wiki_id string, id string, removed_at timestamp_ntz, reason string"
D = lambda n: dt(2024, 1, n)


def tables(spark, leaf, page=(), gone=()):
    return spark.createDataFrame(list(leaf), LEAF), spark.createDataFrame(list(page), PAGE), spark.createDataFrame(list(gone), GONE)


def row(no, wiki, id_, links=None, overlay=None, aliases=None, at=1, loaded=1):
    return (no, wiki, id_, None, None if links is None else [(x, "r") for x in links], overlay, aliases, D(at), D(loaded), "x", "y", 1)


def found(df):
    return {tuple(r) for r in df.select("leaf_no", "field", "target").collect()}


def test_spellings_and_parents(spark):
    t = tables(
        spark,
        [
            row(1, "w", "A", links=["./b.md#top", " B ", "missing", None, "#only", ""], overlay=["page", "Old", "Gone.md"], aliases=["was", "never"]),
            row(2, "w", "b", aliases=["old"]),
            row(3, "v", "missing"),
        ],
        [("w", "x/page/index.md", "PAGE", D(1))],
        [("w", "was", D(1), None), ("w", "Old.md", D(1), None)],
    )
    assert found(orphans(*t)) == {(1, "links", "missing"), (1, "overlay_targets", "Gone.md"), (1, "aliases", "never")}


def test_removed_leaves_neither_refer_nor_answer(spark):
    leaf = [row(1, "w", "a", links=["b", "c"], at=5), row(2, "w", "b", links=["nowhere"], at=5), row(3, "w", "c", at=9)]
    gone = [("w", "B", D(5), None), ("w", "b", D(2), None), ("w", "c", D(8), "merge")]
    # b is removed at its own time; c is in use again after its removal
    assert found(orphans(*tables(spark, leaf, gone=gone))) == {(1, "links", "b")}
    report = {(r["field"], r["state"]): (r["references"], r["leaves"]) for r in orphan_report(*tables(spark, leaf, gone=gone)).collect()}
    assert report == {("links", "removed"): (1, 1)}


def test_latest_row_counts_and_ties_and_repeats(spark):
    leaf = [row(1, "w", "a", links=["old"], at=1), row(1, "w", "a", links=["new", "new"], at=3), row(1, "w", "a", links=["new", "new"], at=3, loaded=4)]
    assert found(orphans(*tables(spark, leaf))) == {(1, "links", "new")}


def test_late_targets(spark):
    leaf = [row(1, "w", "a", links=["b"], loaded=2), row(2, "w", "b", loaded=9)]
    rows = orphan_report(*tables(spark, leaf)).collect()
    assert [(r["state"], r["references"]) for r in rows] == [("late", 1)]
    assert found(orphans(*tables(spark, leaf))) == set()


def test_null_wiki_and_empty_tables(spark):
    assert found(orphans(*tables(spark, [row(1, None, "a", links=["a", "z"]), (None,) * 12]))) == {(1, "links", "z")}
    assert found(orphans(*tables(spark, []))) == set()
    assert orphan_report(*tables(spark, [])).count() == 0


def test_hot_target(spark):
    leaf = [row(i, "w", f"n{i}", links=["gone"]) for i in range(300)]
    assert len(found(orphans(*tables(spark, leaf)))) == 300
    assert isinstance(orphans(*tables(spark, leaf)).schema["leaf_no"].dataType, T.LongType)


def test_entries_without_an_id_are_live_whatever_was_removed(spark):
    t = tables(spark, [row(1, "w", None, links=["nowhere"]), row(2, "w", None, aliases=["by-alias"]), row(3, "w", "x", links=["by-alias"])], gone=[("w", None, D(9), None), ("w", "x.md", D(1), None)])
    assert found(orphans(*t)) == {(1, "links", "nowhere"), (2, "aliases", "by-alias")}


def test_a_target_that_was_there_before_is_not_late(spark):
    """The target's counting row came in after the reference, but an older row of it before."""
    t = tables(spark, [row(1, "w", "a", links=["b", "c"], loaded=5), row(2, "w", "B", at=1, loaded=2), row(2, "w", "b", at=3, loaded=9), row(3, "w", "c", loaded=9)])
    assert [(r["field"], r["state"], r["references"]) for r in orphan_report(*t).collect()] == [("links", "late", 1)]
