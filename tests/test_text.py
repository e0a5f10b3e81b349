"""Text functions on literal values."""

from pyspark.sql import Row, functions as F

from thicket.functions import text as t
from thicket.functions.forms import hash_form, path_form, reference_form, value_form


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()["x"]


def test_forms(spark):
    assert one(spark, value_form(F.col("v")), v="  A-b__C\t\nd ") == "a b c d"
    assert one(spark, reference_form(F.col("v")), v=" ../X/Name.MD#frag/ment ") == "name"
    assert one(spark, path_form(F.col("v")), v=".//a\\b//C.md") == "a/b/C.md"
    assert one(spark, hash_form(F.col("v")), v="SHA256:ABC") == "abc"


def test_tokens(spark):
    assert one(spark, t.tokenize(F.col("v")), v="The log-in of Überraschung v2, a x") == ["log", "überraschung", "v2"]


def test_ids(spark):
    for path, want in {"a/Build Me!.md": "build-me", "x/index.md": "overview", "x/---.md": "untitled", "plain": "plain", "a/.hidden": "hidden"}.items():
        assert one(spark, t.slug_id(F.col("v")), v=path) == want, path


def test_title_and_lead(spark):
    raw = "intro\n\n```\n# no\n```\n# Title  \nfirst\nsecond\n\nthird"
    assert one(spark, t.title(F.col("v"), F.lit("a/b.md")), v=raw) == "no"
    assert one(spark, t.lead(F.col("v")), v=raw) == "intro"
    assert one(spark, t.lead(F.col("v")), v="# T\n\none\ntwo\n## H\nthree") == "one two"
    assert one(spark, t.title(F.col("v"), F.lit("a/b.md")), v="none") == "b"


def test_fnv_and_keys(spark):
    assert one(spark, t.fnv1a(F.col("v")), v="") == "811c9dc5"
    assert one(spark, t.fnv1a(F.col("v")), v="a") == "e40c292c"
    assert one(spark, t.pair_key(F.lit("x"), F.lit("y")) == t.pair_key(F.lit("y"), F.lit("x")), v=1)


def test_relative(spark):
    for a, b, want in (("a/b", "a/c", "../c"), ("a", "a/b/c", "b/c"), ("a/b/c", "a", "../.."), ("a", "a", "")):
        assert one(spark, t.relative_path(F.lit(a), F.lit(b)), v=1) == want


def test_small_ones(spark):
    assert one(spark, t.redact_url(F.col("v")), v="https://me:secret@host/x") == "https://***@host/x"
    assert one(spark, t.namespace(F.col("v")), v="notes.wiki") == "notes"
    assert one(spark, t.clamp01(F.col("v")), v=float("nan")) == 0.0
    assert one(spark, t.jaccard(F.col("v"), F.col("w")), v=["a", "b", "a"], w=["b", "c"]) == 1 / 3
    assert one(spark, t.leaf_signs(F.col("v")), v="1. a\n2. b") is True
    assert one(spark, t.authored_zone(F.col("v")), v="x<!-- BEGIN AUTHORED ORIENTATION -->hi\nho<!-- END AUTHORED ORIENTATION -->y") == "hi\nho"


def test_grammars(spark):
    from thicket.operators.scalars import index_path, op_id, rollback_ref

    for raw, want in {"a/./b//index.md": "a/b/index.md", "a/../index.md": "index.md", "../index.md": None, "/a/index.md": None, "C:\\x\\index.md": None, "a/b.md": None}.items():
        assert one(spark, index_path(F.col("v")), v=raw) == want, raw
    for raw, want in {"genesis": "op/genesis", "op-1-x": "op/op-1-x", "pre-op-1": "pre-op/op-1", "op/abc": "op/abc", "--all": None}.items():
        assert one(spark, rollback_ref(F.col("v")), v=raw) == want, raw
    assert one(spark, op_id(F.lit("2024-01-02 03:04:05").cast("timestamp"), F.lit(255)), v=1) == "op-20240102-030405-00ff"
