"""Markdown folders, front matter, versions and the streaming upsert."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from thicket.sources import markdown as md
from thicket.streaming.ingest import decision_rate, ingest_stream


def test_walk_and_parse(spark, tmp_path):
    files = {
        "a/one.md": "---\nid: one\ncovers:\n  - x\n  - y\nwhen: 2024-01-02\n__proto__: bad\n---\nbody\n", "a/two.md": "no matter", "a/three.md": "---\r\nid: three\r\n---\r\nb\r\n",
        "a/bad.md": "---\nid: [\n---\nb", "a/open.md": "---\nid: x\n", "node_modules/x.md": "z", ".git/y.md": "z", "code.py": "1",
    }
    for p, text in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(text.encode())
    got = {r["path"]: r for r in md.entries_of(md.read_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"a/one.md", "a/two.md", "a/three.md", "a/bad.md", "a/open.md"}
    one = got["a/one.md"]
    assert (one["id"], one["covers"], one["body"]) == ("one", ["x", "y"], "body\n") and "2024-01-02" in one["extra_json"] and "proto" not in one["extra_json"]
    assert got["a/three.md"]["id"] == "three" and got["a/two.md"]["id"] is None and got["a/two.md"]["body"] == "no matter"
    assert got["a/bad.md"]["error"] and got["a/open.md"]["error"]
    assert md.read_files(spark, str(tmp_path), code=True).where("path = 'code.py'").count() == 1


def test_render_round_trip(spark):
    text = md.render_matter({"zeta": 1, "focus": "a: b", "id": "x", "tags": ["p", "q"]}, "body")
    assert text.index("id:") < text.index("focus:") < text.index("zeta:")
    data, body, error = md.parse_matter(text)
    assert data == {"zeta": 1, "focus": "a: b", "id": "x", "tags": ["p", "q"]} and body == "body" and error is None
    df = spark.createDataFrame([("p.md", "x", ["t"], "hello")], "path string, id string, tags array<string>, body string")
    assert md.parse_matter(md.rendered(df).first()["text"])[0] == {"id": "x", "tags": ["t"]}


def test_versions(spark, tmp_path):
    root = str(tmp_path / "c")
    a = spark.createDataFrame([("w", "x")], "wiki_id string, id string")
    md.write_version(a, root, 0, "init")
    md.write_version(a.unionByName(spark.createDataFrame([("w", "y")], a.schema)), root, 1, "build", 0)
    assert md.current_version(spark, root) == 1 and md.read_version(spark, root).count() == 2
    md.roll_back(spark, root, 0)
    assert md.read_version(spark, root).count() == 1
    with pytest.raises(ValueError):
        md.roll_back(spark, root, 9)


def test_streaming_upsert_is_idempotent(spark, tmp_path):
    schema = "wiki_id string, path string, hash string, updated_at timestamp_ntz"
    rows = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: ingest_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows(("w", "a", "1", dt(2024, 1, 1)), ("w", "b", "1", dt(2024, 1, 1)))
    go()
    rows(("w", "a", "1", dt(2024, 1, 2)), ("w", "b", "2", dt(2024, 1, 2)))
    go()
    got = sorted((r["path"], r["hash"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "1"), ("b", "1"), ("b", "2")]


def test_decision_rate(spark):
    df = spark.createDataFrame([(dt(2024, 1, 1, 1), "m"), (dt(2024, 1, 1, 5), "m"), (dt(2024, 1, 2), "m")], "ts timestamp, event_type string")
    assert sorted(r["decisions"] for r in decision_rate(df).collect()) == [1, 2]
    assert decision_rate(df).where(F.col("operator") == "m").count() == 2
