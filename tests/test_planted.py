"""Rules and rewrites that the given tables hold no case for: planted cases, compared with the SQL twins."""

import os
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare, connect

from thicket.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
NAMES = (
    "q_undecidable", "q_dup_id", "q_alias_collision", "q_id_mismatch_dir", "q_depth_role", "q_parents_required", "q_root_leaf", "q_invalid_wiki",
    "q_shared_covers", "q_stub_tags", "q_lift", "q_same_focus", "q_findings_summary", "q_heal", "q_rebuild_index", "q_join", "q_shape_check",
)


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    to = tmp_path_factory.mktemp("planted")
    for f in os.listdir(FOLDER):
        if f not in ("leaf.parquet", "index_page.parquet"):
            os.symlink(f"{FOLDER}/{f}", to / f)
    leaf = pq.read_table(f"{FOLDER}/leaf.parquet")
    rows = leaf.to_pylist()
    many = Counter(r["leaf_no"] for r in rows)
    one = [r for r in rows if many[r["leaf_no"]] == 1 and r["parent_dir"] and r["id"]]
    mates = next(([a, b] for a in one for b in one if a["wiki_id"] == b["wiki_id"] and a["leaf_no"] < b["leaf_no"]))
    mates[1]["id"] = mates[0]["id"]
    rest = [r for r in one if r not in mates][:8]
    rest[0]["aliases"] = [next(r["id"] for r in one if r["wiki_id"] == rest[0]["wiki_id"] and r is not rest[0]) if sum(r["wiki_id"] == rest[0]["wiki_id"] for r in one) > 1 else rest[0]["id"]]
    rest[1]["depth_role"] = "category"
    rest[2]["parents"] = []
    rest[3].update(parent_dir="", path="at-root.md")
    rest[4]["wiki_id"] = "ghost.wiki"
    rest[5].update(focus=None, covers=None, tags=None, domains=None)
    rest[6].update(parent_dir="lone/deeper/down", path="lone/deeper/down/only.md")
    top = max(r["leaf_no"] for r in rows)
    twins = [rest[7] | {"leaf_no": top + i, "id": f"twin-{i}", "parent_dir": "pair", "path": f"pair/twin-{i}.md", "covers": ["in both", f"own {i}", None], "tags": ["shared"]} for i in (1, 2)]
    pq.write_table(pa.Table.from_pylist(rows + twins, leaf.schema), to / "leaf.parquet")
    page = pq.read_table(f"{FOLDER}/index_page.parquet")
    pages = page.to_pylist()
    deep = [p for p in pages if "/" in p["path"]]
    deep[0]["id"] = "another-name"
    pages[0]["focus"], pages[1]["focus"] = " One And The Same ", "one and the same"
    pq.write_table(pa.Table.from_pylist(pages, page.schema), to / "index_page.parquet")
    return str(to)


@pytest.mark.parametrize("name", NAMES)
def test_planted_cases(spark, planted, name):
    df = catalog.QUERIES[name](spark, planted)
    compare(df, connect(planted), catalog.SQL[name])
    assert df.count() > 0
