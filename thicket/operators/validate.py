"""Integrity rules: one query for each code, a summary, and what to do about the findings.

The entries of a wiki are its leaves and index pages. The authored zone of an index page is not
in the tables; the texts of ``documents`` stand in for it where a rule reads bodies. Rules marked
"specified only" are described by the methodology without a published check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from thicket.functions.text import BASE_NAME, base_name, leaf_signs
from thicket.sources.entries import LEAVES_SQL, PAGES_SQL, entries, leaves, pages
from thicket.sources.tables import table

#: What a finding of each code calls for, and the rank of each action.
ACTIONS = {
    "WIKI-01": "manual", "GIT-01": "manual", "LOSS-01": "rebuild", "PARSE": "manual", "MISSING-FIELD": "fix", "DUP-ID": "rebuild",
    "ALIAS-COLLIDES-ID": "fix", "ID-MISMATCH-DIR": "rebuild", "ID-MISMATCH-FILE": "rebuild", "DEPTH-ROLE": "rebuild", "PARENTS-REQUIRED": "rebuild",
    "PARENT-CONTRACT": "rebuild", "DANGLING-LINK": "fix", "DANGLING-OVERLAY": "fix", "LEAF-AT-WIKI-ROOT": "fix", "SIZE-CAP": "none",
}
RANK = {"none": 0, "fix": 1, "rebuild": 2, "manual": 3}
VERDICT = {"none": "ok", "fix": "fixable", "rebuild": "needs-rebuild", "manual": "broken"}
LINES, OVERLAY_LINES, ZONE_CHARS = 500, 200, 2048


class Corpus:
    """The tables that the rules read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.entries, self.leaves, self.pages = entries(spark, folder), leaves(spark, folder), pages(spark, folder)

    @property
    def ids(self) -> DataFrame:
        """wiki_id, id of every entry."""
        return self.entries.where("id IS NOT NULL").select("wiki_id", "id").distinct()

    @property
    def names(self) -> DataFrame:
        """wiki_id, id that a reference may name: ids and aliases."""
        alias = self.leaves.select("wiki_id", F.explode("aliases").alias("id")).where("id IS NOT NULL")
        return self.ids.unionByName(alias).distinct()


def _finding(df: DataFrame, code: str, target, message, severity: str = "error") -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "wiki_id", target.alias("target"), message.alias("message"))


def duplicate_ids(c: Corpus) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("wiki_id", "id").orderBy("path", "kind"))
    return _finding(c.entries.where("id IS NOT NULL").withColumn("r", rank).where("r > 1"), "DUP-ID", F.col("path"), F.col("id"))


def alias_collisions(c: Corpus) -> DataFrame:
    alias = c.leaves.select("wiki_id", "path", F.explode("aliases").alias("id")).distinct()
    return _finding(alias.join(c.ids, ["wiki_id", "id"], "left_semi"), "ALIAS-COLLIDES-ID", F.col("path"), F.col("id"))


def missing_fields(c: Corpus) -> DataFrame:
    fields = ["id", "type", "depth_role", "focus"]
    gaps = F.array_compact(F.array(*(F.when(F.col(f).isNull() | (F.col(f) == ""), F.lit(f)) for f in fields)))
    return _finding(c.entries.select("wiki_id", "path", F.explode(gaps).alias("gap")), "MISSING-FIELD", F.col("path"), F.col("gap"))


def dir_mismatches(c: Corpus) -> DataFrame:
    name = F.substring_index("parent_dir", "/", -1)
    return _finding(c.pages.where((F.col("parent_dir") != "") & (F.col("id") != name)), "ID-MISMATCH-DIR", F.col("path"), F.col("id"))


def file_mismatches(c: Corpus) -> DataFrame:
    return _finding(c.leaves.where(F.col("id") != base_name(F.col("path"))), "ID-MISMATCH-FILE", F.col("path"), F.col("id"))


def depth_roles(c: Corpus) -> DataFrame:
    root = (F.col("kind") == "index") & (F.col("parent_dir") == "") & (F.col("depth_role") != "category")
    leaf = (F.col("kind") == "leaf") & (F.col("depth_role") != "leaf")
    return _finding(c.entries.where(root | leaf), "DEPTH-ROLE", F.col("path"), F.col("depth_role"))


def missing_parents(c: Corpus) -> DataFrame:
    none = F.coalesce(F.size(F.array_compact("parents")), F.lit(0)) <= 0
    return _finding(c.entries.where((F.col("parent_dir") != "") & (F.col("parents").isNull() | none)), "PARENTS-REQUIRED", F.col("path"), F.col("kind"))


def size_caps(c: Corpus) -> DataFrame:
    cap = F.when(F.col("type") == "overlay", OVERLAY_LINES).otherwise(LINES)
    return _finding(c.leaves.where(F.col("line_count") > cap), "SIZE-CAP", F.col("path"), F.col("line_count").cast("string"), "warning")


def parent_contract(c: Corpus) -> DataFrame:
    """Bodies that hold what belongs into a leaf: a checklist, code, or too much text."""
    raw = F.coalesce("text", F.lit(""))
    flags = F.array_compact(F.array(
        F.when(raw.rlike(r"(?md)^[ \t]*[-*][ \t]+\[[ xX]\]"), "checklist"), F.when(raw.rlike(r"(?md)^[ \t]*```"), "code"), F.when(F.length(raw) > ZONE_CHARS, "budget"),
    ))
    d = table(c.spark, c.folder, "documents").where("path IS NOT NULL").select("wiki_id", "path", "doc_id", F.explode(flags).alias("flag"))
    return _finding(d, "PARENT-CONTRACT", F.col("doc_id").cast("string"), F.col("flag"))


def dangling_links(c: Corpus) -> DataFrame:
    ref = c.leaves.select("wiki_id", "path", F.explode("links").alias("l")).select("wiki_id", "path", F.col("l.id").alias("id")).where("id IS NOT NULL").distinct()
    return _finding(ref.join(c.names, ["wiki_id", "id"], "left_anti"), "DANGLING-LINK", F.col("path"), F.col("id"))


def dangling_overlays(c: Corpus) -> DataFrame:
    ref = c.leaves.select("wiki_id", "path", F.explode("overlay_targets").alias("id")).where("id IS NOT NULL").distinct()
    return _finding(ref.join(c.names, ["wiki_id", "id"], "left_anti"), "DANGLING-OVERLAY", F.col("path"), F.col("id"))


def root_leaves(c: Corpus) -> DataFrame:
    return _finding(c.leaves.where("parent_dir = '' OR parent_dir IS NULL"), "LEAF-AT-WIKI-ROOT", F.col("path"), F.col("id"))


def invalid_wikis(c: Corpus) -> DataFrame:
    """Wikis that entries name but the table of wikis doesn't know."""
    known = table(c.spark, c.folder, "wiki").select("wiki_id")
    return _finding(c.entries.select("wiki_id").distinct().join(known, "wiki_id", "left_anti"), "WIKI-01", F.col("wiki_id"), F.lit("no such wiki"))


CHECKS = {
    "q_dup_id": duplicate_ids, "q_alias_collision": alias_collisions, "q_missing_field": missing_fields, "q_id_mismatch_dir": dir_mismatches,
    "q_id_mismatch_file": file_mismatches, "q_depth_role": depth_roles, "q_parents_required": missing_parents, "q_size_cap": size_caps,
    "q_parent_contract": parent_contract, "q_dangling_link": dangling_links, "q_dangling_overlay": dangling_overlays, "q_root_leaf": root_leaves, "q_invalid_wiki": invalid_wikis,
}


def findings(c: Corpus) -> DataFrame:
    return reduce(DataFrame.unionByName, (f(c) for f in CHECKS.values()))


def summary(c: Corpus) -> DataFrame:
    """wiki_id, code, severity, n."""
    return findings(c).groupBy("wiki_id", "code", "severity").agg(F.count("*").alias("n"))


def heal(c: Corpus) -> DataFrame:
    """wiki_id, action, verdict: the gravest action that the errors of a wiki call for."""
    known = F.create_map(*(F.lit(x) for k, a in ACTIONS.items() for x in (k, RANK[a])))
    rank = F.coalesce(F.element_at(known, F.col("code")), F.lit(RANK["rebuild"]))
    worst = findings(c).where("severity = 'error'").groupBy("wiki_id").agg(F.max(rank).alias("r"))
    name = F.element_at(F.array(*map(F.lit, RANK)), F.col("r") + 1)
    verdict = F.element_at(F.create_map(*(F.lit(x) for kv in VERDICT.items() for x in kv)), F.col("action"))
    return worst.select("wiki_id", name.alias("action")).withColumn("verdict", verdict)


def index_gaps(c: Corpus) -> DataFrame:
    """Specified only: leaves that the index page of their directory doesn't list, and entries listed without a leaf."""
    listed = c.pages.select("wiki_id", "dir", F.explode("entries").alias("e")).select("wiki_id", "dir", F.col("e.id").alias("id")).where("id IS NOT NULL").distinct()
    have = c.leaves.where("id IS NOT NULL").select("wiki_id", "dir", "id").distinct()
    unlisted = have.join(listed, ["wiki_id", "dir", "id"], "left_anti").withColumn("gap", F.lit("unlisted"))
    ghost = listed.join(have, ["wiki_id", "dir", "id"], "left_anti").withColumn("gap", F.lit("no leaf"))
    return unlisted.unionByName(ghost)


def source_drift(c: Corpus) -> DataFrame:
    """Specified only: leaves whose source hash differs from the latest known one of their source path."""
    s = table(c.spark, c.folder, "source_snapshot").where("hash IS NOT NULL")
    last = s.groupBy("wiki_id", "path").agg(F.max(F.struct("snapshot_no", "scanned_at", "hash"))["hash"].alias("latest"))
    mine = c.leaves.select("leaf_no", "wiki_id", F.col("source.path").alias("path"), F.col("source.hash").alias("hash")).where("hash IS NOT NULL")
    return mine.join(last, ["wiki_id", "path"]).where("hash <> latest").select("leaf_no", "hash", "latest")


# ---------------------------------------------------------------- DuckDB twins

_ENTRIES = f"""{LEAVES_SQL}, {PAGES_SQL},
every AS (SELECT 'leaf' AS kind, wiki_id, parent_dir, path, id, type, depth_role, focus, parents FROM ent
  UNION ALL SELECT 'index', wiki_id, parent_dir, path, id, 'index', depth_role, focus, parents FROM page),
ids AS (SELECT DISTINCT wiki_id, id FROM every WHERE id IS NOT NULL),
ali AS (SELECT DISTINCT wiki_id, path, id FROM (SELECT wiki_id, path, unnest(aliases) AS id FROM ent) WHERE id IS NOT NULL),
names AS (SELECT * FROM ids UNION SELECT wiki_id, id FROM ali),
lk AS (SELECT DISTINCT wiki_id, path, id FROM (SELECT wiki_id, path, unnest(links).id AS id FROM ent) WHERE id IS NOT NULL),
ov AS (SELECT DISTINCT wiki_id, path, id FROM (SELECT wiki_id, path, unnest(overlay_targets) AS id FROM ent) WHERE id IS NOT NULL)"""
_ROWS = {
    "q_dup_id": ("DUP-ID", "error", "SELECT wiki_id, path AS target, id AS message FROM every WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY wiki_id, id ORDER BY path, kind) > 1"),
    "q_alias_collision": ("ALIAS-COLLIDES-ID", "error", "SELECT wiki_id, path AS target, id AS message FROM ali SEMI JOIN ids USING (wiki_id, id)"),
    "q_missing_field": ("MISSING-FIELD", "error", " UNION ALL ".join(f"SELECT wiki_id, path AS target, '{f}' AS message FROM every WHERE {f} IS NULL OR {f} = ''" for f in ("id", "type", "depth_role", "focus"))),
    "q_id_mismatch_dir": ("ID-MISMATCH-DIR", "error", "SELECT wiki_id, path AS target, id AS message FROM page WHERE parent_dir <> '' AND id <> regexp_replace(parent_dir, '^.*/', '')"),
    "q_id_mismatch_file": ("ID-MISMATCH-FILE", "error", f"SELECT wiki_id, path AS target, id AS message FROM ent WHERE id <> {BASE_NAME.format('path')}"),
    "q_depth_role": ("DEPTH-ROLE", "error", "SELECT wiki_id, path AS target, depth_role AS message FROM every WHERE (kind = 'index' AND parent_dir = '' AND depth_role <> 'category') OR (kind = 'leaf' AND depth_role <> 'leaf')"),
    "q_parents_required": ("PARENTS-REQUIRED", "error", "SELECT wiki_id, path AS target, kind AS message FROM every WHERE parent_dir <> '' AND len(list_filter(coalesce(parents, []), lambda p: p IS NOT NULL)) = 0"),
    "q_size_cap": ("SIZE-CAP", "warning", f"SELECT wiki_id, path AS target, line_count::VARCHAR AS message FROM ent WHERE line_count > CASE WHEN type = 'overlay' THEN {OVERLAY_LINES} ELSE {LINES} END"),
    "q_parent_contract": ("PARENT-CONTRACT", "error", " UNION ALL ".join(
        f"SELECT wiki_id, doc_id::VARCHAR AS target, '{flag}' AS message FROM documents WHERE path IS NOT NULL AND {test}" for flag, test in (
            ("checklist", r"regexp_matches(text, '(?m)^[ \t]*[-*][ \t]+\[[ xX]\]')"), ("code", r"regexp_matches(text, '(?m)^[ \t]*```')"), ("budget", f"length(text) > {ZONE_CHARS}")))),
    "q_dangling_link": ("DANGLING-LINK", "error", "SELECT wiki_id, path AS target, id AS message FROM lk ANTI JOIN names USING (wiki_id, id)"),
    "q_dangling_overlay": ("DANGLING-OVERLAY", "error", "SELECT wiki_id, path AS target, id AS message FROM ov ANTI JOIN names USING (wiki_id, id)"),
    "q_root_leaf": ("LEAF-AT-WIKI-ROOT", "error", "SELECT wiki_id, path AS target, id AS message FROM ent WHERE parent_dir = '' OR parent_dir IS NULL"),
    "q_invalid_wiki": ("WIKI-01", "error", "SELECT wiki_id, wiki_id AS target, 'no such wiki' AS message FROM (SELECT DISTINCT wiki_id FROM every) ANTI JOIN wiki USING (wiki_id)"),
}
_one = lambda k: f"SELECT '{_ROWS[k][0]}' AS code, '{_ROWS[k][1]}' AS severity, wiki_id, target, message FROM ({_ROWS[k][2]})"
_ALL = f"WITH {_ENTRIES}, found AS ({' UNION ALL '.join(map(_one, _ROWS))}) "
SQL = {k: f"WITH {_ENTRIES} {_one(k)}" for k in _ROWS}
SQL["q_findings_summary"] = _ALL + "SELECT wiki_id, code, severity, count(*) AS n FROM found GROUP BY ALL"
_CASE = "CASE code " + " ".join(f"WHEN '{k}' THEN {RANK[a]}" for k, a in ACTIONS.items()) + f" ELSE {RANK['rebuild']} END"
SQL["q_heal"] = _ALL + f""", r AS (SELECT wiki_id, max({_CASE}) AS r FROM found WHERE severity = 'error' GROUP BY wiki_id)
SELECT wiki_id, {list(RANK)!r}[r + 1] AS action, {list(VERDICT.values())!r}[r + 1] AS verdict FROM r"""
SQL["q_index_gaps"] = f"""WITH {_ENTRIES}, li AS (SELECT DISTINCT wiki_id, dir, e.id AS id FROM (SELECT wiki_id, dir, unnest(entries) AS e FROM page) WHERE e.id IS NOT NULL),
hv AS (SELECT DISTINCT wiki_id, dir, id FROM ent WHERE id IS NOT NULL)
SELECT *, 'unlisted' AS gap FROM hv ANTI JOIN li USING (wiki_id, dir, id) UNION ALL SELECT *, 'no leaf' FROM li ANTI JOIN hv USING (wiki_id, dir, id)"""
SQL["q_source_drift"] = f"""WITH {LEAVES_SQL}, la AS (SELECT wiki_id, path, hash AS latest FROM source_snapshot WHERE hash IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY wiki_id, path ORDER BY snapshot_no DESC, scanned_at DESC, hash DESC) = 1)
SELECT leaf_no, source.hash AS hash, latest FROM ent JOIN la ON la.wiki_id = ent.wiki_id AND la.path = source.path WHERE source.hash <> latest"""
SQL["q_leaf_signs"] = r"""SELECT doc_id, regexp_matches(t, '(?m)^[ \t]*```') OR regexp_matches(t, '(?m)^[ \t]*[-*][ \t]+\[[ xX]\]') OR len(regexp_extract_all(t, '(?m)^[ \t]*\d+\.[ \t]+')) >= 2 AS leaf_like
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""


def queries() -> dict:
    of = lambda fn: lambda s, d: fn(Corpus(s, d))
    return {k: of(f) for k, f in CHECKS.items()} | {
        "q_findings_summary": of(summary), "q_heal": of(heal), "q_index_gaps": of(index_gaps), "q_source_drift": of(source_drift),
        "q_leaf_signs": lambda s, d: table(s, d, "documents").select("doc_id", leaf_signs(F.coalesce("text", F.lit(""))).alias("leaf_like")),
    }
