"""Scalar functions over the entries, and the small grammars of references and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from thicket.functions import text as t
from thicket.operators.validate import SQL as VALID, Corpus, duplicate_ids, findings, missing_fields
from thicket.operators.union import already_reported
from thicket.sources.entries import LEAVES_SQL, leaves
from thicket.sources.markdown import entries_of
from thicket.sources.tables import table


def index_path(c: Column) -> Column:
    """A relative path of an index page, normalised; null if it is absolute, leaves the root or is no index page."""
    bad = c.rlike(r"^(/|\\|[A-Za-z]:)") | ~c.rlike(r"(^|/)index\.md\z")
    steps = F.filter(F.split(c, r"[/\\]+"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))
    walk = F.aggregate(steps, start, lambda s, x: F.when(x == "..", F.struct(F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0))).alias("at"), (s["out"] | (F.size(s["at"]) == 0)).alias("out"))).otherwise(F.struct(F.concat(s["at"], F.array(x)).alias("at"), s["out"].alias("out"))))
    return F.when(c.isNull() | bad | walk["out"], None).otherwise(F.array_join(walk["at"], "/"))


def rollback_ref(c: Column) -> Column:
    """The tag that a rollback reference names: genesis, an operation, or its state before; null otherwise."""
    return (
        F.when(c.isin("genesis", "op/genesis"), "op/genesis")
        .when(c.rlike(r"^pre-op-?[\w-]+\z"), F.concat(F.lit("pre-op/"), F.regexp_extract(c, r"^pre-(op-[\w-]+)\z", 1)))
        .when(c.rlike(r"^op-[\w-]+\z"), F.concat(F.lit("op/"), c))
        .when(c.rlike(r"^(op|pre-op)/[\w-]+\z"), c)
    )


def op_id(ts: Column, number: Column) -> Column:
    """``op-YYYYMMDD-HHMMSS-`` and four hex digits."""
    return F.concat(F.lit("op-"), F.date_format(ts, "yyyyMMdd-HHmmss"), F.lit("-"), F.lower(F.lpad(F.hex(F.pmod(number, F.lit(65536))), 4, "0")))


def cost_line(before: Column, after: Column) -> Column:
    return F.format_string("%.4f -> %.4f", before, after)


def of_leaves(lv: DataFrame) -> DataFrame:
    return lv.select(
        "leaf_no", t.valid_slug(F.col("id")).alias("slug"), t.fnv1a(F.col("id")).alias("fnv"), t.namespace(F.col("wiki_id")).alias("space"), t.titleize(F.col("id")).alias("title"),
        index_path(F.concat_ws("/", "parent_dir", F.lit("../index.md"))).alias("up"), t.authored(F.col("focus"), F.col("id")).alias("focus"),
    )


SQL = {
    "q_scalars": f"""WITH {LEAVES_SQL} SELECT leaf_no, regexp_full_match(id, '[a-z][a-z0-9-]{{0,63}}') AS slug,
lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(id, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295))), 8, '0') AS fnv,
regexp_replace(wiki_id, '\\.wiki\\z', '') AS space, array_to_string(list_transform(string_split(replace(id, '-', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS title,
CASE WHEN parent_dir LIKE '%/%' THEN regexp_replace(parent_dir, '/[^/]*\\z', '') || '/index.md' ELSE 'index.md' END AS up,
CASE WHEN focus IS NULL OR regexp_full_match(focus, '\\s*') THEN id ELSE focus END AS focus FROM ent""",
    "q_op_ids": "SELECT event_id, 'op-' || strftime(ts, '%Y%m%d-%H%M%S') || '-' || lpad(lower(to_hex(event_id % 65536)), 4, '0') AS op FROM events",
    "q_validate_sources": VALID["q_findings_summary"].split("SELECT wiki_id, code, severity, count(*) AS n FROM found")[0] + "SELECT code, count(*) AS n FROM found WHERE code NOT IN ('DUP-ID', 'MISSING-FIELD') GROUP BY code",
}


def queries() -> dict:
    def sources(s, d):
        c = Corpus(s, d)
        return already_reported(findings(c), duplicate_ids(c).unionByName(missing_fields(c))).groupBy("code").agg(F.count("*").alias("n"))

    matter = lambda s, d: entries_of(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("raw")))
    return {
        "q_scalars": lambda s, d: of_leaves(leaves(s, d)),
        "q_op_ids": lambda s, d: table(s, d, "events").select("event_id", op_id(F.col("ts"), F.col("event_id")).alias("op")),
        "q_validate_sources": sources,
        "q_front_matter": lambda s, d: matter(s, d).where("id IS NOT NULL OR error IS NOT NULL").select("path", "id", "type", "focus", F.array_join("tags", " ").alias("tags"), "error"),
    }
