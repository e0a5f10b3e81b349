"""Drafting entries from source texts: ids, titles, leads, covers, tags and how sure they are.

The texts of ``documents`` play the sources; each has a path within its wiki. Documents without a
path are no sources. A null text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from thicket.functions import text as t
from thicket.sources.tables import table

#: Directories that a walk skips, and the endings of text and code files.
SKIPPED = (
    "node_modules", ".git", ".svn", ".hg", "dist", "build", "target", "__pycache__", ".venv", "venv", ".next", ".turbo", ".cache", "coverage",
)
TEXT_ENDINGS = (".md", ".mdx", ".txt", ".rst", ".org", ".adoc", ".markdown")
CODE_ENDINGS = (
    ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".py", ".go", ".rs", ".java", ".kt", ".scala",
    ".rb", ".php", ".cs", ".swift", ".c", ".h", ".cpp", ".hpp", ".sh", ".zsh", ".bash",
)


def walked(paths: DataFrame, path: str = "path", code: bool = False) -> DataFrame:
    """The rows whose path a walk reaches: no skipped or hidden directory, a text (or code) ending."""
    segments = F.split(path, "/")
    hidden = F.exists(segments, lambda p: p.isin(*SKIPPED) | (p.startswith(".") & ~p.isin(".", "..", ".well-known")))
    ending = F.lower(F.regexp_extract(F.element_at(segments, -1), r"(\.[^.]*)\z", 1))
    return paths.where(~hidden & ending.isin(*TEXT_ENDINGS, *(CODE_ENDINGS if code else ())))


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, wiki_id, path, raw of every document with a path."""
    d = table(spark, folder, "documents").where("path IS NOT NULL")
    return d.select("doc_id", "wiki_id", "path", F.coalesce("text", F.lit("")).alias("raw"))


def is_index(raw, path):
    """Whether a source is an index: by its name, or by the type its front matter gives."""
    matter = F.regexp_extract(raw, r"\A---[ \t]*\r?\n((?:[^\n]*\n)*?)---[ \t]*(?:\r?\n|\z)", 1)
    return F.lower(F.substring_index(path, "/", -1)).eqNullSafe("index.md") | matter.rlike(r"(?md)^type:[ \t]*index[ \t]*\r?$")


def drafts(src: DataFrame) -> DataFrame:
    """Every derived field of every source in one projection."""
    raw, path = F.col("raw"), F.col("path")
    d = src.select("doc_id", "wiki_id", "path", t.slug_id(path).alias("id"), t.title(raw, path).alias("title"), t.headings(raw).alias("heads"), t.lead(raw).alias("lead"), t.content_hash(raw).alias("hash"), F.length(raw).alias("size"))
    d = d.withColumn("covers", t.covers(F.col("heads"), F.col("lead"))).withColumn("tags", t.directory_tags(path)).withColumn("category", t.category(path))
    d = d.withColumn("focus", F.coalesce(F.nullif("title", F.lit("")), "id"))
    d = d.withColumn("confidence", t.confidence(F.col("focus"), F.col("id"), F.col("covers"), F.col("heads"), F.col("size")))
    return d.withColumn("needs_review", F.col("confidence") < t.CONFIDENT)


def disambiguate(ids: DataFrame, group: str = "wiki_id", base: str = "id", order: tuple[str, ...] = ("path", "doc_id")) -> DataFrame:
    """``ids`` with ``unique_id``: later holders of an id get ``-2``, ``-3`` and so on, past ids that are taken by nature."""
    rank = F.row_number().over(Window.partitionBy(group, base).orderBy(*order))
    # numbers that some natural id of the group already takes, by the id they would be appended to
    tail = ids.select(group, F.regexp_extract(base, r"^(.*)-([1-9]\d{0,6})\z", 1).alias(base), F.regexp_extract(base, r"^(.*)-([1-9]\d{0,6})\z", 2).alias("n")).where("n <> ''")
    taken = tail.groupBy(group, base).agg(F.array_sort(F.collect_set(F.col("n").cast("int"))).alias("taken"))
    out = ids.withColumn("_rank", rank).join(taken, [group, base], "left")
    number = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("_rank"), lambda k, x: F.when(x.between(2, k), k + 1).otherwise(k))
    return out.withColumn("unique_id", F.when(F.col("_rank") == 1, F.col(base)).otherwise(F.concat_ws("-", base, number.cast("string")))).drop("_rank", "taken")


# ---------------------------------------------------------------- DuckDB twins

_LINES = r"""doc AS (SELECT doc_id, wiki_id, path, coalesce(text, '') AS raw FROM documents WHERE path IS NOT NULL),
ln AS (SELECT doc_id, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS ord FROM doc),
co AS (SELECT *, starts_with(line, '```') AS fence, sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS nf FROM ln),
vis AS (SELECT doc_id, ord, line, regexp_matches(line, '^#{1,6}\s+') AS head, regexp_replace(line, '^\s+|\s+\z', '', 'g') = '' AS blank FROM co WHERE NOT fence AND nf % 2 = 0),
hd AS (SELECT *, head AND row_number() OVER (PARTITION BY doc_id, head ORDER BY ord) = 1 AS first_head FROM vis),
mk AS (SELECT *, sum((head OR blank)::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS g FROM hd WHERE NOT first_head),
run AS (SELECT *, min(g) OVER (PARTITION BY doc_id) AS g0, row_number() OVER (PARTITION BY doc_id, g ORDER BY ord) AS rn FROM mk WHERE NOT head AND NOT blank),
lead AS (SELECT doc_id, left(string_agg(regexp_replace(line, '^\s+|\s+\z', '', 'g'), ' ' ORDER BY ord), 400) AS lead FROM run WHERE g = g0 AND rn <= 6 GROUP BY doc_id)"""
_SENTENCES = r"list_filter(string_split(regexp_replace(coalesce(lead, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 10)"
BASE = f"""WITH {_LINES},
d0 AS (SELECT doc_id, wiki_id, path, raw, {t.SLUG_ID.format('path')} AS id, {t.TITLE.format('raw', 'path')} AS title, {t.HEADINGS.format('raw')} AS heads,
  coalesce(lead, '') AS lead, 'sha256:' || sha256(raw) AS hash, length(raw) AS size,
  string_split(regexp_replace(path, '\\\\', '/', 'g'), '/') AS parts FROM doc LEFT JOIN lead USING (doc_id)),
d1 AS (SELECT *, CASE WHEN len(list_filter(heads, lambda h: h.level = 2)) > 0 THEN list_slice(list_transform(list_filter(heads, lambda h: h.level = 2), lambda h: h.text), 1, 10)
  ELSE list_slice(list_transform({_SENTENCES}, lambda s: left(s, 120)), 1, 5) END AS covers,
  list_concat(list_transform(list_filter(list_slice(parts, 1, len(parts) - 1), lambda p: p <> '' AND p <> '.' AND NOT regexp_full_match(p, '\\d+')),
    lambda p: regexp_replace(lower(p), '[^a-z0-9-]+', '-', 'g')), CASE WHEN path LIKE '%.md' THEN ['markdown'] ELSE [] END) AS alltags,
  CASE WHEN len(list_filter(parts, lambda p: p <> '')) <= 1 THEN '' ELSE regexp_replace(lower(list_filter(parts, lambda p: p <> '')[1]), '[^a-z0-9-]+', '-', 'g') END AS category,
  coalesce(nullif(title, ''), id) AS focus FROM d0),
d2 AS (SELECT *, list_slice(list_filter(alltags, lambda x, i: list_position(alltags, x) = i), 1, 8) AS tags,
  round(least(1.0, CASE WHEN focus <> '' AND focus <> id THEN 0.3 ELSE 0 END + CASE WHEN len(covers) >= 3 THEN 0.4 WHEN len(covers) >= 1 THEN 0.2 ELSE 0 END
  + CASE WHEN len(list_filter(heads, lambda h: h.level = 2)) >= 2 THEN 0.2 ELSE 0 END + CASE WHEN size > 200 THEN 0.1 ELSE 0 END), 1)::DOUBLE AS confidence FROM d1)
"""
_LIST = "array_to_string({}, chr(10))"
SQL = {
    "q_derive_id": BASE + "SELECT doc_id, id FROM d0",
    "q_title": BASE + "SELECT doc_id, title FROM d0",
    "q_headings": BASE + "SELECT doc_id, h.level AS level, h.text AS text FROM (SELECT doc_id, unnest(heads) AS h FROM d0)",
    "q_lead": BASE + "SELECT doc_id, lead FROM d0",
    "q_covers": BASE + f"SELECT doc_id, {_LIST.format('covers')} AS covers FROM d1",
    "q_infer_tags": BASE + "SELECT doc_id, array_to_string(tags, ' ') AS tags FROM d2",
    "q_category": BASE + "SELECT doc_id, category FROM d1",
    "q_confidence": BASE + "SELECT doc_id, confidence, confidence < 0.6 AS needs_review FROM d2",
    "q_content_hash": BASE + "SELECT doc_id, hash FROM d0",
    "q_draft": BASE + f"SELECT doc_id, wiki_id, path, id, focus, {_LIST.format('covers')} AS covers, array_to_string(tags, ' ') AS tags, category, hash, confidence FROM d2",
    "q_disambiguate": BASE + r""", r AS (SELECT doc_id, wiki_id, id, row_number() OVER (PARTITION BY wiki_id, id ORDER BY path, doc_id) AS r FROM d0),
tk AS (SELECT wiki_id, regexp_extract(id, '^(.*)-([1-9]\d{0,6})\z', 1) AS id, list_sort(list_distinct(list(regexp_extract(id, '^(.*)-([1-9]\d{0,6})\z', 2)::INT))) AS taken
  FROM d0 WHERE regexp_matches(id, '^(.*)-([1-9]\d{0,6})\z') GROUP BY ALL)
SELECT r.doc_id, CASE WHEN r = 1 THEN r.id ELSE r.id || '-' || list_reduce(list_prepend(r, coalesce(taken, [])), lambda k, x: CASE WHEN x BETWEEN 2 AND k THEN k + 1 ELSE k END) END AS unique_id
FROM r LEFT JOIN tk ON tk.wiki_id IS NOT DISTINCT FROM r.wiki_id AND tk.id = r.id""",
    "q_walk": f"""SELECT doc_id, path FROM documents WHERE path IS NOT NULL
AND len(list_filter(string_split(path, '/'), lambda p: list_contains({list(SKIPPED)!r}, p) OR (starts_with(p, '.') AND NOT list_contains(['.', '..', '.well-known'], p)))) = 0
AND list_contains({list(TEXT_ENDINGS)!r}, lower(regexp_extract(regexp_replace(path, '^.*/', ''), '(\\.[^.]*)\\z', 1)))""",
    "q_index_sources": r"""SELECT doc_id, lower(regexp_replace(path, '^.*/', '')) = 'index.md' OR
regexp_matches(regexp_extract(coalesce(text, ''), '\A---[ \t]*\r?\n((?:[^\n]*\n)*?)---[ \t]*(?:\r?\n|\z)', 1), '(?m)^type:[ \t]*index[ \t]*\r?$') AS is_index FROM documents WHERE path IS NOT NULL""",
}


def queries() -> dict:
    of = lambda fn: lambda s, d: fn(drafts(sources(s, d)))
    lines = lambda c: F.array_join(c, "\n")
    return {
        "q_derive_id": of(lambda d: d.select("doc_id", "id")),
        "q_title": of(lambda d: d.select("doc_id", "title")),
        "q_headings": of(lambda d: d.select("doc_id", F.explode("heads").alias("h")).select("doc_id", "h.*")),
        "q_lead": of(lambda d: d.select("doc_id", "lead")),
        "q_covers": of(lambda d: d.select("doc_id", lines("covers").alias("covers"))),
        "q_infer_tags": of(lambda d: d.select("doc_id", F.array_join("tags", " ").alias("tags"))),
        "q_category": of(lambda d: d.select("doc_id", "category")),
        "q_confidence": of(lambda d: d.select("doc_id", "confidence", "needs_review")),
        "q_content_hash": of(lambda d: d.select("doc_id", "hash")),
        "q_draft": of(lambda d: d.select("doc_id", "wiki_id", "path", "id", "focus", lines("covers").alias("covers"), F.array_join("tags", " ").alias("tags"), "category", "hash", "confidence")),
        "q_disambiguate": of(lambda d: disambiguate(d.select("doc_id", "wiki_id", "path", "id")).select("doc_id", "unique_id")),
        "q_walk": lambda s, d: walked(table(s, d, "documents").where("path IS NOT NULL")).select("doc_id", "path"),
        "q_index_sources": lambda s, d: sources(s, d).select("doc_id", is_index(F.col("raw"), F.col("path")).alias("is_index")),
    }
