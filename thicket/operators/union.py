"""Joining several wikis into one: union, id collisions, references rewritten, categories that agree.

Sources are ordered by their id; within a source leaves come before index pages, then by path. The
first entry of an id keeps it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from thicket.functions.text import namespace, valid_slug
from thicket.sources.entries import LEAVES_SQL, PAGES_SQL, entries, leaves, pages


def plan_union(ent: DataFrame) -> DataFrame:
    """All entries of all sources with the order of their source."""
    order = ent.select("wiki_id").distinct().withColumn("source_order", F.row_number().over(Window.orderBy("wiki_id")))
    return ent.join(order, "wiki_id").select("source_order", "wiki_id", "kind", "id", "path")


def _ranked(ent: DataFrame) -> DataFrame:
    """Entries with their rank among those of the same id; the id decides the part, so no global sort."""
    w = Window.partitionBy("id").orderBy("wiki_id", F.col("kind") != "leaf", "path")
    return ent.where("id IS NOT NULL").withColumn("rank", F.row_number().over(w))


def namespaced(ent: DataFrame) -> DataFrame:
    """wiki_id, kind, id, path, new_id: entries that lose a collision get their source's name before the id.

    A name that is taken by nature or twice gets ``-2``, ``-3`` and so on.
    """
    lost = _ranked(ent).where("rank > 1").withColumn("base", F.concat_ws("-", namespace(F.col("wiki_id")), "id"))
    taken = ent.select(F.col("id").alias("base")).where("base IS NOT NULL").distinct().withColumn("_t", F.lit(1))
    n = F.row_number().over(Window.partitionBy("base").orderBy("kind", "path"))
    lost = lost.join(taken, "base", "left").withColumn("n", n + F.coalesce("_t", F.lit(0)))
    return lost.select("wiki_id", "kind", "id", "path", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("new_id"))


def mergeable(ent: DataFrame) -> DataFrame:
    """id, wiki_id, path, verdict: under the policy of merging, what becomes of later holders of an id."""
    r = _ranked(ent)
    first = r.where("rank = 1").select("id", *(F.col(c).alias(f"_{c}") for c in ("kind", "focus", "type", "depth_role")))
    same = F.lit(True)
    for c in ("kind", "focus", "type", "depth_role"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return r.where("rank > 1").join(first, "id").select("id", "wiki_id", "path", F.when(same, "merge").otherwise("refuse").alias("verdict"))


def rewired(lv: DataFrame, renames: DataFrame) -> DataFrame:
    """leaf_no, ref, new_ref: links with the ids that their targets have after renaming within their wiki."""
    ref = lv.select("leaf_no", "wiki_id", F.explode("links").alias("l")).select("leaf_no", "wiki_id", F.col("l.id").alias("ref")).where("ref IS NOT NULL").distinct()
    r = renames.select("wiki_id", F.col("id").alias("ref"), "new_id").groupBy("wiki_id", "ref").agg(F.min("new_id").alias("new_id"))
    return ref.join(r, ["wiki_id", "ref"], "left").select("leaf_no", "ref", F.coalesce("new_id", "ref").alias("new_ref"))


def joined(ent: DataFrame, lv: DataFrame) -> DataFrame:
    """wiki_id, kind, path, id, links, overlay_targets of every entry in the wiki that all sources are joined into.

    Paths lie below the name of the source. Entries that lose an id are renamed, and what their source says of them in
    ``links`` and ``overlay_targets`` follows; both come out as distinct sorted lines, null for pages and empty lists.
    """
    renames = namespaced(ent)
    own = renames.select("wiki_id", "kind", "path", "new_id").dropDuplicates(["wiki_id", "kind", "path"])
    rows = ent.select("wiki_id", "kind", "path", "id").join(own, ["wiki_id", "kind", "path"], "left")
    where = F.concat_ws("/", namespace(F.col("wiki_id")), "path")
    rows = rows.select("wiki_id", "kind", "path", where.alias("new_path"), F.coalesce("new_id", "id").alias("id"))
    names = renames.groupBy("wiki_id", F.col("id").alias("ref")).agg(F.min("new_id").alias("new_ref"))
    of = lambda field, get: F.transform(F.coalesce(F.col(field), F.array()), lambda x: F.struct(F.lit(field).alias("field"), get(x).alias("ref")))
    refs = lv.select("wiki_id", "path", F.explode(F.concat(of("links", lambda x: x["id"]), of("overlay_targets", lambda x: x))).alias("r")).select("wiki_id", "path", "r.*").where("ref IS NOT NULL")
    refs = refs.join(names, ["wiki_id", "ref"], "left").withColumn("to", F.coalesce("new_ref", "ref"))
    lines = lambda f: F.array_join(F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("to")))), "\n")
    refs = refs.groupBy("wiki_id", "path").agg(*(F.nullif(lines(f), F.lit("")).alias(f) for f in ("links", "overlay_targets"))).withColumn("kind", F.lit("leaf"))
    return rows.join(refs, ["wiki_id", "kind", "path"], "left").select("wiki_id", "kind", F.col("new_path").alias("path"), "id", "links", "overlay_targets")


def same_focus(pg: DataFrame) -> DataFrame:
    """focus, pages: index pages of different directories with the same focus."""
    f = F.lower(F.trim("focus"))
    return pg.where(F.trim("focus") != "").groupBy(f.alias("focus")).agg(F.count("*").alias("pages")).where("pages > 1")


def live_ids(ent: DataFrame) -> DataFrame:
    return ent.where("id IS NOT NULL").select("wiki_id", "id").distinct()


def forbidden_ids(ent: DataFrame, lv: DataFrame) -> DataFrame:
    """wiki_id, id that a new directory must not take: ids, aliases and names of directories."""
    alias = lv.select("wiki_id", F.explode("aliases").alias("id"))
    parts = lv.select("wiki_id", F.explode(F.split("parent_dir", "/")).alias("id")).where("id <> ''")
    return live_ids(ent).unionByName(alias.where("id IS NOT NULL")).unionByName(parts).distinct()


def resolve_slugs(wanted: DataFrame, forbidden: DataFrame, most: int = 99) -> DataFrame:
    """wiki_id, slug, resolved: the slug, ``-group``, ``-group-2`` and so on, whichever is free and valid first."""
    tries = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda n: F.struct(n.alias("n"), F.when(n == 0, F.col("slug")).when(n == 1, F.concat("slug", F.lit("-group"))).otherwise(F.concat(F.col("slug"), F.lit("-group-"), n.cast("string"))).alias("id")))
    t = wanted.select("wiki_id", "slug", F.explode(tries).alias("t")).select("wiki_id", "slug", "t.n", "t.id").where(valid_slug(F.col("id")))
    free = t.join(forbidden, ["wiki_id", "id"], "left_anti").groupBy("wiki_id", "slug").agg(F.min_by("id", "n").alias("resolved"))
    # a slug that none of the tries is free for stops the plan, unless nothing of it is a valid name
    none = F.raise_error(F.concat(F.lit("no free name for "), "slug")).cast("string")
    out = wanted.select("wiki_id", "slug").distinct().join(free, ["wiki_id", "slug"], "left").where(F.col("resolved").isNotNull() | valid_slug(F.col("slug")))
    return out.select("wiki_id", "slug", F.coalesce("resolved", none).alias("resolved"))


def already_reported(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings less those whose code and target are known."""
    return findings.join(known.select("code", "target").distinct(), ["code", "target"], "left_anti")


# ---------------------------------------------------------------- DuckDB twins

_B = f"""WITH {LEAVES_SQL}, {PAGES_SQL},
every AS (SELECT 'leaf' AS kind, wiki_id, parent_dir, path, id, type, depth_role, focus FROM ent UNION ALL SELECT 'index', wiki_id, parent_dir, path, id, 'index', depth_role, focus FROM page),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY wiki_id, kind <> 'leaf', path) AS rank FROM every WHERE id IS NOT NULL),
ls AS (SELECT *, regexp_replace(wiki_id, '\\.wiki\\z', '') || '-' || id AS base FROM rk WHERE rank > 1),
nm AS (SELECT wiki_id, kind, id, path, base, row_number() OVER (PARTITION BY base ORDER BY kind, path) + (base IN (SELECT id FROM every WHERE id IS NOT NULL))::INT AS n FROM ls),
ren AS (SELECT wiki_id, kind, id, path, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS new_id FROM nm),
forb AS (SELECT wiki_id, id FROM every WHERE id IS NOT NULL UNION SELECT wiki_id, id FROM (SELECT wiki_id, unnest(aliases) AS id FROM ent) WHERE id IS NOT NULL
  UNION SELECT wiki_id, id FROM (SELECT wiki_id, unnest(string_split(parent_dir, '/')) AS id FROM ent) WHERE id <> '')
"""
SQL = {
    "q_plan_union": _B + "SELECT dense_rank() OVER (ORDER BY wiki_id)::INTEGER AS source_order, wiki_id, kind, id, path FROM every",
    "q_collision_namespace": _B + "SELECT * FROM ren",
    "q_collision_merge": _B + "SELECT r.id, r.wiki_id, r.path, CASE WHEN r.kind = f.kind AND r.focus IS NOT DISTINCT FROM f.focus AND r.type IS NOT DISTINCT FROM f.type AND r.depth_role IS NOT DISTINCT FROM f.depth_role THEN 'merge' ELSE 'refuse' END AS verdict FROM rk r JOIN rk f ON f.id = r.id AND f.rank = 1 WHERE r.rank > 1",
    "q_rewire": _B + ", lk AS (SELECT DISTINCT leaf_no, wiki_id, ref FROM (SELECT leaf_no, wiki_id, unnest(links).id AS ref FROM ent) WHERE ref IS NOT NULL) SELECT leaf_no, ref, coalesce(new_id, ref) AS new_ref FROM lk LEFT JOIN (SELECT wiki_id, id, min(new_id) AS new_id FROM ren GROUP BY ALL) r ON r.wiki_id = lk.wiki_id AND r.id = lk.ref",
    "q_join": _B + r""", own AS (SELECT wiki_id, kind, path, any_value(new_id) AS new_id FROM ren GROUP BY ALL), mp AS (SELECT wiki_id, id AS ref, min(new_id) AS new_ref FROM ren GROUP BY ALL),
rf AS (SELECT wiki_id, path, 'links' AS field, unnest(links).id AS ref FROM ent UNION ALL SELECT wiki_id, path, 'overlay_targets', unnest(overlay_targets) FROM ent),
nr AS (SELECT wiki_id, path, field, coalesce(new_ref, ref) AS x FROM rf LEFT JOIN mp USING (wiki_id, ref) WHERE ref IS NOT NULL),
ag AS (SELECT wiki_id, path, 'leaf' AS kind, nullif(string_agg(DISTINCT x, chr(10) ORDER BY x) FILTER (field = 'links'), '') AS links, nullif(string_agg(DISTINCT x, chr(10) ORDER BY x) FILTER (field = 'overlay_targets'), '') AS overlay_targets FROM nr GROUP BY wiki_id, path)
SELECT e.wiki_id, e.kind, regexp_replace(e.wiki_id, '\.wiki\z', '') || '/' || e.path AS path, coalesce(own.new_id, e.id) AS id, links, overlay_targets
FROM every e LEFT JOIN own USING (wiki_id, kind, path) LEFT JOIN ag USING (wiki_id, kind, path)""",
    "q_same_focus": _B + "SELECT lower(trim(focus)) AS focus, count(*) AS pages FROM page WHERE trim(focus) <> '' GROUP BY 1 HAVING count(*) > 1",
    "q_live_ids": _B + "SELECT DISTINCT wiki_id, id FROM every WHERE id IS NOT NULL",
    "q_forbidden_ids": _B + "SELECT wiki_id, id FROM forb",
    "q_slug_resolve": _B + r""", want AS (SELECT DISTINCT wiki_id, id AS slug FROM page WHERE id IS NOT NULL),
tr AS (SELECT wiki_id, slug, n, CASE n WHEN 0 THEN slug WHEN 1 THEN slug || '-group' ELSE slug || '-group-' || n END AS id FROM want, range(100) t(n))
SELECT wiki_id, slug, arg_min(id, n) AS resolved FROM tr ANTI JOIN forb USING (wiki_id, id) WHERE regexp_full_match(id, '[a-z][a-z0-9-]{0,63}') GROUP BY ALL""",
}


def queries() -> dict:
    ent = lambda fn: lambda s, d: fn(entries(s, d))
    return {
        "q_plan_union": ent(plan_union), "q_collision_namespace": ent(namespaced), "q_collision_merge": ent(mergeable),
        "q_rewire": lambda s, d: rewired(leaves(s, d), namespaced(entries(s, d))), "q_same_focus": lambda s, d: same_focus(pages(s, d)),
        "q_join": lambda s, d: joined(entries(s, d), leaves(s, d)),
        "q_live_ids": ent(live_ids), "q_forbidden_ids": lambda s, d: forbidden_ids(entries(s, d), leaves(s, d)),
        "q_slug_resolve": lambda s, d: resolve_slugs(pages(s, d).where("id IS NOT NULL").select("wiki_id", F.col("id").alias("slug")).distinct(), forbidden_ids(entries(s, d), leaves(s, d))),
    }
