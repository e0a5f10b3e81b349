"""What a query reads on its way down a tree, and what that costs.

A query has keywords and tags. An entry matches if a tag is equal (in any letter case) or its focus
holds a keyword anywhere, so ``log`` finds ``catalog``. A page matches by what the page above lists of it
or by its own focus and shared covers; that of the root always does. A page is read if it and all
pages above it match and it lies at most ``DEEPEST`` directories down; directories without a page let
every query pass. A leaf is read if it matches and its page is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from thicket.sources.entries import LEAVES_SQL, PAGES_SQL, leaves, pages

#: Queries to measure a tree with: name, keywords, tags. A parameter of every operator here.
PROBES = (
    ("p-migration", ("migration", "rollback"), ("release",)),
    ("p-storage", ("vault", "archive", "snapshot"), ("storage",)),
    ("p-access", ("login", "passkey", "certificate"), ("access", "security")),
    ("p-network", ("router", "gateway", "stream"), ("network",)),
    ("p-quality", ("audit", "review", "metric"), ("quality",)),
    ("p-supply", ("shipment", "pallet", "warehouse"), ("logistics",)),
    ("p-none", ("zzz-nothing",), ()),
)
#: Bytes that an index page counts for: a base and so much for each entry.
PAGE_BASE, PAGE_ENTRY = 256, 64
#: Directories below the root down to which pages are read.
DEEPEST = 10
#: A rewrite by likeness must lower the cost by more than EPSILON; one by judgement may raise it so far.
EPSILON, TOLERANCE = 1e-9, 1.05


def probes(spark: SparkSession, rows=PROBES) -> DataFrame:
    return spark.createDataFrame([(a, list(k), list(t)) for a, k, t in rows], "query string, keywords array<string>, qtags array<string>")


def matches(focus: Column, tags: Column, covers: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    low = F.transform(F.array_compact(F.coalesce(tags, none)), F.lower)
    hit = F.arrays_overlap(low, F.transform("qtags", F.lower)) | F.exists("keywords", lambda k: F.contains(F.lower(F.coalesce(focus, F.lit(""))), F.lower(k)))
    if covers is not None:
        hit = hit | F.exists(F.array_compact(F.coalesce(covers, none)), lambda c: F.exists("keywords", lambda k: F.contains(F.lower(c), F.lower(k))))
    return F.coalesce(hit, F.lit(False))


def entry_matches(lv: DataFrame, q: DataFrame) -> DataFrame:
    """query, leaf_no. The queries are few and broadcast: their number is checked by the caller's list."""
    return lv.join(F.broadcast(q)).where(matches(F.col("focus"), F.col("tags"))).select("query", "leaf_no")


def page_visits(pg: DataFrame, q: DataFrame) -> DataFrame:
    """query, wiki_id, parent_dir, dir, bytes of the pages that a query reads."""
    none = F.array().cast("array<string>")
    size = PAGE_BASE + PAGE_ENTRY * F.greatest(F.size(F.coalesce("entries", F.array().cast(pg.schema["entries"].dataType))), F.lit(0))
    hit = pg.select("wiki_id", "parent_dir", "dir", "focus", "shared_covers", size.cast("long").alias("bytes")).join(F.broadcast(q))
    hit = hit.withColumn("hit", (F.col("parent_dir") == "") | matches(F.col("focus"), none, F.col("shared_covers"))).drop("focus", "shared_covers", "keywords", "qtags")
    # what pages list of the pages below them
    below = F.concat_ws("/", F.nullif("parent_dir", F.lit("")), F.regexp_replace("e.file", r"/?index\.md\z", ""))
    listed = pg.select("wiki_id", "parent_dir", F.explode("entries").alias("e")).where("e.type = 'index' AND e.file IS NOT NULL").select("wiki_id", below.alias("parent_dir"), "e.focus", "e.tags")
    listed = listed.join(F.broadcast(q)).where(matches(F.col("focus"), F.col("tags"))).select("query", "wiki_id", "parent_dir").distinct().withColumn("listed", F.lit(True))
    hit = hit.join(listed, ["query", "wiki_id", "parent_dir"], "left").withColumn("hit", F.col("hit") | F.coalesce("listed", F.lit(False))).drop("listed")
    # pages above: one row for each proper prefix of the path that has a page
    parts = F.split("parent_dir", "/")
    above = hit.where("hit AND parent_dir <> ''").select("query", "wiki_id", "dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("up"))
    shut = above.join(hit.where("NOT hit").select("query", "wiki_id", F.col("parent_dir").alias("up")), ["query", "wiki_id", "up"], "left_semi").select("query", "dir").distinct()
    return hit.where(F.col("hit") & (F.size(parts) <= DEEPEST)).join(shut, ["query", "dir"], "left_anti").select("query", "wiki_id", "parent_dir", "dir", "bytes")


def visits(lv: DataFrame, pg: DataFrame, q: DataFrame) -> DataFrame:
    """query, wiki_id, kind, node, bytes: all that each query reads."""
    p = page_visits(pg, q)
    read = lv.join(F.broadcast(q)).where(matches(F.col("focus"), F.col("tags"))).join(p.select("query", "dir"), ["query", "dir"], "left_semi")
    leaf = read.select("query", "wiki_id", F.lit("leaf").alias("kind"), F.col("leaf_no").cast("string").alias("node"), F.coalesce("size_bytes", F.lit(0)).alias("bytes"))
    return p.select("query", "wiki_id", F.lit("index").alias("kind"), F.col("dir").alias("node"), "bytes").unionByName(leaf)


def total_bytes(lv: DataFrame, pg: DataFrame) -> DataFrame:
    """wiki_id, total: bytes of leaves and pages."""
    none = F.array().cast(pg.schema["entries"].dataType)
    page = pg.select("wiki_id", (PAGE_BASE + PAGE_ENTRY * F.size(F.coalesce("entries", none))).cast("long").alias("b"))
    return lv.select("wiki_id", F.coalesce("size_bytes", F.lit(0)).alias("b")).unionByName(page).groupBy("wiki_id").agg(F.sum("b").alias("total"))


def routing_cost(lv: DataFrame, pg: DataFrame, q: DataFrame) -> DataFrame:
    """wiki_id, query, bytes, cost: the share of a wiki that each query reads."""
    v = visits(lv, pg, q).groupBy("wiki_id", "query").agg(F.sum("bytes").alias("bytes"))
    every = total_bytes(lv, pg).join(F.broadcast(q.select("query")))
    out = every.join(v, ["wiki_id", "query"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    return out.select("wiki_id", "query", "bytes", F.round(F.col("bytes") / F.col("total"), 9).alias("cost"))


def gate(before: DataFrame, after: DataFrame) -> DataFrame:
    """wiki_id, pre, post, by_likeness, by_judgement: whether a rewrite may stay, by its summed cost."""
    s = lambda df, n: df.groupBy("wiki_id").agg(F.round(F.sum("cost"), 9).alias(n))
    both = s(before, "pre").join(s(after, "post"), "wiki_id")
    return both.select("wiki_id", "pre", "post", (F.col("post") <= F.col("pre") - EPSILON).alias("by_likeness"), (F.col("post") <= F.round(F.col("pre") * TOLERANCE, 9)).alias("by_judgement"))


def without_lone_directories(lv: DataFrame) -> DataFrame:
    """The leaves after every lone leaf moved up."""
    from thicket.operators.tree import lift

    up = lift(lv).select("leaf_no", F.regexp_replace("new_path", r"/?[^/]*\z", "").alias("_up"))
    out = lv.join(up, "leaf_no", "left").withColumn("parent_dir", F.coalesce("_up", "parent_dir")).drop("_up")
    return out.withColumn("dir", F.concat_ws("/", "wiki_id", "parent_dir"))


# ---------------------------------------------------------------- DuckDB twins

_LISTS = lambda x: "[" + ", ".join(f"'{v}'" for v in x) + "]::VARCHAR[]"
_PROBES = "probe AS (" + " UNION ALL ".join(f"SELECT '{a}' AS query, {_LISTS(k)} AS keywords, {_LISTS(t)} AS qtags" for a, k, t in PROBES) + ")"
_LOW = "list_transform(list_filter(coalesce({}, []), lambda x: x IS NOT NULL), lambda x: lower(x))"
_KEY = "len(list_filter(keywords, lambda k: contains(lower(coalesce(focus, '')), k))) > 0"
_BASE = f"""WITH {LEAVES_SQL}, {PAGES_SQL}, {_PROBES},
lm AS (SELECT query, e.* FROM ent e, probe WHERE list_has_any({_LOW.format('tags')}, qtags) OR {_KEY}),
rc AS (SELECT DISTINCT query, wiki_id, child AS parent_dir, TRUE AS listed FROM (SELECT wiki_id, concat_ws('/', nullif(parent_dir, ''), regexp_replace(e.file, '/?index\\.md\\z', '')) AS child, e.focus AS focus, e.tags AS tags
  FROM (SELECT wiki_id, parent_dir, unnest(entries) AS e FROM page) WHERE e.type = 'index' AND e.file IS NOT NULL), probe WHERE list_has_any({_LOW.format('tags')}, qtags) OR {_KEY}),
pm AS (SELECT query, wiki_id, parent_dir, dir, {PAGE_BASE} + {PAGE_ENTRY} * len(coalesce(entries, [])) AS bytes,
  parent_dir = '' OR coalesce(listed, FALSE) OR {_KEY} OR len(list_filter({_LOW.format('shared_covers')}, lambda c: len(list_filter(keywords, lambda k: contains(c, k))) > 0)) > 0 AS hit
  FROM (SELECT * FROM page, probe) LEFT JOIN rc USING (query, wiki_id, parent_dir)),
pv AS (SELECT query, wiki_id, parent_dir, dir, bytes FROM pm p WHERE hit AND len(string_split(parent_dir, '/')) <= {DEEPEST} AND NOT EXISTS (SELECT 1 FROM pm u WHERE u.query = p.query AND u.wiki_id = p.wiki_id AND NOT u.hit
  AND u.parent_dir <> p.parent_dir AND (u.parent_dir = '' OR starts_with(p.parent_dir, u.parent_dir || '/')))),
vis AS (SELECT query, wiki_id, 'index' AS kind, dir AS node, bytes::BIGINT AS bytes FROM pv
  UNION ALL SELECT l.query, l.wiki_id, 'leaf', l.leaf_no::VARCHAR, coalesce(size_bytes, 0) FROM lm l SEMI JOIN pv ON pv.query = l.query AND pv.dir = l.dir),
tot AS (SELECT wiki_id, sum(b)::BIGINT AS total FROM (SELECT wiki_id, coalesce(size_bytes, 0) AS b FROM ent UNION ALL SELECT wiki_id, {PAGE_BASE} + {PAGE_ENTRY} * len(coalesce(entries, [])) FROM page) GROUP BY 1),
cost AS (SELECT t.wiki_id, p.query, coalesce(sum(v.bytes), 0)::BIGINT AS bytes, round(coalesce(sum(v.bytes), 0) / any_value(total), 9) AS cost
  FROM tot t CROSS JOIN probe p LEFT JOIN vis v ON v.wiki_id = t.wiki_id AND v.query = p.query GROUP BY ALL)
"""
SQL = {
    "q_total_bytes": _BASE + "SELECT wiki_id, total FROM tot",
    "q_entry_match": _BASE + "SELECT query, leaf_no FROM lm",
    "q_routing_visits": _BASE + "SELECT query, wiki_id, kind, node, bytes FROM vis",
    "q_routing_cost": _BASE + "SELECT wiki_id, query, bytes, cost FROM cost",
    "q_query_cost": _BASE + "SELECT query, round(avg(cost), 6) AS mean, round(max(cost), 6) AS most, count(*) FILTER (bytes > 0) AS wikis FROM cost GROUP BY query",
}


def queries() -> dict:
    of = lambda fn: lambda s, d: fn(leaves(s, d), pages(s, d), probes(s))
    return {
        "q_total_bytes": of(lambda lv, pg, q: total_bytes(lv, pg)),
        "q_entry_match": of(lambda lv, pg, q: entry_matches(lv, q)),
        "q_routing_visits": of(visits),
        "q_routing_cost": of(routing_cost),
        "q_query_cost": of(lambda *x: routing_cost(*x).groupBy("query").agg(F.round(F.avg("cost"), 6).alias("mean"), F.round(F.max("cost"), 6).alias("most"), F.count(F.when(F.col("bytes") > 0, 1)).alias("wikis"))),
        "q_metric_gate": of(lambda lv, pg, q: gate(routing_cost(lv, pg, q), routing_cost(without_lone_directories(lv), pg, q))),
    }
