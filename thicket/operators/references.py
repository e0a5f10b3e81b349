"""References to records that do not exist (problem 3).

Method: a left anti-join of the distinct non-null foreign keys against the parent keys; the
orphan keys are then joined back, salted, for rows and for counts per field and month.

Defined results. Null targets and targets with an empty form are no references. A missing
``wiki_id`` is a wiki of its own. Rows of a leaf without ``leaf_no`` don't count. An entry with a null id
is live and answers to nothing but its aliases. Repeated targets of a leaf give one row. Empty tables give no rows. Other columns of the tables are
never read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from thicket.functions.forms import REFERENCE_SQL, reference_form
from thicket.plans.scale import cut, salted_join
from thicket.sources.tables import CUR_SQL, counting_rows

FIELDS = ("links", "overlay_targets", "aliases")


def _key(kind: Column, wiki: Column, form: Column) -> Column:
    """One string for a key of ``kind`` (``id`` or ``retired``), wiki and compared form; null without a form."""
    return F.concat(kind, F.lit("\u0001"), F.coalesce(wiki, F.lit("\u0002")), F.lit("\u0001"), form)


def live_leaves(leaf: DataFrame, removal: DataFrame) -> DataFrame:
    """Counting rows whose id has no removal at or after their ``updated_at``."""
    cur = counting_rows(leaf, "leaf_no", "wiki_id", "id", "aliases", "overlay_targets", "links", "updated_at", "loaded_at")
    cur = cur.withColumn("_id", _key(F.lit("id"), F.col("wiki_id"), reference_form(F.col("id"))))
    gone = removal.select(_key(F.lit("id"), F.col("wiki_id"), reference_form(F.col("id"))).alias("_id"), "removed_at")
    gone = gone.where("_id IS NOT NULL").groupBy("_id").agg(F.max("removed_at").alias("removed_at"))
    dead = F.coalesce(F.col("removed_at") >= F.col("updated_at"), F.lit(False))
    # entries without an id meet no removal, and would meet in one key
    named = cur.where("_id IS NOT NULL").join(gone, "_id", "left").where(~dead).drop("removed_at")
    return named.unionByName(cur.where("_id IS NULL"))


def _refs(live: DataFrame) -> DataFrame:
    """leaf_no, field, target, key, month, loaded_at: each distinct reference of a live leaf."""
    of = lambda field, get: F.transform(F.coalesce(F.col(field), F.array()), lambda x: F.struct(F.lit(field).alias("field"), get(x).alias("target")))
    every = F.concat(of("links", lambda x: x["id"]), of("overlay_targets", lambda x: x), of("aliases", lambda x: x))
    kind = F.when(F.col("field") == "aliases", "retired").otherwise("id")
    refs = live.select("leaf_no", "wiki_id", "updated_at", "loaded_at", F.explode(F.array_distinct(every)).alias("_r"))
    refs = refs.select("leaf_no", "wiki_id", "loaded_at", F.date_format("updated_at", "yyyy-MM").alias("month"), "_r.*")
    refs = refs.withColumn("_form", reference_form(F.col("target"))).where(F.col("_form") != "")
    return refs.withColumn("key", _key(kind, F.col("wiki_id"), F.col("_form"))).drop("wiki_id", "_form")


def _first_given(leaf: DataFrame) -> DataFrame:
    """leaf_no, key, first: when each leaf was first delivered with an id or alias, whichever of its rows counts."""
    form = lambda x: _key(F.lit("id"), F.col("wiki_id"), reference_form(x))
    keys = F.concat(F.array(form(F.col("id"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), form))
    given = leaf.select("leaf_no", "loaded_at", F.explode(keys).alias("key")).where("leaf_no IS NOT NULL AND key IS NOT NULL")
    return given.groupBy("leaf_no", "key").agg(F.min("loaded_at").alias("first"))


def _parents(live: DataFrame, index_page: DataFrame, removal: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """key, since: every key that answers a reference, with the time it first came in (with ``first``, by any row of its leaf)."""
    ids = live.select("leaf_no", F.col("_id").alias("key"), F.col("loaded_at").alias("since"))
    alias = live.select("leaf_no", "wiki_id", "loaded_at", F.explode("aliases").alias("a"))
    alias = alias.select("leaf_no", _key(F.lit("id"), F.col("wiki_id"), reference_form(F.col("a"))).alias("key"), F.col("loaded_at").alias("since"))
    own = ids.unionByName(alias)
    if first is not None:
        own = own.join(first, ["leaf_no", "key"], "left").withColumn("since", F.coalesce("first", "since"))
    own = own.select("key", "since")
    pages = index_page.select(_key(F.lit("id"), F.col("wiki_id"), reference_form(F.col("id"))).alias("key"), F.col("updated_at").alias("since"))
    retired = removal.select(_key(F.lit("retired"), F.col("wiki_id"), reference_form(F.col("id"))).alias("key"), F.col("removed_at").alias("since"))
    return own.unionByName(pages).unionByName(retired).where("key IS NOT NULL").groupBy("key").agg(F.min("since").alias("since"))


def _orphan_keys(refs: DataFrame, parents: DataFrame) -> DataFrame:
    return refs.select("key").distinct().join(parents, "key", "left_anti")


def orphans(leaf: DataFrame, index_page: DataFrame, removal: DataFrame) -> DataFrame:
    """leaf_no, field, target: every reference that nothing answers to."""
    live = cut(live_leaves(leaf, removal))
    refs = _refs(live)
    keys = _orphan_keys(refs, _parents(live, index_page, removal))
    return salted_join(refs, keys, "key", ["leaf_no", "target"]).select("leaf_no", "field", "target")


def orphan_report(leaf: DataFrame, index_page: DataFrame, removal: DataFrame) -> DataFrame:
    """field, month, state, references, leaves: references per field, month of ``updated_at`` and state.

    ``state`` is ``missing`` (nothing answers and nothing was retired), ``removed`` (nothing
    answers, but the target is a retired id) or ``late`` (what answers was first delivered after the
    reference's row came in). References that are answered in time aren't reported.
    """
    live = cut(live_leaves(leaf, removal))
    refs = _refs(live)
    parents = _parents(live, index_page, removal, _first_given(leaf))
    retired = removal.select(_key(F.lit("id"), F.col("wiki_id"), reference_form(F.col("id"))).alias("key")).distinct().withColumn("retired", F.lit(True))
    known = refs.select("key").distinct().join(parents, "key", "left").join(retired, "key", "left")
    known = known.withColumn("answered", F.col("since").isNotNull())
    state = (
        F.when(~F.col("answered"), F.when(F.col("retired"), "removed").otherwise("missing"))
        .when(F.col("since") > F.col("loaded_at"), "late")
    )
    rows = salted_join(refs, known, "key", ["leaf_no", "target"]).withColumn("state", state).where(F.col("state").isNotNull())
    # counts of leaves: one row per leaf first, so that no distinct set is held for a hot group
    once = rows.groupBy("field", "month", "state", "leaf_no").agg(F.count("*").alias("n"))
    return once.groupBy("field", "month", "state").agg(F.sum("n").alias("references"), F.count("*").alias("leaves"))


_R = lambda x: REFERENCE_SQL.format(x)
_BASE_SQL = f"""WITH {CUR_SQL},
gone AS (SELECT wiki_id, {_R('id')} AS form, max(removed_at) AS removed_at FROM leaf_removal GROUP BY ALL),
live AS (SELECT c.*, {_R('c.id')} AS form FROM cur c WHERE NOT EXISTS (SELECT 1 FROM gone g
  WHERE g.wiki_id IS NOT DISTINCT FROM c.wiki_id AND g.form = {_R('c.id')} AND g.removed_at >= c.updated_at)),
raw AS (SELECT leaf_no, wiki_id, updated_at, loaded_at, 'links' AS field, unnest(links).id AS target FROM live
  UNION ALL SELECT leaf_no, wiki_id, updated_at, loaded_at, 'overlay_targets', unnest(overlay_targets) FROM live
  UNION ALL SELECT leaf_no, wiki_id, updated_at, loaded_at, 'aliases', unnest(aliases) FROM live),
refs AS (SELECT DISTINCT *, {_R('target')} AS form FROM raw WHERE {_R('target')} <> ''),
ali AS (SELECT leaf_no, wiki_id, unnest(aliases) AS a FROM live),
given AS (SELECT leaf_no, wiki_id, {_R('id')} AS form, loaded_at FROM leaf
  UNION ALL SELECT leaf_no, wiki_id, {_R('a')}, loaded_at FROM (SELECT leaf_no, wiki_id, loaded_at, unnest(aliases) AS a FROM leaf)),
first AS (SELECT leaf_no, coalesce(wiki_id, '?') AS wiki, form, min(loaded_at) AS since FROM given GROUP BY ALL),
own AS (SELECT leaf_no, wiki_id, form FROM live UNION SELECT leaf_no, wiki_id, {_R('a')} FROM ali),
answers AS (SELECT 'id' AS kind, wiki_id, own.form, since FROM own JOIN first ON first.leaf_no = own.leaf_no AND first.wiki = coalesce(own.wiki_id, '?') AND first.form = own.form
  UNION ALL SELECT 'id', wiki_id, {_R('id')}, updated_at FROM index_page
  UNION ALL SELECT 'retired', wiki_id, {_R('id')}, removed_at FROM leaf_removal),
parents AS (SELECT kind, coalesce(wiki_id, '?') AS wiki, form, min(since) AS since FROM answers GROUP BY ALL),
judged AS (SELECT r.*, p.form IS NOT NULL AS answered, p.since FROM refs r LEFT JOIN parents p
  ON p.kind = CASE WHEN r.field = 'aliases' THEN 'retired' ELSE 'id' END
  AND p.wiki = coalesce(r.wiki_id, '?') AND p.form = r.form)
"""
ORPHANS_SQL = _BASE_SQL + "SELECT DISTINCT leaf_no, field, target FROM judged WHERE NOT answered"
REPORT_SQL = _BASE_SQL + """, states AS (SELECT j.*, CASE WHEN NOT answered THEN
  CASE WHEN g.form IS NOT NULL THEN 'removed' ELSE 'missing' END
  WHEN since > loaded_at THEN 'late' END AS state
  FROM judged j LEFT JOIN gone g ON coalesce(g.wiki_id, '?') = coalesce(j.wiki_id, '?') AND g.form = j.form)
SELECT field, strftime(updated_at, '%Y-%m') AS month, state, count(*) AS "references", count(DISTINCT leaf_no) AS leaves
FROM states WHERE state IS NOT NULL GROUP BY ALL"""
