"""Versions, logs and requests to an outside judge: append-only tables and what is asked of them.

Operation and decision logs are played by ``events`` (operator, subject, likeness, time); versions
by the deliveries of ``source_snapshot``, each the parent of the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from thicket.functions.forms import HASH_SQL, PATH_SQL, hash_form, path_form
from thicket.operators.similarity import BASE as SIM, tier0
from thicket.sources.entries import leaves
from thicket.sources.tables import table


def decision_summary(events: DataFrame) -> DataFrame:
    """operator, decisions, mean, first, last of a decision log."""
    return events.groupBy(F.col("event_type").alias("operator")).agg(F.count("*").alias("decisions"), F.round(F.avg("value"), 6).alias("mean"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def trajectory(events: DataFrame) -> DataFrame:
    """op, iteration, cost, change: the cost from step to step of each operation."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = events.withColumn("iteration", F.row_number().over(w)).withColumn("before", F.lag("value").over(w))
    return n.select(F.col("user_id").alias("op"), "iteration", F.col("value").alias("cost"), F.round(F.col("value") - F.col("before"), 6).alias("change"))


def op_history(events: DataFrame, subject: str = "1") -> DataFrame:
    """The log lines that name a subject, newest first within the result."""
    return events.where(F.contains(F.coalesce("props", F.lit("")), F.lit(subject))).select("event_id", "event_type", "ts")


def version_diff(snapshots: DataFrame, old: int, new: int) -> DataFrame:
    """wiki_id, path, change between any two versions; moved content of one hash is ``renamed``."""
    s = snapshots.where(F.col("snapshot_no").isin(old, new)).select("snapshot_no", "wiki_id", path_form(F.col("path")).alias("path"), hash_form(F.col("hash")).alias("hash"), "scanned_at")
    s = s.groupBy("snapshot_no", "wiki_id", "path").agg(F.max(F.struct("scanned_at", "hash"))["hash"].alias("hash"))
    a, b = (s.where(F.col("snapshot_no") == n).select("wiki_id", "path", F.col("hash").alias(h), F.lit(True).alias(f"in_{h}")) for n, h in ((old, "was"), (new, "now")))
    d = a.join(b, ["wiki_id", "path"], "full")
    change = F.when(F.col("in_was").isNull(), "added").when(F.col("in_now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    d = d.withColumn("change", change).where("change IS NOT NULL")
    gone = d.where("change = 'removed' AND was IS NOT NULL").select("wiki_id", F.col("was").alias("now")).distinct().withColumn("_moved", F.lit(True))
    return d.join(gone, ["wiki_id", "now"], "left").select("wiki_id", "path", F.when((F.col("change") == "added") & F.col("_moved"), "renamed").otherwise(F.col("change")).alias("change"))


def ancestors(spark: SparkSession, snapshots: DataFrame, head: int) -> DataFrame:
    """version, steps: the versions that lead to ``head``, by a recursive query over parents."""
    versions = snapshots.groupBy("snapshot_no").agg(F.min("taken_at").alias("taken_at"))
    versions = versions.select(F.col("snapshot_no").alias("version"), F.lag("snapshot_no").over(Window.partitionBy(F.lit(0)).orderBy("snapshot_no")).alias("parent"))
    return spark.sql(
        "WITH RECURSIVE up AS (SELECT version, parent, 0 AS steps FROM {v} WHERE version = {head} UNION ALL "
        "SELECT v.version, v.parent, up.steps + 1 FROM up JOIN {v} v ON v.version = up.parent) SELECT version, steps FROM up",
        v=versions, head=head,
    )


def resume(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """path, action: what an ingest does with each candidate (path, hash) given what there is."""
    have = existing.groupBy("wiki_id", "path").agg(F.max_by("hash", "updated_at").alias("have"), F.lit(True).alias("there"))
    c = candidates.join(have, ["wiki_id", "path"], "left")
    return c.select("wiki_id", "path", F.when(F.col("there").isNull(), "insert").when(F.col("hash").eqNullSafe(F.col("have")), "skip").otherwise("update").alias("action"))


def existing_by_source(lv: DataFrame) -> DataFrame:
    return lv.where("source.path IS NOT NULL").select("wiki_id", path_form(F.col("source.path")).alias("path"), hash_form(F.col("source.hash")).alias("hash"), "updated_at")


def latest_sources(snapshots: DataFrame) -> DataFrame:
    """wiki_id, path, hash of every file in the latest delivery of its wiki."""
    last = snapshots.groupBy("wiki_id").agg(F.max("snapshot_no").alias("snapshot_no"))
    s = snapshots.join(last, ["wiki_id", "snapshot_no"]).select("wiki_id", path_form(F.col("path")).alias("path"), hash_form(F.col("hash")).alias("hash"), "scanned_at")
    return s.groupBy("wiki_id", "path").agg(F.max(F.struct("scanned_at", "hash"))["hash"].alias("hash"))


# ---------------------------------------------------------------- requests to an outside judge

#: The kinds of request to an outside judge.
KINDS = ("merge_decision", "nest_decision", "cluster_name", "propose_structure", "draft_frontmatter", "rebuild_plan_review", "human_fix_item")


def request_id(kind: Column, inputs: Column) -> Column:
    """The first 16 hex digits of the hash of the canonical JSON, whose keys are sorted."""
    return F.substring(F.sha2(F.to_json(F.struct(inputs.alias("inputs"), kind.alias("kind"))), 256), 1, 16)


def merge_requests(lv: DataFrame) -> DataFrame:
    """request_id, kind, leaf_a, leaf_b of the pairs that tier 0 escalates, one request an id."""
    p = tier0(lv).where("verdict = 'escalate'")
    r = p.select(F.lit(KINDS[0]).alias("kind"), "leaf_a", "leaf_b").withColumn("request_id", request_id(F.col("kind"), F.struct("leaf_a", "leaf_b")))
    return r.groupBy("request_id").agg(F.min("kind").alias("kind"), F.min("leaf_a").alias("leaf_a"), F.min("leaf_b").alias("leaf_b"))


def pending(requests: DataFrame, responses: DataFrame) -> DataFrame:
    return requests.join(responses.select("request_id").distinct(), "request_id", "left_anti")


def resolve(requests: DataFrame, fixture: DataFrame) -> DataFrame:
    """request_id, response, how: an exact answer, else that for any request of the kind, else none.

    ``fixture``: request_id (null for any), kind, response; the last ``n`` of an id counts.
    """
    exact = fixture.where("request_id IS NOT NULL").groupBy("request_id").agg(F.max_by("response", "n").alias("_exact"))
    any_ = fixture.where("request_id IS NULL").groupBy("kind").agg(F.max_by("response", "n").alias("_any"))
    r = requests.join(exact, "request_id", "left").join(any_, "kind", "left")
    return r.select("request_id", F.coalesce("_exact", "_any").alias("response"), F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_any").isNotNull(), "any").otherwise("pending").alias("how"))


# ---------------------------------------------------------------- DuckDB twins

_REQ = SIM + """, req AS (SELECT substr(sha256('{"inputs":{"leaf_a":' || leaf_a || ',"leaf_b":' || leaf_b || '},"kind":"merge_decision"}'), 1, 16) AS request_id, leaf_a, leaf_b FROM t0 WHERE verdict = 'escalate')
"""
_FILES = f"""fs AS (SELECT snapshot_no, wiki_id, {PATH_SQL.format('path')} AS path, arg_max({HASH_SQL.format('hash')}, scanned_at) AS hash FROM source_snapshot GROUP BY ALL)"""
SQL = {
    "q_decision_summary": 'SELECT event_type AS operator, count(*) AS decisions, round(avg(value), 6) AS mean, min(ts) AS "first", max(ts) AS "last" FROM events GROUP BY ALL',
    "q_trajectory": "SELECT user_id AS op, row_number() OVER w::INTEGER AS iteration, value AS cost, round(value - lag(value) OVER w, 6) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)".replace("OVER w::INTEGER", "OVER w"),
    "q_op_history": "SELECT event_id, event_type, ts FROM events WHERE contains(coalesce(props, ''), '1')",
    "q_version_diff": f"""WITH st AS (SELECT snapshot_no, wiki_id, {PATH_SQL.format('path')} AS path, {HASH_SQL.format('hash')} AS hash FROM source_snapshot WHERE snapshot_no IN (5, 6)
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, wiki_id, {PATH_SQL.format('path')} ORDER BY scanned_at DESC, {HASH_SQL.format('hash')} DESC NULLS LAST) = 1),
a AS (SELECT * FROM st WHERE snapshot_no = 5), b AS (SELECT * FROM st WHERE snapshot_no = 6),
d AS (SELECT coalesce(a.wiki_id, b.wiki_id) AS wiki_id, coalesce(a.path, b.path) AS path, a.hash AS was, b.hash AS now,
  CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'changed' END AS change FROM a FULL JOIN b ON a.wiki_id = b.wiki_id AND a.path = b.path)
SELECT wiki_id, path, CASE WHEN change = 'added' AND EXISTS (SELECT 1 FROM d g WHERE g.change = 'removed' AND g.wiki_id = d.wiki_id AND g.was = d.now) THEN 'renamed' ELSE change END AS change FROM d WHERE change IS NOT NULL""",
    "q_ancestor": "SELECT snapshot_no AS version, (6 - snapshot_no)::INTEGER AS steps FROM (SELECT DISTINCT snapshot_no FROM source_snapshot) WHERE snapshot_no <= 6",
    "q_request_id": _REQ + "SELECT leaf_a, leaf_b, request_id FROM req",
    "q_t2_pending": _REQ + "SELECT request_id, leaf_a, leaf_b FROM req WHERE request_id >= '8'",
    "q_t2_resolve": _REQ + "SELECT request_id, CASE WHEN request_id < '4' THEN 'yes' ELSE 'no' END AS response, CASE WHEN request_id < '4' THEN 'exact' ELSE 'any' END AS how FROM req",
    "q_resume_upsert": SIM + f""", la AS (SELECT wiki_id, max(snapshot_no) AS snapshot_no FROM source_snapshot GROUP BY 1),
cand AS (SELECT wiki_id, {PATH_SQL.format('path')} AS path, {HASH_SQL.format('hash')} AS hash FROM source_snapshot JOIN la USING (wiki_id, snapshot_no)
  QUALIFY row_number() OVER (PARTITION BY wiki_id, {PATH_SQL.format('path')} ORDER BY scanned_at DESC, {HASH_SQL.format('hash')} DESC NULLS LAST) = 1),
have AS (SELECT wiki_id, {PATH_SQL.format('source.path')} AS path, {HASH_SQL.format('source.hash')} AS hash FROM ent WHERE source.path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY wiki_id, {PATH_SQL.format('source.path')} ORDER BY updated_at DESC) = 1)
SELECT c.wiki_id, c.path, CASE WHEN h.path IS NULL THEN 'insert' WHEN c.hash IS NOT DISTINCT FROM h.hash THEN 'skip' ELSE 'update' END AS action FROM cand c LEFT JOIN have h USING (wiki_id, path)""",
}


def queries() -> dict:
    req = lambda fn: lambda s, d: fn(merge_requests(leaves(s, d)))
    ev = lambda fn: lambda s, d: fn(table(s, d, "events"))

    def fixture(r: DataFrame) -> DataFrame:
        given = r.where("request_id < '4'").select("request_id", "kind", F.lit("yes").alias("response"), F.lit(1).alias("n"))
        rest = r.sparkSession.createDataFrame([(None, KINDS[0], "no", 1)], "request_id string, kind string, response string, n int")
        return given.unionByName(rest)

    return {
        "q_decision_summary": ev(decision_summary), "q_trajectory": ev(trajectory), "q_op_history": ev(op_history),
        "q_version_diff": lambda s, d: version_diff(table(s, d, "source_snapshot"), 5, 6),
        "q_ancestor": lambda s, d: ancestors(s, table(s, d, "source_snapshot"), 6),
        "q_request_id": req(lambda r: r.select("leaf_a", "leaf_b", "request_id")),
        "q_t2_pending": req(lambda r: pending(r, r.where("request_id < '8'")).select("request_id", "leaf_a", "leaf_b")),
        "q_t2_resolve": req(lambda r: resolve(r, fixture(r))),
        "q_resume_upsert": lambda s, d: resume(latest_sources(table(s, d, "source_snapshot")), existing_by_source(leaves(s, d))),
    }
