"""Fixed points: convergence, balance, containment of root leaves, and greedy selection.

Each round derives a new version of the leaves from the last one and cuts its lineage. A round
applies every rewrite of one kind that doesn't touch another, in all wikis at once; the rounds are
capped as the methodology has it. The driver holds only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from thicket.functions.text import entry_text, tokenize
from thicket.operators import cluster, routing, tree
from thicket.operators.similarity import affinity as every_affinity, bound_vectors, small_affinity as affinity
from thicket.plans.scale import cut, fresh
from thicket.sources.entries import PAGES_SQL, LEAVES_SQL, leaves, pages
from thicket.sources.tables import table

MOST_CONVERGENCE, MOST_BALANCE = 200, 20
ZONE_CHARS = 2048


def moved(lv: DataFrame, to: DataFrame) -> DataFrame:
    """``lv`` with the leaves of ``to`` (leaf_no, new_dir) in their new directories."""
    n = to.groupBy("leaf_no").agg(F.min("new_dir").alias("_to"))
    out = lv.join(n, "leaf_no", "left").withColumn("parent_dir", F.coalesce("_to", "parent_dir")).drop("_to")
    out = out.withColumn("path", F.concat_ws("/", F.nullif("parent_dir", F.lit("")), F.substring_index("path", "/", -1)))
    return out.withColumn("dir", F.concat_ws("/", "wiki_id", "parent_dir")).withColumn("depth", F.when(F.col("parent_dir") == "", 0).otherwise(F.size(F.split("parent_dir", "/"))))


def nest_targets(lv: DataFrame, cl: DataFrame) -> DataFrame:
    """leaf_no, new_dir: the members of each cluster below their directory, in one named after them."""
    names = cluster.slugs(lv, cl)
    part = lv.select("leaf_no", "parent_dir")
    # two clusters of one directory may want one name: the later ones get a number
    n = F.row_number().over(Window.partitionBy("dir", "slug").orderBy("label"))
    names = names.withColumn("slug", F.when(n == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", n.cast("string"))))
    to = cl.select("dir", "label", "leaf_no").join(names, ["dir", "label"]).join(part, "leaf_no")
    return to.select("leaf_no", F.concat_ws("/", F.nullif("parent_dir", F.lit("")), "slug").alias("new_dir"))


def balance(lv: DataFrame, rounds: int = MOST_BALANCE) -> DataFrame:
    """leaf_no, dir_before, dir_after: passthroughs are flattened first, then overfull directories are parted."""
    start = lv.select("leaf_no", F.col("parent_dir").alias("dir_before"))
    now = fresh(lv)
    for _ in range(rounds):
        deep = tree.passthroughs(now).where("overdeep").select("wiki_id", F.col("path").alias("hop"))
        hit = tree.flatten(now).select("leaf_no", F.regexp_replace("new_path", r"/?[^/]*\z", "").alias("new_dir"))
        hit = hit.join(now.select("leaf_no", "wiki_id", "parent_dir"), "leaf_no").join(deep, F.expr("startswith(concat(parent_dir, '/'), concat(hop, '/'))") & (now["wiki_id"] == deep["wiki_id"]), "left_semi")
        step = cut(hit.select("leaf_no", "new_dir"))
        if step.isEmpty():
            full = tree.fanout(now).where("overfull").select("wiki_id", F.col("path").alias("parent_dir"))
            crowd = now.join(full, ["wiki_id", "parent_dir"], "left_semi")
            step = cut(nest_targets(now, cluster.coarse_clusters(crowd, 0)))
            if step.isEmpty():
                break
        now = fresh(moved(now, step))
    else:
        raise RuntimeError(f"directories are not balanced after {rounds} rounds")
    return start.join(now.select("leaf_no", F.col("parent_dir").alias("dir_after")), "leaf_no").where("dir_before <> dir_after")


def absorb(lv: DataFrame, gone: DataFrame) -> DataFrame:
    """``lv`` without the leaves that are absorbed (absorbed, keeper); their keepers take over what they hold.

    Covers, tags, domains, links and overlay targets are united, the absorbed ids and their aliases become aliases.
    """
    lists = ("covers", "tags", "domains", "links", "overlay_targets", "aliases")
    some = lambda c: F.coalesce(F.col(c), F.array().cast(lv.schema[c].dataType))
    lost = gone.select("keeper", F.col("absorbed").alias("leaf_no")).join(lv, "leaf_no")
    ids = F.array(F.col("id"))
    taken = lost.groupBy("keeper").agg(*(F.flatten(F.collect_list(F.concat(some(c), ids) if c == "aliases" else some(c))).alias(f"_{c}") for c in lists))
    kept = lv.join(gone.select(F.col("absorbed").alias("leaf_no")), "leaf_no", "left_anti").join(taken, lv["leaf_no"] == taken["keeper"], "left").drop("keeper")
    for c in lists:
        kept = kept.withColumn(c, F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.array_compact(F.array_union(some(c), F.col(f"_{c}"))))).drop(f"_{c}")
    kept = kept.withColumn("text", entry_text(F.col("focus"), F.col("covers"), F.col("tags"), F.col("domains")))
    return (kept.withColumn("tokens", tokenize(F.col("text"))) if "tokens" in lv.columns else kept).select(*lv.columns)


def _unseen(lv: DataFrame, seen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The leaves of directories that are not in ``seen`` (dir, n, mark) as they are now, and what to know as seen from here on.

    A directory that a detector finds something in is changed by what is applied, or its wiki is left alone
    for good; so one that is as it was when it was last looked at holds nothing.
    """
    marks = cut(lv.groupBy("dir").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("leaf_no", "text", "covers", "tags")).alias("mark")))
    new = marks if seen is None else marks.join(seen, ["dir", "n", "mark"], "left_anti")
    return lv.join(new.select("dir"), "dir", "left_semi"), marks


def converge(lv: DataFrame, pg: DataFrame, vectors: DataFrame, probes: DataFrame, rounds: int = MOST_CONVERGENCE) -> tuple[DataFrame, list[tuple[int, str, int]]]:
    """The leaves at the fixed point, and round, operator, applied of every round.

    Lifting comes before merging, merging before nesting; a nest stays in the wikis whose routing
    cost it lowers.
    """
    now, log, pinned, merged, nested = fresh(lv), [], None, None, None
    for n in range(1, rounds + 1):
        up = cut(tree.lift(now).select("leaf_no", F.regexp_replace("new_path", r"/?[^/]*\z", "").alias("new_dir")))
        if k := up.count():
            now = fresh(moved(now, up))
            log.append((n, "LIFT", k))
            continue
        part, merged = _unseen(now, merged)
        pairs = tree.merge_rows(part).groupBy("absorbed").agg(F.min("keeper").alias("keeper"))
        gone = cut(pairs.join(pairs.select(F.col("absorbed").alias("keeper")), "keeper", "left_anti"))
        if k := gone.count():
            now = fresh(absorb(now, gone))
            log.append((n, "MERGE", k))
            continue
        open_ = now if pinned is None else now.join(pinned, "wiki_id", "left_anti")
        part, nested = _unseen(open_, nested)
        part = fresh(part.withColumn("tokens", tokenize(F.col("text"))))
        # pairs are clustered in directories of these sizes only
        fit = part.groupBy("dir").agg(F.count("*").alias("k")).where(F.col("k").between(cluster.LEAST, cluster.COARSE)).select("dir")
        aff = fresh(affinity(part.join(fit, "dir", "left_semi"), vectors))
        cl = fresh(cluster.detect(part, aff))
        if cl.isEmpty():
            break
        # names need the words of a directory's leaves only where it has clusters
        after = fresh(moved(open_, nest_targets(part.join(cl.select("dir").distinct(), "dir", "left_semi"), cl)))
        tried = cut(cl.select("dir").distinct().join(open_.select("dir", "wiki_id").distinct(), "dir").select("wiki_id").distinct())
        of = lambda df: df.join(tried, "wiki_id", "left_semi")
        fine = routing.gate(routing.routing_cost(of(open_), of(pg), probes), routing.routing_cost(of(after), of(pg), probes)).where("by_likeness").select("wiki_id")
        fine = cut(fine)
        refused = tried.join(fine, "wiki_id", "left_anti")
        pinned = fresh(refused if pinned is None else pinned.unionByName(refused).distinct())
        kept = after.join(fine, "wiki_id", "left_semi")
        k = kept.join(cl.select("leaf_no"), "leaf_no", "left_semi").count()
        if not k:
            break
        now = fresh(now.join(fine, "wiki_id", "left_anti").unionByName(kept.select(*now.columns)))
        log.append((n, "NEST", k))
    return now, log


def contain_roots(lv: DataFrame) -> DataFrame:
    """leaf_no, new_dir: each leaf at a wiki's root in a directory of its own, named by its heaviest words."""
    root = lv.where("parent_dir = ''")
    cl = root.select("dir", F.col("leaf_no").alias("label"), "leaf_no")
    names = cluster.slugs(root, cl).join(root.select("leaf_no", "wiki_id"), F.col("label") == F.col("leaf_no"))
    n = F.row_number().over(Window.partitionBy("wiki_id", "slug").orderBy("leaf_no"))
    taken = lv.where("parent_dir <> ''").select("wiki_id", F.split("parent_dir", "/")[0].alias("slug")).distinct().withColumn("_t", F.lit(1))
    names = names.withColumn("n", n).join(taken, ["wiki_id", "slug"], "left").withColumn("n", F.col("n") + F.coalesce("_t", F.lit(0)))
    return names.select("leaf_no", F.when(F.col("n") == 1, F.col("slug")).when(F.col("n") == 2, F.concat("slug", F.lit("-group"))).otherwise(F.concat(F.col("slug"), F.lit("-group-"), (F.col("n") - 1).cast("string"))).alias("new_dir"))


def greedy_disjoint(proposals: DataFrame) -> DataFrame:
    """dir, proposal, members: proposals (dir, proposal, score, members) in order of score, less those that share a member with one before.

    The proposals of one directory are folded in one row; their number is bounded by its size.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "proposal", "members")))
    none = F.array().cast("array<struct<proposal:string,members:array<bigint>>>")
    start = F.struct(F.array().cast("array<bigint>").alias("taken"), none.alias("kept"))
    step = lambda s, p: F.when(F.arrays_overlap(s["taken"], p["members"]), s).otherwise(F.struct(F.concat(s["taken"], p["members"]).alias("taken"), F.concat(s["kept"], F.array(F.struct(p["proposal"].alias("proposal"), p["members"].alias("members")))).alias("kept")))
    folded = proposals.groupBy("dir").agg(F.aggregate(order, start, step)["kept"].alias("kept"))
    return folded.select("dir", F.explode("kept").alias("k")).select("dir", "k.*")


def descend(documents: DataFrame) -> DataFrame:
    """doc_id, new_id: bodies that are too long or look like a leaf become leaves of their own."""
    from thicket.functions.text import leaf_signs

    zone = F.coalesce("text", F.lit(""))
    d = documents.where("path IS NOT NULL").where((F.length(zone) > ZONE_CHARS) | leaf_signs(zone)).select("doc_id", "wiki_id", F.regexp_replace("path", r"/?[^/]*\z", "").alias("dir"))
    n = F.row_number().over(Window.partitionBy("wiki_id", "dir").orderBy("doc_id"))
    return d.select("doc_id", F.concat(F.lit("descended-content-"), n.cast("string")).alias("new_id"))


def shape_check(lv: DataFrame, documents: DataFrame) -> DataFrame:
    """wiki_id, operator, n: what each detector suggests."""
    one = lambda df, op: df.select("wiki_id", F.lit(op).alias("operator"))
    w = lv.select("leaf_no", "wiki_id")
    every = one(tree.lift(lv).join(w, "leaf_no"), "LIFT")
    every = every.unionByName(one(tree.merge_pairs(lv).join(w, F.col("leaf_a") == F.col("leaf_no")), "MERGE"))
    every = every.unionByName(one(descend(documents).join(documents.select("doc_id", "wiki_id"), "doc_id"), "DESCEND"))
    every = every.unionByName(one(tree.decompose(lv).where("shape_check").join(w, "leaf_no"), "DECOMPOSE")).unionByName(one(tree.nest_hints(lv).join(w, "leaf_no"), "NEST"))
    return every.groupBy("wiki_id", "operator").agg(F.count("*").alias("n"))


def on_cycles(lv: DataFrame) -> DataFrame:
    """Specified only: leaf_no of leaves that ``depends-on`` links lead back to, or between such leaves.

    Leaves nothing points to, or that point to nothing, are peeled off until none is left to peel.
    """
    ids = lv.select("wiki_id", "id", F.col("leaf_no").alias("b"))
    e = lv.select("wiki_id", F.col("leaf_no").alias("a"), F.explode("links").alias("l")).where("l.relation = 'depends-on'").select("wiki_id", "a", F.col("l.id").alias("id"))
    edges = cut(e.join(ids, ["wiki_id", "id"]).select("a", "b").distinct())
    left = edges.count()
    while left:
        kept = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        kept = cut(kept)
        n = kept.count()
        if n == left:
            break
        edges, left = kept, n
    return edges.select(F.col("a").alias("leaf_no")).unionByName(edges.select(F.col("b").alias("leaf_no"))).distinct()


# ---------------------------------------------------------------- DuckDB twins

_SIGNS = r"(regexp_matches(coalesce(text, ''), '(?m)^[ \t]*```') OR regexp_matches(coalesce(text, ''), '(?m)^[ \t]*[-*][ \t]+\[[ xX]\]') OR len(regexp_extract_all(coalesce(text, ''), '(?m)^[ \t]*\d+\.[ \t]+')) >= 2)"
_DESC = f"SELECT doc_id, wiki_id, 'descended-content-' || row_number() OVER (PARTITION BY wiki_id, regexp_replace(path, '/?[^/]*\\z', '') ORDER BY doc_id) AS new_id FROM documents WHERE path IS NOT NULL AND (length(coalesce(text, '')) > {ZONE_CHARS} OR {_SIGNS})"
SQL = {
    "q_descend": f"SELECT doc_id, new_id FROM ({_DESC})",
    "q_shape_check": tree.SQL["q_merge_pairs"].replace(" SELECT dir, leaf_a, leaf_b FROM mp", f""", sug AS (SELECT e.wiki_id, 'LIFT' AS operator FROM ent e JOIN dirs d ON d.wiki_id = e.wiki_id AND d.path = e.parent_dir WHERE leaves = 1 AND subdirs = 0 AND d.depth >= 2
  UNION ALL SELECT wiki_id, 'MERGE' FROM mp JOIN ent ON leaf_no = leaf_a UNION ALL SELECT wiki_id, 'DESCEND' FROM ({_DESC})
  UNION ALL SELECT wiki_id, 'DECOMPOSE' FROM ent WHERE len(covers) > {tree.DECOMPOSE} UNION ALL SELECT wiki_id, 'NEST' FROM ent WHERE len(list_filter(domains, lambda x: trim(x) <> '')) > 0)
SELECT wiki_id, operator, count(*) AS n FROM sug GROUP BY ALL"""),
}


def queries() -> dict:
    def proposals(s: SparkSession, d: str) -> DataFrame:
        lv = leaves(s, d)
        aff = cut(every_affinity(lv, bound_vectors(lv, table(s, d, "embeddings"))))
        parts = cut(cluster.partitions(lv, aff))
        t = parts.groupBy("dir", "threshold", "label").agg(F.array_sort(F.collect_set("leaf_no")).alias("members")).where(F.size("members").between(cluster.LEAST, cluster.MOST))
        name = F.concat_ws("@", F.col("label").cast("string"), F.col("threshold").cast("string"))
        return t.select("dir", name.alias("proposal"), F.col("threshold").alias("score"), "members")

    def converged(s: SparkSession, d: str) -> DataFrame:
        # rounds carry only what they look at or change
        lv = leaves(s, d).drop("tokens", "depth_role", "parents", "source", "line_count", "updated_at", "loaded_at")
        _, log = converge(lv, pages(s, d), cut(bound_vectors(lv, table(s, d, "embeddings"))), routing.probes(s))
        return s.createDataFrame(log, "round int, operator string, applied long")

    return {
        "q_descend": lambda s, d: descend(table(s, d, "documents")),
        "q_shape_check": lambda s, d: shape_check(leaves(s, d), table(s, d, "documents")),
        "q_greedy_disjoint": lambda s, d: greedy_disjoint(proposals(s, d)).select("dir", "proposal", F.array_join(F.transform("members", lambda x: x.cast("string")), " ").alias("members")),
        "q_nest_apply": lambda s, d: (lambda lv: nest_targets(lv, cluster.detect(lv, cut(every_affinity(lv, bound_vectors(lv, table(s, d, "embeddings")))))))(leaves(s, d)),
        "q_balance": lambda s, d: balance(leaves(s, d)),
        "q_convergence": converged,
        "q_root_containment": lambda s, d: contain_roots(leaves(s, d).withColumn("parent_dir", F.when(F.col("type") == "overlay", "").otherwise(F.col("parent_dir"))).withColumn("dir", F.concat_ws("/", "wiki_id", "parent_dir"))),
        "q_acyclic": lambda s, d: on_cycles(leaves(s, d)),
    }
