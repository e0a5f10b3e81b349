"""Clusters of siblings: threshold graph, components, the best partition, names and purposes.

Components of a graph of any size are found by passing the smallest label along edges and along labels;
each round halves what is left of a chain. Those of a directory are found in one task. Directories of more than ``COARSE`` leaves are
partitioned by farthest-first k-means instead, one directory to a task, whose likeness is worked out
in pieces of bounded size.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from thicket.functions.text import fnv1a, valid_slug
from thicket.operators.similarity import BASE as SIM, SMALL, affinity, bound_vectors, weights
from thicket.plans.scale import cut
from thicket.sources.entries import leaves
from thicket.sources.tables import table

THRESHOLDS = (0.10, 0.15, 0.20, 0.25, 0.30, 0.38, 0.46)
#: Accepted sizes of a cluster, the share that makes a component a blob, and when k-means takes over.
LEAST, MOST, BLOB, COARSE = 3, 8, 0.75, SMALL
#: Accepted sizes of a coarse cluster, leaves per cluster aimed at, and rounds.
COARSE_LEAST, COARSE_MOST, COARSE_EACH, COARSE_ROUNDS = 3, 30, 8, 20
#: Clusters, and weights of leaves, that are compared at a time; this bounds memory and changes no result.
COARSE_WIDTH, COARSE_WEIGHTS = 256, 2_000
#: Leaves of small directories whose components are found in one task; this bounds memory and changes no result.
BLOCK = 10_000


def threshold_edges(aff: DataFrame) -> DataFrame:
    """threshold, dir, leaf_a, leaf_b: the edges of each threshold."""
    t = F.explode(F.filter(F.array(*map(F.lit, THRESHOLDS)), lambda t: t <= F.col("affinity")))
    return aff.select("dir", "leaf_a", "leaf_b", "affinity", t.alias("threshold"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (g, n) with ``label``, the smallest node that is reachable by ``edges`` (g, a, b) of its group."""
    both = cut(edges.select("g", "a", "b").unionByName(edges.select("g", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("g", "n", F.col("n").alias("label")))
    while True:
        near = both.join(labels.select("g", F.col("n").alias("b"), "label"), ["g", "b"]).groupBy("g", F.col("a").alias("n")).agg(F.min("label").alias("other"))
        step = labels.join(near, ["g", "n"], "left").select("g", "n", F.least("label", F.coalesce("other", "label")).alias("label"), F.col("label").alias("old"))
        jump = step.select("g", F.col("n").alias("label"), F.col("label").alias("further"))
        new = cut(step.join(jump, ["g", "label"], "left").select("g", "n", F.least("label", F.coalesce("further", "label")).alias("label"), "old"))
        labels = new.select("g", "n", "label")
        if new.where("label <> old").isEmpty():
            break
    return labels


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that is reachable from each of ``n`` nodes by the edges."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _block(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The leaves of some directories in order, their numbers, and the pairs by places of their leaves, with affinities."""
    table = table.combine_chunks()
    alone = pc.is_null(table["leaf_b"])
    nodes, pairs = table.filter(alone).sort_by("leaf_no"), table.filter(pc.invert(alone))
    leaf = nodes["leaf_no"].to_numpy()
    return nodes, leaf, *(np.searchsorted(leaf, pairs[c].to_numpy()) for c in ("leaf_no", "leaf_b")), pairs["affinity"].to_numpy()


def _partition_block(table: pa.Table) -> pa.Table:
    """threshold, dir, leaf_no, label of some directories."""
    nodes, leaf, a, b, affinity = _block(table)
    labels = [leaf[_labels(len(leaf), a[affinity >= t], b[affinity >= t])] for t in THRESHOLDS]
    return pa.concat_tables(pa.table({"threshold": np.full(len(leaf), t), "dir": nodes["dir"], "leaf_no": leaf, "label": label}) for t, label in zip(THRESHOLDS, labels))


def _half_up(x: float) -> float:
    """``x`` with six decimals, as Spark rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def _cluster_block(table: pa.Table) -> pa.Table:
    """dir, label, leaf_no, threshold of the accepted clusters of some directories; as ``shape_scores`` says, at each one's best threshold."""
    nodes, leaf, a, b, affinity = _block(table)
    names, of = np.unique(nodes["dir"].to_numpy(zero_copy_only=False), return_inverse=True)
    n = np.bincount(of)
    best, at, label = np.zeros(len(names)), np.full(len(names), -1), []
    for i, t in enumerate(THRESHOLDS):
        own = _labels(len(leaf), a[affinity >= t], b[affinity >= t])
        size, inside = np.bincount(own, minlength=len(leaf)), own[a] == own[b]
        total = np.bincount(own[a[inside]], affinity[inside], len(leaf))
        fit = np.flatnonzero((size >= LEAST) & (size <= MOST))
        # the label of a component is one of its leaves, so it lies in its directory
        add = lambda x: np.bincount(of[fit], x, len(names))
        k, largest = np.bincount(of[fit], minlength=len(names)), np.zeros(len(names), np.int64)
        np.maximum.at(largest, of, size)
        covered, cohesion, pairs = add(size[fit]), add(total[fit]), add(size[fit] * (size[fit] - 1) / 2)
        for d in np.flatnonzero((k > 0) & (largest <= BLOB * n)):
            score = _half_up(float((covered[d] / n[d]) * (1 + 0.25 * (k[d] - 1)) * (0.5 + 0.5 * cohesion[d] / pairs[d])))
            if score > best[d]:
                best[d], at[d] = score, i
        label.append(np.where((size[own] >= LEAST) & (size[own] <= MOST), own, -1))
    every = np.array(label)[at[of], np.arange(len(leaf))]
    keep = np.flatnonzero((at[of] >= 0) & (every >= 0))
    return pa.table({"dir": nodes["dir"].take(pa.array(keep)), "label": leaf[every[keep]], "leaf_no": leaf[keep], "threshold": np.array(THRESHOLDS)[at[of[keep]]]})


def _blocks(lv: DataFrame, aff: DataFrame) -> DataFrame:
    """dir, leaf_no, leaf_b, affinity, block: leaves and pairs of directories small enough, about ``BLOCK`` leaves to a block."""
    small = lv.groupBy("dir").agg(F.count("*").alias("k")).where((F.col("k") >= LEAST) & (F.col("k") <= COARSE)).select("dir")
    blocks = max(1, -(-lv.count() // BLOCK))
    nodes = lv.select("dir", "leaf_no", F.lit(None).cast("long").alias("leaf_b"), F.lit(None).cast("double").alias("affinity"))
    rows = nodes.unionByName(aff.select("dir", F.col("leaf_a").alias("leaf_no"), "leaf_b", "affinity")).join(small, "dir", "left_semi")
    return rows.withColumn("block", F.pmod(F.xxhash64("dir"), F.lit(blocks)))


def partitions(lv: DataFrame, aff: DataFrame) -> DataFrame:
    """threshold, dir, leaf_no, label for directories small enough, at every threshold.

    A directory of this size has few pairs, so its components at all thresholds are found in one task, together
    with those of other directories.
    """
    return _blocks(lv, aff).groupBy("block").applyInArrow(lambda t: _partition_block(t), "threshold double, dir string, leaf_no long, label long")


def shape_scores(parts: DataFrame, aff: DataFrame) -> DataFrame:
    """threshold, dir, score: coverage by accepted clusters, times their number, times their cohesion."""
    sizes = parts.groupBy("threshold", "dir", "label").agg(F.count("*").alias("size"))
    n = parts.groupBy("threshold", "dir").agg(F.count("*").alias("n"))
    ok = F.col("size").between(LEAST, MOST)
    side = lambda s: parts.select("threshold", "dir", F.col("leaf_no").alias(f"leaf_{s}"), F.col("label").alias(f"label_{s}"))
    inside = aff.join(side("a"), ["dir", "leaf_a"]).join(side("b"), ["threshold", "dir", "leaf_b"]).where("label_a = label_b")
    inside = inside.groupBy("threshold", "dir", F.col("label_a").alias("label")).agg(F.sum("affinity").alias("sum"))
    s = sizes.join(inside, ["threshold", "dir", "label"], "left").na.fill(0, ["sum"])
    s = s.groupBy("threshold", "dir").agg(
        F.sum(F.when(ok, F.col("size"))).alias("covered"), F.sum(ok.cast("int")).alias("k"), F.max("size").alias("largest"),
        F.sum(F.when(ok, F.col("sum"))).alias("total"), F.sum(F.when(ok, F.col("size") * (F.col("size") - 1) / 2)).alias("pairs"),
    ).join(n, ["threshold", "dir"])
    score = (F.col("covered") / F.col("n")) * (1 + 0.25 * (F.col("k") - 1)) * (0.5 + 0.5 * F.col("total") / F.col("pairs"))
    return s.select("threshold", "dir", F.round(F.when((F.col("k") == 0) | (F.col("largest") > BLOB * F.col("n")), 0.0).otherwise(score), 6).alias("score"))


def clusters(lv: DataFrame, aff: DataFrame) -> DataFrame:
    """dir, label, leaf_no, threshold of the accepted clusters of each directory's best threshold (the lowest on a tie)."""
    return _blocks(lv, aff).groupBy("block").applyInArrow(lambda t: _cluster_block(t), "dir string, label long, leaf_no long, threshold double")


def detect(lv: DataFrame, aff: DataFrame) -> DataFrame:
    """``clusters`` of the smaller directories and those that k-means finds in the larger ones, which have no threshold."""
    return clusters(lv, aff).unionByName(coarse_clusters(lv).withColumn("threshold", F.lit(None).cast("double")))


def cluster_affinity(cl: DataFrame, aff: DataFrame) -> DataFrame:
    """dir, label, size, average: the mean affinity of a cluster's pairs."""
    side = lambda s: cl.select("dir", F.col("leaf_no").alias(f"leaf_{s}"), F.col("label").alias(f"label_{s}"))
    inside = aff.join(side("a"), ["dir", "leaf_a"]).join(side("b"), ["dir", "leaf_b"]).where("label_a = label_b").groupBy("dir", F.col("label_a").alias("label")).agg(F.sum("affinity").alias("sum"))
    size = cl.groupBy("dir", "label").agg(F.count("*").alias("size"))
    return size.join(inside, ["dir", "label"], "left").select("dir", "label", "size", F.round(F.coalesce("sum", F.lit(0.0)) / (F.col("size") * (F.col("size") - 1) / 2), 6).alias("average"))


def slugs(lv: DataFrame, cl: DataFrame, take: int = 16) -> DataFrame:
    """dir, label, slug: the first valid pair of the heaviest words, one word, or a hash of the ids."""
    w = weights(lv).join(cl.select("dir", "label", "leaf_no"), ["dir", "leaf_no"]).groupBy("dir", "label", "term").agg(F.round(F.sum("w"), 6).alias("w"))
    rank = F.row_number().over(Window.partitionBy("dir", "label").orderBy(F.desc("w"), "term"))
    top = w.where(F.col("term").rlike(r"^[a-z][a-z0-9]*\z")).withColumn("r", rank).where(F.col("r") <= take)
    words = top.groupBy("dir", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("t"))
    pair = F.flatten(F.transform("t", lambda a, i: F.transform(F.filter("t", lambda b, j: j > i), lambda b: F.concat_ws("-", a, b))))
    ids = lv.select("leaf_no", "id").join(cl, "leaf_no").groupBy("dir", "label").agg(F.array_join(F.array_sort(F.collect_list("id")), "|").alias("ids"))
    valid = lambda xs: F.filter(xs, valid_slug)
    out = ids.join(words, ["dir", "label"], "left").withColumn("t", F.coalesce("t", F.array().cast("array<string>")))
    pick = F.coalesce(F.try_element_at(valid(pair), F.lit(1)), F.try_element_at(valid(F.col("t")), F.lit(1)), F.concat(F.lit("cluster-"), F.substring(fnv1a(F.col("ids")), 1, 7)))
    return out.select("dir", "label", pick.alias("slug"))


def purposes(lv: DataFrame, cl: DataFrame, most: int = 4) -> DataFrame:
    """dir, label, purpose: the covers that most members have, else the focus of the smallest id."""
    m = lv.join(cl.select("leaf_no", "label"), "leaf_no")
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")
    each = m.select("dir", "label", F.explode(F.array_distinct(F.transform(F.array_compact(F.coalesce("covers", F.array().cast("array<string>"))), strip))).alias("c")).where("c <> ''")
    n = each.groupBy("dir", "label", "c").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("dir", "label").orderBy(F.desc("n"), "c"))
    top = n.withColumn("r", rank).where(F.col("r") <= most).groupBy("dir", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "c"))), lambda x: x["c"]), "; ").alias("covers"))
    first = m.groupBy("dir", "label").agg(F.min_by(F.coalesce("focus", F.lit("")), "id").alias("focus"))
    return first.join(top, ["dir", "label"], "left").select("dir", "label", F.coalesce("covers", "focus").alias("purpose"))


def _dots(ptr: np.ndarray, col: np.ndarray, w: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """The product of sparse rows, none of them empty, with a dense matrix."""
    out = np.empty((len(ptr) - 1, dense.shape[1]))
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(ptr, ptr[at] + COARSE_WEIGHTS, side="right")) - 1)
        piece = slice(ptr[at], ptr[to])
        out[at:to] = np.add.reduceat(dense[col[piece]] * w[piece, None], ptr[at:to] - ptr[at], axis=0)
        at = to
    return out


def _coarse(pdf: pd.DataFrame) -> pd.DataFrame:
    """Farthest-first k-means over the likeness of the leaves of one directory, given as sparse unit vectors."""
    pdf = pdf.sort_values(["leaf_no", "term"], kind="stable")
    ids, row = np.unique(pdf["leaf_no"].to_numpy(), return_inverse=True)
    _, col = np.unique(pdf["term"].to_numpy(), return_inverse=True)
    w = pdf["w"].to_numpy()
    n, width = len(ids), int(col.max()) + 1
    ptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    own = np.bincount(row, w * w, n)
    k = max(2, min(-(-n // COARSE_EACH), n // 3))
    by = np.argsort(col, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(col, minlength=width))])

    def like(leaf: int) -> np.ndarray:
        out = np.zeros(n)
        for i in range(ptr[leaf], ptr[leaf + 1]):
            x = by[start[col[i]] : start[col[i] + 1]]
            out[row[x]] += w[x] * w[i]
        out[leaf] = 0.0
        return out

    seeds, label, nearest = [0], np.zeros(n, np.int64), like(0)
    while len(seeds) < k:
        left = nearest.copy()
        left[seeds] = np.inf
        seeds.append(int(np.argmin(left)))
        other = like(seeds[-1])
        label[other > nearest] = len(seeds) - 1
        nearest = np.maximum(nearest, other)
    label[seeds] = np.arange(k)
    for _ in range(COARSE_ROUNDS):
        members = np.bincount(label, minlength=k)
        best, new = np.full(n, -np.inf), np.zeros(n, np.int64)
        for lo in range(0, k, COARSE_WIDTH):
            hi = min(lo + COARSE_WIDTH, k)
            mine = np.flatnonzero((label >= lo) & (label < hi))
            held = np.isin(row, mine)
            sums = np.bincount(col[held] * (hi - lo) + label[row[held]] - lo, w[held], width * (hi - lo)).reshape(width, hi - lo)
            mean = _dots(ptr, col, w, sums)
            # the mean over a cluster counts a leaf's own zero, so membership is no advantage
            mean[mine, label[mine] - lo] -= own[mine]
            mean[np.abs(mean) < 1e-12] = 0.0
            mean /= np.maximum(members[lo:hi], 1)
            at = np.argmax(mean, axis=1)
            score = mean[np.arange(n), at]
            better = score > best
            best[better], new[better] = score[better], lo + at[better]
        if (new == label).all():
            break
        label = new
    size = np.bincount(label, minlength=k)
    keep = (size[label] >= COARSE_LEAST) & (size[label] <= COARSE_MOST)
    first = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(first, label, ids)
    return pd.DataFrame({"dir": pdf["dir"].iloc[0], "leaf_no": ids[keep], "label": first[label][keep]})


def coarse_clusters(lv: DataFrame, more_than: int = COARSE) -> DataFrame:
    """dir, leaf_no, label for directories of more than ``more_than`` leaves."""
    n = lv.groupBy("dir").agg(F.count("*").alias("k")).where(F.col("k") > more_than)
    from thicket.operators.similarity import unit_weights

    # weights are of a directory, so those of the others need not be made
    return unit_weights(weights(lv.join(n.select("dir"), "dir", "left_semi"))).groupBy("dir").applyInPandas(lambda pdf: _coarse(pdf), "dir string, leaf_no long, label long")


def same_sets(one: DataFrame, other: DataFrame) -> DataFrame:
    """members, source: clusters (label, leaf_no) of two origins, joined where their members are equal."""
    sets = lambda df: df.groupBy("label").agg(F.array_join(F.array_sort(F.transform(F.collect_set("leaf_no"), lambda x: x.cast("string"))), " ").alias("members")).select("members").distinct()
    a, b = sets(one).withColumn("a", F.lit(1)), sets(other).withColumn("b", F.lit(1))
    return a.join(b, "members", "full").select("members", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "first").otherwise("second").alias("source"))


# ---------------------------------------------------------------- DuckDB twins

_T = ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)
_B = SIM.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
thr(threshold) AS (VALUES {_T}),
small AS (SELECT dir, count(*) AS n FROM ent GROUP BY dir HAVING count(*) BETWEEN {LEAST} AND {COARSE}),
edge AS (SELECT threshold, dir, leaf_a AS a, leaf_b AS b FROM aff JOIN small USING (dir) JOIN thr ON threshold <= affinity),
arc AS (SELECT * FROM edge UNION ALL SELECT threshold, dir, b, a FROM edge),
reach AS (SELECT threshold, dir, leaf_no AS n, leaf_no AS m FROM ent JOIN small USING (dir), thr UNION SELECT r.threshold, r.dir, r.n, arc.b FROM reach r JOIN arc ON arc.threshold = r.threshold AND arc.dir = r.dir AND arc.a = r.m),
part AS (SELECT threshold, dir, n AS leaf_no, min(m) AS label FROM reach GROUP BY ALL),
size AS (SELECT threshold, dir, label, count(*) AS size FROM part GROUP BY ALL),
insum AS (SELECT x.threshold, x.dir, x.label, sum(affinity) AS s FROM aff JOIN part x ON x.dir = aff.dir AND x.leaf_no = leaf_a JOIN part y ON y.dir = aff.dir AND y.threshold = x.threshold AND y.leaf_no = leaf_b AND y.label = x.label GROUP BY ALL),
agg AS (SELECT threshold, dir, any_value(n) AS n, sum(size) FILTER (size BETWEEN {LEAST} AND {MOST}) AS covered, count(*) FILTER (size BETWEEN {LEAST} AND {MOST}) AS k, max(size) AS largest,
  sum(coalesce(s, 0)) FILTER (size BETWEEN {LEAST} AND {MOST}) AS total, sum(size * (size - 1) / 2) FILTER (size BETWEEN {LEAST} AND {MOST}) AS pairs
  FROM size LEFT JOIN insum USING (threshold, dir, label) JOIN small USING (dir) GROUP BY ALL),
score AS (SELECT threshold, dir, round(CASE WHEN k = 0 OR largest > {BLOB} * n THEN 0.0 ELSE covered / n * (1 + 0.25 * (k - 1)) * (0.5 + 0.5 * total / pairs) END, 6) AS score FROM agg),
best AS (SELECT dir, threshold FROM score WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, threshold) = 1),
clu AS (SELECT dir, label, leaf_no, threshold FROM part JOIN best USING (dir, threshold) JOIN size USING (threshold, dir, label) WHERE size BETWEEN {LEAST} AND {MOST})
"""
SQL = {
    "q_threshold_scan": _B + "SELECT threshold, dir, count(*) AS edges FROM aff JOIN thr ON threshold <= affinity GROUP BY ALL",
    "q_components": _B + "SELECT threshold, dir, leaf_no, label FROM part",
    "q_shape_score": _B + "SELECT threshold, dir, score FROM score",
    "q_clusters": _B + "SELECT dir, label, leaf_no, threshold FROM clu",
    "q_cluster_affinity": _B + "SELECT dir, label, size, round(coalesce(s, 0) / (size * (size - 1) / 2), 6) AS average FROM (SELECT dir, label, threshold, count(*) AS size FROM clu GROUP BY ALL) LEFT JOIN insum USING (threshold, dir, label)",
    "q_purpose": _B + r""", mc AS (SELECT DISTINCT clu.dir, label, leaf_no, regexp_replace(c, '^\s+|\s+\z', '', 'g') AS c FROM (SELECT leaf_no, unnest(covers) AS c FROM ent) JOIN clu USING (leaf_no) WHERE c IS NOT NULL),
rk AS (SELECT dir, label, c, row_number() OVER (PARTITION BY dir, label ORDER BY count(*) DESC, c) AS r FROM mc WHERE c <> '' GROUP BY dir, label, c),
tp AS (SELECT dir, label, string_agg(c, '; ' ORDER BY r) AS covers FROM rk WHERE r <= 4 GROUP BY ALL)
SELECT dir, label, coalesce(covers, focus) AS purpose FROM (SELECT clu.dir, label, arg_min(coalesce(focus, ''), id) AS focus FROM clu JOIN ent USING (leaf_no) GROUP BY ALL) LEFT JOIN tp USING (dir, label)""",
    "q_slug": _B + r""", tw AS (SELECT dir, label, term, round(sum(w), 6) AS w FROM wt JOIN clu USING (dir, leaf_no) WHERE regexp_full_match(term, '[a-z][a-z0-9]*') GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY dir, label ORDER BY w DESC, term) AS r FROM tw),
pr AS (SELECT a.dir, a.label, arg_min(a.term || '-' || b.term, a.r * 100 + b.r) AS slug FROM tr a JOIN tr b ON a.dir = b.dir AND a.label = b.label AND a.r < b.r AND b.r <= 16 WHERE length(a.term) + length(b.term) < 64 GROUP BY ALL)
SELECT DISTINCT dir, label, slug FROM clu JOIN pr USING (dir, label)""",
}


def queries() -> dict:
    def given(s, d):
        lv = leaves(s, d)
        return lv, affinity(lv, bound_vectors(lv, table(s, d, "embeddings")))

    def both(s, d):
        lv, aff = given(s, d)
        aff = cut(aff)
        return lv, aff, clusters(lv, aff)

    def dedup(s, d):
        lv, aff, cl = both(s, d)
        low = cut(partitions(lv, aff)).where(F.col("threshold") == 0.30)
        return same_sets(cl, low.select("label", "leaf_no"))

    return {
        "q_threshold_scan": lambda s, d: threshold_edges(given(s, d)[1]).groupBy("threshold", "dir").agg(F.count("*").alias("edges")),
        "q_components": lambda s, d: partitions(*given(s, d)),
        "q_shape_score": lambda s, d: (lambda lv, aff: shape_scores(cut(partitions(lv, aff)), aff))(*given(s, d)),
        "q_clusters": lambda s, d: both(s, d)[2],
        "q_cluster_affinity": lambda s, d: (lambda lv, aff, cl: cluster_affinity(cl, aff))(*both(s, d)),
        "q_slug": lambda s, d: (lambda lv, aff, cl: slugs(lv, cl))(*both(s, d)),
        "q_purpose": lambda s, d: (lambda lv, aff, cl: purposes(lv, cl))(*both(s, d)),
        "q_detect_clusters": lambda s, d: (lambda lv, aff: detect(lv, cut(aff)))(*given(s, d)),
        "q_kmeans": lambda s, d: coarse_clusters(leaves(s, d)),
        "q_cluster_dedup": dedup,
    }
