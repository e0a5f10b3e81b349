"""The similarity ladder: TF-IDF within a directory, vectors, set overlap, and how they decide.

Pairs are made by an inverted index: only siblings that share a term meet. Siblings without a
common term have similarity 0, are ``different`` and don't come out. The affinity has other grounds
than terms, so it is there for all siblings of a directory of at most ``SMALL`` leaves, the
directories whose pairs are clustered; larger ones are not compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from thicket.functions.text import content_hash, jaccard, pair_key
from thicket.functions.vectors import stand_in_vectors
from thicket.plans.scale import cut
from thicket.sources.entries import LEAVES_SQL

#: Tier 0: same from, different up to. Tier 1 likewise. The middle band of tier 1 is split here.
SAME0, DIFFERENT0, SAME1, DIFFERENT1, MIDDLE = 0.85, 0.30, 0.80, 0.45, 0.625
#: Weights of tier 0, tier 1, tags and keywords in the affinity.
WEIGHTS = (0.25, 0.40, 0.20, 0.15)
#: Leaves of a directory up to which all its pairs have an affinity.
SMALL = 50


def term_counts(leaves: DataFrame) -> DataFrame:
    """dir, leaf_no, term, tf."""
    return leaves.select("dir", "leaf_no", F.explode("tokens").alias("term")).groupBy("dir", "leaf_no", "term").agg(F.count("*").alias("tf"))


def inverse_frequency(leaves: DataFrame, tf: DataFrame | None = None) -> DataFrame:
    """dir, term, df, idf; every entry of the directory counts, also one without terms."""
    tf = term_counts(leaves) if tf is None else tf
    n = leaves.groupBy("dir").agg(F.count("*").alias("n"))
    df = tf.groupBy("dir", "term").agg(F.count("*").alias("df"))
    return df.join(n, "dir").select("dir", "term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(leaves: DataFrame) -> DataFrame:
    """dir, leaf_no, term, w: TF-IDF."""
    tf = term_counts(leaves)
    return tf.join(inverse_frequency(leaves, tf), ["dir", "term"]).select("dir", "leaf_no", "term", (F.col("tf") * F.col("idf")).alias("w"))


def unit_weights(w: DataFrame, key: str = "leaf_no") -> DataFrame:
    norm = w.groupBy("dir", key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, ["dir", key]).select("dir", key, "term", (F.col("w") / F.col("norm")).alias("w"))


def cosine_pairs(leaves: DataFrame) -> DataFrame:
    """dir, leaf_a, leaf_b, cosine of siblings with a common term."""
    u = unit_weights(weights(leaves))
    a = u.select("dir", "term", F.col("leaf_no").alias("leaf_a"), F.col("w").alias("wa"))
    b = u.select("dir", "term", F.col("leaf_no").alias("leaf_b"), F.col("w").alias("wb"))
    pairs = a.join(b, ["dir", "term"]).where("leaf_a < leaf_b")
    return pairs.groupBy("dir", "leaf_a", "leaf_b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("cosine"))


def band(c: Column, same: float, different: float, between: str) -> Column:
    """The verdict on a similarity; both edges belong to the outer bands."""
    return F.when(c >= same, "same").when(c <= different, "different").otherwise(between)


def tier0(leaves: DataFrame) -> DataFrame:
    """The pairs with the verdict of tier 0; texts without any character can't be compared."""
    return cosine_pairs(leaves.where("text <> ''")).withColumn("verdict", band(F.col("cosine"), SAME0, DIFFERENT0, "escalate"))


def undecidable(leaves: DataFrame) -> DataFrame:
    return leaves.where("text = ''").select("dir", "leaf_no")


def hashes(leaves: DataFrame) -> DataFrame:
    return leaves.select("leaf_no", content_hash(F.col("text")).alias("entry_hash"))


def cache_keys(leaves: DataFrame) -> DataFrame:
    """leaf_a, leaf_b, cache_key of the escalated pairs."""
    h = hashes(leaves)
    a, b = h.select(F.col("leaf_no").alias("leaf_a"), F.col("entry_hash").alias("ha")), h.select(F.col("leaf_no").alias("leaf_b"), F.col("entry_hash").alias("hb"))
    p = tier0(leaves).where("verdict = 'escalate'")
    return p.join(a, "leaf_a").join(b, "leaf_b").select("leaf_a", "leaf_b", pair_key(F.col("ha"), F.col("hb")).alias("cache_key"))


def probe_cache(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """The wanted pairs with what the cache (cache_key, decision) knows of them, and whether it does."""
    known = cache.select("cache_key", "decision").dropDuplicates(["cache_key"])
    return wanted.join(known, "cache_key", "left").withColumn("hit", F.col("decision").isNotNull())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two lists of numbers; 0 for empty, zero or unlike lengths."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def bound_vectors(leaves: DataFrame, embeddings: DataFrame) -> DataFrame:
    """leaf_no, vec: the supplied vector that stands for each leaf (its number modulo the table's size)."""
    n = embeddings.agg(F.count("*").alias("n"))
    keyed = leaves.select("leaf_no").join(F.broadcast(n)).select("leaf_no", F.pmod("leaf_no", "n").alias("vec_id"))
    return keyed.join(embeddings.select("vec_id", "embedding"), "vec_id").select("leaf_no", F.col("embedding").alias("vec"))


def tier1(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` with ``similarity`` of their vectors."""
    a, b = vectors.select(F.col("leaf_no").alias("leaf_a"), F.col("vec").alias("va")), vectors.select(F.col("leaf_no").alias("leaf_b"), F.col("vec").alias("vb"))
    return pairs.join(a, "leaf_a").join(b, "leaf_b").withColumn("similarity", F.round(vector_cosine(F.col("va"), F.col("vb")), 6)).drop("va", "vb")


def ladder(leaves: DataFrame, vectors: DataFrame, mode: str = "deterministic") -> DataFrame:
    """leaf_a, leaf_b, tier, decision of every sibling pair with a common term.

    ``deterministic`` settles the middle band of tier 1 by ``MIDDLE``; ``tiered`` leaves it
    pending for an outside judge; ``lexical`` leaves all that tier 0 can't settle to it.
    """
    t0 = tier0(leaves).select("leaf_a", "leaf_b", "verdict")
    sure = t0.where("verdict <> 'escalate'").select("leaf_a", "leaf_b", F.lit(0).alias("tier"), F.col("verdict").alias("decision"))
    open_ = t0.where("verdict = 'escalate'")
    if mode == "lexical":
        return sure.unionByName(open_.select("leaf_a", "leaf_b", F.lit(2).alias("tier"), F.lit("pending").alias("decision")))
    s = F.col("similarity")
    v = band(s, SAME1, DIFFERENT1, "middle")
    t1 = tier1(open_, vectors).withColumn("v", v)
    if mode == "deterministic":
        decided = t1.select("leaf_a", "leaf_b", F.lit(1).alias("tier"), F.when(F.col("v") != "middle", F.col("v")).when(s > MIDDLE, "same").otherwise("different").alias("decision"))
    else:
        decided = t1.select("leaf_a", "leaf_b", F.when(F.col("v") == "middle", 2).otherwise(1).alias("tier"), F.when(F.col("v") == "middle", "pending").otherwise(F.col("v")).alias("decision"))
    return sure.unionByName(decided)


def affinity(leaves: DataFrame, vectors: DataFrame) -> DataFrame:
    """dir, leaf_a, leaf_b, affinity: the weighted sum of the four likenesses of siblings."""
    side = lambda s: leaves.select(F.col("leaf_no").alias(f"leaf_{s}"), F.col("tags").alias(f"t{s}"), F.transform(F.coalesce(F.col("activation.keyword_matches"), F.array().cast("array<string>")), F.lower).alias(f"k{s}"))
    n = leaves.groupBy("dir").agg(F.count("*").alias("_n")).where(F.col("_n") <= SMALL).select("dir")
    one = lambda s: leaves.select("dir", F.col("leaf_no").alias(f"leaf_{s}"))
    siblings = one("a").join(n, "dir", "left_semi").join(one("b"), "dir").where("leaf_a < leaf_b")
    met = siblings.join(cosine_pairs(leaves), ["dir", "leaf_a", "leaf_b"], "full").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    p = tier1(met, vectors).join(side("a"), "leaf_a").join(side("b"), "leaf_b")
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    w0, w1, wt, wk = WEIGHTS
    total = w0 * F.col("cosine") + w1 * clip(F.col("similarity")) + wt * jaccard(F.col("ta"), F.col("tb")) + wk * jaccard(F.col("ka"), F.col("kb"))
    return p.select("dir", "leaf_a", "leaf_b", F.round(total, 9).alias("affinity"))


def small_affinity(leaves: DataFrame, vectors: DataFrame) -> DataFrame:
    """``affinity`` of directories of at most ``SMALL`` leaves, without those that are larger.

    All that is known of a leaf is with its siblings before they are paired, so only leaves are shuffled and no pairs.
    """
    few = leaves.groupBy("dir").agg(F.count("*").alias("_n")).where(F.col("_n") <= SMALL).select("dir")
    small = leaves.join(few, "dir", "left_semi")
    terms = unit_weights(weights(small)).groupBy("leaf_no").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "w")))).alias("w"))
    none = F.array().cast("array<string>")
    keys = F.transform(F.coalesce(F.col("activation.keyword_matches"), none), F.lower)
    values = lambda c: F.array_distinct(F.array_compact(F.coalesce(c, none)))
    vec = vectors.select("leaf_no", "vec", F.sqrt(dot(F.col("vec"), F.col("vec"))).alias("norm"))
    one = small.select("dir", "leaf_no", values("tags").alias("t"), values(keys).alias("k")).join(terms, "leaf_no", "left").join(vec, "leaf_no")
    one = cut(one.select("dir", F.col("leaf_no"), F.struct("t", "k", F.map_keys("w").alias("terms"), F.map_values("w").alias("ws"), "w", "vec", "norm").alias("x")))
    a, b = (one.select("dir", F.col("leaf_no").alias(f"leaf_{s}"), F.col("x").alias(s)) for s in "ab")
    met = a.join(b, "dir").where("leaf_a < leaf_b")
    cosine = F.aggregate(F.arrays_zip("a.terms", "a.ws"), F.lit(0.0), lambda s, x: s + x["ws"] * F.coalesce(F.try_element_at("b.w", x["terms"]), F.lit(0.0)))
    cosine = F.coalesce(F.round(cosine, 6), F.lit(0.0))
    n = F.col("a.norm") * F.col("b.norm")
    similarity = F.when((F.size("a.vec") != F.size("b.vec")) | (F.size("a.vec") == 0) | (n == 0), 0.0).otherwise(dot(F.col("a.vec"), F.col("b.vec")) / n)

    def like(c: str) -> Column:
        both, every = F.size(F.array_intersect(f"a.{c}", f"b.{c}")), F.size(f"a.{c}") + F.size(f"b.{c}")
        return F.when(every == 0, 0.0).otherwise(both / (every - both))

    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    w0, w1, wt, wk = WEIGHTS
    total = w0 * cosine + w1 * clip(F.round(similarity, 6)) + wt * like("t") + wk * like("k")
    return met.select("dir", "leaf_a", "leaf_b", F.round(total, 9).alias("affinity"))


# ---------------------------------------------------------------- DuckDB twins

BASE = f"""WITH {LEAVES_SQL},
tf AS (SELECT dir, leaf_no, term, count(*) AS tf FROM (SELECT dir, leaf_no, unnest(tokens) AS term FROM tok) GROUP BY ALL),
idf AS (SELECT dir, term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT dir, term, count(*) AS df FROM tf GROUP BY ALL)
  JOIN (SELECT dir, count(*) AS n FROM tok GROUP BY ALL) USING (dir)),
wt AS (SELECT dir, leaf_no, term, tf * idf AS w FROM tf JOIN idf USING (dir, term)),
unit AS (SELECT dir, leaf_no, term, w / norm AS w FROM wt JOIN (SELECT dir, leaf_no, sqrt(sum(w * w)) AS norm FROM wt GROUP BY ALL) USING (dir, leaf_no)),
pairs AS MATERIALIZED (SELECT dir, a.leaf_no AS leaf_a, b.leaf_no AS leaf_b, round(sum(a.w * b.w), 6) AS cosine
  FROM unit a JOIN unit b USING (dir, term) WHERE a.leaf_no < b.leaf_no GROUP BY ALL),
t0 AS (SELECT *, CASE WHEN cosine >= {SAME0} THEN 'same' WHEN cosine <= {DIFFERENT0} THEN 'different' ELSE 'escalate' END AS verdict FROM pairs),
hash AS (SELECT leaf_no, 'sha256:' || sha256(text) AS entry_hash FROM tok),
nvec AS MATERIALIZED (SELECT count(*) AS n FROM embeddings),
keyed AS MATERIALIZED (SELECT leaf_no, leaf_no % n AS vec_id FROM tok, nvec),
vraw AS MATERIALIZED (SELECT leaf_no, embedding::DOUBLE[] AS vec FROM keyed JOIN embeddings USING (vec_id)),
vec AS MATERIALIZED (SELECT leaf_no, vec, sqrt(list_dot_product(vec, vec)) AS norm FROM vraw),
met AS MATERIALIZED (SELECT p.dir, p.leaf_a, p.leaf_b, p.cosine, p.verdict FROM t0 p),
t1 AS (SELECT p.*, round(list_dot_product(a.vec, b.vec) / (a.norm * b.norm), 6) AS similarity
  FROM met p JOIN vec a ON a.leaf_no = leaf_a JOIN vec b ON b.leaf_no = leaf_b),
sib AS MATERIALIZED (SELECT a.dir, a.leaf_no AS leaf_a, b.leaf_no AS leaf_b FROM tok a JOIN tok b ON a.dir = b.dir AND a.leaf_no < b.leaf_no
  WHERE a.dir IN (SELECT dir FROM tok GROUP BY dir HAVING count(*) <= {SMALL})),
every_pair AS MATERIALIZED (SELECT dir, leaf_a, leaf_b, coalesce(cosine, 0.0) AS cosine FROM sib FULL JOIN pairs USING (dir, leaf_a, leaf_b)),
t1a AS (SELECT p.*, round(list_dot_product(a.vec, b.vec) / (a.norm * b.norm), 6) AS similarity
  FROM every_pair p JOIN vec a ON a.leaf_no = leaf_a JOIN vec b ON b.leaf_no = leaf_b),
kw AS (SELECT leaf_no, list_transform(coalesce(activation.keyword_matches, []), lambda x: lower(x)) AS k, coalesce(tags, []) AS t FROM ent)"""
_BOTH = lambda a, b: (
    f"(len(list_distinct({a})) + len(list_distinct({b})) - len(list_intersect(list_distinct({a}), list_distinct({b}))))"
)
_JACCARD = lambda a, b: f"CASE WHEN {_BOTH(a, b)} = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / {_BOTH(a, b)} END"
BASE += f""",
aff AS (SELECT p.dir, leaf_a, leaf_b, round({WEIGHTS[0]} * cosine + {WEIGHTS[1]} * greatest(0, least(1, similarity))
  + {WEIGHTS[2]} * ({_JACCARD('ka.t', 'kb.t')}) + {WEIGHTS[3]} * ({_JACCARD('ka.k', 'kb.k')}), 9) AS affinity
  FROM t1a p JOIN kw ka ON ka.leaf_no = leaf_a JOIN kw kb ON kb.leaf_no = leaf_b)
"""
SQL = {
    "q_tokens": BASE + "SELECT leaf_no, unnest(tokens) AS term FROM tok",
    "q_tf": BASE + "SELECT dir, leaf_no, term, tf FROM tf",
    "q_idf": BASE + "SELECT dir, term, df, round(idf, 6) AS idf FROM idf",
    "q_tfidf": BASE + "SELECT dir, leaf_no, term, round(w, 6) AS w FROM wt",
    "q_cosine_pairs": BASE + "SELECT dir, leaf_a, leaf_b, cosine FROM pairs",
    "q_tier0_bands": BASE + "SELECT dir, leaf_a, leaf_b, cosine, verdict FROM t0",
    "q_undecidable": BASE + "SELECT dir, leaf_no FROM tok WHERE text = ''",
    "q_entry_hash": BASE + "SELECT leaf_no, entry_hash FROM hash",
    "q_pair_cache_key": BASE + """SELECT leaf_a, leaf_b, substr(sha256(least(a.entry_hash, b.entry_hash) || chr(0) || greatest(a.entry_hash, b.entry_hash)), 1, 32) AS cache_key
  FROM t0 JOIN hash a ON a.leaf_no = leaf_a JOIN hash b ON b.leaf_no = leaf_b WHERE verdict = 'escalate'""",
    "q_pair_cache_probe": BASE + """, key AS (SELECT leaf_a, leaf_b, substr(sha256(least(a.entry_hash, b.entry_hash) || chr(0) || greatest(a.entry_hash, b.entry_hash)), 1, 32) AS cache_key
  FROM t0 JOIN hash a ON a.leaf_no = leaf_a JOIN hash b ON b.leaf_no = leaf_b WHERE verdict = 'escalate'),
cache AS (SELECT cache_key, min(CASE WHEN similarity > 0.625 THEN 'same' ELSE 'different' END) AS decision FROM key JOIN t1 USING (leaf_a, leaf_b) WHERE cache_key < '8' GROUP BY cache_key)
SELECT leaf_a, leaf_b, cache_key, decision, decision IS NOT NULL AS hit FROM key LEFT JOIN cache USING (cache_key)""",
    "q_embed_cosine": BASE + f"SELECT leaf_a, leaf_b, similarity, CASE WHEN similarity >= {SAME1} THEN 'same' WHEN similarity <= {DIFFERENT1} THEN 'different' ELSE 'middle' END AS verdict FROM t1",
    "q_det_midband": BASE + f"SELECT leaf_a, leaf_b, similarity, CASE WHEN similarity > {MIDDLE} THEN 'same' ELSE 'different' END AS decision FROM t1 WHERE similarity < {SAME1} AND similarity > {DIFFERENT1}",
    "q_ladder": BASE + f"""SELECT leaf_a, leaf_b, CASE WHEN verdict = 'escalate' THEN 1 ELSE 0 END AS tier, CASE WHEN verdict <> 'escalate' THEN verdict
  WHEN similarity >= {SAME1} THEN 'same' WHEN similarity <= {DIFFERENT1} THEN 'different' WHEN similarity > {MIDDLE} THEN 'same' ELSE 'different' END AS decision FROM t1""",
    "q_ladder_tiered": BASE + f"""SELECT leaf_a, leaf_b, CASE WHEN verdict <> 'escalate' THEN 0 WHEN similarity < {SAME1} AND similarity > {DIFFERENT1} THEN 2 ELSE 1 END AS tier,
  CASE WHEN verdict <> 'escalate' THEN verdict WHEN similarity >= {SAME1} THEN 'same' WHEN similarity <= {DIFFERENT1} THEN 'different' ELSE 'pending' END AS decision FROM t1""",
    "q_affinity": BASE + "SELECT dir, leaf_a, leaf_b, affinity FROM aff",
    "q_tag_jaccard": BASE + f"SELECT leaf_a, leaf_b, round({_JACCARD('ka.t', 'kb.t')}, 6) AS jaccard FROM pairs JOIN kw ka ON ka.leaf_no = leaf_a JOIN kw kb ON kb.leaf_no = leaf_b",
}


def queries() -> dict:
    """The queries over the tables of a folder."""
    from thicket.sources.entries import leaves
    from thicket.sources.tables import table

    of = lambda fn: lambda s, d: fn(leaves(s, d))
    vec = lambda fn: lambda s, d: fn(lv := leaves(s, d), bound_vectors(lv, table(s, d, "embeddings")))

    def probe(lv, vectors):
        keys = cache_keys(lv)
        known = tier1(keys, vectors).where("cache_key < '8'").withColumn("d", F.when(F.col("similarity") > MIDDLE, "same").otherwise("different"))
        return probe_cache(keys, known.groupBy("cache_key").agg(F.min("d").alias("decision")))

    def tags(lv):
        t = lambda s: lv.select(F.col("leaf_no").alias(f"leaf_{s}"), F.col("tags").alias(f"t{s}"))
        p = cosine_pairs(lv).join(t("a"), "leaf_a").join(t("b"), "leaf_b")
        return p.select("leaf_a", "leaf_b", F.round(jaccard(F.col("ta"), F.col("tb")), 6).alias("jaccard"))

    similarity = lambda lv, v: tier1(cosine_pairs(lv), v).select("leaf_a", "leaf_b", "similarity")
    return {
        "q_tokens": of(lambda lv: lv.select("leaf_no", F.explode("tokens").alias("term"))),
        "q_tf": of(term_counts),
        "q_idf": of(lambda lv: inverse_frequency(lv).withColumn("idf", F.round("idf", 6))),
        "q_tfidf": of(lambda lv: weights(lv).withColumn("w", F.round("w", 6))),
        "q_cosine_pairs": of(cosine_pairs),
        "q_tier0_bands": of(tier0),
        "q_undecidable": of(undecidable),
        "q_entry_hash": of(hashes),
        "q_pair_cache_key": of(cache_keys),
        "q_pair_cache_probe": vec(probe),
        "q_embed_cosine": vec(lambda lv, v: similarity(lv, v).withColumn("verdict", band(F.col("similarity"), SAME1, DIFFERENT1, "middle"))),
        "q_det_midband": vec(lambda lv, v: similarity(lv, v).where((F.col("similarity") < SAME1) & (F.col("similarity") > DIFFERENT1)).withColumn("decision", F.when(F.col("similarity") > MIDDLE, "same").otherwise("different"))),
        "q_ladder": vec(ladder),
        "q_ladder_tiered": vec(lambda lv, v: ladder(lv, v, "tiered")),
        "q_affinity": vec(affinity),
        "q_tag_jaccard": of(tags),
        "q_stand_in_vectors": of(lambda lv: lv.select("leaf_no", stand_in_vectors(F.col("text"), F.col("tokens")).alias("vec"))),
    }
