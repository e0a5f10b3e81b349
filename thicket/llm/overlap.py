"""All similar pairs between set-valued records (problem 1).

Method: a forest of sorted minhash sketches. In each of many independent trees a set has a
signature of minhashes; sets in lexicographic order of it that share a prefix of ``SHALLOW``
hashes are neighbours. A neighbourhood of more than ``CROWD`` sets is deepened, one hash at a
time. All pairs of a neighbourhood are compared exactly within its task and only pairs over the
threshold leave it. A pair at the threshold ``s`` shares a prefix of ``d`` with chance ``s**d``,
so each set's chance to have missed a partner is the product of ``1 - s**d`` over its trees; sets
above ``1 - RECALL`` (those of crowded neighbourhoods) go on to another round of trees, and what
is left after ``ROUNDS`` is compared by an exact join on the rarest values (prefix filter).

Equal sets are collapsed first, so a group of copies is one set here, of any size.

Similarity is common values over the values in either set (Jaccard); exactly the threshold counts.
Defined results. Null values, and values with an empty compared form, don't count; sets of fewer
than ``least`` values take no part; repeated values count once. Records without a key are no
records. Empty tables give no rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from thicket.functions.forms import value_form
from thicket.plans.scale import cut, fan_out
from thicket.sources.tables import counting_rows

THRESHOLD, LEAST = 0.6, 4
#: Depth of prefixes to begin with, the greatest depth, and the sets from which a neighbourhood is deepened.
SHALLOW, DEEP, CROWD = 3, 7, 1024
RECALL, ROUNDS = 0.9995, 3
#: Trees a round beyond what the recall needs, so that some crowded trees cost a set no second round.
SPARE = 1.25
#: Copies of a set that are expanded into pairs at once.
COPIES = 1_000
#: Pairs that are compared at once.
BLOCK = 250_000


def trees_for(threshold: float, recall: float = RECALL, depth: int = SHALLOW) -> int:
    """Trees of prefixes of ``depth`` that find a pair at the threshold with the wanted chance."""
    if threshold >= 1:
        return 1
    return math.ceil(SPARE * math.log(1 - recall) / math.log(1 - threshold**depth))


# ---------------------------------------------------------------- numpy kernels


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of an Arrow list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy()


def prefixes(offsets: np.ndarray, values: np.ndarray, first: int, trees: int, depth: int) -> np.ndarray:
    """Prefix ids [set, tree] of non-empty sets: equal where the first ``depth`` hashes are equal."""
    x, n = values.view(np.uint64), len(offsets) - 1
    out = np.empty((n, trees), np.uint64)
    with np.errstate(over="ignore"):
        for t in range(trees):
            odd = np.random.default_rng(7 + first + t).integers(1, 2**63, DEEP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            so_far = np.full(n, first + t + 1, np.uint64)
            for d in range(depth):
                h = x * odd[d]
                h ^= h >> np.uint64(31)
                h *= np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                so_far = (so_far ^ np.minimum.reduceat(h, offsets[:-1])) * np.uint64(0xD6E8FEB86659FD93)
                so_far ^= so_far >> np.uint64(32)
            out[:, t] = so_far
    return out.view(np.int64)


def common_counts(offsets: np.ndarray, values: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common values of the sets i and j, pair by pair; values are sorted within each set."""
    u, rank = np.unique(values, return_inverse=True)
    size = np.diff(offsets)
    hay = np.repeat(np.arange(len(size)), size) * len(u) + rank
    out = np.zeros(len(i), np.int64)
    for at in range(0, len(i), BLOCK):
        a, b = i[at : at + BLOCK], j[at : at + BLOCK]
        swap = size[a] > size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        n = size[a]
        pair = np.repeat(np.arange(len(a)), n)
        pos = np.repeat(offsets[a] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        want = b[pair] * len(u) + rank[pos]
        found = np.minimum(np.searchsorted(hay, want), len(hay) - 1)
        out[at : at + BLOCK] = np.bincount(pair, hay[found] == want, len(a))
    return out


def similar(offsets, values, i, j, threshold: Fraction) -> np.ndarray:
    """Whether each pair's common values reach the threshold of the values in either set."""
    size = np.diff(offsets)
    possible = np.minimum(size[i], size[j]) * threshold.denominator >= np.maximum(size[i], size[j]) * threshold.numerator
    at = np.flatnonzero(possible)
    common = common_counts(offsets, values, i[at], j[at])
    either = size[i[at]] + size[j[at]] - common
    out = np.zeros(len(i), bool)
    out[at] = common * threshold.denominator >= either * threshold.numerator
    return out


def _neighbours(threshold: Fraction):
    """Rows sorted by neighbourhood g -> pairs a < b over the threshold, at least one of them active."""

    def pairs(table: pa.Table):
        g, rep, active = (table.column(n).to_numpy() for n in ("g", "rep", "active"))
        offsets, values = _lists(table.column("tokens"))
        step, left, right, n = 1, [], [], 0
        at = np.arange(len(g))
        while True:
            at = at[at + step < len(g)]
            at = at[g[at] == g[at + step]]
            keep = at[active[at] | active[at + step]]
            left.append(keep)
            right.append(keep + step)
            n += len(keep)
            step += 1
            if n and (n >= BLOCK or not len(at)):
                i, j = np.concatenate(left), np.concatenate(right)
                over = similar(offsets, values, i, j, threshold)
                a, b = rep[i[over]], rep[j[over]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                left, right, n = [], [], 0
            if not len(at):
                return

    def run(batches):
        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            table = pa.Table.from_batches(held)
            if table.num_rows < 20_000:
                continue
            g = table.column("g").to_numpy()
            cut_at = int(np.searchsorted(g, g[-1]))  # the last neighbourhood may go on
            if cut_at:
                yield from pairs(table.slice(0, cut_at))
                held = table.slice(cut_at).combine_chunks().to_batches()
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


# ---------------------------------------------------------------- plans


def distinct_sets(rows: DataFrame, key: str, values: list[str], least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Distinct sets (rep, tokens: sorted hashes) and the membership (record, rep)."""
    every = F.concat(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in values))
    forms = F.array_distinct(F.filter(F.transform(every, value_form), lambda x: x != ""))
    sets = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("record"), forms.alias("f")).where(F.size("f") >= least)
    sets = sets.select("record", F.array_sort(F.transform("f", lambda x: F.xxhash64(x))).alias("tokens"))
    reps = sets.groupBy("tokens").agg(F.min("record").alias("rep")).select("rep", "tokens")
    reps = cut(reps)
    return reps, cut(sets.join(reps, "tokens").select("record", "rep"))


def _signed(sets: DataFrame, first: int, trees: int, depth: int) -> DataFrame:
    """rep, tree, g: the prefix id of every set in every tree."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                offsets, values = _lists(part.column(part.schema.get_field_index("tokens")))
                g = prefixes(offsets, values, first, trees, depth)
                rep = np.repeat(part.column(part.schema.get_field_index("rep")).to_numpy(), trees)
                tree = np.tile(np.arange(trees, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(tree), pa.array(g.reshape(-1))], names=["rep", "tree", "g"])

    return fan_out(sets.select("rep", "tokens")).mapInArrow(run, "rep long, tree int, g long")


def _round(sets: DataFrame, active: DataFrame | None, first: int, trees: int, threshold: Fraction) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of one round of trees with an active set (none: all are), and rep, miss.

    ``miss`` is the logarithm of a set's chance to have missed a partner; only sets of crowded
    neighbourhoods have a row, as the trees of a round suffice for all others.
    """
    s = float(threshold)
    rows, settled, deeper = _signed(sets, first, trees, SHALLOW), None, None
    for depth in range(SHALLOW, DEEP + 1):
        n = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
        crowded = cut(n.where(F.col("n") > CROWD).select("g"))
        part = rows.join(n.where(F.col("n") <= CROWD).select("g"), "g", "left_semi").select("rep", "g")
        settled = part if settled is None else settled.unionByName(part)
        if crowded.isEmpty():
            break
        # neighbourhoods of more than CROWD sets go one hash deeper in their tree
        open_ = cut(rows.join(crowded, "g", "left_semi").select("rep", "tree"))
        # what one more hash costs: from the chance at this depth to that at the next; beyond DEEP a tree finds nothing
        now, after = (math.log(1 - s**d) if s < 1 else -50.0 for d in (depth, depth + 1))
        loss = open_.select("rep", F.lit((after if depth < DEEP else 0.0) - now).alias("loss"))
        deeper = loss if deeper is None else deeper.unionByName(loss)
        if depth < DEEP:
            again = sets.join(open_.select("rep").distinct(), "rep", "left_semi")
            rows = _signed(again, first, trees, depth + 1).join(open_, ["rep", "tree"], "left_semi")
    found = settled.join(sets, "rep")
    found = found.withColumn("active", F.lit(True)) if active is None else found.join(active.withColumn("active", F.lit(True)), "rep", "left").na.fill(False, ["active"])
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.select("g", "rep", "active", "tokens").repartition(parts, "g").sortWithinPartitions("g")
    pairs = found.mapInArrow(_neighbours(threshold), "a long, b long").distinct()
    if deeper is None:
        return pairs, None
    full = trees * (math.log(1 - s**SHALLOW) if s < 1 else -50.0)
    return pairs, deeper.groupBy("rep").agg((F.sum("loss") + full).alias("miss"))


def _exact(sets: DataFrame, active: DataFrame, threshold: Fraction) -> DataFrame:
    """All pairs over the threshold with an active set, by a join on the rarest values of each set."""
    flat = sets.select("rep", F.size("tokens").alias("size"), F.explode("tokens").alias("t"))
    df = flat.groupBy("t").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("df", "t"))
    need = F.ceil(F.col("size") * threshold.numerator / F.lit(threshold.denominator))
    prefix = flat.join(df, "t").withColumn("r", rank).where(F.col("r") <= F.col("size") - need + 1).select("rep", "t")
    mine = prefix.join(active, "rep", "left_semi").select(F.col("rep").alias("x"), "t")
    both = mine.join(prefix, "t").where("x <> rep").select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()
    a, b = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    over = common * threshold.denominator >= (F.size("ta") + F.size("tb") - common) * threshold.numerator
    return both.join(a, "a").join(b, "b").where(over).select("a", "b")


def similar_sets(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """a, b: all pairs of distinct sets (rep, tokens) whose similarity reaches the threshold."""
    exact = Fraction(str(threshold))
    trees = trees_for(threshold, recall)
    active, before, out = None, None, None
    for r in range(ROUNDS):
        pairs, miss = _round(sets, active, r * trees, trees, exact)
        out = pairs if out is None else out.unionByName(pairs)
        if miss is None:
            break
        if before is not None:  # the chances of the rounds multiply
            miss = before.join(miss, "rep").select("rep", (F.col("before") + F.col("miss")).alias("miss"))
        before = cut(miss.where(F.col("miss") > math.log(1 - recall)).select("rep", F.col("miss").alias("before")))
        if before.isEmpty():
            break
        active = before.select("rep")
    else:
        out = out.unionByName(_exact(sets, active, exact))
    return out.distinct() if r else out


def _expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of records: of different sets over the threshold, and of equal sets."""
    # the copies of a set are in parts of bounded size, each a key of its own, so that a large group is many tasks
    size = members.groupBy("rep").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("parts"))
    parted = members.join(size, "rep").select("rep", "record", "parts", F.pmod(F.xxhash64("record"), F.col("parts")).cast("int").alias("part"))
    parts = lambda rep: size.select(F.col("rep").alias(rep), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{rep}"))
    side = lambda rep, as_: parted.select(F.col("rep").alias(rep), F.col("part").alias(f"part_{rep}"), F.col("record").alias(as_))
    far = pairs.join(parts("a"), "a").join(parts("b"), "b").join(side("a", "x"), ["a", "part_a"]).join(side("b", "y"), ["b", "part_b"])
    whole = parted.select(F.col("rep").alias("a"), F.col("record").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part_b"))
    same = whole.join(parted.select(F.col("rep").alias("a"), F.col("part").alias("part_b"), F.col("record").alias("y")), ["a", "part_b"]).where("x < y")
    return far.select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b")).unionByName(same.select(F.col("x").alias("record_a"), F.col("y").alias("record_b")))


def similar_records(rows: DataFrame, key: str, values: list[str], threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """record_a, record_b: every pair of records of one table over the threshold, smaller key first."""
    sets, members = distinct_sets(rows, key, values, least)
    return _expand(similar_sets(sets, threshold), members)


def similar_between(left: DataFrame, right: DataFrame, key: str, values: list[str], threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """left_key, right_key: every pair of a record of ``left`` and one of ``right`` over the threshold."""
    one = lambda df, side: df.where(F.col(key).isNotNull()).select((F.col(key).cast("long") * 2 + side).alias("_k"), *values)
    sets, members = distinct_sets(one(left, 0).unionByName(one(right, 1)), "_k", values, least)
    pairs = similar_sets(sets, threshold)
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(sets.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    a = members.where("record % 2 = 0").select(F.col("rep").alias("a"), F.shiftright("record", 1).alias("left_key"))
    b = members.where("record % 2 <> 0").select(F.col("rep").alias("b"), F.shiftright("record", 1).alias("right_key"))
    return pairs.join(a, "a").join(b, "b").select("left_key", "right_key")


def _leaves(leaf: DataFrame) -> DataFrame:
    return counting_rows(leaf, "leaf_no", "covers", "tags", "updated_at", "loaded_at")


def leaf_pairs(leaf: DataFrame) -> DataFrame:
    """leaf_no_a, leaf_no_b: leaves whose pooled covers and tags overlap by 0.6 or more."""
    return similar_records(_leaves(leaf), "leaf_no", ["covers", "tags"]).select(F.col("record_a").alias("leaf_no_a"), F.col("record_b").alias("leaf_no_b"))


def leaf_links(leaf: DataFrame) -> DataFrame:
    """leaf_no, class, copies, links: each leaf with the class of equal sets it is in and the leaves like it.

    Copies are not expanded into pairs: ``links`` sums the sizes of the classes linked to.
    """
    sets, members = distinct_sets(_leaves(leaf), "leaf_no", ["covers", "tags"])
    pairs = similar_sets(sets)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = members.groupBy("rep").agg(F.count("*").alias("copies"))
    linked = both.join(size, both["b"] == size["rep"]).groupBy("a").agg(F.sum("copies").alias("linked"))
    classes = size.join(linked, size["rep"] == linked["a"], "left").select("rep", "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return members.join(classes, "rep").select(F.col("record").alias("leaf_no"), F.col("rep").alias("class"), "copies", "links")


_SETS_SQL = """WITH cur AS (SELECT * FROM leaf WHERE leaf_no IS NOT NULL QUALIFY row_number() OVER
  (PARTITION BY leaf_no ORDER BY updated_at DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1),
raw AS (SELECT leaf_no, unnest(covers) AS v FROM cur UNION ALL SELECT leaf_no, unnest(tags) FROM cur),
el AS (SELECT DISTINCT leaf_no, trim(regexp_replace(lower(v), '[ \\t\\n_-]+', ' ', 'g')) AS value FROM raw),
val AS (SELECT * FROM el WHERE value <> ''),
size AS (SELECT leaf_no, count(*) AS n FROM val GROUP BY leaf_no HAVING count(*) >= 4),
common AS (SELECT a.leaf_no AS leaf_no_a, b.leaf_no AS leaf_no_b, count(*) AS c FROM val a JOIN val b
  ON a.value = b.value AND a.leaf_no < b.leaf_no GROUP BY ALL),
pairs AS (SELECT leaf_no_a, leaf_no_b FROM common JOIN size x ON x.leaf_no = leaf_no_a JOIN size y ON y.leaf_no = leaf_no_b
  WHERE 5 * c >= 3 * (x.n + y.n - c))
"""
PAIRS_SQL = _SETS_SQL + "SELECT leaf_no_a, leaf_no_b FROM pairs"
