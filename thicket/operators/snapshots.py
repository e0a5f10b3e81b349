"""What changed between full snapshots (problem 4).

Method: compact rows of key hash and value hash, one per key and snapshot, go to hash buckets;
a task sorts its bucket's arrays in numpy and takes set differences with ``searchsorted``. Full
keys are fetched only for the keys that differ.

Keys are hashed to 128 bits, values to 64. The rows of one key and snapshot are reduced to the
latest scan before any shuffle. Which snapshots a wiki was delivered in travels as a column, so
buckets need no lookup.

Defined results. Rows without path, wiki or snapshot are no file. A null hash is unknown: such
a file is there, but never ``changed``. A null ``scanned_at`` is older than any other. A group's
first snapshot and snapshots it is missing from yield nothing. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thicket.functions.forms import HASH_SQL, PATH_SQL, hash_form, path_form
from thicket.plans.scale import SALTS, cut

CHANGES = ("added", "removed", "changed")
#: Compact rows (about 50 bytes each) that one bucket is planned for.
BUCKET_ROWS = 4_000_000


def _absent(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``want`` is missing from the sorted ``keys``, and its place."""
    at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
    return (keys[at] != want) if len(keys) else np.ones(len(want), bool), at


def _diff_bucket(batches):
    """Differences of one bucket. Rows: hi, lo, snapshot, earlier, later, value."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    c = {n: table.column(n).to_numpy() for n in ("hi", "lo", "snapshot", "earlier", "later", "value")}
    order = np.lexsort((c["snapshot"], c["lo"], c["hi"]))
    c = {n: v[order] for n, v in c.items()}
    new = np.ones(len(order), bool)
    new[1:] = (c["hi"][1:] != c["hi"][:-1]) | (c["lo"][1:] != c["lo"][:-1])
    rank = np.cumsum(new) - 1
    slots, at = np.unique(np.concatenate([c["snapshot"], c["earlier"], c["later"]]), return_inverse=True)
    n = len(order)
    mine, before, after = rank * len(slots) + at[:n], rank * len(slots) + at[n : 2 * n], rank * len(slots) + at[2 * n :]
    gone_before, place = _absent(mine, before)
    gone_after, _ = _absent(mine, after)
    has_before, has_after = c["earlier"] >= 0, c["later"] >= 0
    added = has_before & gone_before
    removed = has_after & gone_after
    old, now = c["value"][place], c["value"]
    changed = has_before & ~gone_before & (old != 0) & (now != 0) & (old != now)
    for k, mask in enumerate((added, removed, changed)):
        number = c["later"] if k == 1 else c["snapshot"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c["hi"][mask]), pa.array(c["lo"][mask]), pa.array(number[mask].astype("int32")), pa.array(np.full(int(mask.sum()), k, "int32"))],
            names=["hi", "lo", "snapshot_no", "kind"],
        )


def snapshot_changes(snapshots: DataFrame, buckets: int | None = None) -> DataFrame:
    """snapshot_no, wiki_id, path, change of every file that differs from its wiki's previous delivery."""
    spark = snapshots.sparkSession
    rows = snapshots.where("snapshot_no IS NOT NULL AND wiki_id IS NOT NULL AND path IS NOT NULL").select(
        F.col("snapshot_no").cast("int").alias("snapshot"), "wiki_id", path_form(F.col("path")).alias("path"), "hash", "scanned_at"
    )
    key = [F.xxhash64("wiki_id", "path").alias("hi"), F.xxhash64(F.lit("lo"), "path", "wiki_id").alias("lo")]
    # which deliveries a wiki had: one row per wiki and snapshot, with the neighbours
    delivered = rows.groupBy("wiki_id").agg(F.array_sort(F.collect_set("snapshot")).alias("all"))
    pair = lambda x, i: F.struct(
        x.alias("snapshot"),
        F.when(i > 0, F.col("all")[i - 1]).otherwise(-1).alias("earlier"),
        F.when(i + 1 < F.size("all"), F.col("all")[i + 1]).otherwise(-1).alias("later"),
    )
    delivered = cut(delivered.select(F.xxhash64("wiki_id").alias("wiki"), F.explode(F.transform("all", pair)).alias("d")).select("wiki", "d.*"))
    # one big wiki's delivery is one key of the join below, so it is salted
    delivered = delivered.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    value = F.when(F.col("hash").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce(F.nullif(F.xxhash64(hash_form(F.col("hash"))), F.lit(0).cast("long")), F.lit(1).cast("long")))
    compact = (
        rows.select(*key, F.xxhash64("wiki_id").alias("wiki"), "snapshot", "scanned_at", value.alias("value"))
        .groupBy("hi", "lo", "wiki", "snapshot")
        .agg(F.max(F.struct("scanned_at", "value")).alias("m"))
        .select("hi", "lo", "wiki", "snapshot", F.col("m.value").alias("value"), F.pmod("hi", F.lit(SALTS)).cast("int").alias("salt"))
        .join(delivered, ["wiki", "snapshot", "salt"])
        .select("hi", "lo", "snapshot", "earlier", "later", "value")
    )
    if buckets is None:
        # a Parquet file tells its rows without being read
        rows_of = snapshots.agg(F.count("*")).collect()[0][0]
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows_of // BUCKET_ROWS))
    diff = compact.repartition(buckets, "hi", "lo").mapInArrow(_diff_bucket, "hi long, lo long, snapshot_no int, kind int")
    diff = diff.withColumn("change", F.element_at(F.array(*map(F.lit, CHANGES)), F.col("kind") + 1)).drop("kind")
    # only differing keys fetch their full values, once each
    wanted = diff.select("hi", "lo").distinct()
    names = rows.select(*key, "wiki_id", "path").join(wanted, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.first("wiki_id").alias("wiki_id"), F.first("path").alias("path"))
    return diff.join(names, ["hi", "lo"]).select("snapshot_no", "wiki_id", "path", "change")


def change_counts(snapshots: DataFrame) -> DataFrame:
    """snapshot_no, change, files: how many files each delivery added, removed or changed."""
    return snapshot_changes(snapshots).groupBy("snapshot_no", "change").agg(F.count("*").alias("files"))


_BASE_SQL = f"""WITH rows AS (SELECT snapshot_no, wiki_id, {PATH_SQL.format('path')} AS path, {HASH_SQL.format('hash')} AS hash, scanned_at
  FROM source_snapshot WHERE snapshot_no IS NOT NULL AND wiki_id IS NOT NULL AND path IS NOT NULL),
state AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY snapshot_no, wiki_id, path ORDER BY scanned_at DESC NULLS LAST, hash NULLS LAST) = 1),
given AS (SELECT *, lag(snapshot_no) OVER (PARTITION BY wiki_id ORDER BY snapshot_no) AS earlier
  FROM (SELECT DISTINCT wiki_id, snapshot_no FROM state)),
diff AS (SELECT g.snapshot_no, s.wiki_id, s.path, 'added' AS change FROM state s JOIN given g USING (wiki_id, snapshot_no)
  WHERE g.earlier IS NOT NULL AND NOT EXISTS (SELECT 1 FROM state o WHERE o.wiki_id = s.wiki_id AND o.path = s.path AND o.snapshot_no = g.earlier)
  UNION ALL SELECT g.snapshot_no, o.wiki_id, o.path, 'removed' FROM state o JOIN given g ON g.wiki_id = o.wiki_id AND g.earlier = o.snapshot_no
  WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.wiki_id = o.wiki_id AND s.path = o.path AND s.snapshot_no = g.snapshot_no)
  UNION ALL SELECT g.snapshot_no, s.wiki_id, s.path, 'changed' FROM state s JOIN given g USING (wiki_id, snapshot_no)
  JOIN state o ON o.wiki_id = s.wiki_id AND o.path = s.path AND o.snapshot_no = g.earlier WHERE o.hash <> s.hash)
"""
CHANGES_SQL = _BASE_SQL + "SELECT snapshot_no, wiki_id, path, change FROM diff"
COUNTS_SQL = _BASE_SQL + "SELECT snapshot_no, change, count(*) AS files FROM diff GROUP BY ALL"
