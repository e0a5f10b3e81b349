"""Frequency of every distinct value (problem 5).

Method: (field, value, record) rows are range-partitioned and sorted, which spills to disk as
any Spark sort; a run-length scan over the sorted rows counts occurrences and distinct records.
All rows of one value and record share a range, and a value held by very many records spans
several ranges, so the partial counts of a value simply add up.

Defined results. Null elements and elements with an empty compared form don't count. A record
is a distinct non-null key. Null and empty lists hold nothing. A value that is both below
``rare_below`` and above ``common_above`` (tiny tables) is ``rare``. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from thicket.functions.forms import VALUE_SQL, value_form
from thicket.sources.tables import CUR_SQL, counting_rows

RARE_BELOW, COMMON_ABOVE = 3, 0.05


def _batch(field, value, occurrences, records) -> pa.RecordBatch:
    kinds = {"field": pa.string(), "value": pa.string(), "occurrences": pa.int64(), "records": pa.int64()}
    columns = [x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip((field, value, occurrences, records), kinds.values())]
    return pa.RecordBatch.from_arrays(columns, names=list(kinds))


def _runs(batches):
    """Run-length scan over rows sorted by field, value and record; one row for each run of a value."""
    held = None  # the run that may go on: field, value, last record, occurrences, records
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        f, v, r = b.column("field"), b.column("value"), b.column("record").to_numpy()
        term, record = np.ones(n, bool), np.ones(n, bool)
        if n > 1:
            differ = pc.or_(pc.not_equal(f[1:], f[:-1]), pc.not_equal(v[1:], v[:-1]))
            term[1:] = differ.to_numpy(zero_copy_only=False)
            record[1:] = term[1:] | (r[1:] != r[:-1])
        at = np.flatnonzero(term)
        occ, rec = np.diff(np.append(at, n)), np.add.reduceat(record.astype("int64"), at)
        if held and (held[0], held[1]) == (f[0].as_py(), v[0].as_py()):
            occ[0] += held[3]
            rec[0] += held[4] - (held[2] == r[0])
        elif held:
            yield _batch([held[0]], [held[1]], [held[3]], [held[4]])
        last = int(at[-1])
        held = (f[last].as_py(), v[last].as_py(), r[-1], int(occ[-1]), int(rec[-1]))
        if len(at) > 1:
            done = pa.array(at[:-1])
            yield _batch(f.take(done), v.take(done), occ[:-1], rec[:-1])
    if held:
        yield _batch([held[0]], [held[1]], [held[3]], [held[4]])


def value_frequency(rows: DataFrame, key: str, fields: list[str], rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """field, value, occurrences, records, mark for every compared form in the list columns ``fields``.

    ``rows`` has one row per ``key``. ``mark`` is ``rare`` (fewer than ``rare_below`` records),
    ``common`` (more than the share ``common_above`` of all records) or null.
    """
    total = rows.select(key).agg(F.count("*").alias("total"))
    held = lambda f: F.transform(F.coalesce(F.col(f), F.array()), lambda x: F.struct(F.lit(f).alias("field"), value_form(x).alias("value")))
    pairs = F.concat(*map(held, fields))
    flat = rows.select(F.col(key).cast("long").alias("record"), F.explode(pairs).alias("p")).where("p.value <> ''")
    flat = flat.select("p.field", "p.value", "record")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = flat.repartitionByRange(parts, "field", "value", "record").sortWithinPartitions("field", "value", "record")
    runs = ordered.mapInArrow(_runs, "field string, value string, occurrences long, records long")
    counts = runs.groupBy("field", "value").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * F.col("total"), "common")
    # one row: the number of all records
    return counts.join(F.broadcast(total)).select("field", "value", "occurrences", "records", mark.alias("mark"))


def leaf_frequency(leaf: DataFrame) -> DataFrame:
    cur = counting_rows(leaf, "leaf_no", "covers", "tags", "updated_at", "loaded_at")
    return value_frequency(cur, "leaf_no", ["covers", "tags"]).withColumnRenamed("records", "leaves")


def marked(leaf: DataFrame) -> DataFrame:
    return leaf_frequency(leaf).where("mark IS NOT NULL").select("field", "value", "mark")


_BASE_SQL = f"""WITH {CUR_SQL},
raw AS (SELECT leaf_no, 'covers' AS field, unnest(covers) AS v FROM cur UNION ALL SELECT leaf_no, 'tags', unnest(tags) FROM cur),
flat AS (SELECT leaf_no, field, {VALUE_SQL.format('v')} AS value FROM raw),
counts AS (SELECT field, value, count(*) AS occurrences, count(DISTINCT leaf_no) AS leaves FROM flat WHERE value <> '' GROUP BY ALL),
marks AS (SELECT *, CASE WHEN leaves < {RARE_BELOW} THEN 'rare' WHEN leaves > {COMMON_ABOVE} * (SELECT count(*) FROM cur) THEN 'common' END AS mark FROM counts)
"""
FREQUENCY_SQL = _BASE_SQL + "SELECT field, value, occurrences, leaves, mark FROM marks"
FOUND_SQL = _BASE_SQL + "SELECT field, value, mark FROM marks WHERE mark IS NOT NULL"
