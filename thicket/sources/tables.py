"""Reading the tables of a data folder, and the row of each leaf that counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``, one Parquet file or folder each."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def counting_rows(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per ``key``: that of the latest ``updated_at``, then ``loaded_at``.

    ``max_by`` aggregates before the shuffle, so a key with very many rows is no hot spot.
    Rows with a null key are dropped; a null ``updated_at`` is older than any other.
    """
    cols = [c for c in columns if c != key]
    latest = F.max_by(F.struct(*cols), F.struct("updated_at", "loaded_at"))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(latest.alias("_row")).select(key, "_row.*")


#: The same in DuckDB, as a common table expression named cur.
CUR_SQL = """cur AS (SELECT * FROM leaf WHERE leaf_no IS NOT NULL QUALIFY row_number() OVER
  (PARTITION BY leaf_no ORDER BY updated_at DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1)"""
