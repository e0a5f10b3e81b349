"""Entries of all wikis: counting leaves and index pages in one shape.

A directory is a wiki and a path below it (``dir``); siblings share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from thicket.functions.text import ENTRY_TEXT, TOKENS, entry_text, hashed, tokenize
from thicket.sources.tables import CUR_SQL, counting_rows, table

_STRINGS = T.ArrayType(T.StringType())
#: The shape of an entry; index pages lack what only leaves have.
SCHEMA = T.StructType([
    T.StructField("wiki_id", T.StringType()), T.StructField("dir", T.StringType()), T.StructField("parent_dir", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("depth", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("id", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("depth_role", T.StringType()), T.StructField("focus", T.StringType()), T.StructField("covers", _STRINGS), T.StructField("tags", _STRINGS),
    T.StructField("parents", _STRINGS), T.StructField("size_bytes", T.LongType()),
])
_LEAF = ("wiki_id", "id", "path", "parent_dir", "depth", "type", "depth_role", "focus", "covers", "tags", "domains", "aliases", "parents", "overlay_targets", "links", "activation", "source", "size_bytes", "line_count", "updated_at", "loaded_at")


def leaves(spark: SparkSession, folder: str) -> DataFrame:
    """The counting row of each leaf with ``dir``, ``text`` and ``tokens``."""
    cur = counting_rows(table(spark, folder, "leaf"), "leaf_no", *_LEAF)
    cur = cur.withColumn("dir", F.concat_ws("/", "wiki_id", "parent_dir"))
    return cur.withColumn("text", entry_text(F.col("focus"), F.col("covers"), F.col("tags"), F.col("domains"))).withColumn("tokens", tokenize(F.col("text")))


def leaf_terms(spark: SparkSession, folder: str) -> DataFrame:
    """wiki_id, dir, leaf_no and ``terms``, the hashed tokens, of the counting row of each leaf.

    They are made before that row is looked for, since texts would make up most of what is shuffled. Whoever
    needs only ``wiki_id`` reads no text.
    """
    rows = table(spark, folder, "leaf").where("leaf_no IS NOT NULL")
    terms = hashed(tokenize(entry_text(F.col("focus"), F.col("covers"), F.col("tags"), F.col("domains"))))
    rows = rows.select("leaf_no", "wiki_id", F.struct(F.concat_ws("/", "wiki_id", "parent_dir").alias("dir"), terms.alias("terms")).alias("row"), F.struct("updated_at", "loaded_at").alias("at"))
    latest = rows.groupBy("leaf_no").agg(F.max_by("wiki_id", "at").alias("wiki_id"), F.max_by("row", "at").alias("row"))
    return latest.select("leaf_no", "wiki_id", "row.*")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Index pages with the directory they describe (``dir``) and the one they lie in (``up``)."""
    p = table(spark, folder, "index_page")
    here = F.regexp_replace("path", r"/?index\.md\z", "")
    p = p.withColumn("parent_dir", here).withColumn("dir", F.concat_ws("/", "wiki_id", here))
    return p.withColumn("up", F.concat_ws("/", "wiki_id", F.regexp_replace(here, r"(^|/)[^/]*\z", "")))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves and index pages in the shape of ``SCHEMA``."""
    one = lambda df, **more: df.select(*((more[f.name] if f.name in more else F.col(f.name)).cast(f.dataType).alias(f.name) for f in SCHEMA))
    none = F.lit(None)
    return one(leaves(spark, folder), kind=F.lit("leaf")).unionByName(
        one(pages(spark, folder), kind=F.lit("index"), type=F.lit("index"), covers=F.col("shared_covers"), tags=none, size_bytes=none)
    )


#: cur (counting rows), ent (with dir and text) and tok (with tokens) for DuckDB.
LEAVES_SQL = f"""{CUR_SQL},
ent AS (SELECT *, concat_ws('/', wiki_id, parent_dir) AS dir, {ENTRY_TEXT} AS text FROM cur),
tok AS (SELECT leaf_no, dir, text, {TOKENS.format('text')} AS tokens FROM ent)"""
PAGES_SQL = r"""page AS (SELECT *, regexp_replace(path, '/?index\.md\z', '') AS parent_dir,
  concat_ws('/', wiki_id, regexp_replace(path, '/?index\.md\z', '')) AS dir,
  concat_ws('/', wiki_id, regexp_replace(regexp_replace(path, '/?index\.md\z', ''), '(^|/)[^/]*\z', '')) AS up FROM index_page)"""
