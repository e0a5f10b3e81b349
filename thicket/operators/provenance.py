"""Coverage of sources by byte ranges: gaps, tails, overlaps and ranges out of bounds.

Ranges of a source are folded in order of their start, then their number: a range that begins
before the cursor is an overlap and doesn't move it; one that begins after it leaves a gap; an end
beyond the source is out of bounds, and the cursor stops at the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from thicket.sources.tables import table

KINDS = "array<struct<kind:string,start:long,end:long>>"


def coverage(ranges: DataFrame, sizes: DataFrame) -> DataFrame:
    """source, kind, start, end. ``ranges``: source, ordinal, start, end; ``sizes``: source, size.

    The ranges of one source are gathered in one row; their number is bounded by the targets
    made from one file. Sources without a size are ``unknown``.
    """
    lists = ranges.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("start", "ordinal", "end"))).alias("r")).join(sizes, "source", "left")
    size = F.coalesce("size", F.lit(0))
    empty = F.array().cast(KINDS)
    note = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("start"), b.cast("long").alias("end"))

    def step(s, r):
        out = s["found"]
        out = F.concat(out, F.when(r["end"] > size, F.array(note("out of bounds", r["start"], r["end"]))).otherwise(empty))
        over = r["start"] < s["cursor"]
        out = F.concat(out, F.when(over, F.array(note("overlap", r["start"], r["end"]))).when(r["start"] > s["cursor"], F.array(note("gap", s["cursor"], r["start"]))).otherwise(empty))
        cursor = F.when(over, s["cursor"]).otherwise(F.least(size, F.greatest(s["cursor"], r["end"])))
        return F.struct(cursor.cast("long").alias("cursor"), out.alias("found"))

    start = F.struct(F.lit(0).cast("long").alias("cursor"), empty.alias("found"))
    done = lists.select("source", "size", F.aggregate("r", start, step).alias("s"))
    tail = F.when(F.col("s.cursor") < size, F.array(note("tail", F.col("s.cursor"), size))).otherwise(empty)
    every = F.when(F.col("size").isNull(), F.array(note("unknown", F.lit(None), F.lit(None)))).otherwise(F.concat("s.found", tail))
    return done.select("source", F.explode(every).alias("x")).select("source", "x.*")


def line_ranges(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Line items as byte ranges of their order: returned items leave gaps, finished ones reach one further."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    li = table(spark, folder, "lineitem").select("*", F.row_number().over(w).alias("ordinal"), F.sum(F.col("l_quantity").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    li = li.select(F.col("l_orderkey").alias("source"), "ordinal", (F.col("upto") - F.col("l_quantity").cast("long")).alias("start"), F.col("upto").alias("end"), "l_returnflag", "l_linestatus")
    sizes = li.groupBy("source").agg(F.max("end").alias("size"))
    kept = li.where("l_returnflag <> 'R'").withColumn("end", F.col("end") + (F.col("l_linestatus") == "F").cast("long"))
    return kept.select("source", "ordinal", "start", "end"), sizes


_FOLD = """WITH RECURSIVE li AS (SELECT l_orderkey AS source, row_number() OVER w AS ordinal, sum(l_quantity::BIGINT) OVER w AS upto, l_quantity::BIGINT AS q, l_returnflag AS f, l_linestatus AS s FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate ROWS UNBOUNDED PRECEDING)),
sz AS (SELECT source, max(upto)::BIGINT AS size FROM li GROUP BY source),
kept AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY upto - q, ordinal) AS n, (upto - q)::BIGINT AS a, (upto + (s = 'F')::INT)::BIGINT AS b FROM li WHERE f <> 'R'),
fold AS (SELECT source, 0::BIGINT AS n, 0::BIGINT AS cur, NULL::BIGINT AS a, NULL::BIGINT AS b, 0::BIGINT AS before FROM sz SEMI JOIN kept USING (source)
  UNION ALL SELECT k.source, k.n, CASE WHEN k.a < f.cur THEN f.cur ELSE least(size, greatest(f.cur, k.b)) END, k.a, k.b, f.cur
  FROM fold f JOIN kept k ON k.source = f.source AND k.n = f.n + 1 JOIN sz ON sz.source = f.source),
found AS (SELECT source, 'out of bounds' AS kind, a AS "start", b AS "end" FROM fold JOIN sz USING (source) WHERE b > size
  UNION ALL SELECT source, 'overlap', a, b FROM fold WHERE a < before
  UNION ALL SELECT source, 'gap', before, a FROM fold WHERE a > before
  UNION ALL SELECT source, 'tail', cur, size FROM fold JOIN sz USING (source) WHERE cur < size QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC) = 1
    AND n = (SELECT max(n) FROM fold g WHERE g.source = fold.source))
"""
SQL = {
    "q_coverage": _FOLD + 'SELECT source, kind, "start", "end" FROM found',
    "q_coverage_overlaps": _FOLD + "SELECT source, count(*) AS overlaps FROM found WHERE kind = 'overlap' GROUP BY source",
}


def queries() -> dict:
    return {
        "q_coverage": lambda s, d: coverage(*line_ranges(s, d)),
        "q_coverage_overlaps": lambda s, d: coverage(*line_ranges(s, d)).where("kind = 'overlap'").groupBy("source").agg(F.count("*").alias("overlaps")),
    }
