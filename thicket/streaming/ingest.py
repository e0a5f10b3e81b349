"""Streaming ingest: an addition to the batch operators, which know no streams.

New source files come as rows (wiki_id, path, hash, updated_at); each batch is compared with what
the target has and only inserts and updates are appended, so a batch that is repeated after a
failure changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from thicket.operators.history import resume


def upsert_batch(target: str):
    """A function for ``foreachBatch`` that appends what is new to the Parquet folder ``target``."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        one = batch.groupBy("wiki_id", "path").agg(F.max_by("hash", "updated_at").alias("hash"), F.max("updated_at").alias("updated_at"))
        try:
            have = spark.read.parquet(target)
        except AnalysisException as e:  # the first batch finds no folder; any other failure is one
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            have = spark.createDataFrame([], "wiki_id string, path string, hash string, updated_at timestamp_ntz")
        todo = resume(one, have.select("wiki_id", "path", "hash", "updated_at")).where("action <> 'skip'")
        one.join(todo, ["wiki_id", "path"]).write.mode("append").parquet(target)

    return run


def ingest_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Follow a folder of Parquet files and upsert their rows into ``target``."""
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(upsert_batch(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decision_rate(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, operator, decisions: a log of decisions counted by time window, with a watermark for late rows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), F.col("event_type").alias("operator")).agg(F.count("*").alias("decisions"))
    return w.select(F.col("window.start").alias("start"), "operator", "decisions")
