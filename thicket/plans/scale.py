"""Helpers that keep plans safe on a cluster: checkpoints in the shared folder, salted joins, fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Replicas of the distinct side of a salted join; a hot key is spread over so many tasks.
SALTS = 16


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by ``checkpoint()``.

    The folder is that of ``spark.checkpoint.dir``, which every executor must see. Only in local mode, where
    there is one machine, the session's own scratch folder stands in for it.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = f"{sc.getConf().get('spark.local.dir', '/tmp')}/thicket-{sc.applicationId}"
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def fresh(df: DataFrame) -> DataFrame:
    """``cut`` without what the optimizer knows of the rows.

    A checkpoint keeps the constraints of its plan, and over many rounds they grow faster than
    the data; loops begin each round from rows alone.
    """
    spark, rows = df.sparkSession, cut(df)
    plain = spark._jsparkSession.internalCreateDataFrame(rows._jdf.queryExecution().toRdd(), rows._jdf.schema(), False)
    return DataFrame(plain, spark)


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join ``many`` to ``one`` (one row a key) on ``key`` without a hot key ending in one task.

    Rows of ``many`` are spread by a hash of ``spread`` over ``salts`` parts of their key and
    each row of ``one`` is there once for every part. ``how`` is inner, left or left_anti.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def fan_out(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` in at least as many parts as the cluster has cores, for Python work on few input splits.

    A table of many splits is left as it is, so this shuffles only small inputs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *cols)
