"""Cutting lineage: intermediate results in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: While cut() runs, Spark deletes a finished execution's shuffle files at once, and Python tasks get batches of fewer rows
#: than by default, as texts are long.
WHILE_CUTTING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; without executors (tests) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not folder and not jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='blockprint-')}")
    return folder or jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder. Spark deletes the files when nothing refers to them any more."""
    spark = df.sparkSession
    shared_folder(spark)
    before = {k: spark.conf.get(k, None) for k in WHILE_CUTTING}
    for k, v in WHILE_CUTTING.items():
        spark.conf.set(k, v)
    try:
        return sized(df.select("*").checkpoint())  # a new plan, made under these settings
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sized(df: DataFrame) -> DataFrame:
    """df with the default size if Spark's estimate is beyond all use. A checkpoint keeps the estimate of its plan, joins
    multiply estimates, and rounds of joins would make them numbers of millions of digits."""
    spark = df.sparkSession
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 62:
        return df
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)
