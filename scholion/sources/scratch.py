"""Tables that are computed once and read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's checkpoint directory, which driver and executors share; where the session names none and
    runs on one machine, in a fresh temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="scholion-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/scholion-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table at such a path."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, few: int = 4) -> DataFrame:
    """``df`` dealt to all cores if it is read from a few files: such a table is small, but a file may be one row group, so one
    task. Tables of more files are read as they are."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if 0 < len(df.inputFiles()) <= few else df
