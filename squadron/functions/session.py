"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where all executors are this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="squadron-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``; sets one only where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str, per_core: int = 4) -> DataFrame:
    """``df`` dealt by ``keys``, or evenly without any, to several tasks a core. Few rows can mean much work; a number that is given is not
    merged again at run time."""
    return df.repartition(per_core * df.sparkSession.sparkContext.defaultParallelism, *keys)
