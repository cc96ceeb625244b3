"""Cutting long lineages through storage that outlives an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that the session names (``spark.checkpoint.dir``)."""
    spark = df.sparkSession
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
