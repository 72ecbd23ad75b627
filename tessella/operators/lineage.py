"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder (spark.checkpoint.dir), so that what follows doesn't make it again, even if executors are lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir")
        if not configured:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured)
    return df.checkpoint()
