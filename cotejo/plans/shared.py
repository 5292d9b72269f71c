"""Cutting lineage where one intermediate feeds several branches."""

from __future__ import annotations

from pyspark.sql import DataFrame


def checkpoint_dir(df: DataFrame) -> str:
    """The shared checkpoint folder, as set on the context or named in spark.checkpoint.dir."""
    spark = df.sparkSession
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder once and reads it from there after."""
    checkpoint_dir(df)
    return df.checkpoint(eager=True)
