"""Checkpoints for loops that the driver runs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the shared folder ``spark.checkpoint.dir``; on one machine, as in tests, it may be unset."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(place or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)
