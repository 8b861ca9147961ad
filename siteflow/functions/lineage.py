"""Cutting the lineage of iterated tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, or spark.checkpoint.dir.

    Where neither is set, a local master gets a temporary folder of its own; a cluster gets an error, since its
    executors could not see the driver's folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        chosen = spark.conf.get("spark.checkpoint.dir", None)
        if not chosen:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            chosen = tempfile.mkdtemp(prefix="siteflow-")
        sc.setCheckpointDir(chosen)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df through a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
