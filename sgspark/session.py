"""Session settings: a builder with the engine's defaults, and the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

#: Adaptive planning does the re-partitioning and the splitting of skewed joins.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def builder(name: str = "sgspark") -> SparkSession.Builder:
    return SparkSession.builder.appName(name).config(map=DEFAULTS)


def checkpointed(spark: SparkSession) -> str:
    """The shared folder (spark.checkpoint.dir) for checkpoint(). Where none is set, a local master gets one of our own; a
    cluster has to name one, as its machines share no temporary folder."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext.getCheckpointDir():
        if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = at or tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at
