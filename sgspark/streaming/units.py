"""Incremental unit statistics: sums by unit that grow as files arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sgspark.session import checkpointed


def sums(events: DataFrame) -> DataFrame:
    """By user unit (user_id % 16) and event type: n and the sum of values in whole hundredths."""
    return events.groupBy((F.col("user_id") % 16).alias("unit"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("hundredths"))


def unit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums of all events, through a stream that takes what is there and stops. State is one row a unit and type; each
    batch replaces the result's table in the shared folder, so nothing of it is held by the driver."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    folder = f"{checkpointed(spark).rstrip('/')}/streams/units-{uuid.uuid4().hex}"

    def replaced(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result-{number}")

    run = sums(stream).writeStream.outputMode("complete").foreachBatch(replaced).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    last = max((p["batchId"] for p in run.recentProgress if p["numInputRows"] > 0), default=0)
    return spark.read.parquet(f"{folder}/result-{last}")
