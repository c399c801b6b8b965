"""The latest state of each run from a stream of state events, and counts a bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoanswers.operators.runs import run_bucket


def latest_states(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """run_id, state, ts, events from a stream of (event_id, run_id, state, ts); repeated event ids count once."""
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("run_id").agg(F.max(F.struct("ts", "event_id", "state")).alias("m"), F.count("*").alias("events")).select("run_id", "m.state", "m.ts", "events")


def run_stream(spark: SparkSession, events: DataFrame, name: str, path: str) -> DataFrame:
    """Drive the stream over what is there now; each round's changed runs are appended under path with the round's number,
    and the newest round of a run is its state. Survives a restart: the checkpoint is beside the rows."""

    def save(changed: DataFrame, round_: int) -> None:
        changed.withColumn("round", F.lit(round_)).write.mode("overwrite").parquet(f"{path}/rows/round={round_}_")

    q = latest_states(events).writeStream.outputMode("update").queryName(name).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).schema("run_id long, state string, ts timestamp, events long, round long").parquet(f"{path}/rows")
    return rows.groupBy("run_id").agg(F.max_by(F.struct("state", "ts", "events"), "round").alias("m")).select("run_id", "m.*")


def bucket_counts(states: DataFrame) -> DataFrame:
    return states.groupBy(run_bucket(F.col("state")).alias("bucket")).agg(F.count("*").alias("runs"))
