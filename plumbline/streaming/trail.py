"""Streaming forms of two reports over append-only logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.trail import merge_retrievals, retrieval_state
from plumbline.sources.scratch import shared_dir


def trail_counts(trail: DataFrame, late: str = "1 day") -> DataFrame:
    """Successful operations per day; rows later than ``late`` behind the newest are dropped."""
    rows = trail.where(F.col("outcome") == "ok").withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    counts = rows.groupBy(F.window("at", "1 day").alias("w"), "op").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "op", "n")


def stream_retrievals(retrievals: DataFrame, folder: str, compact_after: int = 8) -> DataFrame:
    """Merge what the stream ``(claim_id, at)`` has now into the stored counters of ``folder``, and return these.

    The stream keeps no state of its own: each micro-batch is a batch of the stored
    table under its id, so one that is run again after a failure counts once.  A
    further run goes on where the last one stopped.  The deltas become a new base
    when there are more than ``compact_after``.
    """
    state = retrieval_state(retrievals.sparkSession, f"{folder}/table")

    def keep(batch: DataFrame, batch_id: int) -> None:
        merge_retrievals(state, batch, f"stream {batch_id}")
        state.compact(compact_after)

    query = retrievals.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return state.read()


def run_available(stream: DataFrame, name: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return its latest row per key.

    Updates are written batch by batch under their batch id, so a batch that is
    run again after a failure replaces its own rows.  With the ``folder`` of an
    earlier run it goes on where that stopped and reads nothing twice.
    """
    spark = stream.sparkSession
    at = folder or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    rest = [c for c in stream.columns if c not in keys]
    last = F.max(F.struct("_batch", *rest)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
