"""Progress of pipeline stages: append-only step events to the latest state, as a batch or as a stream.

The streaming form is an extension; batch and stream give the same rows on a bounded input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_timeline(events: DataFrame) -> DataFrame:
    """``run_id, stage, started_at, completed_at, steps`` from events (run_id, stage, at): the first start is kept."""
    return events.groupBy("run_id", "stage").agg(F.min("at").alias("started_at"), F.max("at").alias("completed_at"), F.count("*").alias("steps"))


def latest_status(events: DataFrame) -> DataFrame:
    """``run_id, stage, status`` from events (run_id, stage, status, at): the last one, done before running before pending at one time."""
    rank = F.when(F.col("status") == "done", 2).when(F.col("status") == "running", 1).otherwise(0)
    return events.groupBy("run_id", "stage").agg(F.max_by("status", F.struct("at", rank.alias("r"))).alias("status"))


def token_usage(events: DataFrame) -> DataFrame:
    """Null-aware sums of input and output tokens of a run."""
    return events.groupBy("run_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("total_tokens"))


def windowed_timeline(stream: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """The timeline by event-time windows; events later than ``delay`` behind the newest are dropped, as watermarks do."""
    return stream.withWatermark("at", delay).groupBy(F.window("at", width), "run_id", "stage").agg(F.min("at").alias("started_at"), F.max("at").alias("completed_at"), F.count("*").alias("steps"))


def write_progress(stream: DataFrame, path: str, checkpoint: str):
    """Events as JSON lines, all that is there at once; the checkpoint folder must be shared."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
