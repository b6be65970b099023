"""Job states per video and stage, and which stages become stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.config import DOWNSTREAM
from cutloom.operators.store import upsert

PENDING, RUNNING, DONE, FAILED = "pending", "running", "done", "failed"


def latest(jobs: DataFrame) -> DataFrame:
    """One row per video and stage, the last update; redelivered rows count once."""
    rest = [c for c in jobs.columns if c not in ("video_id", "stage")]
    picked = jobs.groupBy("video_id", "stage").agg(F.max_by(F.struct(*rest), "updated_at").alias("r"))
    return picked.select(*[c if c not in rest else F.col("r")[c].alias(c) for c in jobs.columns])


def status_of(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """status and is_done of each wanted (video_id, stage); without a row it is pending."""
    joined = wanted.join(jobs.select("video_id", "stage", "status"), ["video_id", "stage"], "left")
    status = F.coalesce("status", F.lit(PENDING))
    return joined.select("video_id", "stage", status.alias("status"), (status == DONE).alias("is_done"))


def set_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert of (video_id, stage, status[, error]); an error not given is cleared, the time is now."""
    error = F.col("error") if "error" in changes.columns else F.lit(None).cast("string")
    new = changes.select("video_id", "stage", "status", error.alias("error"), F.current_timestamp().cast("timestamp_ntz").alias("updated_at"))
    return upsert(jobs, new, ["video_id", "stage"])


def cascade(runs: DataFrame) -> DataFrame:
    """The stages (video_id, stage) that running the given ones makes pending."""
    edges = [(a, b) for a, targets in DOWNSTREAM.items() for b in targets]
    consumers = F.broadcast(runs.sparkSession.createDataFrame(edges, "stage string, consumer string"))
    return runs.select("video_id", "stage").join(consumers, "stage").select("video_id", F.col("consumer").alias("stage")).distinct()


def failed_stages(jobs: DataFrame) -> DataFrame:
    """Failed stages of each video in alphabetical order."""
    return jobs.filter(F.col("status") == FAILED).groupBy("video_id").agg(F.array_sort(F.collect_set("stage")).alias("failed"))
