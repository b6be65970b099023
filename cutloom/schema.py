"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIDEOS = """video_id string, source_url string, source_hash string, media_path string, media_hash string, fps_num int, fps_den int, frame_count bigint,
duration_s double, width int, height int, codec string, audio_offset_s double, source_pix_fmt string, source_bit_depth int, color_normalized boolean,
has_speech boolean, ingested_at timestamp_ntz"""
SEGMENTS = """id bigint, video_id string, kind string, t_start_s double, t_end_s double, frame_start bigint, frame_end bigint, model_name string, dim int,
speaker string, alignment_confidence double, payload string, embedding array<float>, ingested_at timestamp_ntz"""
JOBS = "video_id string, stage string, status string, error string, updated_at timestamp_ntz"
TABLES = {"videos": VIDEOS, "segments": SEGMENTS, "jobs": JOBS}

#: What readers of segments get: no vectors, no reserved columns.
CONTRACT = ("id", "video_id", "kind", "t_start_s", "t_end_s", "frame_start", "frame_end", "model_name", "dim", "payload")


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty table of the given name."""
    return spark.createDataFrame([], TABLES[name])
