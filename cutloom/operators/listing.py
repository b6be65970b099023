"""The exhaustive read contract: exact, ordered filters; and point lookups."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.functions.text import preview
from cutloom.schema import CONTRACT


def first_delivery(df: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """One row per key, the first that arrived. Partial aggregation keeps redelivered rows out of the shuffle."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), arrival).alias("r"))
    return picked.select(*[c if c in key else F.col("r")[c].alias(c) for c in df.columns])


def overlaps(start: float, end: float) -> Column:
    """Half-open intervals that overlap [start, end); both comparisons are strict and reach the file statistics."""
    return (F.col("t_start_s") < end) & (F.col("t_end_s") > start)


def payload_equals(payload: Column, key: str, value: Any) -> Column:
    """Equality as in Python: null equals a missing key, true equals 1, 1 equals 1.0, and '2' is not 2. Deep for lists and objects."""
    v = F.try_parse_json(payload)
    at = F.try_variant_get(v, f"$.{key}", "variant")
    kind = F.schema_of_variant(at)
    text = F.try_variant_get(v, f"$.{key}", "string")
    if value is None:
        return at.isNull() | F.is_variant_null(at)
    if isinstance(value, (bool, int, float)):
        number = F.when(kind == "BOOLEAN", text.try_cast("boolean").cast("double")).when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), text.try_cast("double"))
        return F.coalesce(number == float(value), F.lit(False))
    if isinstance(value, str):
        return F.coalesce((kind == "STRING") & (text == value), F.lit(False))
    import json

    same = F.to_json(F.parse_json(F.lit(json.dumps(value))))
    return F.coalesce(F.to_json(at) == same, F.lit(False))


def list_segments(segments: DataFrame, video_id: str, kind: str | None = None, filters: dict[str, Any] | None = None, between: tuple[float, float] | None = None) -> DataFrame:
    """All segments of a video that meet every filter, ordered by start and id; never limited, never with vectors.

    Payloads that are null count as empty objects; those that are no JSON match only null filters.
    """
    rows = segments.filter(F.col("video_id") == video_id)
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if between is not None:
        rows = rows.filter(overlaps(*between))
    for key, value in (filters or {}).items():
        rows = rows.filter(payload_equals(F.col("payload"), key, value))
    return rows.select(*[c for c in CONTRACT if c in rows.columns]).orderBy("t_start_s", "id")


def list_delivered(segments: DataFrame, video_id: str, kind: str | None = None, filters: dict[str, Any] | None = None, between: tuple[float, float] | None = None) -> DataFrame:
    """list_segments of a table that may hold a row twice (with ingested_at): video, kind and range are filtered in the scan, the first delivery per id is taken, payloads are compared last."""
    rows = segments.filter(F.col("video_id") == video_id)
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if between is not None:
        rows = rows.filter(overlaps(*between))
    return list_segments(first_delivery(rows.select(*CONTRACT, "ingested_at"), ["id"], "ingested_at"), video_id, filters=filters)


def segments_by_ids(segments: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """Segments with these ids (a list, or a DataFrame with a column id), ordered by start and id; none for an empty list."""
    rows = segments.join(ids.select("id").distinct(), "id", "left_semi") if isinstance(ids, DataFrame) else segments.filter(F.col("id").isin(list(ids)) if ids else F.lit(False))
    return rows.select(*[c for c in CONTRACT if c in rows.columns]).orderBy("t_start_s", "id")


def get_video(videos: DataFrame, video_id: str) -> DataFrame:
    """The row of a video, without the speech flag; empty if there is none."""
    return videos.filter(F.col("video_id") == video_id).drop("has_speech").limit(1)


def has_speech(videos: DataFrame, wanted: DataFrame) -> DataFrame:
    """The tri-state flag of each wanted video_id: null if there is no row or it is not known."""
    return wanted.join(videos.select("video_id", "has_speech"), "video_id", "left")


def _seconds(*columns: str) -> Column:
    return F.array(*[F.round(c, 3) for c in columns])


def list_lines(rows: DataFrame) -> DataFrame:
    """The list command's lines: kind, seconds to three places, frames and the payload as JSON, in order."""
    payload = F.coalesce(F.try_parse_json("payload"), F.parse_json(F.lit("{}")))
    shown = F.struct("kind", _seconds("t_start_s", "t_end_s").alias("t"), F.array("frame_start", "frame_end").alias("frames"), payload.alias("payload"))
    return rows.orderBy("t_start_s", "id").select(F.to_json(shown, {"ignoreNullFields": "false"}).alias("line"))


def search_lines(hits: DataFrame) -> DataFrame:
    """The search command's lines: video, kind, own and cut range, score to five places, rank and distance (four places) per space, and a preview, by position."""
    v = F.try_parse_json("payload")
    spaces = F.transform_values("per_space", lambda k, x: F.struct(x["rank"].alias("rank"), F.round(x["dist"], 4).alias("dist")))
    texts = [F.try_variant_get(v, f"$.{k}", "string") for k in ("text", "description", "frame_path")]
    shown = F.struct(
        F.col("video_id").alias("video"), "kind", _seconds("t_start_s", "t_end_s").alias("t"), F.array("frame_start", "frame_end").alias("frames"), _seconds("cut_start_s", "cut_end_s").alias("cut_t"),
        F.array("cut_frame_start", "cut_frame_end").alias("cut_frames"), F.round("rrf_score", 5).alias("rrf"), spaces.alias("spaces"), preview(*texts).alias("preview"),
    )
    return hits.orderBy("position").select(F.to_json(shown, {"ignoreNullFields": "false"}).alias("line"))
