"""References to records that do not exist (orphans): skew-aware split of an anti-join.

References are pre-aggregated per key and period. Keys with more than a given share of all references are heavy; there are
at most 1 / share of them, so they are checked by a broadcast join. The other keys go through a shuffle anti-join of the
pre-aggregated rows. Both kinds of suspect keys then pick their references out of the rows again, and the union is listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.functions.values import parsed, text_at, text_list, whole_text
from cutloom.session import broadcast_if_small, cut_lineage, written

SEP = "\x01"


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws(SEP, F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])


def orphan_references(refs: DataFrame, targets: DataFrame, deleted: DataFrame, *, heavy_share: float = 0.001, period: str = "month") -> DataFrame:
    """References without a target, or older than their target.

    refs: src_table, src_key, ref_field, ref_value, key, arrival; several deliveries of one reference may occur.
    targets: key, seen (arrival of the target). deleted: key of removed targets. Other columns are ignored.

    Result: src_table, src_key, ref_field, ref_value, status, arrival, period; one row per reference. status is ``late`` if
    the target exists but its first arrival is later than the reference's first, else without a target ``deleted`` if the
    key is in deleted, otherwise ``missing``. Rows whose key or ref_value is null are no references. A null arrival on
    either side is never late; its period is null. Empty inputs give an empty result or, without targets, all references.
    """
    refs = refs.filter(F.col("key").isNotNull() & F.col("ref_value").isNotNull()).select(
        "src_table", "src_key", "ref_field", "ref_value", "key", "arrival", F.date_trunc(period, "arrival").alias("period")
    )
    refs = written(refs, "references")  # parsed once: keys are counted in it, and those of heavy and of light suspects are picked out
    targets = targets.filter(F.col("key").isNotNull()).select("key", "seen")
    deleted = deleted.filter(F.col("key").isNotNull()).select("key")

    per_key = cut_lineage(refs.groupBy("key", "period").agg(F.count("*").alias("n"), F.min("arrival").alias("first_ref")))
    total = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    least = max(1000, int(total * heavy_share))
    # At most 1 / heavy_share keys can reach the least count: their broadcasts (per key, and per key and period) are bounded whatever the data.
    heavy = cut_lineage(per_key.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key"))

    def first_seen(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.min("seen").alias("seen"), F.lit(True).alias("found"))

    def suspects(keys: DataFrame, seen: DataFrame, gone: DataFrame) -> DataFrame:
        joined = keys.join(seen, "key", "left").join(gone.withColumn("was_deleted", F.lit(True)), "key", "left")
        return joined.filter(F.col("found").isNull() | (F.col("seen") > F.col("first_ref"))).select("key", "period", "seen", "found", "was_deleted")

    few = F.broadcast(heavy)
    heavy_suspects = suspects(
        per_key.join(few, "key", "left_semi"),
        F.broadcast(first_seen(targets.join(few, "key", "left_semi"))),
        F.broadcast(deleted.join(few, "key", "left_semi").distinct()),
    )
    light_suspects = cut_lineage(suspects(per_key.join(few, "key", "left_anti"), first_seen(targets), deleted.distinct()))

    def listed(rows: DataFrame, keys: DataFrame) -> DataFrame:
        rows = rows.withColumn("month", F.coalesce("period", F.lit("1000-01-01").cast("timestamp"))).drop("period")
        keys = keys.withColumn("month", F.coalesce("period", F.lit("1000-01-01").cast("timestamp"))).drop("period")
        return rows.join(keys, ["key", "month"])

    hits = listed(refs.join(few, "key", "left_semi"), F.broadcast(heavy_suspects)).unionByName(
        listed(refs.join(few, "key", "left_anti"), broadcast_if_small(light_suspects))
    )
    status = F.when(F.col("found"), "late").when(F.col("was_deleted"), "deleted").otherwise("missing")
    return (
        hits.filter(F.col("found").isNull() | (F.col("seen") > F.col("arrival")))
        .groupBy("src_table", "src_key", "ref_field", "ref_value", status.alias("status"))
        .agg(F.min("arrival").alias("arrival"))
        .withColumn("period", F.date_trunc(period, "arrival"))
    )


def segment_references(segments: DataFrame) -> DataFrame:
    """References held by segments: to their video, to a shot (frame, caption), to speech segments (speech_window)."""
    kind, video = F.col("kind"), F.col("video_id")
    ref = lambda field, value, key: F.struct(F.lit(field).alias("ref_field"), value.alias("ref_value"), key.alias("key"))
    none = F.expr("cast(array() as array<struct<ref_field:string,ref_value:string,key:string>>)")
    shot_index = whole_text(text_at(F.col("v"), "$.shot_index"))
    ids = F.array_distinct(F.transform(text_list(F.col("v"), "$.source_speech_ids"), whole_text))
    rows = segments.select(
        F.col("id").cast("string").alias("src_key"),
        video,
        kind,
        F.col("ingested_at").alias("arrival"),
        F.when(kind.isin("frame", "caption", "speech_window"), parsed(F.col("payload"))).alias("v"),
    )
    refs = F.concat(
        F.array(ref("video_id", video, _key("v", video))),
        F.when(kind.isin("frame", "caption"), F.array(ref("shot_index", shot_index, _key("s", video, shot_index)))).otherwise(none),
        F.when(kind == "speech_window", F.coalesce(F.transform(ids, lambda x: ref("source_speech_ids", x, _key("p", video, x))), none)).otherwise(none),
    )
    return rows.select(F.lit("segments").alias("src_table"), "src_key", "arrival", F.explode(refs).alias("r")).select("src_table", "src_key", "r.*", "arrival")


def media_references(segments: DataFrame, jobs: DataFrame, cut_marks: DataFrame, search_results: DataFrame) -> DataFrame:
    """All references between the tables of the index, in the form orphan_references takes."""
    video = F.col("video_id")

    def of(df: DataFrame, name: str, src_key: Column, field: str, value: Column, key: Column, arrival: str) -> DataFrame:
        return df.select(F.lit(name).alias("src_table"), src_key.cast("string").alias("src_key"), F.lit(field).alias("ref_field"), value.cast("string").alias("ref_value"), key.alias("key"), F.col(arrival).alias("arrival"))

    hit = F.col("segment_id")
    return (
        segment_references(segments)
        .unionByName(of(jobs, "jobs", F.concat_ws("/", F.coalesce("video_id", F.lit("")), F.coalesce("stage", F.lit(""))), "video_id", video, _key("v", video), "updated_at"))
        .unionByName(of(cut_marks, "cut_marks", F.col("mark_id"), "video_id", video, _key("v", video), "created_at"))
        .unionByName(of(search_results, "search_results", F.col("result_id"), "segment_id", hit, _key("g", hit), "served_at"))
    )


def media_targets(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """Keys of the records that exist: videos, shots by index, speech by id, and any segment by id."""
    kind, video, sid = F.col("kind"), F.col("video_id"), F.col("id")
    shot_index = whole_text(text_at(parsed(F.col("payload")), "$.shot_index"))
    own = F.when(kind == "shot", F.when(shot_index.isNotNull(), _key("s", video, shot_index))).when(kind == "speech", _key("p", video, sid))
    keys = F.filter(F.array(_key("g", sid), own), lambda x: x.isNotNull())
    return segments.select(F.explode(keys).alias("key"), F.col("ingested_at").alias("seen")).unionByName(
        videos.filter(video.isNotNull()).select(_key("v", video).alias("key"), F.col("ingested_at").alias("seen"))
    )


def media_deleted(segment_deletes: DataFrame) -> DataFrame:
    """Keys of removed segments: by id for search results; a shot by its index, speech by its id, each in its video."""
    kind, video, sid = F.col("kind"), F.col("video_id"), F.col("id")
    shot_index = whole_text(text_at(parsed(F.col("payload")), "$.shot_index"))
    own = F.when(kind == "shot", F.when(shot_index.isNotNull(), _key("s", video, shot_index))).when(kind == "speech", _key("p", video, sid))
    return segment_deletes.select(F.explode(F.filter(F.array(_key("g", sid), own), lambda x: x.isNotNull())).alias("key"))
