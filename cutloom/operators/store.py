"""Writes as pure plans (old rows and changes in, new rows out), and the snapshot store that commits them atomically."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path
from threading import RLock

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom import schema
from cutloom.operators.frames import tile_counts, tile_end
from cutloom.session import broadcast_if_small, cut_lineage


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of new replace those of old with the same keys; columns in ``keep`` stay as they were. The last row of new per key must be unique."""
    kept = [c for c in keep if c in old.columns]
    fresh = new.drop(*kept).join(old.select(*keys, *kept), list(keys), "left") if kept else new
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(fresh.select(*[c for c in old.columns if c in fresh.columns]), allowMissingColumns=True)


def minted(old: DataFrame, new: DataFrame, order: Sequence[str], position: str | None = None) -> DataFrame:
    """New rows with ids above all old ones, in the given order, or by the numbers from 1 that they have.

    Rows are numbered per video, and videos by ranges of their ids: the sizes of the ranges, one per partition, are added up.
    """
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ranked = new.withColumnRenamed(position, "_n") if position else new.withColumn("_n", F.row_number().over(Window.partitionBy("video_id").orderBy(*order)))
    counts = new.groupBy("video_id").agg(F.count("*").alias("_c")).repartitionByRange("video_id").withColumn("_p", F.spark_partition_id())
    counts = cut_lineage(counts)
    sizes, starts, total = sorted(counts.groupBy("_p").agg(F.sum("_c")).collect()), [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    offsets = F.broadcast(old.sparkSession.createDataFrame(starts, "_p int, _start long"))
    before = F.col("_start") + F.sum("_c").over(Window.partitionBy("_p").orderBy("video_id")) - F.col("_c")
    counts = counts.join(offsets, "_p").select("video_id", before.alias("_before"))
    if position:  # a video of very many rows stays where its rows are
        counts = broadcast_if_small(counts)
    return ranked.join(counts, "video_id").withColumn("id", F.lit(top) + F.col("_before") + F.col("_n")).drop("_n", "_before")


def merge_payload(payload: Column, updates: Column) -> Column:
    """Shallow merge of two JSON objects as texts, the second wins; nulls and what is no object count as empty. Nested values keep their JSON."""
    as_map = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    merged = F.map_zip_with(as_map(payload), as_map(updates), lambda k, a, b: F.coalesce(b, a))
    return F.to_json(merged)


def checked_patches(segments: DataFrame, patches: DataFrame) -> DataFrame:
    """The patches; KeyError if one names an id that no segment has."""
    unknown = patches.join(segments.select("id"), "id", "left_anti").limit(1).collect()
    if unknown:
        raise KeyError(unknown[0]["id"])
    return patches


def patch_payloads(segments: DataFrame, patches: DataFrame) -> DataFrame:
    """Segments with the payload updates of patches (id, updates) merged in. Unknown ids do nothing here: see checked_patches."""
    joined = segments.join(patches.select("id", "updates"), "id", "left")
    payload = F.when(F.col("updates").isNotNull(), merge_payload(F.col("payload"), F.col("updates"))).otherwise(F.col("payload"))
    return joined.withColumn("payload", payload).select(*segments.columns)


def replace_segments(old: DataFrame, new: DataFrame, kinds: Sequence[str], patches: DataFrame | None = None, position: str | None = None, videos: DataFrame | None = None) -> DataFrame:
    """Old rows without the kinds of the videos in ``new``, or of ``videos`` (video_id) if some of them have no new rows; the new rows with minted ids, and patches on other rows.

    position: a column of ``new`` that numbers each video's rows from 1 already.
    """
    gone = (new if videos is None else videos).select("video_id").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    kept = old.join(gone, ["video_id", "kind"], "left_anti")
    if patches is not None:
        kept = patch_payloads(kept, patches)
    return kept.unionByName(minted(old, new, ["t_start_s", "kind", "t_end_s"], position), allowMissingColumns=True)


def delete_segments(old: DataFrame, video_id: str, kind: str | None = None) -> DataFrame:
    """Old rows without those of a video, or of one kind of it."""
    gone = F.col("video_id").eqNullSafe(video_id)
    return old.filter(~(gone if kind is None else gone & F.col("kind").eqNullSafe(kind)))


def set_has_speech(videos: DataFrame, video_id: str, spoken: bool) -> DataFrame:
    """Videos with the speech flag of one of them set."""
    return videos.withColumn("has_speech", F.when(F.col("video_id").eqNullSafe(video_id), F.lit(spoken)).otherwise(F.col("has_speech")))


def append(old: DataFrame, new: DataFrame, order: Sequence[str] = ("t_start_s", "kind", "t_end_s")) -> DataFrame:
    """Old rows and new ones with ids above them; vectors of new rows are kept."""
    return old.unionByName(minted(old, new, list(order)), allowMissingColumns=True)


def set_embeddings(segments: DataFrame, vectors: DataFrame) -> DataFrame:
    """Segments with the vectors of (id, embedding, model_name, dim) attached, all in one join. KeyError if an id is unknown, ValueError if one comes twice."""
    if vectors.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        raise ValueError("an id has more than one vector")
    unknown = vectors.join(segments.select("id"), "id", "left_anti").limit(1).collect()
    if unknown:
        raise KeyError(unknown[0]["id"])
    return attach(segments, vectors)


def attach(segments: DataFrame, vectors: DataFrame) -> DataFrame:
    """The join of set_embeddings without its checks."""
    new = vectors.select("id", F.col("embedding").alias("_e"), F.col("model_name").alias("_m"), F.col("dim").alias("_d"))
    joined = segments.join(new, "id", "left")
    hit = F.col("_m").isNotNull()
    for column, own in (("embedding", "_e"), ("model_name", "_m"), ("dim", "_d")):
        joined = joined.withColumn(column, F.when(hit, F.col(own)).otherwise(F.col(column)))
    return joined.select(*segments.columns)


def unembedded(segments: DataFrame, kind: str, model: str | None = None, video_id: str | None = None) -> DataFrame:
    """Ids of a kind without a vector, or with one of another model (null-safe): the work list of an incremental run."""
    stale = F.col("embedding").isNull()
    if model is not None:
        stale = stale | ~F.col("model_name").eqNullSafe(model)
    rows = segments.filter((F.col("kind") == kind) & stale)
    return (rows if video_id is None else rows.filter(F.col("video_id") == video_id)).select("id")


def windows_match(stored: DataFrame, made: DataFrame, key: str = "video_id") -> DataFrame:
    """Per key whether stored windows (s, e, text, source_ids) equal the recomputed ones in number, bounds, text and ids, and so in order.

    Windows meet by a hash of their text and ids; no key is sorted in one task.
    """
    def side(df: DataFrame, prefix: str) -> DataFrame:
        h = [F.xxhash64("text", "source_ids").alias("h"), F.hash("text", "source_ids", F.size("source_ids")).alias("g")]
        bounds = [f(c).alias(f"{prefix}{n}_{c}") for c in ("s", "e") for n, f in (("least", F.min), ("most", F.max))]
        return df.select(key, *h, "s", "e").groupBy(key, "h", "g").agg(F.count("*").alias(f"{prefix}n"), *bounds)

    both = side(stored, "a_").join(side(made, "b_"), [key, "h", "g"], "full")
    same = F.col("a_n") == F.col("b_n")
    for c in ("least_s", "most_s", "least_e", "most_e"):
        same = same & (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) < 1e-6)
    return both.groupBy(key).agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("matches"))


def tiling_matches(stored: DataFrame, spans: DataFrame, key: str = "video_id", *, model: str, win_s: float = 10.0, min_s: float = 2.0) -> DataFrame:
    """Per key whether stored audio windows (s, e, win_s, model_name: that of their vector, null without one) equal the tiling of spans, all with vectors of the model.

    A window says by its start which tile it must be, and that tile is computed where the two are compared: no tile is made, and no key is sorted in one task.
    """
    both = stored.withColumn("j", F.round(F.col("s") / win_s)).join(tile_counts(spans, key, win_s=win_s, min_s=min_s), key, "full")
    inside = (F.col("j") >= 0) & (F.col("j") < F.col("n"))
    same = inside & (F.abs(F.col("s") - F.col("j") * win_s) < 1e-6) & (F.abs(F.col("e") - tile_end(F.col("j"), win_s)) < 1e-6) & (F.col("win_s") == win_s) & (F.col("model_name") == model)
    per_tile = both.groupBy(key, "j").agg(F.count("*").alias("times"), F.bool_and(F.coalesce(same, F.lit(False))).alias("same"), F.max("n").alias("n"))
    whole = F.max("n") == F.count("j")
    return per_tile.groupBy(key).agg((F.bool_and(F.col("same") & (F.col("times") == 1)) & F.coalesce(whole, F.lit(False))).alias("reusable"))


def orphan_files(files: DataFrame, rows: DataFrame, name: str = "name") -> DataFrame:
    """Files on disk that no row names."""
    return files.join(rows.select(name), name, "left_anti")


class SnapshotStore:
    """Tables as generations of Parquet under a root; a pointer file, replaced atomically, names the current one of each table.

    A commit writes all its tables first and then moves the pointer once, so readers see all of a change or nothing. Changes by several threads of one
    process follow one another (a change of several tables takes ``lock`` from its first read to its commit); there may be one such process at a time. The root must be a file system that all executors share.
    """

    def __init__(self, spark: SparkSession, root: str | Path) -> None:
        self.spark, self.root, self.lock = spark, Path(root), RLock()
        self.root.mkdir(parents=True, exist_ok=True)
        if not self._pointer().exists():
            self.commit({name: schema.empty(spark, name) for name in schema.TABLES})

    def _pointer(self) -> Path:
        return self.root / "CURRENT"

    def current(self) -> dict[str, str]:
        """Folder of the current generation of each table."""
        return json.loads(self._pointer().read_text()) if self._pointer().exists() else {}

    def read(self, name: str) -> DataFrame:
        """The current rows of a table. Segments are partitioned by kind, so a filter on it prunes folders."""
        return self.spark.read.schema(schema.TABLES[name]).parquet(str(self.root / self.current()[name]))

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Write new generations of some tables, and make all of them current at once."""
        where = self.current()
        for name, df in tables.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            wanted = self.spark.createDataFrame([], schema.TABLES[name])
            rows = wanted.unionByName(df.select(*[c for c in wanted.columns if c in df.columns]), allowMissingColumns=True)
            writer = rows.repartition("kind").sortWithinPartitions("video_id", "t_start_s").write.partitionBy("kind") if name == "segments" else rows.write
            writer.parquet(str(self.root / folder))
            where[name] = folder
        draft = self.root / f".pointer-{uuid.uuid4().hex}"
        draft.write_text(json.dumps(where))
        os.replace(draft, self._pointer())

    def update(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Commit a change of one table."""
        with self.lock:
            self.commit({name: change(self.read(name))})
