"""The stage runner: states, cascades, the overlap of transcription and captions, and stages as plans over the store.

What needs media or a model comes from Sources as DataFrames (cuts, sentences, looks at frames, vectors) or, for captions, as a request; everything relational
around it is here. Every stage reads what it needs, computes, and commits once: one that fails leaves the rows of earlier runs as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.config import DOWNSTREAM, STAGES, Config
from cutloom.functions import captions, media
from cutloom.functions.values import parsed, text_at, whole_text
from cutloom.models import Encoder, embed
from cutloom.operators import folds, frames, intervals, jobs, requests, search, words
from cutloom.operators.store import SnapshotStore, append, attach, checked_patches, delete_segments, orphan_files, replace_segments, set_has_speech, tiling_matches, unembedded, upsert, windows_match
from cutloom.session import cut_lineage
from cutloom.sources.media import prune_files, write_frames

Stage = Callable[[SnapshotStore, str, Config], None]


@dataclass
class Sources:
    """What is outside of this library, for one video. Functions of a video id give DataFrames with a column video_id.

    probe: media_path, media_hash, rate, frame_count, codec, audio_offset_s and more columns of videos. cuts: scenes (s, e in frames). decoded: the frames that the cutter has decoded.
    look: of candidates (video_id, media_path, frame) dhash, boxes, width, height, and content if pictures are to be kept. flow: of pairs (id, media_path, p0, p1) features, diff, scale, dx, dy.
    speech: sid, s, e, text, no_speech_prob, avg_logprob, and words if there are any; None if the video has no audio. regions: kind (music, noise), s, e. lyrics: of merged
    music (video_id, s, e) s, e, text. align: of sentences (sid, s, e, words) better words. ask: the reply to a frame path. images, sounds: of rows to embed embedding, model_name, dim
    by id, or by video_id, s, e. texts: what makes the encoder of texts. audio_s: seconds of audio; None without.
    """

    video_id: str
    probe: Callable[[str], DataFrame]
    cuts: Callable[[str], DataFrame]
    look: Callable[[DataFrame], DataFrame]
    flow: Callable[[DataFrame], DataFrame]
    speech: Callable[[str], DataFrame | None]
    regions: Callable[[str], DataFrame]
    ask: Callable[[str], str]
    images: Callable[[DataFrame], DataFrame]
    sounds: Callable[[DataFrame], DataFrame]
    texts: Callable[[], Encoder]
    audio_s: Callable[[str], float | None]
    decoded: Callable[[str], int] | None = None
    lyrics: Callable[[DataFrame], DataFrame] | None = None
    align: Callable[[DataFrame], DataFrame] | None = None


def default_stages(x: Sources) -> dict[str, Stage]:
    """All stages over the sources of a video."""
    return {
        "ingest": ingest_stage(x.probe), "shots": shots_stage(x.cuts, x.decoded), "frames": frames_stage(x.look, x.flow), "transcribe": transcribe_stage(x.speech, x.regions, x.lyrics, x.align),
        "caption": caption_stage(x.ask), "embed": embed_stage(x.images, x.sounds, x.texts, x.audio_s),
    }


class Runner:
    """Runs stages of a video and records their states. Writes to the store follow one another; the work itself does not."""

    def __init__(self, store: SnapshotStore, stages: dict[str, Stage], config: Config) -> None:
        self.store, self.stages, self.config = store, stages, config

    def status(self, video_id: str, stage: str) -> str:
        """The state of a stage; pending without a row."""
        row = self.store.read("jobs").filter((F.col("video_id") == video_id) & (F.col("stage") == stage)).select("status").first()
        return row["status"] if row else jobs.PENDING

    def mark(self, video_id: str, stages: list[str], status: str, error: str | None = None) -> None:
        """Set the state of stages; an error not given is cleared."""
        rows = self.store.spark.createDataFrame([(video_id, s, status, error) for s in stages], "video_id string, stage string, status string, error string")
        self.store.update("jobs", lambda old: jobs.set_status(old, rows))

    def run_stage(self, video_id: str, stage: str, force: bool = False) -> bool:
        """Run a stage unless it is done; its consumers become pending first. False if it was skipped; errors are recorded and raised."""
        if not force and self.status(video_id, stage) == jobs.DONE:
            return False
        if DOWNSTREAM[stage]:
            self.mark(video_id, list(DOWNSTREAM[stage]), jobs.PENDING)
        self.mark(video_id, [stage], jobs.RUNNING)
        try:
            self.stages[stage](self.store, video_id, self.config)
        except Exception as error:
            self.mark(video_id, [stage], jobs.FAILED, str(error)[:500])
            raise
        self.mark(video_id, [stage], jobs.DONE)
        return True

    def index(self, video_id: str, force: bool = False) -> list[str]:
        """All stages in order; the failed ones are returned. A failed caption stage does not stop the others, any other failure is raised."""
        for stage in ("ingest", "shots", "frames"):
            self.run_stage(video_id, stage, force)
        wanted = ["transcribe", *(["caption"] if self.config.with_captions else [])]
        if self.config.overlap and len(wanted) == 2 and all(force or self.status(video_id, s) != jobs.DONE for s in wanted):
            with ThreadPoolExecutor(2) as pool:
                running = {s: pool.submit(self.run_stage, video_id, s, force) for s in wanted}
                errors = {s: f.exception() for s, f in running.items()}
            if errors["transcribe"]:
                raise errors["transcribe"]
        else:
            for stage in wanted:
                try:
                    self.run_stage(video_id, stage, force)
                except Exception:
                    if stage != "caption":
                        raise
        self.run_stage(video_id, "embed", force)
        own = self.store.read("jobs").filter(F.col("video_id") == video_id)
        return [s for r in jobs.failed_stages(own).collect() for s in sorted(r["failed"], key=STAGES.index)]


def ingest_stage(probe: Callable[[str], DataFrame]) -> Stage:
    """Video rows from probed media: the rate is snapped, the length comes from the frame count. ValueError if no known rate is near, or streams start apart."""
    def run(store: SnapshotStore, video_id: str, config: Config) -> None:
        rows = probe(video_id)
        num, den = media.parse_rate(F.col("rate"))
        snapped = media.snap_rate(media.fps(num, den))
        rows = rows.withColumn("r", snapped).withColumn("fps_num", F.col("r.num")).withColumn("fps_den", F.col("r.den"))
        bad = rows.filter(F.col("r").isNull() | media.skewed(F.col("audio_offset_s"), F.lit(0.0))).first()
        if bad:
            raise ValueError(f"rate {bad['rate']} is unknown, or streams start {bad['audio_offset_s']} s apart")
        rows = rows.withColumn("duration_s", media.span_s(F.col("frame_count"), F.col("fps_num"), F.col("fps_den")))
        store.update("videos", lambda old: upsert(old, rows.select(*[c for c in old.columns if c in rows.columns]), ["video_id"], keep=["has_speech"]))

    return run


def _video(store: SnapshotStore, video_id: str) -> DataFrame:
    """The video with fps, span and last frame. LookupError if it was not ingested."""
    rows = store.read("videos").filter(F.col("video_id") == video_id)
    if rows.isEmpty():
        raise LookupError(f"no video {video_id}; it must be ingested first")
    return rows.withColumns({"fps": media.fps(F.col("fps_num"), F.col("fps_den")), "span": media.span_s(F.col("frame_count"), F.col("fps_num"), F.col("fps_den")), "last": F.col("frame_count") - 1})


def _of(store: SnapshotStore, video_id: str, *kinds: str) -> DataFrame:
    return store.read("segments").filter((F.col("video_id") == video_id) & F.col("kind").isin(*kinds))


def _framed(rows: DataFrame, video: DataFrame) -> DataFrame:
    """Rows (video_id, kind, s, e, payload, ...) as segments with the frames that they touch."""
    rows = rows.join(F.broadcast(video.select("video_id", "fps", "span", "last")), "video_id").withColumn("frame_start", media.first_frame(F.col("s"), F.col("fps"), F.col("last")))
    rows = rows.withColumn("frame_end", media.last_frame(F.col("e"), F.col("fps"), F.col("last"), F.col("frame_start"), F.col("span")))
    return rows.withColumnsRenamed({"s": "t_start_s", "e": "t_end_s"}).drop("fps", "span", "last")


def _shot_index(payload: str = "payload") -> Column:
    return whole_text(text_at(parsed(F.col(payload)), "$.shot_index"))


def shots_stage(cuts: Callable[[str], DataFrame], decoded: Callable[[str], int] | None = None) -> Stage:
    """Shots from raw scenes: short ones are merged, times follow the video clock; a video without scenes is one shot. Frames of older shots go too.

    ValueError if the cutter decoded a number of frames that differs from the video's by more than a few; else the smaller number bounds all shots.
    """
    def run(store: SnapshotStore, video_id: str, config: Config) -> None:
        video = _video(store, video_id)
        counted = video.first()["frame_count"]
        read = decoded(video_id) if decoded else counted
        if abs(read - counted) > config.max_decode_mismatch:
            raise ValueError(f"{read} frames were decoded, but the video has {counted}")
        usable = min(read, counted)
        scenes = folds.reconciled(cuts(video_id), video.select("video_id", F.lit(usable).alias("usable")))
        merged = folds.merge_micro_shots(scenes, "video_id").join(F.broadcast(video.select("video_id", "fps_num", "fps_den")), "video_id")
        index = F.row_number().over(Window.partitionBy("video_id").orderBy("s", "e")) - 1
        first = F.greatest(F.lit(0), F.least(F.lit(usable - 1), F.col("s")))
        placed = merged.withColumn("shot_index", index).withColumn("a", first).withColumn("b", F.greatest(F.col("a"), F.least(F.lit(usable - 1), F.col("e") - 1)))
        t = lambda f: media.frame_time(f, F.col("fps_num"), F.col("fps_den"))
        payload = F.to_json(F.struct("shot_index", F.lit(read - counted).alias("decode_mismatch_frames")))
        rows = placed.select("video_id", F.lit("shot").alias("kind"), t(F.col("a")).alias("t_start_s"), t(F.col("b") + 1).alias("t_end_s"), F.col("a").alias("frame_start"), F.col("b").alias("frame_end"), payload.alias("payload"))
        store.update("segments", lambda old: replace_segments(old, rows, ["shot", "frame"], videos=video))

    return run


def frames_stage(look: Callable[[DataFrame], DataFrame], flow: Callable[[DataFrame], DataFrame]) -> Stage:
    """Frames of all shots: candidates, people, near-duplicates; and the camera motion of each shot, in one commit. Pictures that no row names are deleted."""
    def run(store: SnapshotStore, video_id: str, config: Config) -> None:
        video = _video(store, video_id)
        shots = _of(store, video_id, "shot").select("id", "video_id", F.col("frame_start").alias("a"), F.col("frame_end").alias("b"), _shot_index().alias("shot_index"))
        shots = shots.join(F.broadcast(video.select("video_id", "media_path", "fps", "fps_num", "fps_den")), "video_id")
        if shots.isEmpty():
            raise LookupError(f"no shots of {video_id}")
        made = frames.candidate_frames(F.col("a"), F.col("b"), F.col("fps"), config.keyframe_interval_s)
        wanted = shots.withColumn("c", made).withColumn("rep", frames.nearest_to_middle(F.col("c"), F.col("a"), F.col("b"))).select("video_id", "media_path", "shot_index", "rep", "fps_num", "fps_den", F.explode("c").alias("frame"))
        seen = cut_lineage(look(wanted.select("video_id", "media_path", "frame").distinct()))
        people = frames.people(F.col("boxes"), F.col("width"), F.col("height"))
        looked = wanted.join(seen, ["video_id", "frame"]).withColumn("people", people["count"]).withColumn("area", people["max_area_share"]).withColumn("is_rep", F.col("frame") == F.col("rep"))
        kept = folds.drop_near_duplicates(looked.select("video_id", "shot_index", "frame", F.col("frame").alias("id"), "dhash", "people", "is_rep"), ["video_id", "shot_index"])
        rows = looked.join(kept.select("video_id", "shot_index", F.col("id").alias("frame")), ["video_id", "shot_index", "frame"])
        folder = config.workdir / "media"
        if "content" in seen.columns:
            rows = rows.join(write_frames(rows.select("video_id", "frame", "content").dropDuplicates(["video_id", "frame"]), str(folder)), ["video_id", "frame"])
        else:
            rows = rows.withColumn("frame_path", F.format_string("frames/f%08d.jpg", "frame"))
        payload = F.to_json(F.struct("frame_path", F.col("shot_index").try_cast("bigint").alias("shot_index"), F.col("is_rep").alias("is_representative"), "dhash", F.col("people").alias("person_count"), F.col("area").alias("person_max_area_frac")))
        t = lambda f: media.frame_time(f, F.col("fps_num"), F.col("fps_den"))
        rows = cut_lineage(rows.select("video_id", F.lit("frame").alias("kind"), t(F.col("frame")).alias("t_start_s"), t(F.col("frame") + 1).alias("t_end_s"), F.col("frame").alias("frame_start"), F.col("frame").alias("frame_end"), payload.alias("payload")))

        pairs = shots.select("id", "media_path", F.explode_outer(frames.motion_pairs(F.col("a"), F.col("b"), F.col("fps"))).alias("p"))
        moved = flow(pairs.filter("p is not null").select("id", "media_path", "p.p0", "p.p1"))
        label = frames.motion_label(F.col("features"), F.col("diff"), F.col("scale"), F.col("dx"), F.col("dy"))
        evidence = F.struct("p0", label.alias("label"), "features", "diff", "scale", "dx", "dy")
        voted = moved.groupBy("id").agg(F.array_sort(F.collect_list(evidence)).alias("evidence"))  # at most three pairs a shot
        voted = shots.select("id").join(voted, "id", "left").withColumn("labels", F.coalesce(F.transform("evidence", lambda e: e["label"]), F.expr("cast(array() as array<string>)")))
        changes = F.struct(frames.motion_vote(F.col("labels")).alias("camera_motion"), F.lit("sparse_flow_partial_affine").alias("motion_method"), F.struct(F.col("labels").alias("pairs"), F.transform("evidence", lambda e: e.dropFields("p0", "label")).alias("evidence")).alias("motion_evidence"))
        patches = cut_lineage(voted.select("id", F.to_json(changes).alias("updates")))
        store.update("segments", lambda old: replace_segments(old, rows, ["frame"], checked_patches(old, patches)))

        own = folder / video_id
        if own.is_dir():
            files = store.spark.createDataFrame([(str(x), str(x.relative_to(own))) for x in own.glob("frames/*.jpg")], "path string, name string")
            prune_files(orphan_files(files, rows.select(text_at(parsed(F.col("payload")), "$.frame_path").alias("name"))))

    return run


def transcribe_stage(speech: Callable[[str], DataFrame | None], regions: Callable[[str], DataFrame], lyrics: Callable[[DataFrame], DataFrame] | None = None, align: Callable[[DataFrame], DataFrame] | None = None) -> Stage:
    """Speech, music, noise, lyrics, speech regions and silence. Lyrics of earlier runs stay where no source of lyrics is given; without audio only the speech flag is set.

    Words keep what the recogniser said; where there is an aligner, those that it moves are cut to their sentence, and sentences that it leaves out stay as they are.
    """
    def run(store: SnapshotStore, video_id: str, config: Config) -> None:
        video = _video(store, video_id)
        told = speech(video_id)
        if told is None:
            store.update("videos", lambda old: set_has_speech(old, video_id, False))
            return
        span = video.select("video_id", "span")
        found = regions(video_id)
        music, noise = (cut_lineage(intervals.merge(found.filter(F.col("kind") == k), "video_id")) for k in ("music", "noise"))
        said = told.filter(intervals.passes_guards(F.col("no_speech_prob"), F.col("avg_logprob"), F.col("text")))
        said = said.join(intervals.overlap_share(said, music, "video_id", "sid", name="music"), "sid").filter("music < 0.5")
        said = said.join(intervals.overlap_share(said, noise, "video_id", "sid", name="noise"), "sid")
        if "words" not in said.columns:
            said = said.withColumn("words", F.expr("cast(null as array<struct<w:string,t0:double,t1:double,prob:double>>)"))
        said = cut_lineage(said)
        if align is not None:
            better = align(said.filter("size(words) > 0").select("sid", "s", "e", "words")).select("sid", F.col("words").alias("better"))
            moved = words.repair_words(words.clamp_words(F.col("better"), F.col("s"), F.col("e")), F.col("s"), F.col("e"))
            said = cut_lineage(said.join(better, "sid", "left").withColumn("words", F.coalesce(moved, "words")).drop("better"))
        own = F.to_json(F.struct(
            F.trim("text").alias("text"), "words", "no_speech_prob", "avg_logprob", F.lit(True).alias("music_gate_active"),
            F.when(F.col("music") > 0, F.round("music", 3)).alias("music_overlap_frac"), F.when(F.col("noise") >= 0.5, F.lit(True)).alias("noise_overlap"),
        ))
        parts = [said.select("video_id", F.lit("speech").alias("kind"), "s", "e", own.alias("payload"))]
        pad, quiet = intervals.padded(said, span, "video_id", 0.1), intervals.silence(said, music, span, "video_id", 0.1)
        for kind, rows in (("speech_region", pad), ("silence", quiet), ("music", music), ("noise", noise)):
            s, e = media.clip(F.col("s"), F.col("e"), F.col("span"))
            parts.append(rows.join(span, "video_id").select("video_id", F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), F.lit("{}").alias("payload")).filter("s < e"))
        kinds = ["speech", "speech_region", "silence", "music", "noise"]
        if lyrics is not None:
            sung = lyrics(music).filter(F.trim("text") != "").withColumn("lid", F.monotonically_increasing_id())
            sung = cut_lineage(sung)
            sung = sung.join(intervals.overlap_share(sung, music, "video_id", "lid", name="music"), "lid")
            text = F.to_json(F.struct(F.trim("text").alias("text"), F.round("music", 3).alias("music_overlap"), F.lit(True).alias("advisory")))
            parts.append(sung.select("video_id", F.lit("lyrics").alias("kind"), "s", "e", text.alias("payload")))
            kinds.append("lyrics")
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows, spoken = cut_lineage(_framed(rows, video)), not said.isEmpty()
        with store.lock:
            store.commit({"segments": replace_segments(store.read("segments"), rows, kinds, videos=video), "videos": set_has_speech(store.read("videos"), video_id, spoken)})

    return run


def caption_stage(ask: Callable[[str], str]) -> Stage:
    """Captions of the representative frames, asked in the order of the shots; the errors of shots are noted in their payloads, and those of earlier runs cleared.

    RuntimeError after too many failures in a row, or if all fail: then captions of earlier runs stay.
    """
    def run(store: SnapshotStore, video_id: str, config: Config) -> None:
        video, base = _video(store, video_id), str(config.workdir / "media" / video_id)
        shots = _of(store, video_id, "shot").withColumn("shot_index", _shot_index())
        if shots.isEmpty():
            raise LookupError(f"no shots of {video_id}")
        v = parsed(F.col("payload"))
        reps = _of(store, video_id, "frame").filter(text_at(v, "$.is_representative") == "true")
        reps = reps.groupBy(_shot_index().alias("shot_index")).agg(F.max_by(F.struct(text_at(v, "$.frame_path").alias("frame_path"), F.col("frame_start").alias("source_frame")), F.struct("frame_start", "id")).alias("rep"))
        placed = shots.join(reps, "shot_index", "left").select(F.col("video_id").alias("key"), F.col("frame_start").alias("position"), "id", F.concat_ws("/", F.when(F.col("rep").isNotNull(), F.lit(base)), "rep.frame_path").alias("p"), "rep")
        asked = placed.select("key", "position", "id", F.when(F.col("rep").isNotNull(), F.col("p")).alias("frame_path"))
        outcomes = cut_lineage(requests.requested(asked, ask, parallel=config.caption_parallel, limit=config.caption_failures_max))
        failed = outcomes.filter("reply is null")
        if tripped := outcomes.filter("tripped").first():
            raise RuntimeError(f"{config.caption_failures_max} requests in a row failed; last: {tripped['error']}")
        if outcomes.filter("reply is not null").isEmpty() and (first := failed.first()):
            raise RuntimeError(f"all requests failed; first: {first['error']}")
        told = outcomes.filter("reply is not null").select("id", captions.typed_reply(F.col("reply")).alias("c"))
        joined = told.join(shots, "id").join(reps, "shot_index")
        payload = F.to_json(F.struct(F.col("shot_index").try_cast("bigint").alias("shot_index"), "rep.source_frame", "rep.frame_path", "c.shot_type", "c.people_count", "c.setting", "c.on_screen_text", "c.objects", "c.description", F.lit(True).alias("advisory")))
        rows = cut_lineage(joined.select("video_id", F.lit("caption").alias("kind"), "t_start_s", "t_end_s", "frame_start", "frame_end", payload.alias("payload")))
        notes = outcomes.select("id", F.to_json(F.struct(F.col("error").alias("caption_error")), {"ignoreNullFields": "false"}).alias("updates"))
        store.update("segments", lambda old: replace_segments(old, rows, ["caption"], notes, videos=video))

    return run


def embed_stage(images: Callable[[DataFrame], DataFrame], sounds: Callable[[DataFrame], DataFrame], texts: Callable[[], Encoder], audio_s: Callable[[str], float | None]) -> Stage:
    """Vectors of audio windows, frames, transcript windows and captions. What has not changed since the last run costs its comparison and no model.

    Audio windows tile what video and audio both cover; without audio those of earlier runs go. Transcript windows go when speech is gone.
    """
    def run(store: SnapshotStore, video_id: str, config: Config) -> None:
        video = _video(store, video_id)
        _audio_windows(store, video_id, video, sounds, audio_s(video_id), config.models["audio"])
        todo = unembedded(store.read("segments"), "frame", None, video_id)
        stored = search.stored_models(store.read("segments"), ["frame"], video_id).collect()
        if {r["model_name"] for r in stored} - {config.models["image"]}:  # a space of two models would lose half of its hits
            todo = unembedded(store.read("segments"), "frame", config.models["image"], video_id)
        _attach(store, video_id, "frame", todo, images)
        _speech_windows(store, video_id, video, texts)
        described = F.regexp_replace(F.coalesce(text_at(parsed(F.col("payload")), "$.description"), F.lit("")), r"^\s+|\s+$", "")
        lacking = _of(store, video_id, "caption").join(unembedded(store.read("segments"), "caption", texts().name, video_id), "id", "left_semi").filter(described != "")
        _attach(store, video_id, "caption", lacking.select("id"), lambda rows: _text_vectors(rows.withColumn("text", described), texts).select("id", "embedding", "model_name", "dim"))

    return run


def _text_vectors(rows: DataFrame, texts: Callable[[], Encoder]) -> DataFrame:
    encoder = texts()
    return rows.withColumns({"embedding": embed(F.col("text"), texts), "model_name": F.lit(encoder.name), "dim": F.lit(encoder.dim)})


def _attach(store: SnapshotStore, video_id: str, kind: str, todo: DataFrame, vectors: Callable[[DataFrame], DataFrame]) -> None:
    rows = _of(store, video_id, kind).join(todo, "id", "left_semi")
    if not rows.isEmpty():
        made = cut_lineage(vectors(rows))
        store.update("segments", lambda old: attach(old, made))


def _audio_windows(store: SnapshotStore, video_id: str, video: DataFrame, sounds: Callable[[DataFrame], DataFrame], seconds: float | None, model: str) -> None:
    stored = _of(store, video_id, "audio_window")
    if seconds is None:
        if not stored.isEmpty():
            store.update("segments", lambda old: delete_segments(old, video_id, "audio_window"))
        return
    span = video.select("video_id", F.least("span", F.lit(float(seconds))).alias("span"))
    held = stored.select("video_id", F.col("t_start_s").alias("s"), F.col("t_end_s").alias("e"), text_at(parsed(F.col("payload")), "$.win_s").try_cast("double").alias("win_s"), F.when(F.col("embedding").isNotNull(), F.col("model_name")).alias("model_name"))
    same = tiling_matches(held, span, model=model).filter(F.col("video_id") == video_id).first()
    if same and same["reusable"] or not same and stored.isEmpty():
        return
    tiles = frames.tile(span, "video_id")
    rows = _framed(tiles.withColumns({"kind": F.lit("audio_window"), "payload": F.to_json(F.struct(F.lit(10.0).alias("win_s")))}), video)
    vectors = sounds(tiles).select("video_id", F.col("s").alias("t_start_s"), F.col("e").alias("t_end_s"), "embedding", "model_name", "dim")
    made = cut_lineage(rows.join(vectors, ["video_id", "t_start_s", "t_end_s"], "left"))
    store.update("segments", lambda old: append(delete_segments(old, video_id, "audio_window"), made))


def _speech_windows(store: SnapshotStore, video_id: str, video: DataFrame, texts: Callable[[], Encoder]) -> None:
    v = parsed(F.col("payload"))
    speech = _of(store, video_id, "speech").select("video_id", "id", F.col("t_start_s").alias("s"), F.col("t_end_s").alias("e"), text_at(v, "$.text").alias("text"))
    packed, stored = cut_lineage(folds.pack_windows(speech, "video_id")), _of(store, video_id, "speech_window")
    ids = F.transform(search.window_source_ids(F.col("payload")), lambda x: whole_text(x).try_cast("bigint"))
    held = stored.select("video_id", F.col("t_start_s").alias("s"), F.col("t_end_s").alias("e"), text_at(v, "$.text").alias("text"), ids.alias("source_ids"))
    same = windows_match(held, packed).first()
    if same is None or same["matches"] and unembedded(stored, "speech_window", texts().name).isEmpty():
        return
    payload = F.to_json(F.struct("text", F.col("source_ids").alias("source_speech_ids")))
    rows = _framed(_text_vectors(packed, texts).withColumns({"kind": F.lit("speech_window"), "payload": payload}), video).drop("text", "source_ids")
    made = cut_lineage(rows)
    store.update("segments", lambda old: append(delete_segments(old, video_id, "speech_window"), made))
