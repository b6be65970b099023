import json
import time

import pytest
from pyspark.sql import functions as F

from cutloom.config import Config
from cutloom.models import HashEncoder
from cutloom.operators.requests import in_order
from cutloom.operators.store import SnapshotStore
from cutloom.pipeline import Runner, Sources, default_stages

REPLY = {"shot_type": "WS", "people_count": 1, "setting": "pier", "on_screen_text": None, "objects": ["boat"], "description": " A boat lies at the pier. "}


def ask(path):
    if path.endswith("99999999.jpg"):
        raise OSError("no such frame")
    return json.dumps(REPLY)


def texts():
    return HashEncoder("sentenc-small-v1", 8)


class Made:
    """Sources of one video; attributes may be changed between runs."""

    def __init__(self, spark):
        self.spark, self.ran = spark, []
        self.scenes, self.sentences, self.lines, self.frame_count, self.decoded, self.seconds, self.ask = [(0, 100), (100, 103), (103, 299)], [("hello there", 1.0, 2.0), ("sung", 4.0, 5.0), ("noise", 6.0, 7.0)], None, 299, 299, 9.0, ask

    def sources(self):
        df = lambda rows, names: self.spark.createDataFrame(rows, names)
        words = "array<struct<w:string,t0:double,t1:double,prob:double>>"

        def vectors(what, model, *keys):
            def run(rows):
                self.ran.append(what)
                return rows.select(*keys, F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>").alias("embedding"), F.lit(model).alias("model_name"), F.lit(2).alias("dim"))

            return run

        def look(rows):
            box = F.array(F.struct(F.lit(1).alias("label"), F.lit(0.9).alias("score"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("x1"), F.lit(10.0).alias("y1")))
            return rows.select("video_id", "frame", F.lpad(F.hex(F.col("frame") * 1_000_003), 16, "0").alias("dhash"), box.alias("boxes"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), F.encode(F.col("frame").cast("string"), "utf-8").alias("content"))

        def flow(rows):
            return rows.select("id", "p0", F.lit(40.0).alias("features"), F.lit(3.0).alias("diff"), F.lit(1.0).alias("scale"), F.lit(0.2).alias("dx"), F.lit(0.01).alias("dy"))

        def told(v):
            if self.sentences is None:
                return None
            rows = [(v, i, s, e, t, 0.9 if t == "noise" else 0.1, -0.2, [(w, s, s, 0.5) for w in t.split()]) for i, (t, s, e) in enumerate(self.sentences)]
            return df(rows, f"video_id string, sid long, s double, e double, text string, no_speech_prob double, avg_logprob double, words {words}")

        def align(rows):
            return rows.select("sid", F.transform("words", lambda w, i: F.struct(w["w"].alias("w"), (w["t0"] - 1).alias("t0"), (w["t0"] + 5 * i).alias("t1"), w["prob"].alias("prob"))).alias("words"))

        return Sources(
            "v", probe=lambda v: df([(v, "m.mp4", "x", "2997/100", self.frame_count, "h264", 0.0)], "video_id string, media_path string, media_hash string, rate string, frame_count long, codec string, audio_offset_s double"),
            cuts=lambda v: df([(v, *x) for x in self.scenes], "video_id string, s long, e long"), decoded=lambda v: self.decoded, look=look, flow=flow, speech=told,
            regions=lambda v: df([(v, "music", 3.9, 5.5), (v, "noise", 0.0, 0.2)], "video_id string, kind string, s double, e double"), align=align, ask=lambda p: self.ask(p),
            lyrics=self.lines and (lambda music: music.select("video_id", "s", "e", F.lit(" la la ").alias("text"))), images=vectors("images", "pictower-v2", "id"), sounds=vectors("sounds", "soundtower-v1", "video_id", "s", "e"), texts=texts, audio_s=lambda v: self.seconds,
        )


@pytest.fixture
def made(spark):
    return Made(spark)


@pytest.fixture
def runner(made, spark, tmp_path):
    def build():
        x = made.sources()
        x.ask = made.ask
        return Runner(store, default_stages(x), Config.for_workdir(tmp_path))

    store = SnapshotStore(spark, tmp_path)
    return build


def segments(store, *kinds):
    rows = store.read("segments").filter(F.col("kind").isin(*kinds)).orderBy("t_start_s", "id").collect()
    return [r.asDict() | {"payload": json.loads(r["payload"])} for r in rows]


def test_index(runner, made, tmp_path):
    run = runner()
    assert run.index("v") == []
    store = run.store
    at = lambda kind: [(round(r["t_start_s"], 3), round(r["t_end_s"], 3)) for r in segments(store, kind)]
    assert at("speech") == [(1.0, 2.0)] and at("speech_region") == [(0.9, 2.1)] and at("silence") == [(0.0, 0.9), (2.1, 3.9), (5.5, 9.977)] and at("lyrics") == []
    assert [w["t0"] for w in segments(store, "speech")[0]["payload"]["words"]] == [1.0, 1.0] and [w["t1"] for w in segments(store, "speech")[0]["payload"]["words"]] == [1.02, 2.0]
    shots = segments(store, "shot")
    assert [(r["frame_start"], r["frame_end"], r["payload"]["shot_index"], r["payload"]["camera_motion"], r["payload"]["caption_error"]) for r in shots] == [(0, 99, 0, "pan", None), (100, 298, 1, "pan", None)]
    frames = segments(store, "frame")
    assert sum(r["payload"]["is_representative"] for r in frames) == 2 and all(r["embedding"] and r["payload"]["person_count"] == 1 for r in frames)
    assert all((tmp_path / "media/v" / r["payload"]["frame_path"]).read_text() == str(r["frame_start"]) for r in frames)
    assert [(r["payload"]["description"], r["payload"]["on_screen_text"], r["model_name"], r["dim"]) for r in segments(store, "caption")] == [("A boat lies at the pier.", "", "sentenc-small-v1", 8)] * 2
    assert at("audio_window") == [(0.0, 9.0)] and [(r["frame_start"], r["frame_end"]) for r in segments(store, "audio_window")] == [(0, 269)]
    assert [(r["payload"]["text"], r["model_name"]) for r in segments(store, "speech_window")] == [("hello there", "sentenc-small-v1")]
    assert store.read("videos").first()["has_speech"] is True
    assert run.index("v") == [] and len(made.ran) == 2  # all are done
    before = {r["id"] for r in segments(store, "audio_window", "speech_window", "frame", "caption")}
    run.run_stage("v", "embed", force=True)
    assert len(made.ran) == 2 and {r["id"] for r in segments(store, "audio_window", "speech_window", "frame", "caption")} == before  # nothing has changed: no model runs
    run.run_stage("v", "frames", force=True)
    assert run.status("v", "embed") == run.status("v", "caption") == "pending"
    assert len(list((tmp_path / "media/v/frames").iterdir())) == len(segments(store, "frame"))


def test_what_is_gone_and_what_stays(runner, made, spark):
    made.lines = True
    run = runner()
    for stage in ("ingest", "shots", "transcribe", "embed"):
        run.run_stage("v", stage)
    assert [r["payload"] for r in segments(run.store, "lyrics")] == [{"text": "la la", "music_overlap": 1.0, "advisory": True}]
    first = segments(run.store, "speech_window")[0]
    made.lines, made.ran = None, []
    run = runner()
    run.run_stage("v", "transcribe", force=True)
    assert len(segments(run.store, "lyrics")) == 1  # no source of lyrics: those of the first run stay
    run.run_stage("v", "embed")
    again = segments(run.store, "speech_window")[0]
    assert again["payload"]["source_speech_ids"] != first["payload"]["source_speech_ids"] and again["payload"]["source_speech_ids"] == [r["id"] for r in segments(run.store, "speech")]
    assert made.ran == []  # the audio has not changed
    made.sentences, made.seconds = [], None
    run.run_stage("v", "transcribe", force=True)
    run.run_stage("v", "embed")
    assert segments(run.store, "speech", "speech_window", "audio_window") == [] and run.store.read("videos").first()["has_speech"] is False
    made.sentences, kept = None, len(segments(run.store, "silence"))
    run.run_stage("v", "transcribe", force=True)
    assert len(segments(run.store, "silence")) == kept


def test_shots_of_odd_decodes(runner, made):
    run = runner()
    run.run_stage("v", "ingest")
    made.decoded, made.scenes = 297, []
    run.run_stage("v", "shots")
    assert [(r["frame_start"], r["frame_end"]) for r in segments(run.store, "shot")] == [(0, 296)]
    made.decoded, made.scenes = 300, [(0, 150), (150, 300)]
    run.run_stage("v", "shots", force=True)
    assert [(r["frame_start"], r["frame_end"]) for r in segments(run.store, "shot")] == [(0, 149), (150, 298)]
    made.decoded = 290
    with pytest.raises(ValueError):
        run.run_stage("v", "shots", force=True)
    assert len(segments(run.store, "shot")) == 2 and run.status("v", "shots") == "failed"


def broken(path):
    raise OSError("server is gone")


def test_captions_of_earlier_runs_outlive_a_failure(runner, made):
    run = runner()
    assert run.index("v") == []
    before = segments(run.store, "caption")
    assert len(before) == 2
    made.ask = broken
    run = runner()
    with pytest.raises(RuntimeError):
        run.run_stage("v", "caption", force=True)
    assert segments(run.store, "caption") == before and run.status("v", "caption") == "failed"
    assert run.index("v") == ["caption"] and run.status("v", "embed") == "done"


def test_requests_in_order_with_retry_and_breaker():
    asked = []

    def slow_first(path):
        asked.append(path)
        time.sleep(0.2 if path == "0" else 0.0)
        return json.dumps(REPLY)

    out = list(in_order([(i, str(i)) for i in range(6)], slow_first, parallel=3))
    assert [x[0] for x in out] == list(range(6)) and all(x[1] and not x[3] for x in out)

    times = {}

    def second_time(path):
        times[path] = times.get(path, 0) + 1
        return json.dumps(REPLY) if times[path] > 1 else "{}"

    assert all(x[1] for x in in_order([(1, "a"), (2, "b")], second_time)) and times == {"a": 2, "b": 2}

    asked.clear()

    def fails(path):
        asked.append(path)
        return "[]"

    out = list(in_order([(0, None), *((i, str(i)) for i in range(1, 50))], fails, parallel=2, limit=3, tries=2))
    assert [(x[0], x[2], x[3]) for x in out] == [(0, "no representative frame", False), (1, "not an object", False), (2, "not an object", False), (3, "not an object", True)]
    assert len(asked) <= 10  # the rest is never asked


def test_index_command(spark, tmp_path, monkeypatch, capsys):
    import sys
    import types

    from cutloom.cli import main

    module = types.ModuleType("made_sources")
    module.build = lambda spark, source: Made(spark).sources()
    monkeypatch.setitem(sys.modules, "made_sources", module)
    assert main(["--data", str(tmp_path), "index", "m.mp4", "--sources", "made_sources:build", "--keyframe-interval", "0"], spark) == 2
    assert main(["--data", str(tmp_path), "index", "m.mp4", "--sources", "made_sources:build", "--no-captions"], spark) == 0
    assert {r["kind"] for r in SnapshotStore(spark, tmp_path).read("segments").select("kind").distinct().collect()} >= {"shot", "frame", "speech", "speech_window", "audio_window"}
