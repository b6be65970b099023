"""Queries of the index's own operators over the tables of a data directory, each with its SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom.config import FPS_RATES, SPACE_KINDS
from cutloom.functions import captions, media, text, vectors
from cutloom.functions.values import parsed, text_at, truthy, whole_text
from cutloom.models import HashEncoder
from cutloom.operators import acceptance, folds, frames, intervals, jobs, listing, search, store, words
from cutloom.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The video of the list and search examples, and the models of the spaces.
VIDEO = "harbour-cam-archive"
MODELS = {"image": "pictower-v2", "text": "sentenc-small-v1", "audio": "soundtower-v1"}

_SEG = "seg AS (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"
_SPANS = "spans AS (SELECT video_id, CAST(fps_num AS DOUBLE) / fps_den AS fps, frame_count * CAST(fps_den AS DOUBLE) / fps_num AS span, frame_count - 1 AS last FROM videos)"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def seg(spark: SparkSession, d: str, *columns: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Segments once per id, of some kinds, with only the columns asked for, before anything is shuffled."""
    rows = table(spark, d, "segments")
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    rows = rows.select("id", *[c for c in columns if c != "id"], "ingested_at")
    return listing.first_delivery(rows, ["id"], "ingested_at").drop("ingested_at")


def spans(spark: SparkSession, d: str) -> DataFrame:
    """video_id, fps, span and last frame of each video."""
    v = table(spark, d, "videos")
    return v.select("video_id", media.fps(F.col("fps_num"), F.col("fps_den")).alias("fps"), media.span_s(F.col("frame_count"), F.col("fps_num"), F.col("fps_den")).alias("span"), (F.col("frame_count") - 1).alias("last"))


# --- the list contract -------------------------------------------------------------------------------------------------

_LIST = "SELECT id, video_id, kind, t_start_s, t_end_s, frame_start, frame_end, model_name, dim, payload FROM seg "


def _listed(spark: SparkSession, d: str, **wanted) -> DataFrame:
    return listing.list_delivered(table(spark, d, "segments"), VIDEO, **wanted)


@query(f"WITH {_SEG} {_LIST} WHERE video_id = '{VIDEO}' AND kind = 'shot' ORDER BY t_start_s, id")
def list_by_kind(spark, d):
    return _listed(spark, d, kind="shot")


@query(f"WITH {_SEG} {_LIST} WHERE video_id = '{VIDEO}' AND t_start_s < 9000 AND t_end_s > 8000 ORDER BY t_start_s, id")
def list_time_range(spark, d):
    return _listed(spark, d, between=(8000.0, 9000.0))


@query(f"WITH {_SEG} {_LIST} WHERE video_id = '{VIDEO}' AND kind = 'frame' AND json_extract_string(payload, '$.is_representative') = 'true' AND CAST(json_extract_string(payload, '$.person_count') AS DOUBLE) = 1")
def list_payload_filter(spark, d):
    return _listed(spark, d, kind="frame", filters={"is_representative": True, "person_count": 1})


@query(f"WITH {_SEG} {_LIST} WHERE video_id = '{VIDEO}' AND kind = 'shot' AND t_start_s < 5000 AND t_end_s > 0 AND json_extract_string(payload, '$.camera_motion') = 'pan'")
def list_combined(spark, d):
    return _listed(spark, d, kind="shot", filters={"camera_motion": "pan"}, between=(0.0, 5000.0))


@query(f"WITH {_SEG} {_LIST} WHERE video_id = '{VIDEO}' AND kind = 'shot' AND coalesce(json_type(payload, '$.motion_evidence'), 'NULL') = 'NULL'")
def list_payload_missing_is_null(spark, d):
    return _listed(spark, d, kind="shot", filters={"motion_evidence": None})


@query(f"SELECT video_id, source_url, fps_num, fps_den, frame_count, duration_s, codec, color_normalized FROM videos WHERE video_id = '{VIDEO}'")
def video_lookup(spark, d):
    return listing.get_video(table(spark, d, "videos"), VIDEO).select("video_id", "source_url", "fps_num", "fps_den", "frame_count", "duration_s", "codec", "color_normalized")


@query(f"WITH {_SEG} {_LIST} WHERE id IN (1, 5, 17, 123, 400, 999999999)")
def segments_by_ids(spark, d):
    return listing.segments_by_ids(listing.first_delivery(table(spark, d, "segments").filter(F.col("id").isin(1, 5, 17, 123, 400, 999999999)).drop("embedding"), ["id"], "ingested_at"), [1, 5, 17, 123, 400, 999999999])


@query("SELECT j.video_id, v.has_speech FROM (SELECT DISTINCT video_id FROM jobs) j LEFT JOIN videos v USING (video_id)")
def has_speech_flags(spark, d):
    return listing.has_speech(table(spark, d, "videos"), table(spark, d, "jobs").select("video_id").distinct())


@query("""WITH j AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY video_id, stage ORDER BY updated_at DESC) = 1),
w AS (SELECT video_id, stage FROM videos, (VALUES ('ingest'), ('shots'), ('frames'), ('transcribe'), ('caption'), ('embed')) s(stage))
SELECT w.video_id, w.stage, coalesce(status, 'pending') AS status, coalesce(status, 'pending') = 'done' AS is_done FROM w LEFT JOIN j USING (video_id, stage)""")
def job_status_default(spark, d):
    stages = F.array(*[F.lit(s) for s in ("ingest", "shots", "frames", "transcribe", "caption", "embed")])
    wanted = table(spark, d, "videos").select("video_id", F.explode(stages).alias("stage"))
    return jobs.status_of(jobs.latest(table(spark, d, "jobs")), wanted)


@query("""WITH j AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY video_id, stage ORDER BY updated_at DESC) = 1)
SELECT video_id, list_sort(list(DISTINCT stage)) AS failed FROM j WHERE status = 'failed' GROUP BY video_id""")
def failed_stages(spark, d):
    return jobs.failed_stages(jobs.latest(table(spark, d, "jobs")))


@query("""WITH j AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY video_id, stage ORDER BY updated_at DESC) = 1),
e(stage, consumer) AS (VALUES ('shots','frames'),('shots','caption'),('shots','embed'),('frames','caption'),('frames','embed'),('transcribe','embed'),('caption','embed'))
SELECT DISTINCT video_id, consumer AS stage FROM j JOIN e USING (stage) WHERE status <> 'done'""")
def cascade_status(spark, d):
    return jobs.cascade(jobs.latest(table(spark, d, "jobs")).filter("status <> 'done'"))


@query(f"""WITH {_SEG}, t AS (SELECT id, CASE WHEN json_valid(payload) THEN coalesce(nullif(json_extract_string(payload, '$.text'), ''), nullif(json_extract_string(payload, '$.description'), ''), nullif(json_extract_string(payload, '$.frame_path'), ''), '') ELSE '' END AS p FROM seg) SELECT id, substr(p, 1, 120) AS preview FROM t""")
def preview_text(spark, d):
    rows = seg(spark, d, "payload").select("id", parsed(F.col("payload")).alias("v"))
    return rows.select("id", text.preview(*[text_at(F.col("v"), f"$.{k}") for k in ("text", "description", "frame_path")]).alias("preview"))


@query(r"SELECT doc_id, regexp_replace(coalesce(text, ''), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS body FROM documents WHERE regexp_replace(coalesce(text, ''), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') <> ''")
def trim_nonblank(spark, d):
    return table(spark, d, "documents").select("doc_id", text.stripped(F.col("text")).alias("body")).filter("body <> ''")


@query("SELECT video_id, substr(sha256(source_url), 1, 16) AS url_key, substr(source_hash, 1, 12) AS default_id, source_url LIKE 'http://%' OR source_url LIKE 'https://%' OR source_url LIKE 'www.%' AS is_url FROM videos WHERE source_url IS NOT NULL")
def sha256_ids(spark, d):
    v = table(spark, d, "videos").filter("source_url is not null")
    return v.select("video_id", media.url_key(F.col("source_url")).alias("url_key"), media.default_video_id(F.col("source_hash")).alias("default_id"), media.is_url(F.col("source_url")).alias("is_url"))


# --- media rows and clocks ---------------------------------------------------------------------------------------------

_RATES = "r AS (SELECT video_id, u.rate FROM videos, LATERAL (SELECT unnest([fps_num || '/' || fps_den, (fps_num * 1000 + 1) || '/' || (fps_den * 1000), fps_num || '/0', CAST(fps_num AS VARCHAR), 'x/' || fps_den, (fps_num * 11) || '/' || (fps_den * 10)]) AS rate) u)"


def _rates(spark: SparkSession, d: str) -> DataFrame:
    n, m = F.col("fps_num"), F.col("fps_den")
    s = lambda c: c.cast("string")
    made = F.array(F.concat_ws("/", s(n), s(m)), F.concat_ws("/", s(n * 1000 + 1), s(m * 1000)), F.concat_ws("/", s(n), F.lit("0")), s(n), F.concat_ws("/", F.lit("x"), s(m)), F.concat_ws("/", s(n * 11), s(m * 10)))
    num, den = media.parse_rate(F.col("rate"))
    return table(spark, d, "videos").select("video_id", F.explode(made).alias("rate")).select("video_id", "rate", num.alias("num"), den.alias("den"))


_PARSED = f"WITH {_RATES}, p AS (SELECT video_id, rate, try_cast(string_split(rate, '/')[1] AS BIGINT) AS n, try_cast(string_split(rate, '/')[2] AS BIGINT) AS m FROM r), q AS (SELECT video_id, rate, CASE WHEN n <> 0 AND m <> 0 THEN n END AS num, CASE WHEN n <> 0 AND m <> 0 THEN m END AS den FROM p)"


@query(_PARSED + " SELECT * FROM q")
def parse_rate(spark, d):
    return _rates(spark, d)


_KNOWN = ", ".join(f"({i}, {n}, {m})" for i, (n, m) in enumerate(FPS_RATES))


@query(_PARSED + f""", k(i, kn, kd) AS (VALUES {_KNOWN}),
b AS (SELECT video_id, rate, CAST(num AS DOUBLE) / den AS f, i, kn, kd, abs(CAST(kn AS DOUBLE) / kd - CAST(num AS DOUBLE) / den) AS off FROM q, k WHERE num IS NOT NULL),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY video_id, rate ORDER BY off, i) = 1)
SELECT video_id, rate, CASE WHEN off / f <= 0.002 THEN kn END AS snap_num, CASE WHEN off / f <= 0.002 THEN kd END AS snap_den FROM c""")
def snap_fps(spark, d):
    snapped = media.snap_rate(media.fps(F.col("num"), F.col("den")))
    return _rates(spark, d).filter("num is not null").select("video_id", "rate", snapped["num"].alias("snap_num"), snapped["den"].alias("snap_den"))


@query("SELECT video_id, CASE WHEN lower(coalesce(source_pix_fmt, '')) SIMILAR TO '.*12[lb]e.*' THEN 12 WHEN lower(coalesce(source_pix_fmt, '')) SIMILAR TO '.*10[lb]e.*' THEN 10 ELSE 8 END AS depth FROM videos")
def bit_depth(spark, d):
    return table(spark, d, "videos").select("video_id", media.bit_depth(F.col("source_pix_fmt")).alias("depth"))


_TRANSFERS = "('smpte2084','bt709'), ('bt709','bt2020nc'), (NULL,'bt709'), ('unknown',NULL), ('bt709','bt709')"


@query(f"""SELECT v.video_id, t.a AS transfer, t.b AS primaries, coalesce(lower(t.a), '') IN ('smpte2084', 'arib-std-b67') OR coalesce(lower(t.b), '') IN ('bt2020', 'bt2020nc', 'bt2020c') OR (coalesce(lower(t.a), '') IN ('', 'unknown') AND coalesce(source_bit_depth, 8) >= 10) AS needed
FROM videos v, (VALUES {_TRANSFERS}) t(a, b)""")
def color_guard(spark, d):
    n = F.lit(None).cast("string")
    made = [(F.lit("smpte2084"), F.lit("bt709")), (F.lit("bt709"), F.lit("bt2020nc")), (n, F.lit("bt709")), (F.lit("unknown"), n), (F.lit("bt709"), F.lit("bt709"))]
    pairs = F.explode(F.array(*[F.struct(x.alias("transfer"), y.alias("primaries")) for x, y in made]))
    rows = table(spark, d, "videos").select("video_id", "source_bit_depth", pairs.alias("p")).select("video_id", "source_bit_depth", "p.*")
    return rows.select("video_id", "transfer", "primaries", media.needs_color_work(F.col("transfer"), F.col("primaries"), F.col("source_bit_depth")).alias("needed"))


@query("SELECT video_id, abs(audio_offset_s - 0.0) > 0.021 AS skewed, 2 * frame_count * 1000 + 1000000000 AS bytes_needed, CASE WHEN greatest(width, height) > 1024 THEN CAST(floor(width / (greatest(width, height) / 1024.0)) AS BIGINT) ELSE width END AS w, CASE WHEN greatest(width, height) > 1024 THEN CAST(floor(height / (greatest(width, height) / 1024.0)) AS BIGINT) ELSE height END AS h FROM videos")
def ingest_guards(spark, d):
    w, h = media.downscaled(F.col("width"), F.col("height"))
    return table(spark, d, "videos").select("video_id", media.skewed(F.col("audio_offset_s"), F.lit(0.0)).alias("skewed"), media.bytes_needed(F.col("frame_count") * 1000).alias("bytes_needed"), w.cast("bigint").alias("w"), h.cast("bigint").alias("h"))


@query(f"""WITH {_SEG}, {_SPANS}, a AS (SELECT id, t_end_s, fps, span, last, least(last, greatest(0, CAST(floor(t_start_s * fps + 1e-6) AS BIGINT))) AS first_frame FROM seg JOIN spans USING (video_id) WHERE kind = 'speech')
SELECT id, first_frame, least(last, greatest(first_frame, CAST(ceil(least(t_end_s, span) * fps - 1e-6) AS BIGINT) - 1)) AS last_frame FROM a""")
def frame_bounds(spark, d):
    rows = seg(spark, d, "video_id", "t_start_s", "t_end_s", kinds=("speech",)).join(spans(spark, d), "video_id")
    rows = rows.withColumn("first_frame", media.first_frame(F.col("t_start_s"), F.col("fps"), F.col("last")))
    return rows.select("id", "first_frame", media.last_frame(F.col("t_end_s"), F.col("fps"), F.col("last"), F.col("first_frame"), F.col("span")).alias("last_frame"))


@query(f"WITH {_SEG} SELECT id, frame_start * CAST(fps_den AS DOUBLE) / fps_num AS t0, (frame_end + 1) * CAST(fps_den AS DOUBLE) / fps_num AS t1 FROM seg JOIN videos USING (video_id) WHERE kind = 'shot'")
def frame_to_seconds(spark, d):
    v = table(spark, d, "videos").select("video_id", "fps_num", "fps_den")
    rows = seg(spark, d, "video_id", "frame_start", "frame_end", kinds=("shot",)).join(v, "video_id")
    return rows.select("id", media.frame_time(F.col("frame_start"), F.col("fps_num"), F.col("fps_den")).alias("t0"), media.frame_time(F.col("frame_end") + 1, F.col("fps_num"), F.col("fps_den")).alias("t1"))


@query(f"WITH {_SEG}, {_SPANS}, c AS (SELECT id, greatest(0.0, t_start_s) AS s, least(span, t_end_s) AS e FROM seg JOIN spans USING (video_id) WHERE kind IN ('music', 'noise')) SELECT * FROM c WHERE e > s")
def clip_intervals(spark, d):
    rows = seg(spark, d, "video_id", "t_start_s", "t_end_s", kinds=("music", "noise")).join(spans(spark, d), "video_id")
    s, e = media.clip(F.col("t_start_s"), F.col("t_end_s"), F.col("span"))
    return rows.select("id", s.alias("s"), e.alias("e")).filter("e > s")


# --- intervals ---------------------------------------------------------------------------------------------------------


def _intervals(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    rows = table(spark, d, "segments").filter(F.col("kind").isin(*kinds)).select("video_id", F.col("t_start_s").alias("s"), F.col("t_end_s").alias("e"))
    return rows.distinct()


def _sql_merge(name: str, source: str) -> str:
    return f"""{name}_m AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {source}),
{name}_g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {name}_m),
{name} AS (SELECT video_id, min(s) AS s, max(e) AS e FROM {name}_g GROUP BY video_id, g)"""


def _sql_kind(name: str, kind: str) -> str:
    return f"{name} AS (SELECT DISTINCT video_id, t_start_s AS s, t_end_s AS e FROM segments WHERE kind = '{kind}')"


_PADDED = f"{_sql_kind('sp', 'speech')}, {_sql_merge('mg', 'sp')}, wide AS (SELECT mg.video_id, greatest(0.0, s - 0.1) AS s, least(span, e + 0.1) AS e FROM mg JOIN spans USING (video_id)), wide_ok AS (SELECT * FROM wide WHERE s < e), {_sql_merge('padded', 'wide_ok')}"
_PROTECTED = f"{_PADDED}, {_sql_kind('mu', 'music')}, mclip AS (SELECT mu.video_id, greatest(0.0, s) AS s, least(span, e) AS e FROM mu JOIN spans USING (video_id)), both_ AS (SELECT * FROM padded UNION ALL SELECT * FROM mclip WHERE s < e), {_sql_merge('prot', 'both_')}"


def _sql_complement(name: str, source: str) -> str:
    return f"""{name}_r AS (SELECT video_id, s, e, span FROM {source} JOIN spans USING (video_id) UNION ALL SELECT video_id, span, span, span FROM spans),
{name}_c AS (SELECT video_id, greatest(0.0, max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS s, least(s, span) AS e FROM {name}_r),
{name} AS (SELECT DISTINCT video_id, s, e FROM {name}_c WHERE s < e)"""


@query(f"WITH {_sql_kind('sp', 'speech_region')}, {_sql_merge('mg', 'sp')} SELECT * FROM mg")
def interval_merge(spark, d):
    return intervals.merge(_intervals(spark, d, "speech_region"), "video_id")


@query(f"WITH {_SPANS}, {_PADDED} SELECT * FROM padded")
def interval_pad_merge(spark, d):
    return intervals.padded(_intervals(spark, d, "speech"), spans(spark, d), "video_id", 0.1)


@query(f"WITH {_SPANS}, {_sql_kind('sp', 'music')}, {_sql_complement('gaps', 'sp')} SELECT * FROM gaps")
def interval_complement(spark, d):
    return intervals.complement(_intervals(spark, d, "music"), spans(spark, d), "video_id")


@query(f"WITH {_SPANS}, {_PROTECTED} SELECT * FROM prot")
def protected_regions(spark, d):
    return intervals.protected(_intervals(spark, d, "speech"), _intervals(spark, d, "music"), spans(spark, d), "video_id", 0.1)


@query(f"WITH {_SPANS}, {_PROTECTED}, {_sql_complement('gaps', 'prot')} SELECT * FROM gaps")
def protected_silence(spark, d):
    return intervals.silence(_intervals(spark, d, "speech"), _intervals(spark, d, "music"), spans(spark, d), "video_id", 0.1)


def _speech_times(spark: SparkSession, d: str) -> DataFrame:
    return seg(spark, d, "video_id", "t_start_s", "t_end_s", kinds=("speech",)).withColumnsRenamed({"t_start_s": "s", "t_end_s": "e"})


def _share(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return intervals.overlap_share(_speech_times(spark, d), intervals.merge(_intervals(spark, d, kind).filter("e > s"), "video_id"), "video_id", "id")


def _sql_share(kind: str, name: str = "share") -> str:
    return f"""{_sql_kind(f'k_{kind}', kind)}, ok_{kind} AS (SELECT * FROM k_{kind} WHERE e > s), {_sql_merge(f'm_{kind}', f'ok_{kind}')},
sh_{kind} AS (SELECT seg.id, least(1.0, sum(CASE WHEN r.s IS NULL THEN 0 ELSE greatest(0.0, least(t_end_s, r.e) - greatest(t_start_s, r.s)) END) / greatest(max(t_end_s) - max(t_start_s), 1e-9)) AS {name}
FROM seg LEFT JOIN m_{kind} r ON seg.video_id = r.video_id AND r.s < t_end_s AND r.e > t_start_s WHERE seg.kind = 'speech' GROUP BY seg.id)"""


@query(f"WITH {_SEG}, {_sql_share('music')} SELECT id, round(share, 6) AS share FROM sh_music")
def overlap_fraction(spark, d):
    return _share(spark, d, "music").select("id", F.round("share", 6).alias("share"))


@query(f"WITH {_SEG}, {_sql_share('music')} SELECT id, round(share, 6) >= 0.5 AS is_music FROM sh_music")
def music_gate_split(spark, d):
    return _share(spark, d, "music").select("id", (F.round("share", 6) >= 0.5).alias("is_music"))


@query(f"WITH {_SEG}, {_sql_share('noise')} SELECT id, round(share, 6) >= 0.5 AS noise_overlap FROM sh_noise")
def noise_demote(spark, d):
    return _share(spark, d, "noise").select("id", (F.round("share", 6) >= 0.5).alias("noise_overlap"))


@query(f"""WITH {_SEG} SELECT id FROM seg WHERE kind = 'speech' AND json_valid(payload) AND coalesce(CAST(json_extract_string(payload, '$.no_speech_prob') AS DOUBLE), 0) <= 0.6
AND coalesce(CAST(json_extract_string(payload, '$.avg_logprob') AS DOUBLE), 0) >= -1.0 AND regexp_replace(coalesce(json_extract_string(payload, '$.text'), ''), '[ \\t\\n\\r]+', '', 'g') <> ''""")
def speech_guards(spark, d):
    rows = seg(spark, d, "payload", kinds=("speech",)).select("id", parsed(F.col("payload")).alias("v")).filter("v is not null")
    num = lambda k: text_at(F.col("v"), f"$.{k}").try_cast("double")
    return rows.filter(intervals.passes_guards(num("no_speech_prob"), num("avg_logprob"), text_at(F.col("v"), "$.text"))).select("id")


@query(f"""WITH {_SEG}, {_sql_share('music')} SELECT count(*) FILTER (share < 0.5) AS kept, count(*) FILTER (share >= 0.5) AS excluded, count(*) AS total FROM sh_music""")
def stage_counters(spark, d):
    return _share(spark, d, "music").agg(F.count_if(F.col("share") < 0.5).alias("kept"), F.count_if(F.col("share") >= 0.5).alias("excluded"), F.count("*").alias("total"))


# --- folds, tiling, motion ---------------------------------------------------------------------------------------------

_SPEECH = f"sp AS (SELECT video_id, id, t_start_s AS s, t_end_s AS e, trim(json_extract_string(payload, '$.text'), ' \t\n\r') AS text FROM seg WHERE kind = 'speech' AND json_valid(payload)), sn AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s, id) AS rn FROM sp WHERE text <> '')"
_WINDOWS = f"""WITH RECURSIVE {_SEG}, {_SPEECH},
w AS (SELECT video_id, rn, s AS cs, e AS ce, 1 AS win FROM sn WHERE rn = 1
UNION ALL SELECT n.video_id, n.rn, CASE WHEN n.e - w.cs > 60 OR w.ce - w.cs >= 45 THEN n.s ELSE w.cs END, n.e, CASE WHEN n.e - w.cs > 60 OR w.ce - w.cs >= 45 THEN w.win + 1 ELSE w.win END
FROM w JOIN sn n ON n.video_id = w.video_id AND n.rn = w.rn + 1),
made AS (SELECT w.video_id, arg_min(sn.s, sn.rn) AS s, arg_max(sn.e, sn.rn) AS e, string_agg(sn.text, ' ' ORDER BY sn.rn) AS text, list(sn.id ORDER BY sn.rn) AS source_ids FROM w JOIN sn USING (video_id, rn) GROUP BY w.video_id, w.win)"""


def _speech_text(spark: SparkSession, d: str) -> DataFrame:
    rows = seg(spark, d, "video_id", "t_start_s", "t_end_s", "payload", kinds=("speech",))
    return rows.select("video_id", "id", F.col("t_start_s").alias("s"), F.col("t_end_s").alias("e"), text_at(parsed(F.col("payload")), "$.text").alias("text"))


@query(_WINDOWS + " SELECT * FROM made")
def greedy_windows(spark, d):
    return folds.pack_windows(_speech_text(spark, d), "video_id")


@query(f"""WITH RECURSIVE {_SEG}, sh AS (SELECT video_id, frame_start AS s, frame_end + 1 AS e FROM seg WHERE kind = 'shot' AND frame_start IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s, e) AS rn, count(*) OVER (PARTITION BY video_id) AS c FROM sh),
f AS (SELECT video_id, rn, c, s AS gs, e AS ge, 1 AS g FROM n WHERE rn = 1
UNION ALL SELECT n.video_id, n.rn, n.c, CASE WHEN f.ge - f.gs < 8 THEN f.gs ELSE n.s END, n.e, CASE WHEN f.ge - f.gs < 8 THEN f.g ELSE f.g + 1 END FROM f JOIN n ON n.video_id = f.video_id AND n.rn = f.rn + 1),
m AS (SELECT video_id, g, arg_max(gs, rn) AS s, arg_max(ge, rn) AS e FROM f GROUP BY video_id, g),
t AS (SELECT *, max(g) OVER (PARTITION BY video_id) AS last FROM m),
x AS (SELECT video_id, CASE WHEN g = last AND g > 1 AND e - s < 8 THEN g - 1 ELSE g END AS g, s, e FROM t)
SELECT video_id, min(s) AS s, arg_max(e, s) AS e FROM x GROUP BY video_id, g""")
def micro_shot_merge(spark, d):
    rows = seg(spark, d, "video_id", "frame_start", "frame_end", kinds=("shot",))
    return folds.merge_micro_shots(rows.select("video_id", F.col("frame_start").alias("s"), (F.col("frame_end") + 1).alias("e")), "video_id")


def _frames(spark: SparkSession, d: str) -> DataFrame:
    rows = seg(spark, d, "video_id", "frame_start", "payload", kinds=("frame",)).withColumn("v", parsed(F.col("payload")))
    return rows.select(
        "video_id", whole_text(text_at(F.col("v"), "$.shot_index")).alias("shot_index"), "id", F.col("frame_start").alias("frame"), text_at(F.col("v"), "$.dhash").alias("dhash"),
        text_at(F.col("v"), "$.person_count").try_cast("int").alias("people"), truthy(F.col("v"), "$.is_representative").alias("is_rep"),
    ).filter("shot_index is not null")


_FRAMES = """fr AS (SELECT video_id, CAST(CAST(CAST(json_extract_string(payload, '$.shot_index') AS DOUBLE) AS BIGINT) AS VARCHAR) AS si, id, frame_start AS frame, json_extract_string(payload, '$.dhash') AS h,
CAST(json_extract_string(payload, '$.person_count') AS INT) AS pc, json_valid(payload) AND coalesce(json_type(payload, '$.is_representative'), 'NULL') <> 'NULL' AND json_extract_string(payload, '$.is_representative') NOT IN ('', '[]', '{}') AND NOT (json_type(payload, '$.is_representative') = 'BOOLEAN' AND json_extract_string(payload, '$.is_representative') = 'false') AND NOT (json_type(payload, '$.is_representative') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST(json_extract_string(payload, '$.is_representative') AS DOUBLE) = 0) AS is_rep FROM seg WHERE kind = 'frame' AND json_extract_string(payload, '$.shot_index') IS NOT NULL)"""


def _sql_bits(a: str, b: str) -> str:
    half = lambda h, at: f"CAST('0x' || substr({h}, {at}, 8) AS BIGINT)"
    return f"(bit_count(xor({half(a, 1)}, {half(b, 1)})) + bit_count(xor({half(a, 9)}, {half(b, 9)})))"


@query(f"""WITH RECURSIVE {_SEG}, {_FRAMES}, rep AS (SELECT video_id, si, arg_min(id, (frame, id)) AS rid, arg_min(h, (frame, id)) AS rh, arg_min(pc, (frame, id)) AS rp FROM fr WHERE is_rep GROUP BY video_id, si),
n AS (SELECT fr.*, rid, rh, rp, row_number() OVER (PARTITION BY video_id, si ORDER BY frame, id) AS rn FROM fr LEFT JOIN rep USING (video_id, si)),
f AS (SELECT video_id, si, rn, id, h AS lh, pc AS lp, (id = coalesce(rid, -1) OR NOT coalesce({_sql_bits('h', 'rh')} <= 4 AND pc = rp, false)) AS kept FROM n WHERE rn = 1
UNION ALL SELECT n.video_id, n.si, n.rn, n.id, CASE WHEN k THEN n.h ELSE f.lh END, CASE WHEN k THEN n.pc ELSE f.lp END, k
FROM f JOIN n ON n.video_id = f.video_id AND n.si = f.si AND n.rn = f.rn + 1, LATERAL (SELECT n.id = coalesce(n.rid, -1) OR NOT (coalesce({_sql_bits('n.h', 'f.lh')} <= 4 AND n.pc = f.lp, false) OR coalesce({_sql_bits('n.h', 'n.rh')} <= 4 AND n.pc = n.rp, false)) AS k))
SELECT video_id, si AS shot_index, id FROM f WHERE kept""")
def near_dup_dedup(spark, d):
    return folds.drop_near_duplicates(_frames(spark, d), ["video_id", "shot_index"])


@query(f"""WITH {_SEG}, {_FRAMES}, p AS (SELECT id, h, lag(h) OVER (PARTITION BY video_id, si ORDER BY frame, id) AS ph FROM fr) SELECT id, CAST({_sql_bits('h', 'ph')} AS INT) AS bits FROM p WHERE ph IS NOT NULL""")
def hamming_distance(spark, d):
    before = F.lag("dhash").over(Window.partitionBy("video_id", "shot_index").orderBy("frame", "id"))
    rows = _frames(spark, d).withColumn("before", before).filter("before is not null")
    return rows.select("id", vectors.hash_distance(F.col("dhash"), F.col("before")).cast("int").alias("bits"))


_TILES = f"{_SPANS}, c AS (SELECT *, CAST(floor(span / 10) AS BIGINT) AS f, span - floor(span / 10) * 10 AS rest FROM spans WHERE span > 0), nn AS (SELECT *, f + CASE WHEN rest > 1e-9 AND (rest >= 2 OR f = 0) THEN 1 ELSE 0 END AS n FROM c), tl AS (SELECT video_id, span, rest, n FROM nn WHERE n > 0)"
_TILE_END = "CASE WHEN j = n - 1 AND rest > 1e-9 THEN span ELSE (j + 1) * 10.0 END"


@query(f"""WITH {_TILES}, jj AS (SELECT *, unnest(range(0, n)) AS j FROM tl), tiles AS (SELECT video_id, j * 10.0 AS s, {_TILE_END} AS e FROM jj)
SELECT video_id, count(*) AS tiles, min(s) AS first_s, max(s) AS last_s, max(e) AS last_e, count(*) FILTER (e - s <> 10) AS odd FROM tiles GROUP BY video_id""")
def audio_tiling(spark, d):
    """All tiles of all videos are made; they are told per video, as one video alone has tens of millions."""
    tiles = frames.tile(spans(spark, d), "video_id")
    return tiles.groupBy("video_id").agg(F.count("*").alias("tiles"), F.min("s").alias("first_s"), F.max("s").alias("last_s"), F.max("e").alias("last_e"), F.count_if(F.col("e") - F.col("s") != 10).alias("odd"))


_SHOTS = f"sh AS (SELECT seg.id, frame_start AS a, frame_end AS b, CAST(fps_num AS DOUBLE) / fps_den AS fps FROM seg JOIN videos USING (video_id) WHERE kind = 'shot' AND frame_end >= frame_start)"


def _shots(spark: SparkSession, d: str) -> DataFrame:
    return seg(spark, d, "video_id", "frame_start", "frame_end", kinds=("shot",)).join(spans(spark, d), "video_id").filter("frame_end >= frame_start")


@query(f"""WITH {_SEG}, {_SHOTS} SELECT id, list_sort(list_distinct(list_concat(range(a, b + 1, greatest(1, CAST(round_even(fps * 3.0, 0) AS BIGINT))), [CAST((a + b) // 2 AS BIGINT)]))) AS candidates, (a + b) // 2 AS middle FROM sh""")
def keyframe_candidates(spark, d):
    a, b = F.col("frame_start"), F.col("frame_end")
    c = frames.candidate_frames(a, b, F.col("fps"))
    return _shots(spark, d).select("id", c.alias("candidates"), frames.nearest_to_middle(c, a, b).alias("middle"))


@query(f"""WITH {_SEG}, {_SHOTS}, g AS (SELECT *, greatest(1, CAST(round_even(fps * 0.2, 0) AS BIGINT)) AS gap FROM sh), p AS (SELECT id, b, gap, unnest(list_distinct([a, a + greatest(0, (b - a - gap) // 2), greatest(a, b - gap)])) AS p0 FROM g)
SELECT id, p0, least(b, p0 + gap) AS p1 FROM p WHERE least(b, p0 + gap) > p0""")
def motion_pairs(spark, d):
    pairs = frames.motion_pairs(F.col("frame_start"), F.col("frame_end"), F.col("fps"))
    return _shots(spark, d).select("id", F.explode(pairs).alias("p")).select("id", "p.p0", "p.p1")


@query(f"""WITH {_SEG}, l AS (SELECT id, CAST(json_extract(payload, '$.motion_evidence.pairs') AS VARCHAR[]) AS labels FROM seg WHERE kind = 'shot' AND json_type(payload, '$.motion_evidence.pairs') = 'ARRAY'),
m AS (SELECT id, unnest(list_filter(labels, lambda x: x <> 'static')) AS x FROM l), c AS (SELECT id, x, count(*) AS n, sum(count(*)) OVER (PARTITION BY id) AS t FROM m GROUP BY id, x),
b AS (SELECT id, CASE WHEN max(n) * 2 > max(t) THEN arg_max(x, n) ELSE 'complex' END AS motion FROM c GROUP BY id) SELECT l.id, coalesce(motion, 'static') AS motion FROM l LEFT JOIN b USING (id)""")
def motion_vote(spark, d):
    rows = seg(spark, d, "payload", kinds=("shot",)).select("id", F.try_variant_get(parsed(F.col("payload")), "$.motion_evidence.pairs", "array<string>").alias("labels")).filter("labels is not null")
    return rows.select("id", frames.motion_vote(F.col("labels")).alias("motion"))


@query(f"""WITH {_SEG}, e AS (SELECT id, unnest(CAST(json_extract(payload, '$.motion_evidence.evidence[*]') AS JSON[])) AS j, generate_subscripts(json_extract(payload, '$.motion_evidence.evidence[*]'), 1) - 1 AS pos FROM seg WHERE kind = 'shot' AND json_type(payload, '$.motion_evidence.evidence') = 'ARRAY'),
x AS (SELECT id, pos, CAST(j->>'features' AS DOUBLE) AS f, CAST(j->>'mean_abs_diff' AS DOUBLE) AS df, CAST(j->>'scale' AS DOUBLE) AS sc, CAST(j->>'dx' AS DOUBLE) AS dx, CAST(j->>'dy' AS DOUBLE) AS dy FROM e WHERE json_type(j) = 'OBJECT')
SELECT id, CAST(pos AS INT) AS pos, CASE WHEN f = 0 THEN CASE WHEN df < 0.5 THEN 'static' ELSE 'complex' END WHEN sc IS NULL OR dx IS NULL OR dy IS NULL THEN 'complex' WHEN abs(sc - 1) > 0.005 AND greatest(dx, dy) < 0.02 THEN 'zoom'
WHEN greatest(dx, dy) < 0.002 THEN 'static' WHEN dx > dy * 2 THEN 'pan' WHEN dy > dx * 2 THEN 'tilt' ELSE 'complex' END AS label FROM x""")
def motion_label(spark, d):
    rows = seg(spark, d, "payload", kinds=("shot",)).select("id", F.posexplode(F.try_variant_get(parsed(F.col("payload")), "$.motion_evidence.evidence", "array<variant>")).alias("pos", "j"))
    rows = rows.filter(F.schema_of_variant("j").startswith("OBJECT"))
    num = lambda k: F.try_variant_get("j", f"$.{k}", "double")
    return rows.select("id", "pos", frames.motion_label(num("features"), num("mean_abs_diff"), num("scale"), num("dx"), num("dy")).alias("label"))


@query(f"""WITH {_SEG}, o AS (SELECT video_id, frame_start AS pos, id, json_extract_string(payload, '$.caption_error') IS NOT NULL AS failed FROM seg WHERE kind = 'shot'),
p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos, id) AS position, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY pos, id ROWS UNBOUNDED PRECEDING) AS ok FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, ok ORDER BY pos, id) AS run FROM p WHERE failed), s AS (SELECT video_id, max(run) AS longest, min(position) FILTER (run >= 5) AS trips_at FROM r GROUP BY video_id)
SELECT v.video_id, coalesce(longest, 0) AS longest, trips_at FROM (SELECT DISTINCT video_id FROM o) v LEFT JOIN s USING (video_id)""")
def breaker_runs(spark, d):
    rows = seg(spark, d, "video_id", "frame_start", "payload", kinds=("shot",)).select("video_id", F.struct("frame_start", "id").alias("at"), text_at(parsed(F.col("payload")), "$.caption_error").isNotNull().alias("failed"))
    return frames.failure_runs(rows, "video_id")


@query("""WITH b AS (SELECT l_orderkey, count(*) FILTER (l_linenumber % 3 = 1 AND l_discount * 10 >= 0.5) AS n, max(CASE WHEN l_linenumber % 3 = 1 AND l_discount * 10 >= 0.5 THEN l_quantity * l_linenumber END) AS area FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CAST(n AS INT) AS people, round(coalesce(area / 1000.0, 0), 4) AS area_share FROM b""")
def person_aggregate(spark, d):
    box = F.struct((F.col("l_linenumber") % 3).alias("label"), (F.col("l_discount") * 10).alias("score"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("l_quantity").alias("x1"), F.col("l_linenumber").cast("double").alias("y1"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(box).alias("boxes"))  # boxes of one picture
    p = frames.people(F.col("boxes"), F.lit(100.0), F.lit(10.0))
    return rows.select("l_orderkey", p["count"].alias("people"), p["max_area_share"].alias("area_share"))


# --- words -------------------------------------------------------------------------------------------------------------

_WORDS = """wd AS (SELECT id, t_start_s AS s, t_end_s AS e, unnest(json_extract(payload, '$.words[*]')) AS j, generate_subscripts(json_extract(payload, '$.words[*]'), 1) - 1 AS pos FROM seg WHERE kind = 'speech' AND json_valid(payload) AND json_type(payload, '$.words') = 'ARRAY'),
wt AS (SELECT id, s, e, CAST(pos AS INT) AS pos, j->>'w' AS w, CAST(j->>'t0' AS DOUBLE) AS t0, CAST(j->>'t1' AS DOUBLE) AS t1 FROM wd WHERE j->>'w' IS NOT NULL AND j->>'t0' IS NOT NULL AND j->>'t1' IS NOT NULL)"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    rows = seg(spark, d, "t_start_s", "t_end_s", "payload", kinds=("speech",))
    rows = rows.select("id", F.col("t_start_s").alias("s"), F.col("t_end_s").alias("e"), F.posexplode(F.try_variant_get(parsed(F.col("payload")), "$.words", "array<variant>")).alias("pos", "j"))
    get = lambda k, t: F.try_variant_get("j", f"$.{k}", t)
    return rows.select("id", "s", "e", "pos", get("w", "string").alias("w"), get("t0", "double").alias("t0"), get("t1", "double").alias("t1")).filter("w is not null and t0 is not null and t1 is not null")


_CLAMP = "round(least(greatest({a}, s), e - 0.02), 3)"


@query(f"WITH {_SEG}, {_WORDS} SELECT id, pos, {_CLAMP.format(a='t0')} AS t0, round(least(greatest(t1, least(greatest(t0, s), e - 0.02) + 0.02), e), 3) AS t1 FROM wt")
def word_clamp(spark, d):
    t0, t1 = words.clamp_word(F.col("t0"), F.col("t1"), F.col("s"), F.col("e"))
    return _words(spark, d).select("id", "pos", t0.alias("t0"), t1.alias("t1"))


_LETTERS = "regexp_replace(upper(replace(trim(w), 'ß', 'ss')), '[^A-Z'']', '', 'g')"


@query(f"""WITH {_SEG}, {_WORDS}, lt AS (SELECT id, pos, t0, t1, length({_LETTERS}) AS n FROM wt), tk AS (SELECT id, pos, t0 + i * (t1 - t0) / n AS a, t0 + (i + 1) * (t1 - t0) / n AS b FROM (SELECT *, unnest(range(0, n)) AS i FROM lt WHERE n > 0))
SELECT id, pos AS word, round(min(a), 6) AS t0, round(max(b), 6) AS t1 FROM tk GROUP BY id, pos""")
def word_bounds(spark, d):
    """Spans of the letters of each word, evenly over its time, and the bounds of the word from them."""
    n = F.size(text.spoken_letters(F.col("w")))
    letters = _words(spark, d).withColumn("n", n).filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda i: F.col("t0") + i * (F.col("t1") - F.col("t0")) / F.col("n")
    tokens = letters.select("id", F.col("pos").alias("word"), at(F.col("i")).alias("start"), at(F.col("i") + 1).alias("end"))
    return words.word_bounds(tokens, ["id"]).select("id", "word", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


@query(f"""WITH {_SEG}, {_WORDS}, lt AS (SELECT id, pos, length({_LETTERS}) AS n FROM wt) SELECT id, CAST(sum(n) AS BIGINT) AS tokens, count(*) FILTER (n > 0) - 1 AS separators FROM lt GROUP BY id HAVING sum(n) > 0""")
def token_owners(spark, d):
    """Tokens of all words of a sentence, joined by separators that own no word."""
    sentences = _words(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("l"))  # the words of one sentence
    owned = words.token_owners(F.transform("l", lambda x: text.spoken_letters(x["w"])))
    rows = sentences.select("id", F.explode(owned).alias("t")).select("id", "t.*")
    return rows.groupBy("id").agg(F.count("word").alias("tokens"), F.count_if(F.col("word").isNull()).alias("separators"))


@query(f"WITH {_SEG}, {_WORDS} SELECT id, pos, CASE WHEN t1 <= t0 THEN {_CLAMP.format(a='t0')} ELSE t0 END AS t0, CASE WHEN t1 <= t0 THEN round(least(greatest(t1, least(greatest(t0, s), e - 0.02) + 0.02), e), 3) ELSE t1 END AS t1 FROM wt")
def word_repair(spark, d):
    """Words that end no later than they begin are given their least length, the others stay."""
    word = F.struct("w", "t0", "t1", F.lit(None).cast("double").alias("prob"))
    fixed = words.repair_words(F.array(word), F.col("s"), F.col("e"))[0]
    return _words(spark, d).select("id", "pos", fixed["t0"].alias("t0"), fixed["t1"].alias("t1"))


@query(f"""WITH {_SEG}, {_WORDS} SELECT id, pos, list_filter(list_transform(regexp_extract_all(upper(replace(trim(w), 'ß', 'ss')), '(?s).'), lambda c: CAST(instr('ABCDEFGHIJKLMNOPQRSTUVWXYZ''', c) AS INT)), lambda p: p > 0) AS tokens FROM wt""")
def word_tokenize(spark, d):
    return _words(spark, d).select("id", "pos", text.spoken_letters(F.col("w")).alias("tokens"))


# --- captions ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_SEG}, c AS (SELECT id, payload AS p FROM seg WHERE kind = 'caption')
SELECT id, CASE WHEN p->>'shot_type' IN ('CU', 'MS', 'WS') THEN p->>'shot_type' END AS shot_type, coalesce(CAST(trunc(CAST(p->>'people_count' AS DOUBLE)) AS INT), 0) AS people_count, coalesce(p->>'setting', '') AS setting, coalesce(p->>'on_screen_text', '') AS on_screen_text,
list_slice(CAST(json_extract(p, '$.objects') AS VARCHAR[]), 1, 8) AS objects, trim(p->>'description') AS description FROM c""")
def caption_typing(spark, d):
    rows = seg(spark, d, "payload", kinds=("caption",)).select("id", captions.typed_reply(F.col("payload")).alias("c")).filter("c.error is null")
    return rows.select("id", "c.shot_type", "c.people_count", "c.setting", "c.on_screen_text", "c.objects", "c.description")


@query(f"""WITH {_SEG}, {_FRAMES}, s AS (SELECT id AS shot_id, video_id, CAST(CAST(CAST(json_extract_string(payload, '$.shot_index') AS DOUBLE) AS BIGINT) AS VARCHAR) AS si FROM seg WHERE kind = 'shot'),
r AS (SELECT video_id, si, arg_max(id, (frame, id)) AS frame_id FROM fr WHERE is_rep GROUP BY video_id, si)
SELECT shot_id, frame_id, CASE WHEN frame_id IS NULL THEN 'no representative frame' END AS error FROM s LEFT JOIN r USING (video_id, si)""")
def rep_frame_join(spark, d):
    shots = seg(spark, d, "video_id", "payload", kinds=("shot",)).select(F.col("id").alias("shot_id"), "video_id", whole_text(text_at(parsed(F.col("payload")), "$.shot_index")).alias("shot_index"))
    reps = _frames(spark, d).filter("is_rep").groupBy("video_id", "shot_index").agg(F.max_by("id", F.struct("frame", "id")).alias("frame_id"))
    joined = shots.join(reps, ["video_id", "shot_index"], "left")
    return joined.select("shot_id", "frame_id", F.when(F.col("frame_id").isNull(), "no representative frame").alias("error"))


# --- vectors and search ------------------------------------------------------------------------------------------------


#: The query vector of the search examples, in every space.
QUERY = [math.sin(i + 1) for i in range(64)]


_VALID = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_VECS = f"vec AS (SELECT id, any_value(video_id) AS video_id, any_value(kind) AS kind, any_value(model_name) AS model_name, CAST(any_value(embedding) AS DOUBLE[]) AS v FROM segments WHERE {_VALID} GROUP BY id), q AS (SELECT unnest(['pictower-v2', 'sentenc-small-v1', 'soundtower-v1']) AS model_name, list_transform(range(64), lambda i: sin(i + 1)) AS q)"


def _knn(spark: SparkSession, d: str, k: int, **wanted) -> DataFrame:
    return search.knn(table(spark, d, "segments"), MODELS["image"], QUERY, k, **wanted).select("id", F.round("dist", 9).alias("dist"))


@query(f"WITH {_VECS} SELECT id, round(list_cosine_distance(v, q), 9) AS dist FROM vec JOIN q USING (model_name) WHERE model_name = 'pictower-v2' ORDER BY list_cosine_distance(v, q), id LIMIT 10")
def knn_cosine(spark, d):
    return _knn(spark, d, 10)


@query(f"WITH {_VECS} SELECT id, round(list_cosine_distance(v, q), 9) AS dist FROM vec JOIN q USING (model_name) WHERE model_name = 'pictower-v2' AND video_id = '{VIDEO}' AND kind = 'frame' ORDER BY list_cosine_distance(v, q), id LIMIT 5")
def knn_filtered(spark, d):
    return _knn(spark, d, 5, video_id=VIDEO, kinds=("frame",))


@query("SELECT DISTINCT model_name FROM segments WHERE embedding IS NOT NULL AND kind IN ('speech_window', 'caption')")
def distinct_models(spark, d):
    return search.stored_models(table(spark, d, "segments"), SPACE_KINDS["text"])


@query("SELECT DISTINCT id FROM segments WHERE kind = 'frame' AND (embedding IS NULL OR model_name IS DISTINCT FROM 'pictower-v2')")
def unembedded_worklist(spark, d):
    return store.unembedded(table(spark, d, "segments"), "frame", MODELS["image"]).distinct()


@query("SELECT DISTINCT id, coalesce(json_extract_string(payload, '$.description'), '') <> '' AS has_text FROM segments WHERE kind = 'caption' AND embedding IS NULL")
def captions_to_embed(spark, d):
    rows = seg(spark, d, "kind", "embedding", "payload", kinds=("caption",))
    todo = store.unembedded(rows, "caption")
    return rows.join(todo, "id", "left_semi").select("id", (text.stripped(text_at(parsed(F.col("payload")), "$.description")) != "").alias("has_text"))


@query("WITH n AS (SELECT DISTINCT id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM segments WHERE len(embedding) = dim AND len(list_filter(embedding, lambda x: x IS NULL)) = 0) SELECT * FROM n WHERE norm > 0 AND NOT isnan(norm) AND NOT isinf(norm)")
def vector_norms(spark, d):
    rows = table(spark, d, "segments").filter("size(embedding) = dim").select("id", "embedding").dropDuplicates(["id"])
    return rows.select("id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm")).filter("norm > 0 and norm < double('Infinity')")


_RANKED = f"""{_VECS}, sp(space, ord, model_name) AS (VALUES ('image', 0, 'pictower-v2'), ('text', 1, 'sentenc-small-v1'), ('audio', 2, 'soundtower-v1')),
ks(space, kind) AS (VALUES ('image', 'frame'), ('text', 'speech_window'), ('text', 'caption'), ('audio', 'audio_window')),
rk AS (SELECT id, space, ord, kind, row_number() OVER (PARTITION BY space ORDER BY list_cosine_distance(v, q), id) AS rank FROM vec JOIN q USING (model_name) JOIN sp USING (model_name) JOIN ks USING (space, kind) {{where}})"""
_FUSED = "SELECT id, round(1.0 / (60 + rank), 9) AS rrf_score, CAST(row_number() OVER (ORDER BY 1.0 / (60 + rank) DESC, ord, rank, id) AS INT) AS position FROM rk WHERE rank <= {k} QUALIFY position <= {k}"


def _search(spark: SparkSession, d: str, k: int, **wanted) -> DataFrame:
    return search.search(table(spark, d, "segments"), dict.fromkeys(MODELS, QUERY), MODELS, k=k, **wanted)


@query(f"WITH {_RANKED.format(where='')} {_FUSED.format(k=10)}")
def rrf_fusion(spark, d):
    return _search(spark, d, 10).select("id", F.round("rrf_score", 9).alias("rrf_score"), "position")


@query(f"WITH {_RANKED.format(where=chr(39).join(['WHERE kind IN (', 'speech_window', ', ', 'audio_window', ')']))} {_FUSED.format(k=5)}")
def rrf_kind_restricted(spark, d):
    return _search(spark, d, 5, kinds=("speech_window", "audio_window")).select("id", F.round("rrf_score", 9).alias("rrf_score"), "position")


_SHOT_OF = """so AS (SELECT video_id, CAST(CAST(CAST(json_extract_string(payload, '$.shot_index') AS DOUBLE) AS BIGINT) AS VARCHAR) AS si, arg_min(t_start_s, (t_start_s, id)) AS s, arg_min(t_end_s, (t_start_s, id)) AS e FROM seg WHERE kind = 'shot' GROUP BY ALL)"""


@query(f"""WITH {_SEG}, {_SHOT_OF}, f AS (SELECT id, video_id, t_start_s, t_end_s, CASE WHEN json_extract_string(payload, '$.shot_index') IS NOT NULL THEN CAST(CAST(CAST(json_extract_string(payload, '$.shot_index') AS DOUBLE) AS BIGINT) AS VARCHAR) END AS si FROM seg WHERE kind = 'frame')
SELECT f.id, coalesce(s, t_start_s) AS cut_start_s, CASE WHEN s IS NULL THEN t_end_s ELSE e END AS cut_end_s FROM f LEFT JOIN so USING (video_id, si)""")
def cut_refine_frame(spark, d):
    """All frames against all shots: an equi-join, joined by shuffle."""
    hits = table(spark, d, "segments").filter("kind = 'frame'").select("id").distinct()
    return search.cut_ranges(hits, table(spark, d, "segments")).select("id", "cut_start_s", "cut_end_s")


def _sql_best(windows: str) -> str:
    """The sentence of each window (id, payload) whose hashed vector comes nearest to the query's, as bs (id, s, e)."""
    return f"""ww AS (SELECT id, unnest(json_extract(payload, '$.source_speech_ids[*]')) AS j FROM {windows}), wi AS (SELECT DISTINCT id, CAST(CAST(j->>'$' AS DOUBLE) AS BIGINT) AS sid FROM ww WHERE j->>'$' IS NOT NULL AND CAST(j->>'$' AS DOUBLE) > 0),
ps AS (SELECT wi.id, g.id AS sid, t_start_s AS s, t_end_s AS e, json_extract_string(g.payload, '$.text') AS text FROM wi JOIN seg g ON g.id = sid WHERE json_valid(g.payload) AND trim(coalesce(json_extract_string(g.payload, '$.text'), ''), ' \t\n\r') <> ''),
pw AS (SELECT id, sid, s, e, md5(unnest(string_split_regex(trim(lower(text), ' \t\n\r'), '\\s+'))) AS h FROM ps), pv AS (SELECT id, sid, s, e, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS pos, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS n FROM pw GROUP BY ALL),
sm AS (SELECT id, sid, s, e, round(CASE WHEN sum(n * n) = 0 THEN sin(1) ELSE sum(n * sin(pos + 1)) / sqrt(sum(n * n)) END / sqrt((SELECT sum(sin(i + 1) ** 2) FROM range(64) r(i))), 6) AS sim FROM pv GROUP BY ALL),
bs AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, s, sid) = 1)"""


@query(f"""WITH {_SEG}, sw AS (SELECT * FROM seg WHERE kind = 'speech_window'), {_sql_best("sw")} SELECT g.id, coalesce(bs.s, t_start_s) AS cut_start_s, coalesce(bs.e, t_end_s) AS cut_end_s FROM sw g LEFT JOIN bs USING (id)""")
def cut_refine_speech(spark, d):
    """All windows and their sentences, with the stand-in encoder."""
    all_rows = seg(spark, d, "video_id", "kind", "t_start_s", "t_end_s", "frame_start", "frame_end", "payload", kinds=("speech", "speech_window"))
    windows = all_rows.filter("kind = 'speech_window'")
    parts = search.constituent_speech(windows.select("id", search.window_source_ids(F.col("payload")).alias("source_ids")), all_rows)
    best = search.most_similar_sentences(parts, QUERY, HashEncoder)
    return windows.join(best.select("id", "s", "e"), "id", "left").select("id", F.coalesce("s", "t_start_s").alias("cut_start_s"), F.coalesce("e", "t_end_s").alias("cut_end_s"))


_HITS = f"h AS ({_FUSED.format(k=10)})"
_REFINED = """f AS (SELECT h.id, h.position, g.kind, g.video_id, t_start_s, t_end_s, payload, CASE WHEN g.kind = 'frame' THEN CAST(CAST(CAST(json_extract_string(payload, '$.shot_index') AS DOUBLE) AS BIGINT) AS VARCHAR) END AS si FROM h JOIN seg g ON g.id = h.id), fw AS (SELECT * FROM f WHERE kind = 'speech_window')"""


@query(f"""WITH {_RANKED.format(where='')}, {_HITS}, {_SEG}, {_SHOT_OF}, {_REFINED}, {_sql_best("fw")}
SELECT f.id, position, kind, coalesce(so.s, bs.s, t_start_s) AS cut_start_s, coalesce(so.e, bs.e, t_end_s) AS cut_end_s FROM f LEFT JOIN so USING (video_id, si) LEFT JOIN bs ON bs.id = f.id""")
def search_end_to_end(spark, d):
    hits = search.hits(table(spark, d, "segments"), dict.fromkeys(MODELS, QUERY), MODELS, k=10)
    return search.refined(hits, table(spark, d, "segments"), QUERY, HashEncoder).select("id", "position", "kind", "cut_start_s", "cut_end_s")


_SPOKEN = _RANKED.format(where="WHERE kind = 'speech_window'")


@query(f"""WITH {_SPOKEN}, h AS ({_FUSED.format(k=5)}), {_SEG}, {_REFINED}, {_sql_best("fw")}
SELECT f.id, position, coalesce(bs.s, t_start_s) AS cut_start_s, coalesce(bs.e, t_end_s) AS cut_end_s FROM f LEFT JOIN bs ON bs.id = f.id""")
def search_speech_windows(spark, d):
    hits = search.hits(table(spark, d, "segments"), dict.fromkeys(MODELS, QUERY), MODELS, k=5, kinds=("speech_window",))
    return search.refined(hits, table(spark, d, "segments"), QUERY, HashEncoder).select("id", "position", "cut_start_s", "cut_end_s")


# --- writes ------------------------------------------------------------------------------------------------------------


@query("SELECT video_id, CASE WHEN fps_num = 30 THEN 'av1' ELSE codec END AS codec, has_speech, frame_count FROM videos UNION ALL SELECT 'brand-new', 'av1', NULL, 10")
def upsert_video(spark, d):
    old = table(spark, d, "videos").select("video_id", "codec", "has_speech", "frame_count")
    fresh = spark.createDataFrame([("brand-new", "av1", None, 10)], "video_id string, codec string, has_speech boolean, frame_count long")
    new = table(spark, d, "videos").filter("fps_num = 30").select("video_id", F.lit("av1").alias("codec"), F.lit(None).cast("boolean").alias("has_speech"), "frame_count")
    return store.upsert(old, new.unionByName(fresh), ["video_id"], keep=["has_speech"])


@query(f"""WITH {_SEG}, {_TILES}, kept AS (SELECT id, video_id, kind, t_start_s AS s, t_end_s AS e FROM seg WHERE NOT (kind = 'audio_window' AND video_id IN (SELECT video_id FROM tl))),
top AS (SELECT max(id) AS top FROM segments), made AS (SELECT video_id, n, span, rest, top + sum(n) OVER (ORDER BY video_id) - n AS below FROM tl, top)
SELECT video_id, kind, count(*) AS n, min(id) AS first_id, max(id) AS last_id, min(s) AS first_s, max(e) AS last_e FROM kept GROUP BY video_id, kind
UNION ALL SELECT video_id, 'audio_window', n, CAST(below + 1 AS BIGINT), CAST(below + n AS BIGINT), 0.0, CASE WHEN rest > 1e-9 THEN span ELSE n * 10.0 END FROM made""")
def replace_segments(spark, d):
    """All rows after the replacement, told per video and kind, as one video alone gets tens of millions."""
    old = seg(spark, d, "video_id", "kind", "t_start_s", "t_end_s")
    new = frames.tile(spans(spark, d), "video_id", position="n").select("video_id", F.lit("audio_window").alias("kind"), F.col("s").alias("t_start_s"), F.col("e").alias("t_end_s"), "n")
    rows = store.replace_segments(old, new, ["audio_window"], position="n")
    return rows.groupBy("video_id", "kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min("t_start_s").alias("first_s"), F.max("t_end_s").alias("last_e"))


@query(f"WITH {_SEG} SELECT id, video_id, kind FROM seg WHERE NOT (video_id = '{VIDEO}' AND kind = 'frame')")
def delete_segments(spark, d):
    return store.delete_segments(seg(spark, d, "video_id", "kind"), VIDEO, "frame")


@query(f"""WITH {_SEG} SELECT id, CASE WHEN frame_start % 2 = 0 THEN 'checked' ELSE json_extract_string(payload, '$.camera_motion') END AS camera_motion, json_extract_string(payload, '$.detector') AS detector, CASE WHEN frame_start % 2 = 0 THEN '7' END AS extra FROM seg WHERE kind = 'shot'""")
def payload_merge(spark, d):
    rows = seg(spark, d, "frame_start", "payload", kinds=("shot",))
    patches = rows.filter("frame_start % 2 = 0").select("id", F.lit('{"camera_motion": "checked", "extra": 7}').alias("updates"))
    v = parsed(F.col("payload"))
    return store.patch_payloads(rows, patches).select("id", text_at(v, "$.camera_motion").alias("camera_motion"), text_at(v, "$.detector").alias("detector"), text_at(v, "$.extra").alias("extra"))


@query("SELECT DISTINCT id, CASE WHEN embedding IS NULL THEN 'stub' ELSE model_name END AS model_name, CASE WHEN embedding IS NULL THEN 2 ELSE dim END AS dim, coalesce(len(embedding), 2) AS n FROM segments WHERE kind = 'audio_window'")
def set_embedding_bulk(spark, d):
    rows = seg(spark, d, "kind", "embedding", "model_name", "dim", kinds=("audio_window",))
    new = store.unembedded(rows, "audio_window").select("id", F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>").alias("embedding"), F.lit("stub").alias("model_name"), F.lit(2).alias("dim"))
    return store.attach(rows, new).select("id", "model_name", "dim", F.size("embedding").cast("bigint").alias("n"))


@query("""WITH n AS (SELECT kind, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.frame_path') END AS name FROM segments), g AS (SELECT CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.frame_path') END AS name FROM segment_deletes WHERE kind = 'frame')
SELECT name FROM (SELECT name FROM n WHERE kind = 'frame' UNION SELECT name FROM g) WHERE name IS NOT NULL EXCEPT SELECT name FROM n WHERE kind = 'frame'""")
def orphan_prune(spark, d):
    """The files that were written for frames, also for those that a re-run has deleted, and that no frame names any more."""
    path = text_at(parsed(F.col("payload")), "$.frame_path").alias("name")
    rows = table(spark, d, "segments").filter("kind = 'frame'").select(path)
    gone = table(spark, d, "segment_deletes").filter("kind = 'frame'").select(path)
    files = rows.unionByName(gone).filter("name is not null").distinct()
    return store.orphan_files(files, rows.distinct())


@query(_WINDOWS + """, ex AS (SELECT video_id, t_start_s AS s, t_end_s AS e, json_extract_string(payload, '$.text') AS text, list_transform(json_extract(payload, '$.source_speech_ids[*]'), lambda j: try_cast(j->>'$' AS DOUBLE)) AS ids FROM seg WHERE kind = 'speech_window'),
a AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s, e) AS n FROM ex), b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s, e) AS n FROM made)
SELECT coalesce(a.video_id, b.video_id) AS video_id, bool_and(coalesce(abs(a.s - b.s) < 1e-6 AND abs(a.e - b.e) < 1e-6 AND a.text IS NOT DISTINCT FROM b.text AND a.ids IS NOT DISTINCT FROM CAST(b.source_ids AS DOUBLE[]), false)) AS matches FROM a FULL JOIN b ON a.video_id = b.video_id AND a.n = b.n GROUP BY 1""")
def windows_match(spark, d):
    stored = seg(spark, d, "video_id", "t_start_s", "t_end_s", "payload", kinds=("speech_window",))
    ids = F.transform(search.window_source_ids(F.col("payload")), lambda x: whole_text(x).try_cast("bigint"))
    stored = stored.select("video_id", F.col("t_start_s").alias("s"), F.col("t_end_s").alias("e"), text_at(parsed(F.col("payload")), "$.text").alias("text"), ids.alias("source_ids"))
    return store.windows_match(stored, folds.pack_windows(_speech_text(spark, d), "video_id"))


@query(f"""WITH {_SEG}, {_TILES}, st AS (SELECT video_id, t_start_s AS s, t_end_s AS e, CASE WHEN json_valid(payload) THEN CAST(json_extract_string(payload, '$.win_s') AS DOUBLE) END AS w, CASE WHEN embedding IS NOT NULL THEN model_name END AS m FROM seg WHERE kind = 'audio_window'),
a AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s, e) - 1 AS j FROM st), x AS (SELECT coalesce(a.video_id, tl.video_id) AS video_id, j, n, abs(s - j * 10) < 1e-6 AND abs(e - {_TILE_END}) < 1e-6 AND w = 10 AND m = '{MODELS["audio"]}' AS same FROM a FULL JOIN tl ON a.video_id = tl.video_id)
SELECT video_id, bool_and(coalesce(same, false)) AND coalesce(max(n) = count(j), false) AS reusable FROM x GROUP BY 1""")
def audio_reuse_check(spark, d):
    stored = seg(spark, d, "video_id", "t_start_s", "t_end_s", "payload", "embedding", "model_name", kinds=("audio_window",))
    stored = stored.select("video_id", F.col("t_start_s").alias("s"), F.col("t_end_s").alias("e"), text_at(parsed(F.col("payload")), "$.win_s").try_cast("double").alias("win_s"), F.when(F.col("embedding").isNotNull(), F.col("model_name")).alias("model_name"))
    return store.tiling_matches(stored, spans(spark, d), model=MODELS["audio"])


@query("""WITH k(kind, space) AS (VALUES ('frame', 'image'), ('speech_window', 'text'), ('caption', 'text'), ('audio_window', 'audio'))
SELECT space, model_name, count(DISTINCT id) AS vectors FROM segments JOIN k USING (kind) WHERE embedding IS NOT NULL GROUP BY ALL""")
def stored_spaces(spark, d):
    """The models of each space with their vectors, as the check before a search sees them."""
    rows = table(spark, d, "segments").filter("embedding is not null").select("id", "kind", "model_name")
    own = F.create_map(*[F.lit(x) for space, kinds in SPACE_KINDS.items() for kind in kinds for x in (kind, space)])
    return rows.withColumn("space", own[F.col("kind")]).filter("space is not null").groupBy("space", "model_name").agg(F.countDistinct("id").alias("vectors"))


@query("""WITH v AS (SELECT DISTINCT id, dim, CAST(embedding AS DOUBLE[]) AS e FROM segments WHERE len(embedding) = dim AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0), n AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v)
SELECT id, round(CAST(CAST(e[1] / n AS FLOAT) AS DOUBLE), 5) AS first, round(CAST(CAST(e[-1] / n AS FLOAT) AS DOUBLE), 5) AS last FROM n WHERE n > 0""")
def unit_vectors(spark, d):
    """First and last value of each vector at length one."""
    rows = table(spark, d, "segments").filter("size(embedding) = dim").select("id", "embedding").dropDuplicates(["id"]).select("id", vectors.unit(F.col("embedding")).alias("u"))
    finite = F.forall("u", lambda x: F.abs(x) <= 1.001)
    return rows.filter(F.col("u").isNotNull() & finite).select("id", F.round(F.col("u")[0].cast("double"), 5).alias("first"), F.round(F.element_at("u", -1).cast("double"), 5).alias("last"))


@query("SELECT j.video_id, coalesce(bool_or(status = 'failed'), false) AS unfinished, count(*) FILTER (status = 'done') AS done FROM (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY video_id, stage ORDER BY updated_at DESC) = 1) j GROUP BY 1")
def video_progress(spark, d):
    """Stages done per video, and whether one has failed."""
    rows = jobs.latest(table(spark, d, "jobs"))
    return rows.groupBy("video_id").agg(F.coalesce(F.bool_or(F.col("status") == jobs.FAILED), F.lit(False)).alias("unfinished"), F.count_if(F.col("status") == jobs.DONE).alias("done"))


@query(f"""WITH {_SEG}, ix AS (SELECT *, CASE WHEN json_valid(payload) THEN payload END AS p FROM seg WHERE kind = 'shot'), n AS (SELECT id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY frame_start, id) - 1 AS INT) AS shot_index FROM ix WHERE frame_start IS NOT NULL) SELECT * FROM n""")
def shot_numbers(spark, d):
    """Shots numbered by their start in each video."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_start", "id")) - 1
    return seg(spark, d, "video_id", "frame_start", kinds=("shot",)).filter("frame_start is not null").select("id", n.alias("shot_index"))


@query(f"""WITH {_SEG}, sh AS (SELECT video_id, frame_start AS s, frame_end + 1 AS e FROM seg WHERE kind = 'shot' AND frame_start IS NOT NULL AND frame_end IS NOT NULL), u AS (SELECT video_id, frame_count - 3 AS usable FROM videos),
n AS (SELECT u.video_id, s, e, usable, row_number() OVER (PARTITION BY u.video_id ORDER BY s DESC, e DESC) AS r FROM u LEFT JOIN sh USING (video_id)) SELECT video_id, coalesce(s, 0) AS s, CASE WHEN r = 1 THEN usable ELSE e END AS e FROM n""")
def scenes_reconciled(spark, d):
    """Scenes of all videos, the last one up to the frames that can be decoded, and one scene for a video without any."""
    scenes = seg(spark, d, "video_id", "frame_start", "frame_end", kinds=("shot",)).select("video_id", F.col("frame_start").alias("s"), (F.col("frame_end") + 1).alias("e"))
    return folds.reconciled(scenes, table(spark, d, "videos").select("video_id", (F.col("frame_count") - 3).alias("usable")))


# --- scoring -----------------------------------------------------------------------------------------------------------


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Served results, ranked per query by the old score, those without one last, once per segment."""
    rows = table(spark, d, "search_results")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rrf_score"), "segment_id", "result_id")
    first = rows.groupBy("query_id", "segment_id").agg(F.min_by(F.struct("result_id", "rrf_score", "cut_start_s", "cut_end_s", "per_space"), "result_id").alias("r")).select("query_id", "segment_id", "r.*")
    return first.withColumn("position", F.row_number().over(order)).filter("position <= 3")


_RESULTS = """res AS (SELECT * FROM (SELECT * FROM search_results QUALIFY row_number() OVER (PARTITION BY query_id, segment_id ORDER BY result_id) = 1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC NULLS LAST, segment_id, result_id) <= 3),
rp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC NULLS LAST, segment_id, result_id) AS position FROM res),
gt AS (SELECT id AS query_id, containment_ok, unnest(gt_ranges) AS g FROM acceptance_queries WHERE len(gt_ranges) > 0),
iu AS (SELECT rp.query_id, position, per_space, cut_start_s AS s, cut_end_s AS e, g[1] AS a, g[2] AS b, containment_ok, CASE WHEN greatest(cut_end_s, g[2]) - least(cut_start_s, g[1]) > 0 THEN greatest(0.0, least(cut_end_s, g[2]) - greatest(cut_start_s, g[1])) / (greatest(cut_end_s, g[2]) - least(cut_start_s, g[1])) ELSE 0 END AS iou FROM rp JOIN gt USING (query_id)),
ok AS (SELECT query_id, min(position) AS position, arg_min(per_space, position) AS per_space FROM iu WHERE iou >= 0.5 OR abs(s - a) <= 0.5 OR (coalesce(containment_ok, false) AND s >= a AND e <= b) GROUP BY query_id),
fh AS (SELECT id AS query_id, class, expected_fail, ok.position, ok.per_space FROM acceptance_queries q LEFT JOIN ok ON ok.query_id = q.id WHERE len(gt_ranges) > 0),
fl AS (SELECT space, max(d) AS floor FROM (SELECT unnest(map_keys(per_space)) AS space, unnest(map_values(per_space)).dist AS d FROM fh WHERE position IS NOT NULL) GROUP BY space)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return acceptance.first_hits(_results(spark, d), table(spark, d, "acceptance_queries"))


@query(f"WITH {_RESULTS} SELECT query_id, class, CAST(position AS INT) AS position, CASE WHEN position IS NOT NULL AND NOT coalesce(expected_fail, false) THEN 'PASS' WHEN position IS NOT NULL THEN 'XPASS' WHEN coalesce(expected_fail, false) THEN 'XFAIL' ELSE 'FAIL' END AS verdict FROM fh")
def iou_hits(spark, d):
    return acceptance.verdicts(_hits(spark, d))


@query(f"WITH {_RESULTS} SELECT * FROM fl")
def space_floors(spark, d):
    return acceptance.space_floors(_hits(spark, d))


@query(f"""WITH {_RESULTS}, ng AS (SELECT id AS query_id, class FROM acceptance_queries WHERE len(gt_ranges) = 0), x AS (SELECT query_id, unnest(map_keys(per_space)) AS space, unnest(map_values(per_space)).dist AS d FROM rp JOIN ng USING (query_id)),
j AS (SELECT query_id, sum(CASE WHEN d <= floor THEN 1 ELSE 0 END) AS br, sum(CASE WHEN floor IS NULL THEN 1 ELSE 0 END) AS un FROM x LEFT JOIN fl USING (space) WHERE space <> 'audio' GROUP BY query_id)
SELECT query_id, class, CAST(coalesce(br, 0) AS BIGINT) AS breaches, CASE WHEN coalesce(br, 0) > 0 THEN 'FAIL' WHEN coalesce(un, 0) > 0 THEN 'SKIP' ELSE 'PASS' END AS verdict FROM ng LEFT JOIN j USING (query_id)""")
def negative_breaches(spark, d):
    return acceptance.negative_verdicts(_results(spark, d), table(spark, d, "acceptance_queries"), acceptance.space_floors(_hits(spark, d)))


@query(f"WITH {_RESULTS} SELECT class, count(*) FILTER (position IS NOT NULL AND NOT coalesce(expected_fail, false)) AS passed, count(*) AS total FROM fh GROUP BY class")
def class_scoreboard(spark, d):
    return acceptance.scoreboard(acceptance.verdicts(_hits(spark, d)))
