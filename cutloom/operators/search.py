"""Ranked search: exact nearest neighbours per space, rank fusion, and the range to cut."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cutloom.config import SPACE_KINDS
from cutloom.functions.values import parsed, text_at, text_list, whole_text
from cutloom.functions.vectors import distances, pair_distance
from cutloom.models import Encoder, embed
from cutloom.schema import CONTRACT
from cutloom.session import broadcast_if_small, settled

SEARCHABLE = tuple(k for kinds in SPACE_KINDS.values() for k in kinds)


def knn(segments: DataFrame, model: str, query: Sequence[float], k: int, *, video_id: str | None = None, kinds: Sequence[str] | None = None, keep: Sequence[str] = ("id",)) -> DataFrame:
    """The k nearest segments of one model by exact cosine distance, filtered before ranking: keep, dist. Ties go to the smaller id; a redelivered row counts once.

    Vectors of another length than the query, and those without a direction, are left out. ValueError for k < 1.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = segments.filter(F.col("embedding").isNotNull() & (F.col("model_name") == model) & (F.size("embedding") == len(query)))
    if video_id is not None:
        rows = rows.filter(F.col("video_id") == video_id)
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    scored = rows.select(*keep, distances(F.lit(0), F.col("embedding"), {0: query}).alias("dist")).filter("dist is not null and not isnan(dist)")
    return _nearest(scored, k, F.lit(0)).drop("rank")


def _nearest(scored: DataFrame, k: int, *group: Column | str) -> DataFrame:
    """The k nearest per group with their rank. Redelivered rows have one distance and id, so they share a dense rank and push no others out; each task keeps only ranks up to k before the shuffle."""
    order = Window.partitionBy(*group).orderBy("dist", "id")
    best = scored.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)
    return best.dropDuplicates(["id", *[g for g in group if isinstance(g, str)]])


def knn_many(queries: DataFrame, segments: DataFrame, k: int) -> DataFrame:
    """The same for many queries (query_id, model_name, embedding): query_id, id, dist, rank. Up to 10,000 queries are broadcast, segments stay in place, and each query keeps k rows per task before the shuffle; more are joined by model."""
    q = broadcast_if_small(queries.select("query_id", "model_name", F.col("embedding").alias("q")), 10_000)
    rows = segments.filter(F.col("embedding").isNotNull()).join(q, "model_name").filter(F.size("embedding") == F.size("q"))
    scored = rows.select("query_id", "id", pair_distance(F.col("embedding"), F.col("q")).alias("dist")).filter("dist is not null and not isnan(dist)")
    return _nearest(scored, k, "query_id")


def active_spaces(kinds: Sequence[str] | None) -> dict[str, tuple[str, ...]]:
    """Kinds to search per space, spaces without any left out. ValueError if kinds are given and none is searchable."""
    if kinds is not None and not set(kinds) & set(SEARCHABLE):
        raise ValueError(f"no searchable kind among {tuple(kinds)}; searchable: {SEARCHABLE}")
    wanted = {s: tuple(k for k in own if kinds is None or k in kinds) for s, own in SPACE_KINDS.items()}
    return {s: own for s, own in wanted.items() if own}


def stored_models(segments: DataFrame, kinds: Sequence[str], video_id: str | None = None) -> DataFrame:
    """Distinct models that have vectors for the kinds."""
    rows = segments.filter(F.col("embedding").isNotNull() & F.col("kind").isin(*kinds))
    return (rows if video_id is None else rows.filter(F.col("video_id") == video_id)).select("model_name").distinct()


def require_spaces(segments: DataFrame, models: Mapping[str, str], spaces: Mapping[str, Sequence[str]], video_id: str | None = None) -> None:
    """RuntimeError if vectors are stored for a space's kinds but none of its model; nothing stored is fine. One scan for all spaces."""
    rows = segments.filter(F.col("embedding").isNotNull() & F.col("kind").isin(*[k for kinds in spaces.values() for k in kinds]))
    rows = rows if video_id is None else rows.filter(F.col("video_id") == video_id)
    _check_models({(r["kind"], r["model_name"]) for r in rows.select("kind", "model_name").distinct().collect()}, models, spaces)


def _check_models(pairs: set[tuple[str, str]], models: Mapping[str, str], spaces: Mapping[str, Sequence[str]]) -> None:
    for space, kinds in spaces.items():
        stored = {m for k, m in pairs if k in kinds}
        if stored and models[space] not in stored:
            raise RuntimeError(f"the query's model {models[space]!r} is not among the stored ones {sorted(map(str, stored))} for {tuple(kinds)}; embed these kinds again")


def fuse(ranked: DataFrame, k: int, *, constant: int = 60, group: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank fusion of (id, space, space_ord, rank, dist): id, rrf_score, per_space, position.

    Ties keep the order of admission: space, then rank, then id. With group columns each group is ranked by itself. keep: columns of an id to keep.
    """
    keys = [*group, "id"]
    fused = ranked.groupBy(*keys).agg(
        F.sum(1.0 / (F.lit(float(constant)) + F.col("rank"))).alias("rrf_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("space", F.struct("rank", "dist"))))).alias("per_space"),
        F.min(F.struct("space_ord", "rank")).alias("admitted"),
        *[F.first(c).alias(c) for c in keep],
    )
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("rrf_score"), "admitted", "id")
    return fused.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k).drop("admitted")


def _searched(queries: Mapping[str, Sequence[float]], k: int, kinds: Sequence[str] | None) -> dict[str, tuple[str, ...]]:
    """The kinds of each space that a search goes to. ValueError if there are none, or for k < 1."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spaces = {s: own for s, own in active_spaces(kinds).items() if s in queries}
    if not spaces:
        raise ValueError("no query vector for the active spaces")
    return spaces


def _candidates(segments: DataFrame, spaces: Mapping[str, Sequence[str]], video_id: str | None) -> DataFrame:
    rows = segments.filter(F.col("embedding").isNotNull() & F.col("kind").isin(*[x for own in spaces.values() for x in own]))
    return rows if video_id is None else rows.filter(F.col("video_id") == video_id)


def _ranked(rows: DataFrame, queries: Mapping[str, Sequence[float]], models: Mapping[str, str], spaces: Mapping[str, Sequence[str]], k: int, keep: Sequence[str]) -> DataFrame:
    names, number = list(SPACE_KINDS), F.lit(None).cast("int")
    for name in spaces:
        mine = F.col("kind").isin(*spaces[name]) & (F.col("model_name") == models[name]) & (F.size("embedding") == len(queries[name]))
        number = F.when(mine, names.index(name)).otherwise(number)
    placed = rows.select("id", number.alias("space_ord"), "embedding", *keep).filter("space_ord is not null")
    space = F.element_at(F.array(*map(F.lit, names)), F.col("space_ord") + 1)
    dist = distances(F.col("space_ord"), F.col("embedding"), {names.index(s): queries[s] for s in spaces})
    scored = placed.select("id", space.alias("space"), "space_ord", dist.alias("dist"), *keep).filter("dist is not null and not isnan(dist)")
    return fuse(_nearest(scored, k, "space"), k, keep=keep)


def search(segments: DataFrame, queries: Mapping[str, Sequence[float]], models: Mapping[str, str], *, k: int = 10, kinds: Sequence[str] | None = None, video_id: str | None = None, check: bool = True) -> DataFrame:
    """Ranked hits over all active spaces: id, rrf_score, per_space, position. queries and models hold a vector and a model per space."""
    spaces = _searched(queries, k, kinds)
    if check:
        require_spaces(segments, models, spaces, video_id)
    return _ranked(_candidates(segments, spaces, video_id), queries, models, spaces, k, ())


def hits(segments: DataFrame, queries: Mapping[str, Sequence[float]], models: Mapping[str, str], *, k: int = 10, kinds: Sequence[str] | None = None, video_id: str | None = None) -> DataFrame:
    """The same hits as a local relation, with the columns of the list contract: one scan ranks them, keeps their rows, and observes the stored models, which are checked after it."""
    spaces, seen = _searched(queries, k, kinds), Observation()
    rows = _candidates(segments, spaces, video_id).observe(seen, F.collect_set(F.struct("kind", "model_name")).alias("models"))
    keep = [c for c in CONTRACT if c in segments.columns and c != "id"]
    found = settled(_ranked(rows, queries, models, spaces, k, keep))
    if found.isEmpty():  # the optimiser may have left nothing to observe
        require_spaces(segments, models, spaces, video_id)
    else:
        _check_models({(r["kind"], r["model_name"]) for r in seen.get["models"]}, models, spaces)
    return found


def _hint(df: DataFrame, bounded: bool) -> DataFrame:
    return F.broadcast(df) if bounded else df


def enclosing_shots(hits: DataFrame, segments: DataFrame, bounded: bool = False) -> DataFrame:
    """For frames (id, video_id, shot_index as text): the first shot by start and id with that index: id, s, e, fs, fe."""
    shots = segments.filter(F.col("kind") == "shot").select("video_id", whole_text(text_at(parsed(F.col("payload")), "$.shot_index")).alias("shot_index"), F.struct(F.col("t_start_s").alias("s"), F.col("id").alias("sid"), F.col("t_end_s").alias("e"), F.col("frame_start").alias("fs"), F.col("frame_end").alias("fe")).alias("shot"))
    first = shots.join(_hint(hits.select("video_id", "shot_index").distinct(), bounded), ["video_id", "shot_index"], "left_semi").groupBy("video_id", "shot_index").agg(F.min("shot").alias("shot"))
    return hits.join(first, ["video_id", "shot_index"]).select("id", "shot.s", "shot.e", "shot.fs", "shot.fe")


def constituent_speech(hits: DataFrame, segments: DataFrame, bounded: bool = False) -> DataFrame:
    """For windows (id, source_ids): their speech rows with a text that is not blank: id, sid, text, s, e, fs, fe. Ids not above 0, and dangling ones, vanish."""
    wanted = hits.select("id", F.explode("source_ids").alias("raw")).select("id", whole_text(F.col("raw")).try_cast("bigint").alias("sid")).filter("sid > 0").distinct()
    text = F.regexp_replace(F.coalesce(text_at(parsed(F.col("payload")), "$.text"), F.lit("")), r"^\s+|\s+$", "")
    speech = segments.join(_hint(wanted.select(F.col("sid").alias("id")).distinct(), bounded), "id", "left_semi").select(F.col("id").alias("sid"), text.alias("text"), F.col("t_start_s").alias("s"), F.col("t_end_s").alias("e"), F.col("frame_start").alias("fs"), F.col("frame_end").alias("fe"))
    return wanted.join(speech, "sid").filter("text != ''")


def cut_ranges(hits: DataFrame, segments: DataFrame, best_speech: DataFrame | None = None, bounded: bool = False) -> DataFrame:
    """The range to cut for each hit (rows with an id): id, cut_start_s, cut_end_s, cut_frame_start, cut_frame_end.

    A frame gives its shot; a speech window the sentence of best_speech (id, s, e, fs, fe); all else, and what finds none, itself.
    bounded: the hits are the k of a search, and are broadcast; else they are joined by shuffle.
    """
    own = segments.join(_hint(hits.select("id"), bounded), "id", "left_semi").select("id", "video_id", "kind", "t_start_s", "t_end_s", "frame_start", "frame_end", F.when(F.col("kind") == "frame", whole_text(text_at(parsed(F.col("payload")), "$.shot_index"))).alias("shot_index"))
    own = own.dropDuplicates(["id"])
    finer = enclosing_shots(own.filter("kind = 'frame' and shot_index is not null"), segments, bounded)
    if best_speech is not None:
        finer = finer.unionByName(best_speech.select("id", "s", "e", "fs", "fe"))
    joined = own.join(finer, "id", "left")
    pick = lambda a, b: F.when(F.col("s").isNotNull(), F.col(a)).otherwise(F.col(b))
    return joined.select("id", pick("s", "t_start_s").alias("cut_start_s"), pick("e", "t_end_s").alias("cut_end_s"), pick("fs", "frame_start").alias("cut_frame_start"), pick("fe", "frame_end").alias("cut_frame_end"))


def best_sentences(parts: DataFrame) -> DataFrame:
    """The most similar sentence of each window (id, sid, sim, s, e, ...); the first by start and id of equals."""
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "s", "sid")
    return parts.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def window_source_ids(payload: Column) -> Column:
    """The list of speech ids that a window's payload holds, as texts."""
    return text_list(parsed(payload), "$.source_speech_ids")


def most_similar_sentences(parts: DataFrame, query: Sequence[float], factory: Callable[[], Encoder]) -> DataFrame:
    """For each window (id, sid, text, s, e, ...) the sentence whose vector comes nearest to the query's, to six places; the first by start and id of equals."""
    embedded = parts.withColumn("v", embed(F.col("text"), factory))
    return best_sentences(embedded.withColumn("sim", F.round(1 - distances(F.lit(0), F.col("v"), {0: query}), 6)).drop("v"))


def refined(hits: DataFrame, segments: DataFrame, query: Sequence[float] | None = None, factory: Callable[[], Encoder] | None = None) -> DataFrame:
    """The k hits of a search (a local relation with an id) with their rows and the range to cut.

    A frame gives its shot; a speech window that of its sentences which is most similar to the text query; all else, and what finds none, itself. Ids and videos
    of the hits are literals, so every scan is pruned by them: one for hits that came without their rows, one for shots if there are frames, one for speech if there are windows.
    Columns added: those of the list contract, cut_start_s, cut_end_s, cut_frame_start, cut_frame_end.
    """
    contract = [c for c in CONTRACT if c in segments.columns]
    if set(contract) <= set(hits.columns):
        own, hits = hits.select(*contract), hits.drop(*[c for c in contract if c != "id"])
    else:
        ids = [r["id"] for r in hits.select("id").collect()]
        own = settled(segments.filter(F.col("id").isin(ids) if ids else F.lit(False)).select(*contract).dropDuplicates(["id"]))
    frames = settled(own.filter("kind = 'frame'").select("id", "video_id", whole_text(text_at(parsed(F.col("payload")), "$.shot_index")).alias("shot_index")).filter("shot_index is not null"))
    windows = settled(own.filter("kind = 'speech_window'").select("id", window_source_ids(F.col("payload")).alias("source_ids")))
    spark = hits.sparkSession
    finer = spark.createDataFrame([], "id bigint, s double, e double, fs bigint, fe bigint")
    if videos := {r["video_id"] for r in frames.collect()}:
        finer = finer.unionByName(enclosing_shots(frames, segments.filter(F.col("video_id").isin(sorted(videos))), True))
    sids = {int(x) for r in windows.collect() for x in r["source_ids"] or [] if x is not None and x.strip().isdecimal()}
    if query is not None and factory is not None and sids:
        parts = constituent_speech(windows, segments.filter(F.col("id").isin(sorted(sids))), True)
        finer = finer.unionByName(most_similar_sentences(parts, query, factory).select("id", "s", "e", "fs", "fe"))
    joined = hits.join(own, "id").join(F.broadcast(finer), "id", "left")
    pick = lambda a, b, name: F.when(F.col("s").isNotNull(), F.col(a)).otherwise(F.col(b)).alias(name)
    cut = [pick("s", "t_start_s", "cut_start_s"), pick("e", "t_end_s", "cut_end_s"), pick("fs", "frame_start", "cut_frame_start"), pick("fe", "frame_end", "cut_frame_end")]
    return joined.select(*hits.columns, *[c for c in own.columns if c != "id"], *cut)
