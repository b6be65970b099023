"""Order-dependent folds: state depends on what was kept or flushed last, so windows cannot express them.

Rows are repartitioned by key and sorted within partitions; one pass holds the state of one key, never a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def streaming_fold(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], object]) -> DataFrame:
    """Fold sorted rows per key. ``start`` makes a state with step(row), a named tuple, and end(), both giving output rows (tuples without keys)."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            names = list(batch.columns)
            where = [names.index(k) for k in keys]
            for row in batch.itertuples(index=False, name="Row"):
                now = tuple(row[i] for i in where)
                if now != key:
                    if state is not None:
                        out += [(*key, *made) for made in state.end()]
                    key, state = now, start()
                out += [(*key, *made) for made in state.step(row)]
            yield pd.DataFrame(out, columns=columns)
        if state is not None:
            yield pd.DataFrame([(*key, *made) for made in state.end()], columns=columns)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class _Packing:
    """Greedy packing of sentences into windows."""

    def __init__(self, target: float, most: float) -> None:
        self.target, self.most, self.ids, self.texts, self.s, self.e = target, most, [], [], 0.0, 0.0

    def end(self) -> list[tuple]:
        return [(self.s, self.e, " ".join(self.texts), list(self.ids))] if self.ids else []

    def step(self, row: tuple) -> list[tuple]:
        out = []
        if self.ids and (row.e - self.s > self.most or self.e - self.s >= self.target):
            out, self.ids, self.texts = self.end(), [], []
        if not self.ids:
            self.s = row.s
        self.ids.append(row.id)
        self.texts.append(row.text)
        self.e = row.e
        return out


def pack_windows(speech: DataFrame, key: str, *, target_s: float = 45.0, max_s: float = 60.0) -> DataFrame:
    """Windows of consecutive sentences (id, s, e, text): key, s, e, text, source_ids. Blank texts are skipped; a sentence is never split."""
    strip = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"^\s+|\s+$", "")
    rows = speech.select(key, "id", "s", "e", strip.alias("text")).filter("text != '' and s is not null and e is not null")
    return streaming_fold(rows, [key], ["s", "id"], f"{key} string, s double, e double, text string, source_ids array<bigint>", lambda: _Packing(target_s, max_s))


class _Shots:
    """Merging of shots that are too short; the last finished shot waits, as a short final one joins it."""

    def __init__(self, least: int) -> None:
        self.least, self.done, self.now = least, None, None

    def step(self, row: tuple) -> list[tuple]:
        s, e = row.s, row.e
        if self.now is None:
            self.now = (s, e)
        elif self.now[1] - self.now[0] < self.least:
            self.now = (self.now[0], e)
        else:
            out = [self.done] if self.done else []
            self.done, self.now = self.now, (s, e)
            return out
        return []

    def end(self) -> list[tuple]:
        if self.done and self.now[1] - self.now[0] < self.least:
            return [(self.done[0], self.now[1])]
        return [x for x in (self.done, self.now) if x]


def merge_micro_shots(scenes: DataFrame, key: str, *, min_frames: int = 8) -> DataFrame:
    """Scenes (s, e in frames, e exclusive) with those below min_frames joined to the next one, a short last one to the one before."""
    rows = scenes.filter("s is not null and e is not null").select(key, F.col("s").cast("bigint"), F.col("e").cast("bigint"))
    return streaming_fold(rows, [key], ["s", "e"], f"{key} string, s bigint, e bigint", lambda: _Shots(min_frames))


def reconciled(scenes: DataFrame, videos: DataFrame) -> DataFrame:
    """Scenes (video_id, s, e) of all videos (video_id, usable: the frames that both decoders have): the last one ends there, and a video without scenes is one scene."""
    last = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("s"), F.desc("e"))) == 1
    joined = videos.select("video_id", "usable").join(scenes.filter("s is not null and e is not null").withColumn("last", last), "video_id", "left")
    end = F.when(F.coalesce("last", F.lit(True)), F.col("usable")).otherwise(F.col("e"))
    return joined.select("video_id", F.coalesce("s", F.lit(0)).cast("bigint").alias("s"), end.cast("bigint").alias("e"))


class _Dedup:
    """Near-duplicates of the last kept frame or of the representative; the representative is joined to every row."""

    def __init__(self, bits: int) -> None:
        self.bits, self.last = bits, None

    def _same(self, a: tuple, b: tuple | None) -> bool:
        return b is not None and None not in (a[0], b[0]) and (int(a[0], 16) ^ int(b[0], 16)).bit_count() <= self.bits and a[1] == b[1]

    def step(self, row: tuple) -> list[tuple]:
        own, rep = (row.dhash, row.people), (row.rep_dhash, row.rep_people)
        if row.id == row.rep_id:
            self.last = rep
            return [(row.id,)]
        if self._same(own, self.last) or self._same(own, rep):
            return []
        self.last = own
        return [(row.id,)]

    def end(self) -> list[tuple]:
        return []


def drop_near_duplicates(frames: DataFrame, keys: list[str], *, bits: int = 4) -> DataFrame:
    """Ids of the frames kept per shot (frame, id, dhash, people, is_rep): keys, id.

    The representative (the first flagged one) is always kept. Others are dropped if at most ``bits`` of the hash differ
    and the number of people is the same, against the last kept frame or the representative.
    """
    reps = frames.filter("is_rep").groupBy(*keys).agg(F.min_by(F.struct("id", "dhash", "people"), F.struct("frame", "id")).alias("rep"))
    rows = frames.join(reps, keys, "left").select(*keys, "frame", "id", "dhash", F.coalesce("people", F.lit(-1)).alias("people"), F.coalesce("rep.id", F.lit(-1)).alias("rep_id"), F.col("rep.dhash").alias("rep_dhash"), F.coalesce("rep.people", F.lit(-1)).alias("rep_people"))
    types = dict(frames.dtypes)
    return streaming_fold(rows, keys, ["frame", "id"], ", ".join([*(f"{k} {types[k]}" for k in keys), "id bigint"]), lambda: _Dedup(bits))
