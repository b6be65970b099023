"""Overlapping, nested and gapped intervals: continuous periods per entity and the gaps between them.

Intervals go to blocks of time by their start, so that an entity with a third of all rows is spread over many tasks. Each
(entity, block) keeps an ordered disjoint-interval map as its keyed state: an insertion finds its overlaps by binary search
and merges them. Blocks are then stitched by a running maximum over one summary row per block, never over the intervals.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutloom.session import cut_lineage


class IntervalMap:
    """Ordered disjoint closed-touching intervals; touching ones join. ``starts`` and ``ends`` are sorted lists."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: list | None = None, ends: list | None = None) -> None:
        self.starts, self.ends = starts or [], ends or []

    def insert(self, start: int, end: int) -> None:
        """Merge [start, end) in. The overlapped run is found by binary search on both lists and replaced at once."""
        if not self.starts or start > self.ends[-1]:
            self.starts.append(start)
            self.ends.append(end)
            return
        low, high = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if low < high:
            start, end = min(start, self.starts[low]), max(end, self.ends[high - 1])
        self.starts[low:high], self.ends[low:high] = [start], [end]

    def gaps(self) -> list[tuple[int, int]]:
        """Pauses between consecutive intervals."""
        return list(zip(self.ends[:-1], self.starts[1:], strict=True))


def _fold(names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by key and block, in any order within them: the map of one key is held, and written out when the next key begins."""
        key, state = None, IntervalMap()

        def flushed() -> list[tuple]:
            last = len(state.starts) - 1
            return [(*key, s, e, state.ends[i - 1] if i else None, i == last) for i, (s, e) in enumerate(zip(state.starts, state.ends, strict=True))]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[*names, "s", "e", "prev_e", "last_in_block"])
            return out.astype({"prev_e": "Int64"})

        for batch in batches:
            done: list[tuple] = []
            for *now, s, e in batch[[*names, "s", "e"]].itertuples(index=False, name=None):
                if now != key:
                    if key is not None:
                        done += flushed()
                    key, state = now, IntervalMap()
                state.insert(s, e)
            if done:
                yield frame(done)
        if key is not None:
            yield frame(flushed())

    return run


def periods_and_gaps(df: DataFrame, keys: list[str], start_ms: str, end_ms: str, *, max_gap_ms: int | None = None, block_ms: int = 900_000) -> DataFrame:
    """Maximal continuous periods per key and the pauses between consecutive periods.

    Result: the keys (as text), item (``period`` or ``gap``), start_ms, end_ms (BIGINT). Touching intervals join. Rows with a null key
    part form their own key; rows with a null bound or with end < start are ignored. Gaps longer than max_gap_ms are left
    out (None: all are listed). Repeated rows change nothing; an empty table gives none; other columns are ignored.
    """
    names = [*(f"k{i}" for i in range(len(keys))), "block"]
    null = "\x00"
    base = df.select(*[F.coalesce(F.col(k).cast("string"), F.lit(null)).alias(n) for k, n in zip(keys, names, strict=False)], F.col(start_ms).cast("bigint").alias("s"), F.col(end_ms).cast("bigint").alias("e"))
    base = base.filter("s is not null and e is not null and e >= s").withColumn("block", F.floor(F.col("s") / block_ms).cast("bigint"))
    schema = T.StructType([*(base.schema[n] for n in names), T.StructField("s", T.LongType()), T.StructField("e", T.LongType()), T.StructField("prev_e", T.LongType()), T.StructField("last_in_block", T.BooleanType())])
    # The merged rows are read four times below; they are made once.
    merged = cut_lineage(base.select(*names, "s", "e").repartition(*names).sortWithinPartitions(*names).mapInPandas(_fold(names), schema))

    entity = names[:-1]
    by_block = Window.partitionBy(*entity).orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    # One row per block: how far all earlier blocks reach into this one.
    reach = merged.groupBy(*names).agg(F.max("e").alias("max_e")).withColumn("carry", F.max("max_e").over(before))
    stitched = merged.join(reach.select(*names, "carry"), names)
    # What begins within the reach of earlier blocks is no new period; the rest begins one, after the pause since prev_end.
    begins = stitched.filter("carry is null or s > carry").withColumn("prev_end", F.greatest("carry", "prev_e"))
    inner = begins.filter(~F.col("last_in_block")).select(*entity, F.lit("period").alias("item"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))
    gaps = begins.filter("prev_end is not null").select(*entity, F.lit("gap").alias("item"), F.col("prev_end").alias("start_ms"), F.col("s").alias("end_ms"))
    if max_gap_ms is not None:
        gaps = gaps.filter(F.col("end_ms") - F.col("start_ms") <= max_gap_ms)
    # The last period that begins in a block ends where the next beginning finds its prev_end, in whatever block that is.
    borders = begins.groupBy(*names).agg(F.min_by("prev_end", "s").alias("first_prev_end"), F.max("s").alias("s"))
    ends = reach.groupBy(*entity).agg(F.max("max_e").alias("final_e"))
    last = (
        borders.withColumn("next_prev_end", F.lead("first_prev_end").over(by_block))
        .join(ends, entity)
        .select(*entity, F.lit("period").alias("item"), F.col("s").alias("start_ms"), F.coalesce("next_prev_end", "final_e").alias("end_ms"))
    )
    out = inner.unionByName(gaps).unionByName(last)
    return out.select(*[F.when(F.col(n) != null, F.col(n)).alias(k) for k, n in zip(keys, entity, strict=True)], "item", "start_ms", "end_ms")


def millis(seconds: str):
    """Seconds as whole milliseconds, rounded; null if not finite or beyond BIGINT."""
    return F.when(F.abs(F.col(seconds)) < 9e12, F.round(F.col(seconds) * 1000).cast("bigint"))
