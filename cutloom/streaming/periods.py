"""Streaming form of periods: an ordered disjoint-interval map per entity in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cutloom.operators.periods import IntervalMap


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Insert a micro-batch of intervals; the periods that changed and the gaps beside them are sent on, with a version."""
    starts, ends, version = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], 0)
    before = set(zip(starts, ends, strict=True))
    known = IntervalMap(starts, ends)
    for batch in batches:
        for s, e in batch[["s", "e"]].itertuples(index=False, name=None):
            known.insert(int(s), int(e))
    now = list(zip(known.starts, known.ends, strict=True))
    state.update((known.starts, known.ends, version + 1))
    rows = [(*key, "period", s, e, version + 1) for s, e in now if (s, e) not in before]
    gaps = IntervalMap(*map(list, zip(*sorted(before), strict=True))).gaps() if before else []
    rows += [(*key, "gap", s, e, version + 1) for s, e in known.gaps() if (s, e) not in set(gaps)]
    rows += [(*key, "gone", s, e, version + 1) for s, e in before if (s, e) not in set(now)]
    yield pd.DataFrame(rows, columns=["entity", "block", "item", "start_ms", "end_ms", "version"])


def stream_periods(intervals: DataFrame, entity: str, start_ms: str, end_ms: str, *, block_ms: int = 86_400_000) -> DataFrame:
    """Changes of the periods of a stream of intervals: entity, block, item (period, gap, gone), start_ms, end_ms, version.

    State is kept per entity and block of time (by start), so that it stays bounded: periods that cross a block border are stitched by
    a reader, as operators.periods does. Late intervals change the state whenever they come; rows with a null or backward interval
    are ignored. A ``gone`` row takes back a period that has been merged into another.
    """
    rows = intervals.select(F.col(entity).cast("string").alias("entity"), F.floor(F.col(start_ms) / block_ms).cast("bigint").alias("block"), F.col(start_ms).cast("bigint").alias("s"), F.col(end_ms).cast("bigint").alias("e"))
    rows = rows.filter("entity is not null and s is not null and e >= s")
    return rows.groupBy("entity", "block").applyInPandasWithState(
        _update, "entity string, block bigint, item string, start_ms bigint, end_ms bigint, version bigint", "starts array<bigint>, ends array<bigint>, version bigint", "append", GroupStateTimeout.NoTimeout
    )
