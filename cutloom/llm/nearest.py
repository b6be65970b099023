"""Matching records of two tables by nearest time within a tolerance: a two-pointer streaming merge.

Both tables are repartitioned by entity and block of time and sorted within partitions; one pass over the merged stream
holds only the neighbouring right record and the left rows that still wait for their next one. A block is much longer than
the tolerance; right rows within the tolerance of a border go to both blocks, so a hot entity is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distances are compared with this slack for the rounding of binary fractions.
EPS = 1e-9


def _step(rows: pd.DataFrame, tolerance: float, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Pairs that are settled in these sorted rows, and the rows to carry on: the last right record and waiting left rows."""
    n = len(rows)
    t, is_right, ids = rows["t"].to_numpy(), rows["side"].to_numpy() == 0, rows["id"].to_numpy()
    new = np.ones(n, dtype=bool)
    new[1:] = (rows["k"].to_numpy()[1:] != rows["k"].to_numpy()[:-1]) | (rows["b"].to_numpy()[1:] != rows["b"].to_numpy()[:-1])
    group, at = np.cumsum(new), np.arange(n)
    before = np.maximum.accumulate(np.where(is_right, at, -1))
    after = np.minimum.accumulate(np.where(is_right, at, n)[::-1])[::-1]
    has_before = (before >= 0) & (group[before] == group)
    has_after = (after < n) & (group[np.minimum(after, n - 1)] == group)
    to_before = np.where(has_before, t - t[before], np.inf)
    to_after = np.where(has_after, t[np.minimum(after, n - 1)] - t, np.inf)
    ids_before, ids_after = ids[before], ids[np.minimum(after, n - 1)]
    back = (to_before < to_after) | ((to_before == to_after) & (ids_before < ids_after))
    best, chosen = np.where(back, to_before, to_after), np.where(back, ids_before, ids_after)
    open_end = (group == group[-1]) & ~has_after
    waits = ~is_right & open_end & (t[-1] - t <= np.minimum(to_before, tolerance + EPS)) & (not last)
    settled = ~is_right & ~waits & (best <= tolerance + EPS)
    keep = waits.copy()
    if not last and has_before[-1]:
        keep[before[-1]] = True
    return pd.DataFrame({"left_id": ids[settled], "right_id": chosen[settled]}), rows[keep]


def merge_sorted(batches: Iterator[pd.DataFrame], tolerance: float) -> Iterator[pd.DataFrame]:
    """The streaming merge over batches of rows sorted by k, b, t, side (0 right, 1 left), id."""
    carry, tail = None, None
    for batch in batches:
        if batch.empty:
            continue
        raw_tail = batch.iloc[[-1]]
        seen = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
        # The same left row again, or another right record at the same edge (the smallest id comes first), is dropped.
        same = (seen[["k", "b", "t", "side"]] == seen[["k", "b", "t", "side"]].shift()).all(axis=1)
        repeated = same & ((seen["side"] == 0) | (seen["id"] == seen["id"].shift()))
        fresh = seen[~repeated] if tail is None else seen.iloc[1:][~repeated.iloc[1:]]
        tail = raw_tail
        rows = fresh if carry is None else pd.concat([carry, fresh], ignore_index=True)
        if rows.empty:
            continue
        out, carry = _step(rows.reset_index(drop=True), tolerance, last=False)
        yield out
    if carry is not None and len(carry):
        yield _step(carry.reset_index(drop=True), tolerance, last=True)[0]


def nearest_in_time(left: DataFrame, right: DataFrame, *, entity: list[str], left_id: str, left_time: str | Column, right_id: str, right_time: str | Column, tolerance: float, block: float = 600.0) -> DataFrame:
    """For each left row the right row of the same entity nearest in time, at most tolerance away: left_id, right_id (BIGINT).

    Of right rows at one time the smallest id is taken; of two equally near ones at different times as well. Rows with a null
    entity part, id or time, or a time that is not finite, match nothing. Repeated rows (same entity, time and id) count
    once. Left rows without a match are left out; empty tables give none; other columns are ignored. block must be longer
    than the tolerance; it bounds what one task sees of an entity.
    """
    if block <= 2 * tolerance:
        raise ValueError("block must be longer than twice the tolerance")

    def side(df: DataFrame, number: int, key: str, time: str | Column) -> DataFrame:
        time = (F.col(time) if isinstance(time, str) else time).cast("double")
        rows = df.dropna(subset=entity).select(F.concat_ws("\x01", *[F.col(c).cast("string") for c in entity]).alias("k"), time.alias("t"), F.lit(number).alias("side"), F.col(key).cast("bigint").alias("id"))
        return rows.filter("id is not null and t > double('-Infinity') and t < double('Infinity')")

    low, high = F.floor((F.col("t") - tolerance - EPS) / block), F.floor((F.col("t") + tolerance + EPS) / block)
    rows = side(left, 1, left_id, left_time).withColumn("b", F.floor(F.col("t") / block)).unionByName(
        side(right, 0, right_id, right_time).withColumn("b", F.explode(F.array_distinct(F.array(low, high))))
    )
    rows = rows.select("k", "b", "t", "side", "id").repartition("k", "b").sortWithinPartitions("k", "b", "t", "side", "id")
    return rows.mapInPandas(lambda batches: merge_sorted(batches, tolerance), "left_id bigint, right_id bigint")
