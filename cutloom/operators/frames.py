"""Tiling, candidate frames, motion votes, people and failure runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tile_counts(spans: DataFrame, key: str, *, win_s: float = 10.0, min_s: float = 2.0) -> DataFrame:
    """key, span, n and has_rest of the tiling of [0, span); spans without a tile are left out."""
    full = F.floor(F.col("span") / win_s)
    rest = F.col("span") - full * win_s
    alone = (rest > 1e-9) & ((rest >= min_s) | (full == 0))
    return spans.filter("span > 0").select(key, "span", (full + alone.cast("int")).alias("n"), (rest > 1e-9).alias("has_rest")).filter("n > 0")


def tile_end(j: Column, win_s: float = 10.0) -> Column:
    """The end of tile j (from 0) of a row of tile_counts."""
    return F.when((j == F.col("n") - 1) & F.col("has_rest"), F.col("span")).otherwise((j + 1) * win_s)


def tile(spans: DataFrame, key: str, *, win_s: float = 10.0, min_s: float = 2.0, position: str | None = None, block: int = 50_000) -> DataFrame:
    """Fixed tiling of [0, span): key, s, e, and the number from 1 as ``position``. A rest of at least min_s, or the only window, stands alone; a shorter one joins the last.

    A long span is cut into blocks of tiles, which are spread over the tasks.
    """
    blocks = tile_counts(spans, key, win_s=win_s, min_s=min_s).withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / block))))
    rows = blocks.repartition(4 * spans.sparkSession.sparkContext.defaultParallelism, key, "b")  # a given number, as the rows look too small to be kept apart
    rows = rows.withColumn("j", F.explode(F.sequence(F.col("b") * block, F.least(F.col("n"), (F.col("b") + 1) * block) - 1)))
    numbers = [(F.col("j") + 1).alias(position)] if position else []
    return rows.select(key, (F.col("j") * win_s).alias("s"), tile_end(F.col("j"), win_s).alias("e"), *numbers)


def candidate_frames(first: Column, last: Column, rate: Column, interval_s: float = 3.0) -> Column:
    """Sorted distinct frames of a shot to look at: the middle one, and one every interval from the first."""
    step = F.greatest(F.lit(1).cast("bigint"), F.bround(rate * interval_s, 0).cast("bigint"))
    middle = F.floor((first + last) / 2)
    return F.array_sort(F.array_distinct(F.concat(F.sequence(first, last, step), F.array(middle))))


def nearest_to_middle(candidates: Column, first: Column, last: Column) -> Column:
    """The candidate nearest to the middle, the smaller of equals."""
    middle = F.floor((first + last) / 2)
    return F.array_min(F.transform(candidates, lambda i: F.struct(F.abs(i - middle).alias("off"), i.alias("frame"))))["frame"]


def motion_pairs(first: Column, last: Column, rate: Column) -> Column:
    """Pairs (p0, p1) of close frames at the start, middle and end of a shot; pairs without extent are left out."""
    gap = F.greatest(F.lit(1).cast("bigint"), F.bround(rate * 0.2, 0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    starts = F.array_sort(F.array_distinct(F.array(first, first + F.greatest(zero, F.floor((last - first - gap) / 2)), F.greatest(first, last - gap))))
    pairs = F.transform(starts, lambda p: F.struct(p.alias("p0"), F.least(last, p + gap).alias("p1")))
    return F.filter(pairs, lambda p: p["p1"] > p["p0"])


def motion_label(features: Column, diff: Column, scale: Column, dx: Column, dy: Column, *, still: float = 0.002, zoom_eps: float = 0.005, dominance: float = 2.0, flat_max: float = 0.5) -> Column:
    """Motion of one pair. Without features the pixel difference decides; lost tracking or no fit is complex."""
    size = F.greatest(dx, dy)
    return (
        F.when(features == 0, F.when(diff < flat_max, "static").otherwise("complex"))
        .when(scale.isNull() | dx.isNull() | dy.isNull(), "complex")
        .when((F.abs(scale - 1) > zoom_eps) & (size < still * 10), "zoom")
        .when(size < still, "static")
        .when(dx > dy * dominance, "pan")
        .when(dy > dx * dominance, "tilt")
        .otherwise("complex")
    )


def motion_vote(labels: Column) -> Column:
    """Motion of a shot from its pairs' labels: none, or all static, is static; else the label of more than half of the moving pairs, else complex."""
    moving = F.filter(labels, lambda x: x != "static")
    counts = F.transform(F.array_distinct(moving), lambda x: F.struct(F.size(F.filter(moving, lambda y: y == x)).alias("n"), x.alias("label")))
    best = F.array_max(counts)
    return F.when(F.size(moving) <= 0, "static").when(best["n"] * 2 > F.size(moving), best["label"]).otherwise("complex")


def people(boxes: Column, width: Column, height: Column, least: float = 0.5) -> Column:
    """STRUCT<count, max_area_share> of detected boxes (label, score, x0, y0, x1, y1): label 1 with at least the score."""
    found = F.filter(boxes, lambda b: (b["label"] == 1) & (b["score"] >= least))
    area = F.array_max(F.transform(found, lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])))
    return F.struct(F.size(found).alias("count"), F.round(F.coalesce(area / (width * height), F.lit(0.0)), 4).alias("max_area_share"))


def failure_runs(outcomes: DataFrame, key: str, *, limit: int = 5) -> DataFrame:
    """Longest run of consecutive failures per key, and the position (from 1) at which a run first reached the limit, else null.

    outcomes: key, at (order), failed. A null outcome neither counts nor resets: leave it out of the run.
    """
    rows = outcomes.filter("failed is not null")
    order = Window.partitionBy(key).orderBy("at")
    rows = rows.withColumn("position", F.row_number().over(order)).withColumn("ok", F.sum((~F.col("failed")).cast("int")).over(order))
    inside = rows.filter("failed").withColumn("run", F.row_number().over(Window.partitionBy(key, "ok").orderBy("at")))
    runs = inside.groupBy(key).agg(F.max("run").alias("longest"), F.min(F.when(F.col("run") >= limit, F.col("position"))).alias("trips_at"))
    return rows.select(key).distinct().join(runs, key, "left").select(key, F.coalesce("longest", F.lit(0)).alias("longest"), "trips_at")
