"""Scoring of ranked results against labelled ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spaces whose distances cannot be compared across queries.
EXEMPT = ("audio",)


def iou(s: Column, e: Column, a: Column, b: Column) -> Column:
    """Intersection of two ranges over their hull; 0 if the hull is empty."""
    inner = F.greatest(F.lit(0.0), F.least(e, b) - F.greatest(s, a))
    hull = F.greatest(e, b) - F.least(s, a)
    return F.when(hull > 0, inner / hull).otherwise(0.0)


def matches(s: Column, e: Column, a: Column, b: Column, containment: Column) -> Column:
    """IoU of at least a half, or starts within half a second, or, where that is allowed, the hit inside the range."""
    inside = F.coalesce(containment, F.lit(False)) & (s >= a) & (e <= b)
    return (iou(s, e, a, b) >= 0.5) | (F.abs(s - a) <= 0.5) | inside


def first_hits(results: DataFrame, queries: DataFrame, top: int = 3) -> DataFrame:
    """The best of the first ``top`` hits (query_id, position, cut_start_s, cut_end_s, per_space) that matches a range: one row per labelled query.

    position is null without a match. Unlabelled queries (null ranges) and negatives (no ranges) are left out.
    """
    labelled = queries.filter(F.size("gt_ranges") > 0).select(F.col("id").alias("query_id"), "class", "expected_fail", "containment_ok", "gt_ranges")
    ranges = labelled.select("query_id", "containment_ok", F.explode("gt_ranges").alias("g")).select("query_id", "containment_ok", F.get("g", F.lit(0)).alias("a"), F.get("g", F.lit(1)).alias("b"))
    pairs = results.filter(F.col("position") <= top).join(ranges, "query_id")
    good = pairs.filter(matches(F.col("cut_start_s"), F.col("cut_end_s"), F.col("a"), F.col("b"), F.col("containment_ok")))
    best = good.groupBy("query_id").agg(F.min("position").alias("position"), F.min_by("per_space", "position").alias("per_space"))
    return labelled.select("query_id", "class", "expected_fail").join(best, "query_id", "left")


def verdicts(hits: DataFrame) -> DataFrame:
    """PASS, FAIL, XFAIL or XPASS of each labelled query."""
    hit, xf = F.col("position").isNotNull(), F.coalesce("expected_fail", F.lit(False))
    verdict = F.when(hit & ~xf, "PASS").when(hit, "XPASS").when(xf, "XFAIL").otherwise("FAIL")
    return hits.select("query_id", "class", "position", verdict.alias("verdict"))


def space_floors(hits: DataFrame) -> DataFrame:
    """The loosest distance of a true hit in each space."""
    return hits.filter("position is not null").select(F.explode("per_space").alias("space", "v")).groupBy("space").agg(F.max("v.dist").alias("floor"))


def negative_verdicts(results: DataFrame, queries: DataFrame, floors: DataFrame, top: int = 3) -> DataFrame:
    """Verdict of each negative query (no ranges): FAIL if one of its first hits is as near as a true hit in that space, SKIP if a space has no floor, else PASS."""
    negatives = queries.filter(F.size("gt_ranges") == 0).select(F.col("id").alias("query_id"), "class")
    rows = results.filter(F.col("position") <= top).join(negatives, "query_id").select("query_id", F.explode("per_space").alias("space", "v")).filter(~F.col("space").isin(*EXEMPT))
    judged = rows.join(F.broadcast(floors), "space", "left").groupBy("query_id").agg(F.sum((F.coalesce(F.col("v.dist") <= F.col("floor"), F.lit(False))).cast("int")).alias("breaches"), F.sum(F.col("floor").isNull().cast("int")).alias("uncalibrated"))
    joined = negatives.join(judged, "query_id", "left").fillna(0, ["breaches", "uncalibrated"])
    return joined.select("query_id", "class", "breaches", F.when(F.col("breaches") > 0, "FAIL").when(F.col("uncalibrated") > 0, "SKIP").otherwise("PASS").alias("verdict"))


def scoreboard(all_verdicts: DataFrame) -> DataFrame:
    """Passed and total queries per class."""
    return all_verdicts.groupBy("class").agg(F.count_if(F.col("verdict") == "PASS").alias("passed"), F.count("*").alias("total"))
