"""Interval algebra on rows (key, s, e) in seconds: union, complement, padding, overlap share.

Every key is cut into blocks of time by the start of its intervals, so one with a third of all rows is spread over many tasks; only one
row per block goes on to the window over a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.session import cut_lineage

#: Seconds per block.
BLOCK_S = 3600.0


def _reached(rows: DataFrame, key: str, *keep: str) -> DataFrame:
    """key, block, s, e, keep, ``reach``: the largest e of all rows of the key before this one by (s, e), null for the first; and ``final``, the largest of all."""
    rows = rows.select(key, F.floor(F.col("s") / BLOCK_S).alias("block"), "s", "e", *keep).repartition(key, "block")
    inside = Window.partitionBy(key, "block").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(key, "block").agg(F.max("e").alias("most"))
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(key, "block", F.max("most").over(earlier).alias("carry"), F.max("most").over(Window.partitionBy(key)).alias("final"))
    return rows.withColumn("own", F.max("e").over(inside)).join(carry, [key, "block"]).withColumn("reach", F.greatest("own", "carry")).drop("own", "carry")


def merge(intervals: DataFrame, key: str) -> DataFrame:
    """Union of intervals per key; touching ones join. Rows with a null bound or key are ignored; one that runs backwards and meets no other stays as it is."""
    rows = _reached(intervals.filter(F.col("s").isNotNull() & F.col("e").isNotNull() & F.col(key).isNotNull()), key)
    # A row beyond the reach of all before it begins an island; the island ends at the reach that the next beginning finds.
    begins = cut_lineage(rows.filter("reach is null or s > reach"))  # read twice, by each of several merges that may follow one another
    following = F.lead("reach").over(Window.partitionBy(key, "block").orderBy("s"))
    blocks = begins.groupBy(key, "block").agg(F.min_by("reach", "s").alias("first_reach"))
    later = blocks.select(key, "block", F.lead("first_reach").over(Window.partitionBy(key).orderBy("block")).alias("later"))
    end = F.when(F.col("e") < F.col("s"), F.col("e")).otherwise(F.coalesce("following", "later", "final"))
    return begins.withColumn("following", following).join(later, [key, "block"]).select(key, "s", end.alias("e"))


def complement(intervals: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Gaps of the intervals in [0, span] for every key of spans (key, span); also for keys without intervals.

    Intervals may overlap or run backwards; gaps are cut to the span.
    """
    inner = intervals.filter("s is not null and e is not null").select(key, "s", "e").join(spans.select(key, "span"), key)
    rows = inner.unionByName(spans.select(key, F.col("span").alias("s"), F.col("span").alias("e"), "span"))
    gaps = _reached(rows, key, "span").select(key, F.greatest(F.lit(0.0), "reach").alias("s"), F.least("s", "span").alias("e"))
    return gaps.filter("s < e").distinct()


def padded(intervals: DataFrame, spans: DataFrame, key: str, pad: float) -> DataFrame:
    """Merged intervals, each widened by pad, cut to [0, span], and merged again; what ends up empty is dropped."""
    wide = merge(intervals, key).join(spans.select(key, "span"), key)
    return merge(wide.select(key, F.greatest(F.lit(0.0), F.col("s") - pad).alias("s"), F.least(F.col("span"), F.col("e") + pad).alias("e")).filter("s < e"), key)


def protected(speech: DataFrame, music: DataFrame, spans: DataFrame, key: str, pad: float) -> DataFrame:
    """What must not be cut: padded speech and music cut to the span, merged."""
    inside = music.join(spans.select(key, "span"), key).select(key, F.greatest(F.lit(0.0), F.col("s")).alias("s"), F.least("span", "e").alias("e")).filter("s < e")
    return merge(padded(speech, spans, key, pad).unionByName(inside), key)


def silence(speech: DataFrame, music: DataFrame, spans: DataFrame, key: str, pad: float) -> DataFrame:
    """The complement of what is protected."""
    return complement(protected(speech, music, spans, key, pad), spans, key)


def _covered(s: Column, e: Column) -> Column:
    # Without the guard a row that met no region would get a positive share, as least and greatest skip nulls.
    return F.when(F.col("r_s").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(e, "r_e") - F.greatest(s, "r_s")))


def overlap_share(rows: DataFrame, regions: DataFrame, key: str, row_id: str, *, bin_s: float = 60.0, name: str = "share") -> DataFrame:
    """Share of each row [s, e) that merged regions of its key cover: row_id, share in [0, 1].

    Both sides are split into bins of time and meet by key and bin, each part cut to its bin, so a long key is spread and no
    pair is counted twice. Rows are aggregated by their id.
    """
    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        last = F.greatest(F.floor(F.col(s) / bin_s), F.ceil(F.col(e) / bin_s) - 1)
        return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(s) / bin_s), last)))

    left = binned(rows.select(key, row_id, "s", "e"), "s", "e")
    right = binned(regions.filter("s < e").select(key, F.col("s").alias("r_s"), F.col("e").alias("r_e")), "r_s", "r_e")
    low, high = F.col("bin") * bin_s, (F.col("bin") + 1) * bin_s
    part_s, part_e = F.greatest(F.col("s"), low), F.least(F.col("e"), high)
    joined = left.join(right, [key, "bin"], "left")
    sums = joined.groupBy(row_id).agg(F.sum(_covered(part_s, part_e)).alias("covered"), F.max("s").alias("s"), F.max("e").alias("e"))
    return sums.select(row_id, F.least(F.lit(1.0), F.col("covered") / F.greatest(F.col("e") - F.col("s"), F.lit(1e-9))).alias(name))


def passes_guards(no_speech: Column, logprob: Column, text: Column, no_speech_max: float = 0.6, logprob_min: float = -1.0) -> Column:
    """Whether speech is no hallucination; limits themselves pass, missing values count as 0, blank text fails."""
    zero = F.lit(0.0)
    return (F.coalesce(no_speech, zero) <= no_speech_max) & (F.coalesce(logprob, zero) >= logprob_min) & (F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) != "")
