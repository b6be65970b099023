"""Mixing sources to target weights: hash-threshold histograms.

Tokens are summed by source and hash bucket; the budget of a source lies in one bucket of its histogram, only that boundary
bucket is refined by the next bits of the hash, and what is chosen is then a plain filter: nothing is sorted, and the chosen
sets of growing budgets are nested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutloom.session import cut_lineage

#: Bits of the hash per histogram, and how often the boundary bucket is refined.
BITS, LEVELS = 12, 4


def _prefix(levels: int):
    return F.shiftrightunsigned("h", 64 - BITS * levels)


def _histogram(rows: DataFrame, level: int) -> DataFrame:
    """source, bucket, tokens, and the tokens up to and with the bucket: at most sources x 2^BITS rows, whatever the number of documents."""
    sums = rows.groupBy("source", _prefix(level).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"))
    return sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")))


def _thresholds(sized: DataFrame, histogram: DataFrame, budgets: dict[str, int]) -> dict[str, int]:
    """For each source the hash prefix below which documents are taken, so that their tokens come nearest to its budget. One row per source comes to the driver at each level."""
    spark = sized.sparkSession
    known = {s: (0, 0) for s in budgets}  # the boundary bucket's prefix, and the tokens below it
    rows = sized
    for level in range(1, LEVELS + 1):
        wanted = F.broadcast(spark.createDataFrame([(s, budgets[s] - below) for s, (_, below) in known.items()], "source string, room long"))
        over = histogram.join(wanted, "source").filter(F.col("upto") > F.col("room"))
        for source, found in over.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("below")), "bucket")).collect():
            known[source] = (found["bucket"], known[source][1] + found["below"])
        # Only the documents of the boundary buckets, one in 2^BITS at each level, are looked at again.
        at = F.broadcast(spark.createDataFrame([(s, p) for s, (p, _) in known.items()], "source string, boundary long"))
        rows = cut_lineage(rows.join(at, "source").filter(_prefix(level) == F.col("boundary")).drop("boundary"))
        if level < LEVELS:
            histogram = _histogram(rows, level + 1)
    left = dict(rows.groupBy("source").agg(F.sum("n_tokens")).collect())
    # The documents of the last boundary are few, mostly one: all are taken if that comes nearer.
    return {s: prefix + int(below + left[s] - budgets[s] < budgets[s] - below) for s, (prefix, below) in known.items()}


def plan_mix(totals: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, tuple[int, int]]:
    """Passes and remaining budget (in tokens) of each source: {source: (whole passes, budget of the last, partial one)}.

    Weights are shared among the sources that have tokens, a weight and repeats. Without a total, it is the largest at which
    every share is met; with one that is too large, sources that run out give all they may, and their shares fall short.
    """
    active = {s: (w, r) for s, (w, r) in targets.items() if w > 0 and r > 0 and totals.get(s, 0) > 0}
    if not active:
        return {}
    weights = sum(w for w, _ in active.values())
    if total is None:
        total = min(totals[s] * r / w for s, (w, r) in active.items()) * weights
    plan = {}
    for source, (weight, repeats) in active.items():
        budget = min(round(total * weight / weights), totals[source] * repeats)
        plan[source] = divmod(budget, totals[source])
    return plan


def mix_sources(documents: DataFrame, targets: DataFrame, *, id_col: str, source_col: str, size: str, total: int | None = None) -> DataFrame:
    """The chosen documents and how often each is used: doc_id, source, n_tokens, repeats.

    targets: source, weight (relative, at least 0), max_repeats; of a source listed twice the larger values hold; it must have at
    most 10,000 rows. Documents of no target source, of a null source, or without tokens (size null or 0) are not chosen. A document is used
    whole: shares are met to within the size of one document per source. Repeated rows of one id are all chosen or none.
    The choice depends only on the id, not on partitioning; a larger total contains the documents of a smaller one.
    """
    rows = targets.groupBy("source").agg(F.max("weight").alias("w"), F.max("max_repeats").alias("r")).filter("source is not null and w is not null and r is not null").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 target sources")
    wanted = {x["source"]: (float(x["w"]), int(x["r"])) for x in rows}
    spark = documents.sparkSession
    named = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(size).cast("bigint").alias("n_tokens"))
    names = F.broadcast(spark.createDataFrame([(s,) for s in wanted], "source string"))
    sized = cut_lineage(named.join(names, "source", "left_semi").filter("n_tokens > 0").withColumn("h", F.xxhash64("doc_id")))
    histogram = cut_lineage(_histogram(sized, 1))
    totals = dict(histogram.groupBy("source").agg(F.sum("tokens")).collect())
    plan = plan_mix(totals, wanted, total)
    partial = {s: rest for s, (_, rest) in plan.items() if rest > 0}
    limits = _thresholds(sized, histogram, partial) if partial else {}
    chosen = F.broadcast(spark.createDataFrame([(s, passes, limits.get(s, 0)) for s, (passes, _) in plan.items()], "source string, passes int, below long"))
    repeats = (F.col("passes") + (_prefix(LEVELS) < F.col("below")).cast("int")).alias("repeats")
    return sized.join(chosen, "source").select("doc_id", "source", "n_tokens", repeats).filter("repeats > 0")


def mix_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Actual shares per target source: source, weight, target_share, planned_share, documents, tokens (with repeats), actual_share.

    target_share is relative to all weights; planned_share, which actual_share is to meet, only to those of sources that gave documents,
    as mix_sources shares out the weights of the others. Sources without documents have shares of 0 but for the target.
    """
    used = mix.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    goals = targets.filter("source is not null").groupBy("source").agg(F.max("weight").alias("weight"))
    everything = Window.partitionBy(F.lit(0))  # over one row per target source
    out = goals.join(used, "source", "left").withColumn("own", F.when(F.col("tokens") > 0, F.col("weight")))
    for name in ("weight", "own", "tokens"):
        out = out.withColumn(f"all_{name}", F.sum(name).over(everything))
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))
    return out.select("source", "weight", share("weight", "all_weight").alias("target_share"), share("own", "all_own").alias("planned_share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), share("tokens", "all_tokens").alias("actual_share"))
