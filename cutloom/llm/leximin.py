"""One ranking from several differently scaled scores: leximin over percentiles.

Each space's distances become percentiles within the query, each item's percentiles are sorted ascending, and items are
compared as arrays: the item whose weakest space is strongest comes first, so that no space can mask a weak one.
Percentiles are exact. The scores of a query in a space are ranked in one window as long as they are a bounded number; where there are more,
equal distances are counted first, and the distinct ones are ranked within buckets of equal depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutloom.session import broadcast_if_small, cut_lineage

KEY = ["query", "space"]
#: Buckets of a query and space that has too many scores for one window.
BUCKETS = 1024


def misplaced(scores: DataFrame, window_rows: int = 1_000_000) -> DataFrame:
    """How many items of the query are nearer in the space, ties half: query, item, space, behind.

    scores: query, item, space, dist (smaller is better, not null). Queries with more than window_rows scores in a space are ranked by buckets.
    """
    sizes = cut_lineage(scores.groupBy(*KEY).agg(F.count("*").alias("n")).filter(F.col("n") > window_rows).drop("n"))
    order = Window.partitionBy(*KEY).orderBy("dist")
    ranked = lambda rows: rows.select("query", "item", "space", (F.rank().over(order) - 1 + (F.count("*").over(Window.partitionBy(*KEY, "dist")) - 1) / 2).alias("behind"))
    if sizes.isEmpty():
        return ranked(scores)
    hot = broadcast_if_small(sizes)  # at most one key per window_rows scores
    return ranked(scores.join(hot, KEY, "left_anti")).unionByName(_by_buckets(scores.join(hot, KEY, "left_semi")))


def _by_buckets(scores: DataFrame) -> DataFrame:
    """The same where one window would be too large: only distinct distances are ranked, each within its bucket."""
    values = scores.groupBy(*KEY, "dist").agg(F.count("*").alias("c"))
    cuts = values.groupBy(*KEY).agg(F.percentile_approx("dist", [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS).alias("cuts"))
    values = values.join(broadcast_if_small(cut_lineage(cuts), 1000), KEY).withColumn("bucket", F.size(F.filter("cuts", lambda x: x < F.col("dist")))).drop("cuts")
    before = Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = values.groupBy(*KEY, "bucket").agg(F.sum("c").alias("n")).withColumn("nearer", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy(*KEY, "bucket").orderBy("dist").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("nearer_inside", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(buckets.drop("n"), [*KEY, "bucket"])
    behind = F.col("nearer") + F.col("nearer_inside") + (F.col("c") - 1) / 2
    return scores.join(ranked.select(*KEY, "dist", behind.alias("behind")), [*KEY, "dist"]).select("query", "item", "space", "behind")


def leximin_top(results: DataFrame, *, query: str, item: str, spaces_map: str, spaces: tuple[str, ...], k: int, window_rows: int = 1_000_000) -> DataFrame:
    """The k items of each query that come first by leximin: query, item, goodness (array, ascending), position.

    spaces_map is a MAP of space to a STRUCT with a field dist. The goodness of an item in a space is the share of the query's other
    items that are worse there, ties half; a space that is absent, null or NaN is worse than all others and has goodness 0. The
    same item delivered twice counts once, with the smaller distance of each space. Ties go to the smaller item. Rows with a null
    query or item are ignored; queries with fewer than k items give what they have; an empty table gives none.
    """
    rows = results.filter(F.col(query).isNotNull() & F.col(item).isNotNull())
    dists = [F.when(~F.isnan(x), x).alias(f"d{i}") for i, x in enumerate(F.element_at(F.col(spaces_map), F.lit(s))["dist"].cast("double") for s in spaces)]
    items = rows.select(F.col(query).alias("query"), F.col(item).alias("item"), *dists).groupBy("query", "item").agg(*[F.min(f"d{i}").alias(f"d{i}") for i in range(len(spaces))])
    pairs = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("space"), F.col(f"d{i}").alias("dist")) for i in range(len(spaces))])
    long = items.select("query", "item", F.explode(F.filter(pairs, lambda p: p["dist"].isNotNull())).alias("p")).select("query", "item", "p.*")
    none = items.filter(F.coalesce(*[F.col(f"d{i}") for i in range(len(spaces))]).isNull()).select("query", "item", F.lit(-1).cast("tinyint").alias("space"), F.lit(0.0).alias("behind"))
    behind = misplaced(long, window_rows).unionByName(none).groupBy("query", "item").agg(F.array(*[F.max(F.when(F.col("space") == i, F.col("behind"))) for i in range(len(spaces))]).alias("v"))
    others = items.groupBy("query").agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("others"), F.count("*").alias("n"))
    goodness = F.transform("v", lambda b: F.coalesce((F.col("n") - 1 - b) / F.col("others"), F.lit(0.0)))
    vectors = behind.join(others, "query").select("query", "item", F.array_sort(goodness).alias("goodness"))
    order = Window.partitionBy("query").orderBy(F.desc("goodness"), "item")
    ranked = vectors.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
    return ranked.select(F.col("query").alias(query), F.col("item").alias(item), "goodness", "position")
