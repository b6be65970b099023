"""Queries of the training-data problems (p2, p5 to p10), with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.functions.values import parsed, text_at
from cutloom.llm.encoding import encode_corpus, token_count
from cutloom.llm.leximin import leximin_top
from cutloom.llm.mixing import mix_shares, mix_sources
from cutloom.llm.nearest import nearest_in_time
from cutloom.llm.neighbours import similar_pairs
from cutloom.llm.repetition import repetition
from cutloom.llm.residue import residue
from cutloom.session import broadcast_if_small, spread
from cutloom.sources import table

SPACES = ("image", "text", "audio")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each cut mark with the shot whose edge lies nearest, at most 0.5 s away."""
    edge = F.lower(F.regexp_replace("edge", r"\s+", ""))
    marks = table(spark, d, "cut_marks").select("mark_id", "video_id", edge.alias("edge"), "mark_s").filter(F.col("edge").isin("in", "out"))
    shots = table(spark, d, "segments").filter(F.col("kind") == "shot")
    edges = shots.select(F.col("id").alias("segment_id"), "video_id", F.explode(F.create_map(F.lit("in"), "t_start_s", F.lit("out"), "t_end_s")).alias("edge", "edge_s"))
    pairs = nearest_in_time(marks, edges, entity=["video_id", "edge"], left_id="mark_id", left_time="mark_s", right_id="segment_id", right_time="edge_s", tolerance=0.5)
    return pairs.select(F.col("left_id").alias("mark_id"), F.col("right_id").alias("segment_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The three segments of each query that stand best over all spaces."""
    top = leximin_top(table(spark, d, "search_results"), query="query_id", item="segment_id", spaces_map="per_space", spaces=SPACES, k=3)
    return top.select("query_id", "segment_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of segments with similar embeddings."""
    return similar_pairs(table(spark, d, "segments"), id_col="id", model_col="model_name", dim_col="dim", vector_col="embedding")


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"speech": "$.text", "speech_window": "$.text", "lyrics": "$.text", "caption": "$.description"}
    v = parsed(F.col("payload"))
    rows = table(spark, d, "segments").filter(F.col("kind").isin(*kinds)).select("id", "kind", v.alias("v"))
    return rows.select("id", F.when(F.col("kind") == "caption", text_at(F.col("v"), "$.description")).otherwise(text_at(F.col("v"), "$.text")).alias("text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts of at least 8 words more than half of which are repeated."""
    shares = repetition(_spoken(spark, d), id_col="id", text_col="text")
    return shares.filter("words >= 8 and share > 0.5").select(F.col("id").alias("segment_id"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of repeated words of every spoken, sung or described text."""
    shares = repetition(_spoken(spark, d), id_col="id", text_col="text")
    return shares.select(F.col("id").alias("segment_id"), "words", F.round("share", 6).alias("share"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, d, "documents"), id_col="doc_id", text_col="text")


def _mix(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", token_count(F.col("text")).alias("size"))
    return mix_sources(documents, table(spark, d, "mix_targets"), id_col="doc_id", source_col="source", size="size")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Chosen documents with their repeats."""
    return _mix(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every target source."""
    return mix_shares(_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with unfilled templates, or that consist of filler, an error message or a script notice. The slug is the last part of their video's address."""
    slug = F.replace(F.regexp_extract("source_url", "([^/?#]+)/*(?:[?#].*)?$", 1), F.lit("-"), F.lit(" "))
    slugs = table(spark, d, "videos").filter("source_url is not null").groupBy("video_id").agg(F.min(slug).alias("slug"))
    documents = table(spark, d, "documents").select("doc_id", "text", "source", "video_id").filter("text is not null")
    placed = documents.join(broadcast_if_small(slugs), "video_id", "left")
    return residue(placed, id_col="doc_id", text_col="text", host_col="source", slug_col="slug").select(F.col("id").alias("doc_id"))


QUERIES = {f.__name__: f for f in (p2_found, p5_found, p6_found, p7_found, p7_shares, p8_ids, p9_mix, p9_shares, p10_found)}

_P7 = r"""
WITH t AS (
  SELECT id, any_value(regexp_extract_all(lower(nfc_normalize(CASE WHEN kind = 'caption' THEN json_extract_string(payload, '$.description') ELSE json_extract_string(payload, '$.text') END)), '[\p{L}\p{N}]+')) AS w
  FROM segments WHERE kind IN ('speech', 'speech_window', 'lyrics', 'caption') AND json_valid(payload) GROUP BY id),
g AS (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3),
r AS (SELECT id, i, row_number() OVER (PARTITION BY id, w[i], w[i + 1], w[i + 2] ORDER BY i) AS nth FROM g),
m AS (SELECT id, count(DISTINCT j) AS repeated FROM (SELECT id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE nth > 1) GROUP BY id)
"""

SQL = {
    "p6_found": """
WITH vec AS (SELECT id, any_value(model_name) AS model_name, any_value(dim) AS dim, CAST(any_value(embedding) AS DOUBLE[]) AS v FROM segments
             WHERE embedding IS NOT NULL AND model_name IS NOT NULL AND len(embedding) = dim
               AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
c AS (SELECT a.id AS i, b.id AS o, list_cosine_similarity(a.v, b.v) AS c FROM vec a JOIN vec b ON a.model_name = b.model_name AND a.dim = b.dim AND a.id < b.id),
n AS (SELECT i, o, c FROM c WHERE c >= 0.9 UNION ALL SELECT o, i, c FROM c WHERE c >= 0.9),
t AS (SELECT i, o, row_number() OVER (PARTITION BY i ORDER BY c DESC, o) AS r FROM n)
SELECT DISTINCT least(i, o) AS id_a, greatest(i, o) AS id_b FROM t WHERE r <= 5""",
    "p2_found": """
WITH m AS (SELECT DISTINCT mark_id, video_id, lower(regexp_replace(edge, '\\s+', '', 'g')) AS edge, mark_s FROM cut_marks WHERE mark_s IS NOT NULL),
e AS (SELECT DISTINCT id, video_id, 'in' AS edge, t_start_s AS t FROM segments WHERE kind = 'shot' UNION ALL SELECT DISTINCT id, video_id, 'out', t_end_s FROM segments WHERE kind = 'shot'),
j AS (SELECT mark_id, id, row_number() OVER (PARTITION BY mark_id ORDER BY abs(t - mark_s), id) AS n FROM m JOIN e USING (video_id, edge) WHERE abs(t - mark_s) <= 0.5 + 1e-9)
SELECT mark_id, id AS segment_id FROM j WHERE n = 1""",
    "p5_found": """
WITH i AS (SELECT query_id, segment_id, min(CASE WHEN NOT isnan(per_space['image'].dist) THEN per_space['image'].dist END) AS a,
                  min(CASE WHEN NOT isnan(per_space['text'].dist) THEN per_space['text'].dist END) AS b,
                  min(CASE WHEN NOT isnan(per_space['audio'].dist) THEN per_space['audio'].dist END) AS c
           FROM search_results GROUP BY ALL),
l AS (SELECT query_id, segment_id, s, d, count(*) OVER (PARTITION BY query_id, s) AS n FROM (
  SELECT query_id, segment_id, 1 AS s, a AS d FROM i UNION ALL SELECT query_id, segment_id, 2, b FROM i UNION ALL SELECT query_id, segment_id, 3, c FROM i)),
p AS (SELECT query_id, segment_id, CASE WHEN d IS NULL THEN 0 ELSE
        (n - (rank() OVER (PARTITION BY query_id, s ORDER BY d NULLS LAST) - 1) - count(*) OVER (PARTITION BY query_id, s, d) + (count(*) OVER (PARTITION BY query_id, s, d) - 1) / 2.0) / greatest(n - 1, 1) END AS g FROM l),
v AS (SELECT query_id, segment_id, list_sort(list(CAST(g AS DOUBLE))) AS v FROM p GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, segment_id) AS n FROM v)
SELECT query_id, segment_id FROM k WHERE n <= 3""",
    "p7_shares": _P7 + """SELECT s.id AS segment_id, CAST(coalesce(len(w), 0) AS INT) AS words, round(coalesce(repeated / CAST(len(w) AS DOUBLE), 0), 6) AS share
FROM (SELECT DISTINCT id FROM segments WHERE kind IN ('speech', 'speech_window', 'lyrics', 'caption')) s LEFT JOIN t ON t.id = s.id LEFT JOIN m ON m.id = s.id""",
    "p7_found": _P7 + "SELECT t.id AS segment_id FROM t JOIN m ON t.id = m.id WHERE len(w) >= 8 AND repeated > len(w) / 2.0",
}
