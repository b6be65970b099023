"""Queries of the general data problems over the tables of the index (p1, p3, p4), with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.operators.nested import VariantTables, flatten_payloads
from cutloom.operators.periods import millis, periods_and_gaps
from cutloom.operators.references import media_deleted, media_references, media_targets, orphan_references
from cutloom.sources import table

#: Kinds whose intervals form periods, and the longest pause that counts as a gap.
PERIOD_KINDS, MAX_GAP_MS = ("speech_region", "music", "noise"), 300_000
#: Arrays of objects in the payloads, by kind.
CHILD_PATHS = {"speech": ("words", "words.alts"), "shot": ("motion_evidence.evidence",)}


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """All orphan references of the index, with arrival and period."""
    segments, deletes = table(spark, d, "segments"), table(spark, d, "segment_deletes")
    refs = media_references(segments, table(spark, d, "jobs"), table(spark, d, "cut_marks"), table(spark, d, "search_results"))
    return orphan_references(refs, media_targets(segments, table(spark, d, "videos")), media_deleted(deletes))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references, one row each."""
    return orphans(spark, d).select("src_table", "src_key", "ref_field", "ref_value", "status")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references counted per table, field, month of arrival and status."""
    month = F.date_format("period", "yyyy-MM").alias("month")
    return orphans(spark, d).groupBy("src_table", "ref_field", month, "status").agg(F.count("*").alias("orphans"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods and gaps of speech_region, music and noise per video."""
    rows = table(spark, d, "segments").filter(F.col("kind").isin(*PERIOD_KINDS))
    rows = rows.filter(F.col("t_end_s") > F.col("t_start_s")).select("video_id", "kind", millis("t_start_s").alias("s_ms"), millis("t_end_s").alias("e_ms"))
    return periods_and_gaps(rows, ["video_id", "kind"], "s_ms", "e_ms", max_gap_ms=MAX_GAP_MS)


def _routed(spark: SparkSession, d: str) -> VariantTables:
    """The objects of speech and shot payloads, routed to a table per path and variant."""
    return VariantTables(flatten_payloads(table(spark, d, "segments"), CHILD_PATHS))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Objects in the arrays of speech and shot payloads, with their links: those of all variants' tables."""
    return _routed(spark, d).links()


def p4_children(spark: SparkSession, d: str) -> DataFrame:
    """The same objects with the columns of the common supertype."""
    return _routed(spark, d).supertype().drop("variant", "body")


def p4_variants(spark: SparkSession, d: str) -> DataFrame:
    """The variants that were found under each path, with their keys."""
    return _routed(spark, d).variants().select("path", F.array_sort(F.map_keys("types")).alias("keys"), "objects")


def p4_words(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of the usual variant of words."""
    return _routed(spark, d).table("words", {"w": "text", "t0": "number", "t1": "number", "prob": "number"})


def p4_fits(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of motion evidence with a fitted move."""
    return _routed(spark, d).table("motion_evidence.evidence", {"scale": "number", "dx": "number", "dy": "number"})


def p4_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of motion evidence that tells how many features were kept."""
    return _routed(spark, d).table("motion_evidence.evidence", {"features": "number", "tracked": "number"})


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p4_found": p4_found, "p4_children": p4_children, "p4_variants": p4_variants, "p4_words": p4_words, "p4_fits": p4_fits, "p4_tracks": p4_tracks}

_P1 = r"""
WITH norm AS (
  SELECT id, video_id, kind, ingested_at,
         CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.shot_index') END AS raw_si,
         CASE WHEN kind = 'speech_window' AND json_valid(payload) THEN json_extract(payload, '$.source_speech_ids[*]') END AS ids
  FROM segments),
seg AS (SELECT *, CASE WHEN try_cast(trim(raw_si) AS DOUBLE) = floor(try_cast(trim(raw_si) AS DOUBLE)) THEN CAST(CAST(try_cast(trim(raw_si) AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE trim(raw_si) END AS si FROM norm),
windows AS (SELECT id, video_id, ingested_at, trim(json_extract_string(unnest(ids), '$')) AS raw FROM seg WHERE kind = 'speech_window'),
refs AS (
  SELECT 'segments' AS src_table, CAST(id AS VARCHAR) AS src_key, 'video_id' AS ref_field, video_id AS ref_value, 'v' AS tk, NULL AS vid, video_id AS rv, ingested_at AS arrival FROM seg
  UNION ALL SELECT 'segments', CAST(id AS VARCHAR), 'shot_index', si, 's', video_id, si, ingested_at FROM seg WHERE kind IN ('frame', 'caption')
  UNION ALL SELECT 'segments', CAST(id AS VARCHAR), 'source_speech_ids', x, 'p', video_id, x, ingested_at FROM (
    SELECT id, video_id, ingested_at, CASE WHEN try_cast(raw AS DOUBLE) = floor(try_cast(raw AS DOUBLE)) THEN CAST(CAST(try_cast(raw AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE raw END AS x FROM windows)
  UNION ALL SELECT 'jobs', video_id || '/' || stage, 'video_id', video_id, 'v', NULL, video_id, updated_at FROM jobs
  UNION ALL SELECT 'cut_marks', CAST(mark_id AS VARCHAR), 'video_id', video_id, 'v', NULL, video_id, created_at FROM cut_marks
  UNION ALL SELECT 'search_results', CAST(result_id AS VARCHAR), 'segment_id', CAST(segment_id AS VARCHAR), 'g', NULL, CAST(segment_id AS VARCHAR), served_at FROM search_results),
r AS (SELECT src_table, src_key, ref_field, ref_value, tk, vid, rv, min(arrival) AS arrival FROM refs WHERE ref_value IS NOT NULL GROUP BY ALL),
tg AS (
  SELECT 'v' AS tk, NULL AS vid, video_id AS rv, min(ingested_at) AS seen FROM videos GROUP BY ALL
  UNION ALL SELECT 's', video_id, si, min(ingested_at) FROM seg WHERE kind = 'shot' AND si IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'p', video_id, CAST(id AS VARCHAR), min(ingested_at) FROM seg WHERE kind = 'speech' GROUP BY ALL
  UNION ALL SELECT 'g', NULL, CAST(id AS VARCHAR), min(ingested_at) FROM seg GROUP BY ALL),
dl AS (
  SELECT DISTINCT 's' AS tk, video_id AS vid, json_extract_string(payload, '$.shot_index') AS rv FROM segment_deletes WHERE kind = 'shot' AND json_valid(payload)
  UNION SELECT 'p', video_id, CAST(id AS VARCHAR) FROM segment_deletes WHERE kind = 'speech'
  UNION SELECT 'g', NULL, CAST(id AS VARCHAR) FROM segment_deletes),
bad AS (
  SELECT r.src_table, r.src_key, r.ref_field, r.ref_value, r.arrival,
         CASE WHEN tg.tk IS NOT NULL THEN 'late' WHEN dl.tk IS NOT NULL THEN 'deleted' ELSE 'missing' END AS status
  FROM r LEFT JOIN tg ON r.tk = tg.tk AND r.rv = tg.rv AND coalesce(r.vid, '') = coalesce(tg.vid, '')
         LEFT JOIN dl ON r.tk = dl.tk AND r.rv = dl.rv AND coalesce(r.vid, '') = coalesce(dl.vid, '')
  WHERE tg.tk IS NULL OR tg.seen > r.arrival)
"""



def _own(x: str) -> str:
    """A JSON value, or the value that its text holds."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x}->>'$') THEN CAST({x}->>'$' AS JSON) ELSE {x} END"


def _items(source: str, keep: str) -> str:
    """Objects of the lists j of a source with their positions; one object in place of a list is position 0."""
    lists = f"SELECT {keep}, CASE json_type(j) WHEN 'OBJECT' THEN [j] WHEN 'ARRAY' THEN json_extract(j, '$[*]') END AS l FROM (SELECT {keep}, {_own('j')} AS j FROM {source})"
    each = f"SELECT {keep}, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS ix FROM ({lists}) WHERE l IS NOT NULL"
    return f"SELECT {keep}, ix, o FROM (SELECT {keep}, ix, {_own('e')} AS o FROM ({each})) WHERE json_type(o) = 'OBJECT'"


_P4 = f"""
WITH s AS (SELECT DISTINCT ON (id) id, kind, CAST(payload AS JSON) AS p FROM segments WHERE kind IN ('speech', 'shot') AND json_valid(payload)),
w AS ({_items("(SELECT id, p->'words' AS j FROM s WHERE kind = 'speech')", 'id')}),
a AS (SELECT id, pos, ix, o FROM ({_items("(SELECT id, ix AS pos, o->'alts' AS j FROM w)", 'id, pos')})),
m AS (SELECT id, {_own("j")} AS j FROM (SELECT id, p->'motion_evidence' AS j FROM s WHERE kind = 'shot')),
e AS ({_items("(SELECT id, j->'evidence' AS j FROM m WHERE json_type(j) = 'OBJECT')", 'id')}),
c AS (SELECT id AS segment_id, 'words' AS path, CAST(ix AS INT) AS pos, -1 AS sub_pos, o FROM w
  UNION ALL SELECT id, 'words.alts', CAST(pos AS INT), CAST(ix AS INT), o FROM a
  UNION ALL SELECT id, 'motion_evidence.evidence', CAST(ix AS INT), -1, o FROM e),
k AS (SELECT *, list_sort(list_filter(json_keys(o), lambda x: json_type(o, '$."' || x || '"') <> 'NULL')) AS keys FROM c)
"""


def _typed(path: str, keys: list[str]) -> str:
    """The typed table of a variant: all keys but w are numbers."""
    columns = ", ".join(f"o->>'{k}' AS {k}" if k == "w" else f"TRY_CAST(o->>'{k}' AS DOUBLE) AS {k}" for k in keys)
    return f"{_P4} SELECT segment_id, path, pos, sub_pos, {columns} FROM k WHERE path = '{path}' AND keys = {sorted(keys)}"


SQL = {
    "p1_found": _P1 + "SELECT src_table, src_key, ref_field, ref_value, status FROM bad",
    "p1_report": _P1 + "SELECT src_table, ref_field, strftime(arrival, '%Y-%m') AS month, status, count(*) AS orphans FROM bad GROUP BY ALL",
    "p3_found": """
WITH b AS (SELECT video_id, kind, CAST(round(t_start_s * 1000) AS BIGINT) AS s, CAST(round(t_end_s * 1000) AS BIGINT) AS e
           FROM segments WHERE kind IN ('speech_region', 'music', 'noise') AND t_end_s > t_start_s),
m AS (SELECT *, max(e) OVER (PARTITION BY video_id, kind ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, kind ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT video_id, kind, island, min(s) AS s, max(e) AS e FROM g GROUP BY ALL),
n AS (SELECT *, lag(e) OVER (PARTITION BY video_id, kind ORDER BY island) AS pe FROM p)
SELECT video_id, kind, 'period' AS item, s AS start_ms, e AS end_ms FROM n
UNION ALL SELECT video_id, kind, 'gap', pe, s FROM n WHERE pe IS NOT NULL AND s - pe <= 300000""",
    "p4_found": _P4 + "SELECT segment_id, path, pos, sub_pos FROM c",
    "p4_children": _P4 + """SELECT segment_id, path, pos, sub_pos, coalesce(o->>'w', o->>'word') AS label, TRY_CAST(coalesce(o->>'t0', o->>'start') AS DOUBLE) AS t0, TRY_CAST(coalesce(o->>'t1', o->>'end') AS DOUBLE) AS t1, TRY_CAST(o->>'prob' AS DOUBLE) AS prob FROM c""",
    "p4_variants": _P4 + "SELECT path, keys, count(*) AS objects FROM k GROUP BY path, keys",
    "p4_words": _typed("words", ["prob", "t0", "t1", "w"]),
    "p4_fits": _typed("motion_evidence.evidence", ["dx", "dy", "scale"]),
    "p4_tracks": _typed("motion_evidence.evidence", ["features", "tracked"]),
}
