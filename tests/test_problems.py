"""The general data problems against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cutloom.operators.nested import VariantTables, children, classify, flatten_payloads
from cutloom.operators.periods import IntervalMap, periods_and_gaps
from cutloom.operators.references import orphan_references

T0 = datetime(2025, 1, 1)
REFS = "src_table string, src_key string, ref_field string, ref_value string, key string, arrival timestamp, status string"


def test_orphans_against_brute_force(spark):
    rng = random.Random(1)
    refs, targets, deleted = [], [], [("gone1",), ("gone1",), (None,)]
    for i in range(600):
        key = rng.choice(["hot"] * 5 + ["cold"] * 3 + [f"k{rng.randrange(40)}", "gone1", "nowhere"])
        at = T0 + timedelta(hours=rng.randrange(2000))
        refs.append(("t", str(i), "f", key, key, at, "clash"))
        if rng.random() < 0.2:
            refs.append(("t", str(i), "f", key, key, at + timedelta(hours=900), "clash"))
    refs += [("t", "n1", "f", None, None, T0, None), ("t", "n2", "f", "x", None, T0, None), ("t", "n3", "f", "cold", "cold", None, None)]
    for k in ["hot", "cold", *(f"k{j}" for j in range(20))]:
        targets += [(k, T0 + timedelta(hours=rng.randrange(1500)), 1), (k, T0 + timedelta(hours=1900), 2)]
    seen = {}
    for k, t, _ in targets:
        seen[k] = min(seen.get(k, t), t)
    want = {}
    for _, key, _, value, k, at, _ in refs:
        if k is not None:
            first = min(a for _, x, _, _, _, a, _ in refs if x == key and a is not None) if at else None
            status = "late" if k in seen and first and seen[k] > first else None if k in seen else "deleted" if k == "gone1" else "missing"
            if status:
                want[key] = status
    # heavy_share of a tenth makes hot and cold heavy: at least 1000 references are needed, so rows are multiplied
    many = spark.createDataFrame(refs, REFS).crossJoin(spark.range(12).select(F.col("id").alias("m"))).withColumn("src_key", F.concat_ws("-", "src_key", "m"))
    out = orphan_references(many, spark.createDataFrame(targets, "key string, seen timestamp, status int"), spark.createDataFrame(deleted, "key string"), heavy_share=0.1)
    got = {(r["src_key"], r["status"]) for r in out.collect()}
    assert out.count() == len(got)
    assert got == {(f"{k}-{m}", s) for k, s in want.items() for m in range(12)}


def test_orphans_of_empty_tables(spark):
    none = spark.createDataFrame([], REFS)
    targets, deleted = spark.createDataFrame([], "key string, seen timestamp"), spark.createDataFrame([], "key string")
    assert orphan_references(none, targets, deleted).count() == 0
    one = spark.createDataFrame([("t", "1", "f", "a", "a", T0, None)], REFS)
    assert [r["status"] for r in orphan_references(one, targets, deleted).collect()] == ["missing"]


def brute_periods(rows, longest=None):
    out = set()
    for key in {k for k, _, _ in rows}:
        spans = sorted((s, e) for k, s, e in rows if k == key and s is not None and e is not None and e >= s)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(key, "period", s, e) for s, e in merged}
        out |= {(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if longest is None or b[0] - a[1] <= longest}
    return out


def test_interval_map_in_any_order():
    rng = random.Random(2)
    for _ in range(200):
        rows = [("a", s := rng.randrange(100), s + rng.randrange(12)) for _ in range(rng.randrange(1, 25))]
        known = IntervalMap()
        for _, s, e in rows:
            known.insert(s, e)
        got = {("a", "period", s, e) for s, e in zip(known.starts, known.ends)} | {("a", "gap", s, e) for s, e in known.gaps()}
        assert got == brute_periods(rows)


def test_periods_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        s = rng.randrange(-2000, 20000)
        rows.append((rng.choice(["a", "a", "a", "b", "c", None]), s, s + rng.choice([0, 3, 9, 40, -7, 900, 3000 if rng.random() < 0.02 else 5])))
    rows += rows[:40] + [("a", None, 5), ("d", 7, None), ("e", 10, 10), ("f", -50_000, 90_000), ("f", 90_000, 90_001), ("f", 90_040, 90_050)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "key string, s long, e long, item string, block long").repartition(5)
    for longest in (None, 30):
        got = periods_and_gaps(df, ["key"], "s", "e", max_gap_ms=longest, block_ms=500).collect()
        assert len(got) == len(set(got))
        assert {tuple(r) for r in got} == brute_periods(rows, longest)
    assert periods_and_gaps(df.limit(0), ["key"], "s", "e").count() == 0


PATHS = {"speech": ("words", "words.alts"), "shot": ("motion_evidence.evidence",)}


def test_nested_children():
    find = lambda kind, value: [(p, i, j) for p, i, j, _ in children(value if isinstance(value, str) or value is None else json.dumps(value), PATHS[kind])]
    w = {"w": "a", "t0": 1, "t1": 2}
    assert find("speech", {"words": [w, None, w]}) == [("words", 0, -1), ("words", 2, -1)]
    assert find("speech", {"words": json.dumps([w, None, dict(w, alts=json.dumps([{"w": "b"}, None, {"w": "c"}]))])}) == [("words", 0, -1), ("words", 2, -1), ("words.alts", 2, 0), ("words.alts", 2, 2)]
    assert find("speech", {"words": dict(w, alts={"w": "b"})}) == [("words", 0, -1), ("words.alts", 0, 0)]
    assert find("speech", {"words": [json.dumps(w), "plain", 3, [w]]}) == [("words", 0, -1)]
    assert find("shot", {"motion_evidence": json.dumps({"pairs": ["pan"], "evidence": [{"scale": 1, "dx": 0, "dy": 0}]})}) == [("motion_evidence.evidence", 0, -1)]
    for empty in (None, "", "{", '{"words": [', "[]", "3", {"words": None}, {"words": []}, {"words": ""}, {}):
        assert find("speech", empty) == []
    assert find("speech", "[" * 5000) == []


def test_nested_states():
    assert classify({"w": "a", "t0": 1, "prob": None}).state == '["t0", "w"]' == classify('{"t0": "2.5", "w": null, "w": "b"}').state
    assert [classify(x).state for x in (None, True, 1, 2.5, "3", " 7 ", "1_0", "nan", "x", "", [], "[1]", "[", {})] == ["null", "truth", *["number"] * 4, *["text"] * 4, "list", "list", "text", "[]"]


def test_nested_tables(spark):
    good = json.dumps({"words": [{"w": "a", "t0": 1, "t1": "2.5", "prob": 0.5, "alts": [{"w": "\ud800"}, {}]}, {"word": "b", "start": 3, "end": 4}, {"w": "c", "t0": 7, "t1": 8, "prob": None, "alts": None}]})
    shot = json.dumps({"motion_evidence": {"evidence": [{"features": 9, "tracked": "5"}, {"features": 1, "tracked": True}, {"x" * 400: {"y": [1]}, "'": 1, "$.z": None}]}})
    rows = [(1, "speech", good, "x"), (1, "speech", json.dumps(json.loads(good), indent=1), "y"), (2, "speech", None, None), (3, "speech", good[:-4], None), (4, "shot", shot, None), (None, "shot", shot, None), (5, "frame", good, None)]
    names = "id long, kind string, payload string, path string"
    tables = VariantTables(flatten_payloads(spark.createDataFrame(rows, names), PATHS))
    links = {(1, "words", 0, -1), (1, "words", 1, -1), (1, "words", 2, -1), (1, "words.alts", 0, 0), (1, "words.alts", 0, 1), *((4, "motion_evidence.evidence", i, -1) for i in range(3))}
    got = tables.links().collect()
    assert len(got) == len(links) and {tuple(r) for r in got} == links
    assert {tuple(r)[1:] for r in tables.table("words", {"w": "text", "t0": "number", "t1": "number"}).select("pos", "pos", "t0", "t1", "w").collect()} == {(2, 7.0, 8.0, "c")}
    assert [tuple(r) for r in tables.table("words", {"w": "text", "t0": "number", "t1": "number", "prob": "number"}, lists=("alts",)).select("pos", "prob", "t0", "t1", "w").collect()] == [(0, 0.5, 1.0, 2.5, "a")]
    found = {(r["path"], tuple(sorted((r["types"] or {}).items()))): r["objects"] for r in tables.variants().collect()}
    assert found[("motion_evidence.evidence", (("features", "number"), ("tracked", "text")))] == 2 and found[("words.alts", ())] == 1 and len(found) == 7
    assert sum(found.values()) == len(links)
    assert {(r["segment_id"], r["pos"], r["label"], r["t0"], r["t1"]) for r in tables.supertype().filter("path = 'words'").collect()} == {(1, 0, "a", 1.0, 2.5), (1, 1, "b", 3.0, 4.0), (1, 2, "c", 7.0, 8.0)}
    tables.drop()
    empty = VariantTables(flatten_payloads(spark.createDataFrame([], names), PATHS))
    assert empty.links().count() == empty.variants().count() == empty.supertype().count() == 0
