"""Nested semi-structured payloads as flat child tables with parent links: structural-variant tables.

A bottom-up tree automaton gives every JSON node a state from the states of its children: null, number, text, a list, or for an object
its variant, which is the set of its keys that hold something. Nothing is known of the keys beforehand. Each object under a path is
routed to the typed table of its path and variant; the type of a column is the least one that all states seen in it fit. The columns
that variants share under different names (their common supertype) are kept under one name, with the link to segment, path and position.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.session import drop_folder, new_folder, spread

#: States of the automaton for nodes that are no objects.
NULL, TRUTH, NUMBER, TEXT, LIST = "null", "truth", "number", "text", "list"

#: Columns of the common supertype: name -> keys that hold it.
SUPERTYPE: dict[str, tuple[str, ...]] = {"label": ("w", "word"), "t0": ("t0", "start"), "t1": ("t1", "end"), "prob": ("prob",)}

LINKS = "segment_id bigint, path string, pos int, sub_pos int"
OBJECT_SCHEMA = f"{LINKS}, variant string, states string, body string, kind string"


class _Node:
    """A JSON value with the state that the automaton gave it."""

    __slots__ = ("state", "value", "items")

    def __init__(self, state: str, value: Any = None, items: Any = None) -> None:
        self.state, self.value, self.items = state, value, items


def classify(value: Any) -> _Node:
    """Run the automaton over one value, children first. An array or object kept as JSON text counts like the value itself, a number kept as text like the number."""
    if value is None:
        return _Node(NULL)
    if isinstance(value, bool):
        return _Node(TRUTH, value)
    if isinstance(value, (int, float)):
        return _Node(NUMBER, value)
    if isinstance(value, str):
        head = value.lstrip()[:1]
        if head in ("[", "{"):
            try:
                inner = json.loads(value)
            except (ValueError, RecursionError):
                return _Node(TEXT, value)
            return classify(inner)
        return _Node(NUMBER if _reads_as_number(value) else TEXT, value)
    if isinstance(value, list):
        return _Node(LIST, value, [classify(x) for x in value])
    items = {k: classify(x) for k, x in value.items()}
    return _Node(variant_of(items), value, items)


def variant_of(items: Mapping[str, _Node]) -> str:
    """The state of an object: its keys that are not null, in order."""
    return _text(sorted(k for k, x in items.items() if x.state != NULL))


def _text(value: Any) -> str:
    """JSON text, without the halves of characters that no encoding has."""
    text = json.dumps(value, ensure_ascii=False)
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _reads_as_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return text.strip()[-1:].isdigit() and "_" not in text


def _objects(node: _Node | None) -> list[tuple[int, _Node]]:
    """Objects of a list with their positions; one object in place of the list is position 0."""
    if node is None:
        return []
    if isinstance(node.items, dict):
        return [(0, node)]
    if node.state == LIST:
        return [(i, x) for i, x in enumerate(node.items) if isinstance(x.items, dict)]
    return []


def children(payload: str | None, paths: tuple[str, ...]) -> list[tuple[str, int, int, _Node]]:
    """(path, pos, sub_pos, object) for each object under the paths; 'a.b' is inside each object of the list 'a', if a path of that name is listed, else inside the object 'a'."""
    if payload is None:
        return []
    try:
        root = classify(json.loads(payload))
    except (ValueError, RecursionError):
        return []
    if not isinstance(root.items, dict):
        return []
    out: list[tuple[str, int, int, _Node]] = []
    for path in paths:
        head, _, tail = path.partition(".")
        node = root.items.get(head)
        if not tail:
            out += [(path, i, -1, x) for i, x in _objects(node)]
        elif head in paths:
            out += [(path, i, j, y) for i, x in _objects(node) for j, y in _objects(x.items.get(tail))]
        elif node is not None and isinstance(node.items, dict):
            out += [(path, i, -1, x) for i, x in _objects(node.items.get(tail))]
    return out


def variant_id(path: str, variant: str) -> str:
    """The name of the folder of a path and variant, whatever its keys are."""
    return "v" + hashlib.md5(f"{path}\n{variant}".encode()).hexdigest()[:12]


def flatten_payloads(df: DataFrame, paths_by_kind: dict[str, tuple[str, ...]], *, id_col: str = "id", kind_col: str = "kind", payload_col: str = "payload") -> DataFrame:
    """One row per object under the paths of the row's kind: segment_id, path, pos, sub_pos, variant, states (by key), body, kind (the variant's id).

    pos is the 0-based position, sub_pos that in the inner array, -1 if there is none. Null elements and elements that are no
    objects are no rows but keep their position. Payloads that are null or not valid JSON have no children. body is the object as JSON without
    the keys that are listed as paths of their own. Redelivered segments (the same id, other layout) come twice here.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named: dict[tuple[str, str], str] = {}
        for batch in batches:
            rows = []
            for sid, kind, payload in batch.itertuples(index=False, name=None):
                paths = paths_by_kind[kind]
                for path, pos, sub, node in children(payload, paths):
                    states = {k: "object" if isinstance(x.items, dict) else x.state for k, x in sorted(node.items.items()) if x.state != NULL}
                    body = {k: v for k, v in node.value.items() if f"{path}.{k}" not in paths}
                    if (path, node.state) not in named:
                        named[path, node.state] = variant_id(path, node.state)
                    rows.append((sid, path, pos, sub, node.state, _text(states), _text(body), named[path, node.state]))
            yield pd.DataFrame(rows, columns=["segment_id", "path", "pos", "sub_pos", "variant", "states", "body", "kind"])

    wanted = df.filter(F.col(kind_col).isin(*paths_by_kind) & F.col(payload_col).isNotNull() & F.col(id_col).isNotNull())
    wanted = wanted.select(F.col(id_col).cast("bigint").alias("id"), F.col(kind_col).alias("kind"), F.col(payload_col).alias("payload"))
    return spread(wanted).mapInPandas(run, OBJECT_SCHEMA)


class VariantTables:
    """Objects routed to one table per path and variant: folders of a written table in the shared folder.

    Routing shuffles nothing; each reader gets only its folders and columns. Tables are whole: rare variants, and objects without any
    key, have theirs too. Objects of a redelivered segment are dropped when a table is read.
    """

    KEY = ("segment_id", "path", "pos", "sub_pos")

    def __init__(self, objects: DataFrame) -> None:
        self.spark: SparkSession = objects.sparkSession
        self.folder = new_folder(self.spark, "variants")
        objects.write.partitionBy("kind").parquet(self.folder)
        self.rows = self.spark.read.schema(OBJECT_SCHEMA).parquet(self.folder)

    def drop(self) -> None:
        """Delete the tables."""
        drop_folder(self.spark, self.folder)

    def links(self) -> DataFrame:
        """The links of the objects of all tables, once each."""
        return self.rows.select(*self.KEY).distinct()

    def variants(self) -> DataFrame:
        """path, variant, objects, and the type of each of its keys: the one state that was seen in it, else text."""
        once = self.rows.select(*self.KEY, "variant", "states").dropDuplicates(list(self.KEY))
        shapes = once.groupBy("path", "variant", "states").agg(F.count("*").alias("n"))  # few rows, whatever the number of objects
        counted = shapes.groupBy("path", "variant").agg(F.sum("n").alias("objects"))
        keys = shapes.select("path", "variant", F.explode(F.from_json("states", "map<string,string>")).alias("key", "state")).groupBy("path", "variant", "key").agg(F.min("state").alias("least"), F.max("state").alias("most"))
        column = F.struct("key", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(TEXT).alias("type"))
        types = keys.groupBy("path", "variant").agg(F.map_from_entries(F.array_sort(F.collect_list(column))).alias("types"))
        none = F.expr("cast(map() as map<string,string>)")
        return counted.join(types, ["path", "variant"], "left").withColumn("types", F.coalesce("types", none))

    def table(self, path: str, types: Mapping[str, str], lists: tuple[str, ...] = ()) -> DataFrame:
        """The typed table of the variant with these keys: links, and each key with its type (number as double, truth as boolean, all else as text).

        lists: further keys of the variant that are paths, and so tables, of their own.
        """
        variant = _text(sorted([*types, *lists]))
        own = self.rows.filter((F.col("kind") == variant_id(path, variant)) & (F.col("path") == path) & (F.col("variant") == variant))
        own = own.dropDuplicates(list(self.KEY)).withColumn("fields", F.from_json("body", "map<string,string>"))
        as_type = {NUMBER: "double", TRUTH: "boolean"}
        return own.select(*self.KEY, *[F.element_at("fields", F.lit(k)).try_cast(as_type.get(types[k], "string")).alias(k) for k in sorted(types)])

    def supertype(self) -> DataFrame:
        """All objects with the supertype's columns: links, variant, label, t0, t1, prob, and their body as JSON."""
        once = self.rows.dropDuplicates(list(self.KEY)).withColumn("fields", F.from_json("body", "map<string,string>"))
        first = lambda name: F.coalesce(*[F.element_at("fields", F.lit(k)) for k in SUPERTYPE[name]])
        return once.select(*self.KEY, "variant", first("label").alias("label"), *[first(c).try_cast("double").alias(c) for c in ("t0", "t1", "prob")], "body")
