"""Typing of caption replies."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that a reply must have, known shot types, most objects kept.
REQUIRED = ("shot_type", "people_count", "setting", "on_screen_text", "objects", "description")
SHOT_TYPES = ("CU", "MS", "WS")
MAX_OBJECTS = 8


def fault(reply: str) -> str | None:
    """What is wrong with a reply, in the words of typed_reply; None if nothing is."""
    try:
        found = json.loads(reply)
    except ValueError:
        return "not an object"
    if not isinstance(found, dict):
        return "not an object"
    lacking = sorted(set(REQUIRED) - found.keys())
    if lacking:
        return f"missing {','.join(lacking)}"
    text = found["description"]
    return None if isinstance(text, str) and text.strip() else "no description"


def typed_reply(reply: Column) -> Column:
    """STRUCT of the typed caption, with ``error`` instead of an exception: no object, a missing key, or no description.

    An unknown shot type, and a count that is no number, are null; a count that is null is 0, a fraction is cut off; setting and text become text; objects are texts, at most 8.
    """
    v = F.try_parse_json(reply)
    get = lambda key, kind: F.try_variant_get(v, f"$.{key}", kind)
    keys = F.json_object_keys(reply)
    description = get("description", "string")
    lacking = F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), F.coalesce(keys, F.array().cast("array<string>")))
    error = (
        F.when(v.isNull() | keys.isNull(), "not an object")
        .when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(lacking), ",")))
        .when(F.trim(F.coalesce(description, F.lit(""))) == "", "no description")
    )
    whole = get("people_count", "double")
    shot_type = get("shot_type", "string")
    return F.struct(
        error.alias("error"),
        F.when(shot_type.isin(*SHOT_TYPES), shot_type).alias("shot_type"),
        F.when(get("people_count", "string").isNull(), 0).otherwise(F.when(get("people_count", "string").isin("", "false"), 0).otherwise(whole.cast("int"))).alias("people_count"),
        F.coalesce(get("setting", "string"), F.lit("")).alias("setting"),
        F.coalesce(get("on_screen_text", "string"), F.lit("")).alias("on_screen_text"),
        F.slice(F.coalesce(get("objects", "array<string>"), F.array().cast("array<string>")), 1, MAX_OBJECTS).alias("objects"),
        F.trim(description).alias("description"),
    )
