"""Values out of loosely typed JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(payload: Column) -> Column:
    """The payload as VARIANT; null if it is null or not valid JSON."""
    return F.try_parse_json(payload)


def text_at(variant: Column, path: str) -> Column:
    """The value at a JSON path as text (numbers and booleans rendered); null if absent or JSON null."""
    return F.try_variant_get(variant, path, "string")


def whole_text(value: Column) -> Column:
    """Normalise a key given as text: '7', '7.0', ' 7 ' and '7e0' all become '7'; what is no whole number stays as it is.

    Null gives null. Numbers of more than 18 digits stay as written.
    """
    trimmed = F.trim(value)
    number = trimmed.try_cast("decimal(38,18)")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < F.lit(10**18))
    return F.when(whole, F.floor(number).cast("bigint").cast("string")).otherwise(trimmed)


def text_list(variant: Column, path: str) -> Column:
    """An array of texts at a JSON path. An array kept as JSON text counts as the array, a single value as one element."""
    direct = F.try_variant_get(variant, path, "array<string>")
    single = text_at(variant, path)
    nested = F.try_variant_get(F.try_parse_json(single), "$", "array<string>")
    return F.coalesce(direct, nested, F.when(single.isNotNull(), F.array(single)))


def truthy(variant: Column, path: str) -> Column:
    """Whether the value at a JSON path counts as true: not absent, null, false, zero or empty."""
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    text = text_at(variant, path)
    held = F.when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~text.isin("[]", "{}")).otherwise(text.try_cast("double") != 0)
    return F.coalesce(held, F.lit(False))
