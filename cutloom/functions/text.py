"""Expressions on texts and typed literals."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space at the ends, line breaks and tabs included; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def preview(*candidates: Column, width: int = 120) -> Column:
    """The first candidate that is not empty, cut to a width; else the empty text."""
    return F.substring(F.coalesce(*[F.when(c != "", c) for c in candidates], F.lit("")), 1, width)


def spoken_letters(word: Column, vocabulary: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ'") -> Column:
    """Positions (from 1) of a word's letters in a vocabulary; letters that it lacks are dropped. Blank and separator are never made."""
    letters = F.split(F.upper(F.trim(F.coalesce(word, F.lit("")))), "")
    return F.filter(F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.instr(F.lit(vocabulary), c)), lambda p: p > 0)


def prefixed(query: str, prefix: str) -> str:
    """A query as its encoder wants it; passages go without the prefix."""
    return prefix + query


def typed_literal(text: str) -> Any:
    """A filter value: JSON if it is JSON, else the text itself."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def payload_filter(text: str) -> tuple[str, Any]:
    """'key=value' as key and typed value; ValueError without '='."""
    key, sign, value = text.partition("=")
    if not sign:
        raise ValueError(f"a filter needs key=value, not {text!r}")
    return key, typed_literal(value)


def time_range(text: str) -> tuple[float, float]:
    """'start:end' as two floats; ValueError if malformed."""
    start, sign, end = text.partition(":")
    if not sign:
        raise ValueError(f"a range needs start:end, not {text!r}")
    return float(start), float(end)
