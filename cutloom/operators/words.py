"""Word times: bounds from token spans, clamping, and repair of words without extent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_bounds(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """First start and last end of each word's tokens (start, end, word); tokens that own no word (null) are separators."""
    return tokens.filter("word is not null").groupBy(*keys, "word").agg(F.min("start").alias("t0"), F.max("end").alias("t1"))


def clamp_word(t0: Column, t1: Column, start: Column, end: Column, least: float = 0.02) -> tuple[Column, Column]:
    """A word inside its segment, at least ``least`` long, rounded to milliseconds."""
    first = F.least(F.greatest(t0, start), end - least)
    return F.round(first, 3), F.round(F.least(F.greatest(t1, first + least), end), 3)


def clamp_words(words: Column, start: Column, end: Column, least: float = 0.02) -> Column:
    """The same for an ARRAY<STRUCT<w, t0, t1, prob>>."""
    def one(w: Column) -> Column:
        t0, t1 = clamp_word(w["t0"], w["t1"], start, end, least)
        return F.struct(w["w"].alias("w"), t0.alias("t0"), t1.alias("t1"), w["prob"].alias("prob"))

    return F.transform(words, one)


def repair_words(words: Column, start: Column, end: Column, least: float = 0.02) -> Column:
    """Words that end no later than they begin are clamped to at least 20 ms; the others stay."""
    fixed = clamp_words(words, start, end, least)
    return F.transform(words, lambda w, i: F.when(w["t1"] <= w["t0"], F.get(fixed, i)).otherwise(w))


def token_owners(words: Column) -> Column:
    """ARRAY<STRUCT<token, word>> of tokenised words joined by separators (token 0), which own no word; words without tokens are skipped."""
    kept = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("tokens"), i.alias("word"))), lambda w: F.size(w["tokens"]) > 0)
    owned = F.transform(kept, lambda w, i: F.concat(F.when(i > 0, F.array(F.struct(F.lit(0).alias("token"), F.lit(None).cast("int").alias("word")))).otherwise(F.expr("cast(array() as array<struct<token:int,word:int>>)")), F.transform(w["tokens"], lambda t: F.struct(t.cast("int").alias("token"), w["word"].cast("int").alias("word")))))
    return F.flatten(owned)
