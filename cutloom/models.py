"""Model seams: detectors, recognisers and encoders as protocols, with deterministic stand-ins.

The models themselves are not part of this library. A model is loaded once per executor process and used in batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    """Turns inputs into vectors of one space."""

    name: str
    dim: int

    def encode(self, inputs: list) -> np.ndarray: ...


class RowModel(Protocol):
    """Turns a batch of rows into a batch of rows: shot and person detection, flow, speech, lyrics, music, alignment, captions."""

    def run(self, rows: pd.DataFrame) -> pd.DataFrame: ...


class HashEncoder:
    """A stand-in text encoder: words hash to signed positions; equal texts get equal unit vectors.

    The position is the first 8 hex digits of a word's MD5 modulo the length, the sign is that of the ninth digit (below 8 is positive).
    """

    def __init__(self, name: str = "hash-v1", dim: int = 64) -> None:
        self.name, self.dim = name, dim

    def encode(self, inputs: list) -> np.ndarray:
        out = np.zeros((len(inputs), self.dim), np.float64)
        for i, text in enumerate(inputs):
            for word in re.findall(r"\S+", (text or "").lower(), re.ASCII):
                h = hashlib.md5(word.encode("utf-8", "replace")).hexdigest()
                out[i, int(h[:8], 16) % self.dim] += 1 if h[8] < "8" else -1
            size = np.linalg.norm(out[i])
            out[i] = out[i] / size if size else np.eye(1, self.dim)[0]
        return out.astype(np.float32)


@lru_cache(maxsize=8)
def loaded(factory: Callable[[], object]) -> object:
    """The model of a factory, loaded once per process and kept."""
    return factory()


def release() -> None:
    """Drop the models of this process, before another stage loads its own."""
    loaded.cache_clear()


def embed(inputs: Column, factory: Callable[[], Encoder], batch: int = 32) -> Column:
    """Vectors of a column of inputs, in batches, with a model that is loaded once per worker."""
    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(factory)
        for rows in series:
            parts = [model.encode(rows.iloc[i : i + batch].tolist()) for i in range(0, len(rows), batch)]
            yield pd.Series(list(np.concatenate(parts)) if parts else [], dtype=object)

    return run(inputs)


def apply_model(rows: DataFrame, factory: Callable[[], RowModel], schema: str, retries: int = 0) -> DataFrame:
    """Run a row model over partitions; a batch that fails is tried again, then its error is raised."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(factory)
        for batch in batches:
            for attempt in range(retries + 1):
                try:
                    yield model.run(batch)
                    break
                except Exception:
                    if attempt == retries:
                        raise

    return rows.mapInPandas(run, schema)
