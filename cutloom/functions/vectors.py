"""Expressions on vectors and hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a vector is all zero."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def _stacked(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64)


def distances(space: Column, vector: Column, queries: Mapping[int, Sequence[float]]) -> Column:
    """Cosine distance of vectors to the query of their space (a number), in Arrow batches; equal vectors have equal distances in any batch, which a matrix product does not give; null for vectors without a direction.

    Vectors must have the length of their query.
    """
    known = {s: np.asarray(q, np.float64) / np.linalg.norm(q) for s, q in queries.items()}

    def run(spaces: pd.Series, vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        for s, q in known.items():
            at = np.flatnonzero(spaces.to_numpy() == s)
            if len(at):
                x = _stacked(vectors.iloc[at])
                with np.errstate(all="ignore"):
                    out[at] = 1 - (x * q).sum(1) / np.sqrt((x * x).sum(1))
        return pd.Series(out)

    return F.pandas_udf(run, "double")(space, vector)


def pair_distance(a: Column, b: Column) -> Column:
    """Cosine distance of two columns of vectors of one length per row, in Arrow batches; null where one has no direction."""
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.full(len(left), np.nan)
        sizes = left.map(len).to_numpy()
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            x, y = _stacked(left.iloc[at]), _stacked(right.iloc[at])
            with np.errstate(all="ignore"):
                out[at] = 1 - (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
        return pd.Series(out)

    return F.pandas_udf(run, "double")(a, b)


def unit(v: Column) -> Column:
    """The vector at length one, as floats; null if it is all zero."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: (x.cast("double") / length).cast("float")))


def vector_literal(values) -> Column:
    """A query vector as a constant."""
    return F.array(*[F.lit(float(x)) for x in values])


def hash_distance(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes given as 16 hex digits; halves are compared, so the sign bit is safe."""
    part = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
    return sum((F.bit_count(part(a, at).bitwiseXOR(part(b, at))) for at in (1, 9)), F.lit(0))
