"""Vector functions on array columns, and the sign-projection signature."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

BITS = 32
#: Fixed values of the SplitMix64 generator.
GAMMA, MUL_1, MUL_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
WORD = (1 << 64) - 1


def dot(a: Column, b: Column) -> Column:
    """In double precision, over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def usable(v: Column) -> Column:
    """Not empty, all parts finite, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & fine & (norm(v) > 0), F.lit(False))


def normalize_l2(v: Column) -> Column:
    """The unit vector as floats; null for vectors that are not usable."""
    n = norm(v)
    return F.when(usable(v), F.transform(v, lambda x: (x.cast("double") / n).cast("float")))


def _next(state: int) -> int:
    z = (state + GAMMA) & WORD
    z = ((z ^ (z >> 30)) * MUL_1) & WORD
    z = ((z ^ (z >> 27)) * MUL_2) & WORD
    return z ^ (z >> 31)


def hyperplanes(dim: int) -> np.ndarray:
    """``BITS`` planes of signs, from a generator seeded by the plane's number and the dimension."""
    planes = np.empty((BITS, dim))
    for p in range(BITS):
        state = _next((p + 1) ^ ((dim + GAMMA) & WORD))
        for d in range(dim):
            state = _next(state)
            planes[p, d] = 1.0 if state & 1 else -1.0
    return planes


def signatures(rows: np.ndarray) -> np.ndarray:
    """Bit p is set where the projection on plane p is not negative."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    bits = rows.astype(np.float64) @ hyperplanes(rows.shape[1]).T >= 0
    return bits.astype(np.int64) @ (1 << np.arange(BITS, dtype=np.int64))


@F.pandas_udf(LongType())
def lsh_signature(v: pd.Series) -> pd.Series:
    out = np.zeros(len(v), np.int64)
    sizes = v.map(lambda x: 0 if x is None else len(x)).to_numpy()
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        out[at] = signatures(np.stack(v.iloc[at].to_list()))
    return pd.Series(out)
