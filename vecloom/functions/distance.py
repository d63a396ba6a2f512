"""Distances between vector columns: smaller is nearer, sums in double precision.

Sums that are not finite as 32-bit floats give a metric's largest distance;
this is tested before anything is clamped, as least() and greatest() hide NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Metric

#: What a distance is that cannot be worked out: the largest 32-bit float.
FARTHEST = float(np.finfo(np.float32).max)


def literal(vector: Sequence[float]) -> Column:
    """A vector as one constant, which is folded when the plan is made; not as an expression for each component."""
    return F.split(F.lit(",".join(repr(float(np.float32(x))) for x in vector)), ",").cast("array<double>") if len(vector) else F.array().cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def _odd(x: Column) -> Column:
    narrow = x.cast("float")
    return F.isnan(narrow) | (F.abs(narrow) == float("inf"))


def cosine(a: Column, b: Column, norm: Column | None = None) -> Column:
    """norm: the squared length of b, where it is known."""
    dot, norms = _product(a, b), [_product(a, a), _product(b, b) if norm is None else norm]
    odd = _odd(dot) | _odd(norms[0]) | _odd(norms[1])
    product = norms[0] * norms[1]
    near = 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.sqrt(product)))
    return F.when(odd, F.lit(2.0)).when(product == 0, F.lit(1.0)).otherwise(near)


def euclidean(a: Column, b: Column) -> Column:
    total = _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    return F.when(_odd(total), F.lit(FARTHEST)).otherwise(F.sqrt(total))


def negative_dot(a: Column, b: Column) -> Column:
    dot = _product(a, b)
    return F.when(_odd(dot), F.lit(FARTHEST)).otherwise(-dot)


BUILDERS = {Metric.COSINE: cosine, Metric.EUCLIDEAN: euclidean, Metric.DOT: negative_dot}


def distance(metric: Metric, a: Column, b: Column) -> Column:
    """The distance of two vectors; empty vectors are 0 apart; different lengths are an error."""
    if metric not in BUILDERS:
        raise ValueError(f"unknown metric: {metric}")
    wrong = F.raise_error(F.concat(F.lit("dimension mismatch: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))).cast("double")
    return F.when(F.size(a) != F.size(b), wrong).when(F.size(a) == 0, F.lit(0.0)).otherwise(BUILDERS[metric](a, b))


def distance_to(metric: Metric, a: Column, vector: Sequence[float]) -> Column:
    """The distance of a vector column to one vector, whose length is worked out once."""
    b = literal(vector)
    if metric is not Metric.COSINE or not len(vector):
        return distance(metric, a, b)
    norm = float(sum(float(np.float32(x)) ** 2 for x in vector))
    wrong = F.raise_error(F.concat(F.lit(f"dimension mismatch: {len(vector)} and "), F.size(a).cast("string"))).cast("double")
    return F.when(F.size(a) != len(vector), wrong).otherwise(cosine(a, b, F.lit(norm)))


def _odd_numbers(v: np.ndarray) -> np.ndarray:
    return ~np.isfinite(v.astype(np.float32))


def finished(metric: Metric, total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances from sums: products of components (euclidean: squared differences), and the squared lengths of both sides."""
    with np.errstate(all="ignore"):
        if metric is Metric.COSINE:
            product = a * b
            near = 1 - np.clip(total / np.sqrt(product), -1, 1)
            return np.where(_odd_numbers(total) | _odd_numbers(a) | _odd_numbers(b), 2.0, np.where(product == 0, 1.0, near))
        return np.where(_odd_numbers(total), FARTHEST, -total if metric is Metric.DOT else np.sqrt(total))


def distances(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same for matrices: a row a query, a column a vector."""
    with np.errstate(all="ignore"):
        if metric is not Metric.EUCLIDEAN:
            return finished(metric, q @ x.T, (q * q).sum(axis=1)[:, None], (x * x).sum(axis=1)[None, :])
        out = np.empty((len(q), len(x)))
        for i, row in enumerate(q):  # differences, not |a|^2 + |b|^2 - 2ab, which loses digits
            out[i] = ((x - row) ** 2).sum(axis=1)
        return finished(metric, out, out, out)


def sums(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner products of pairs of rows, summed in the order of the components: the same wherever a pair stands."""
    out = np.zeros(len(q))
    with np.errstate(all="ignore"):
        for i in range(q.shape[1]):
            out += q[:, i] * x[:, i]
    return out


def pair_distances(metric: Metric, q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for pairs of rows, whose squared lengths are a and b."""
    with np.errstate(all="ignore"):
        return finished(metric, sums(q - x, q - x) if metric is Metric.EUCLIDEAN else sums(q, x), a, b)
