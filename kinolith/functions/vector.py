"""Vector functions over array<float>, in double precision; a null or wrongly sized partner gives null."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product."""
    a, b = _col(a), _col(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: str | Column) -> Column:
    """The vector at unit length; null if zero or not finite."""
    a = _col(a)
    return F.when(is_finite(a) & (norm(a) > 0), F.transform(a, lambda x: x.cast("double") / norm(a)))


def is_finite(a: str | Column) -> Column:
    return ~F.exists(_col(a), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def is_unit(a: str | Column, tolerance: float = 2e-3) -> Column:
    return is_finite(a) & (F.abs(norm(a) - 1) <= tolerance)


def hamming(a: str | Column, b: str | Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def literal(a: str | Column) -> Column:
    """[x,y,...] with nine significant digits; null if an element is null or not finite."""
    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else "[" + ",".join(f"{e:.9g}" for e in v) + "]" for v in x.to_pylist()], pa.string())

    a = _col(a)
    return F.when(is_finite(a), run(a))
