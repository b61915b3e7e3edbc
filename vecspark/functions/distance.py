"""Distances as column expressions and as SQL functions; Catalyst inlines both.

L2 is squared, the inner-product distance is one minus the product, and the cosine distance of a zero
vector is one. Vectors of different lengths are cut to the shorter, except by ``strict_distance``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vecspark.sources.options import metric as canonical

_ZIP = "zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> {})"
_SUM = "aggregate({}, 0D, (s, d) -> s + d)"
_DOT = _SUM.format(_ZIP.format("CAST(x AS DOUBLE) * CAST(y AS DOUBLE)"))
_L2 = _SUM.format(_ZIP.format("(CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)"))
_NORMS = _SUM.format(_ZIP.format("CAST(x AS DOUBLE) * x")) + " * " + _SUM.format(_ZIP.format("CAST(y AS DOUBLE) * y"))
_COSINE = f"CASE WHEN {_NORMS} = 0 THEN 1D ELSE 1D - ({_DOT}) / sqrt({_NORMS}) END"
_ERROR = "CAST(raise_error(concat('unknown metric ', coalesce(m, 'NULL'))) AS DOUBLE)"

#: Name after the prefix, parameters, result type, body.
SQL_FUNCTIONS = (
    (
        "distance",
        "a ARRAY<FLOAT>, b ARRAY<FLOAT>, m STRING DEFAULT 'L2'",
        "DOUBLE",
        f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN upper(m) IN ('L2', 'EUCLIDEAN') THEN {_L2} WHEN upper(m) = 'IP' THEN 1D - ({_DOT}) WHEN upper(m) IN ('COSINE', 'ANGULAR', 'COSINENORM') THEN {_COSINE} ELSE {_ERROR} END",
    ),
    (
        "distance_strict",
        "a ARRAY<FLOAT>, b ARRAY<FLOAT>, m STRING DEFAULT 'L2'",
        "DOUBLE",
        f"CASE WHEN size(a) <> size(b) THEN CAST(raise_error('vectors of different lengths') AS DOUBLE) WHEN a IS NULL OR b IS NULL THEN NULL WHEN upper(m) IN ('L2', 'EUCLIDEAN') THEN {_L2} WHEN upper(m) = 'IP' THEN 1D - ({_DOT}) WHEN upper(m) IN ('COSINE', 'ANGULAR', 'COSINENORM') THEN {_COSINE} ELSE {_ERROR} END",
    ),
    ("dot", "a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", _DOT),
    ("hamming_distance", "a ARRAY<BIGINT>, b ARRAY<BIGINT>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> CAST(bit_count(coalesce(x, 0L) ^ coalesce(y, 0L)) AS DOUBLE)), 0D, (s, d) -> s + d)"),
    (
        "quantize",
        "v ARRAY<FLOAT>",
        "ARRAY<BIGINT>",
        "transform(CASE WHEN size(v) >= 64 THEN sequence(0, CAST(floor(size(v) / 64) AS INT) - 1) ELSE CAST(array() AS ARRAY<INT>) END, w -> aggregate(slice(v, w * 64 + 1, 64), 0L, (s, x) -> shiftleft(s, 1) | (CASE WHEN x > 0 THEN 1L ELSE 0L END)))",
    ),
)


def vector_literal(values: Sequence[float]) -> Column:
    """A constant ``ARRAY<FLOAT>``."""
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<float>")


def _pairs(a: Column, b: Column, f) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), f), F.lit(0.0), lambda s, d: s + d)


def dot(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def distance(a: Column, b: Column, metric: str = "L2") -> Column:
    """Distance of two array columns; null where either is null."""
    m = canonical(metric)
    if m == "L2":
        return _pairs(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    if m == "IP":
        return F.lit(1.0) - dot(a, b)
    if m == "HAMMING":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("double")), F.lit(0.0), lambda s, d: s + d)
    norms = _pairs(a, b, lambda x, y: x.cast("double") * x) * _pairs(a, b, lambda x, y: y.cast("double") * y)
    return F.when(norms == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / F.sqrt(norms))


def distance_to(vector: Column, query: Sequence[float], metric: str = "L2") -> Column:
    """Distance of a column to one constant vector, as an unrolled sum that code generation can fuse."""
    m = canonical(metric)
    q = [float(x) for x in query]

    def total(terms: list[Column]) -> Column:
        while len(terms) > 1:
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return terms[0] if terms else F.lit(0.0)

    if m == "HAMMING" or len(q) > 256:
        return distance(vector, F.array(*[F.lit(int(x)) for x in query]) if m == "HAMMING" else vector_literal(q), m)
    at = [F.get(vector, F.lit(i)).cast("double") for i in range(len(q))]
    zero = F.lit(0.0)
    if m == "L2":
        return F.when(vector.isNotNull(), total([F.coalesce((x - F.lit(y)) * (x - F.lit(y)), zero) for x, y in zip(at, q, strict=True)]))
    prod = total([F.coalesce(x * F.lit(y), zero) for x, y in zip(at, q, strict=True)])
    if m == "IP":
        return F.when(vector.isNotNull(), F.lit(1.0) - prod)
    own = F.aggregate(F.slice(vector, 1, len(q)), zero, lambda s, x: s + x.cast("double") * x)
    norms = own * F.lit(sum(y * y for y in q))
    out = F.when(norms == 0, F.lit(1.0)).otherwise(F.lit(1.0) - prod / F.sqrt(norms))
    return F.when(F.size(vector) >= len(q), out).otherwise(distance(vector, vector_literal(q), m))


def quantize(vector: Column) -> Column:
    """One bit for each dimension, set where the value is above 0, in 64-bit words, first dimension first."""
    words = F.when(F.size(vector) >= 64, F.sequence(F.lit(0), (F.size(vector) / 64).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(words, lambda w: F.aggregate(F.slice(vector, w * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))))


def register_distances(spark: SparkSession, prefix: str = "vec_") -> None:
    """Create or replace the SQL functions of this module."""
    for name, parameters, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
