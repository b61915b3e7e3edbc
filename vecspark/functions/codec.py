"""Vectors as text, as arrays and as bytes.

Bytes hold the values as little-endian 32-bit floats (or packed bits), four bytes of metadata (format
version and element type) and the CRC-32 of what precedes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.sources.options import OptionError, parse

FLOATS, BITS = 0x0101, 0x0401
OVERHEAD = 8
NUMBER = r"^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?"
_INNER = (
    "CASE WHEN instr(s, '[') > 0 THEN nullif(regexp_extract(s, '\\\\[([^\\\\]]*\\\\])', 1), '') "
    "WHEN instr(s, '{') > 0 THEN nullif(regexp_extract(s, '\\\\{([^}]*\\\\})', 1), '') "
    "WHEN instr(s, '(') > 0 THEN nullif(regexp_extract(s, '\\\\(([^)]*\\\\))', 1), '') ELSE concat(s, ' ') END"
)
_SPECIAL = "CASE WHEN lower(t) RLIKE '^[+-]?inf' THEN CAST(concat(if(startswith(t, '-'), '-', ''), 'Infinity') AS FLOAT) WHEN lower(t) RLIKE '^[+-]?nan' THEN CAST('NaN' AS FLOAT) END"
#: A text's values: in square, curly or round brackets or bare, parted by spaces and commas. A token begins
#: with a number, ``inf`` or ``nan``, or else is 0. Null where a bracket is not closed.
CONSTRUCT = (
    f"transform(filter(split(substring({_INNER}, 1, length({_INNER}) - 1), '[ ,\\\\t\\\\n\\\\r]+'), t -> t <> ''), "
    f"t -> coalesce(try_cast(regexp_extract(t, '{NUMBER}', 0) AS FLOAT), {_SPECIAL}, CAST(0 AS FLOAT)))"
)
#: Bodies of ``construct`` by its options: what goes in and what comes out.
CONVERSIONS = {("string", "float"): "construct", ("float", "float"): "pass_floats", ("float", "bv"): "quantize", ("string", "bv"): "pack_bytes", ("bv", "bv"): "pass_bits"}
IS_VALID = "coalesce(size(v) = dim AND v IS NOT NULL, false)"
_TAIL = "conv(concat(hex(substring(b, -1, 1)), hex(substring(b, -2, 1)), hex(substring(b, -3, 1)), hex(substring(b, -4, 1))), 16, 10)"
IS_VALID_BYTES = f"coalesce(length(b) = dim * 4 + {OVERHEAD} AND length(b) >= 12 AND crc32(substring(b, 1, length(b) - 4)) = CAST({_TAIL} AS BIGINT), false)"


def conversion(options: str | None) -> str:
    """The function that ``construct`` with options ``i=string|float|bv,o=float|bv`` stands for."""
    o = parse(options)
    key = (o.get("i", "string").lower(), o.get("o", "float").lower())
    if key not in CONVERSIONS or set(o) - {"i", "o"}:
        raise OptionError(f"construct can't be told {options!r}")
    return CONVERSIONS[key]


def construct(value: Column, options: str | None = None) -> Column:
    """A vector of a text, or of another form by ``options``, see :func:`conversion`; needs the session's functions.

    Floats are ``ARRAY<FLOAT>``, also where they come in; bits come out as ``ARRAY<BIGINT>`` words of
    floats, and as sealed bytes of texts that give each byte as a number.
    """
    return F.call_function(f"vec_{conversion(options)}", value)


def is_valid(vector: Column, dim: Column | int) -> Column:
    """Whether a vector is there and has this many values."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dim), F.lit(False))


def _display(values, precision: int) -> str | None:
    return None if values is None else "[" + ", ".join(format(float(x), f".{precision}g") for x in values) + "]"


@F.pandas_udf(T.StringType())
def display(*args: pd.Series) -> pd.Series:
    """``[a, b, c]`` of a vector with as many significant digits as the second argument says; 7 where it is absent, null or 0."""
    return pd.Series([_display(v, p) for v, p in _with_precision(args)], dtype=object)


def _with_precision(args: tuple[pd.Series, ...]):
    given = args[1] if len(args) > 1 else [None] * len(args[0])
    return [(v, int(p) if p is not None and p == p and p > 0 else 7) for v, p in zip(args[0], given, strict=True)]


def _seal(payload: bytes, kind: int) -> bytes:
    body = payload + kind.to_bytes(4, "little")
    return body + zlib.crc32(body).to_bytes(4, "little")


@F.pandas_udf(T.BinaryType())
def to_bytes(vector: pd.Series) -> pd.Series:
    """The bytes of an ``ARRAY<FLOAT>``."""
    return pd.Series([None if v is None else _seal(np.asarray(v, "<f4").tobytes(), FLOATS) for v in vector], dtype=object)


@F.pandas_udf(T.BinaryType())
def bits_to_bytes(words: pd.Series) -> pd.Series:
    """The bytes of quantised words, first dimension first."""
    return pd.Series([None if w is None else _seal(np.asarray(w, ">i8").tobytes(), BITS) for w in words], dtype=object)


def unseal(raw: bytes) -> tuple[bytes, int]:
    """Payload and metadata; an error where the checksum is wrong."""
    if len(raw) < OVERHEAD or zlib.crc32(raw[:-4]) != int.from_bytes(raw[-4:], "little"):
        raise ValueError("invalid vector")
    return raw[:-OVERHEAD], int.from_bytes(raw[-8:-4], "little")


def _floats(raw: bytes | None):
    try:
        payload, kind = unseal(raw) if raw is not None else (None, FLOATS)
    except ValueError:
        return None
    return None if payload is None or kind != FLOATS else np.frombuffer(payload, "<f4").tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(raw: pd.Series) -> pd.Series:
    """``ARRAY<FLOAT>`` of bytes; null where they are null, damaged or of another type."""
    return pd.Series([_floats(b) for b in raw], dtype=object)


@F.pandas_udf(T.StringType())
def display_bytes(*args: pd.Series) -> pd.Series:
    """Text of bytes, with a precision or without: values, packed bits as unsigned bytes, or ``<invalid vector>``."""
    out = []
    for b, p in _with_precision(args):
        if b is None:
            out.append(None)
            continue
        try:
            payload, kind = unseal(b)
        except ValueError:
            out.append("<invalid vector>")
            continue
        values = np.frombuffer(payload, np.uint8 if kind == BITS else "<f4")
        out.append(_display(values, p))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.BinaryType())
def pack_bytes(text: pd.Series) -> pd.Series:
    """Bytes of a text of packed bytes, each a number from 0 to 255."""
    rows = [None if t is None else [int(x) & 255 for x in t.strip("[]{}() ").replace(",", " ").split()] for t in text]
    return pd.Series([None if r is None else _seal(bytes(r), BITS) for r in rows], dtype=object)


def register_codec(spark: SparkSession, prefix: str = "vec_") -> None:
    """Create or replace the SQL functions of this module."""
    for name, parameters, kind, body in (
        ("construct", "s STRING", "ARRAY<FLOAT>", CONSTRUCT),
        ("pass_floats", "v ARRAY<FLOAT>", "ARRAY<FLOAT>", "v"),
        ("pass_bits", "b BINARY", "BINARY", "b"),
        ("is_valid", "v ARRAY<FLOAT>, dim INT", "BOOLEAN", IS_VALID),
        ("is_valid_bytes", "b BINARY, dim INT", "BOOLEAN", IS_VALID_BYTES),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, f in (("display", display), ("to_bytes", to_bytes), ("from_bytes", from_bytes), ("display_bytes", display_bytes), ("bits_to_bytes", bits_to_bytes), ("pack_bytes", pack_bytes)):
        spark.udf.register(f"{prefix}{name}", f)
