"""Hashes that Spark and other SQL engines compute alike, so that random choices can be checked and repeated anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

#: Hexadecimal digits of md5 that make a bucket: 32 bits, or 48 where finer.
DIGITS, FINE_DIGITS = 8, 12


def portable_hash(*parts: Column | str, digits: int = DIGITS) -> Column:
    """The first *digits* hexadecimal digits of md5 over the parts joined by '-', as a long."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("-", *cols).cast("binary")), 1, digits), 16, 10).cast("long")


def unit_hash(*parts: Column | str, digits: int = FINE_DIGITS) -> Column:
    """A number in (0, 1) from the same hash."""
    return (portable_hash(*parts, digits=digits) + F.lit(0.5)) / F.lit(float(16**digits))


def sql_hash(text: str, digits: int = DIGITS) -> str:
    """``portable_hash`` of an SQL text expression, in DuckDB's dialect."""
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array: every input bit moves every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
