"""Portable uniform hash: the same value in Spark SQL and in DuckDB.

u(key) = first 8 hex digits of md5(key) read as an unsigned 32-bit integer,
divided by 2**32.  Splits, folds, SMOTE draws and permutations all derive from
it, so results do not depend on partitioning, task retries or the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def hash_int(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")


def uniform_int(*parts: Column | str, seed: str | int | None = None) -> Column:
    """`uniform` before its division: a whole number from 0 to 2**32 - 1 in the same order."""
    cols = [F.lit(str(seed))] if seed is not None else []
    cols += [F.col(p) if isinstance(p, str) else p for p in parts]
    return hash_int(F.concat_ws("|", *[c.cast("string") for c in cols]))


def uniform(*parts: Column | str, seed: str | int | None = None) -> Column:
    """Uniform [0,1) value of `seed|part1|part2...` (parts joined by '|')."""
    return uniform_int(*parts, seed=seed) / F.lit(TWO_32)


def duck_uniform(key_sql: str) -> str:
    """DuckDB twin of `hash_int(key)/2**32` for an already-built key expression."""
    return f"(CAST('0x' || SUBSTR(MD5({key_sql}), 1, 8) AS BIGINT) / 4294967296e0)"
