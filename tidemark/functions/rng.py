"""Random numbers by counters: the same for a key whatever the partitioning, and in any SQL engine that has MD5."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | int | str) -> Column:
    """In [0, 1), by the first 32 bits of the MD5 of the key's parts, joined by colons."""
    text = F.concat_ws(":", *((k if isinstance(k, Column) else F.lit(k)).cast("string") for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*key: Column | int | str) -> Column:
    """Box-Muller, of two counters."""
    u, v = uniform(*key, "a"), uniform(*key, "b")
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)


def uniform_sql(key: str) -> str:
    """The same in DuckDB's SQL; ``key`` is an SQL string expression."""
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def normal_sql(key: str) -> str:
    return f"(sqrt(-2 * ln(1 - {uniform_sql(key + chr(124) * 2 + chr(39) + ':a' + chr(39))})) * cos(2 * pi() * {uniform_sql(key + chr(124) * 2 + chr(39) + ':b' + chr(39))}))"
