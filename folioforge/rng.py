"""Keyed random numbers: pure functions of a purpose and a key, equal in every engine.

h(purpose, key) is the first 8 hex digits of md5(purpose || ':' || key) as a number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(purpose: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(purpose + ":"), key.cast("string")).cast("binary"))


def h(purpose: str, key: Column) -> Column:
    return F.conv(F.substring(_digest(purpose, key), 1, 8), 16, 10).cast("bigint")


def u(purpose: str, key: Column) -> Column:
    """Uniform in [0, 1)."""
    return h(purpose, key) / F.lit(4294967296.0)


def randint(purpose: str, key: Column, a, b) -> Column:
    """Uniform integer of [a, b]; a and b are numbers or columns."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("bigint") for x in (a, b))
    return a + h(purpose, key) % (b - a + 1)


def choice(purpose: str, key: Column, values: list) -> Column:
    options = F.array(*[F.lit(v) for v in values])
    return F.get(options, (h(purpose, key) % len(values)).cast("int"))


def shuffle_key(purpose: str, key: Column) -> Column:
    return _digest(purpose, key)


# The same in DuckDB's SQL, for oracles.
def sql_h(purpose: str, key: str) -> str:
    return f"('0x' || substr(md5('{purpose}:' || {key}), 1, 8))::BIGINT"


def sql_u(purpose: str, key: str) -> str:
    return f"({sql_h(purpose, key)} / 4294967296.0)"
