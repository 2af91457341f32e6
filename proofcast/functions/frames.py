"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Natural join in which a null key matches a null key."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, match, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "right"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"_r_{k}")) for k in keys})
    return joined.drop(*[f"_r_{k}" for k in keys])


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of the names that the frame has, in the given order."""
    have = set(df.columns)
    return [n for n in names if n in have]


def columns_like(df: DataFrame, part: str) -> list[str]:
    """Names that contain a text, whatever the case."""
    return [n for n in df.columns if part.lower() in n.lower()]


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [n for n, t in df.dtypes if t in kinds or t.startswith("decimal")]


def complete_rows(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in any (of the named) columns."""
    names = list(names or df.columns)
    return df.filter(reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in names]))


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Append frames; a column missing from one becomes null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
