"""Reshaping that makes gaps visible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_sites(df: DataFrame, keys: Sequence[str], value: str, sites: Sequence[str]) -> DataFrame:
    """Every key with every site, null where the site has no value."""
    wide = df.groupBy(*keys).pivot("site_id", list(sites)).agg(F.max(value))
    return wide.unpivot(list(keys), list(sites), "site_id", value)


def day_spine(first: str, last: str, df: DataFrame, name: str = "reference_datetime") -> DataFrame:
    """Every day between two dates, as one exploded row of a frame's session."""
    spark = df.sparkSession
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias(name))
