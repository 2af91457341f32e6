"""Seasonality and spread of the observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofcast.functions import columns as C
from proofcast.operators.orderstats import exact_quantiles


def restrict(targets: DataFrame, variable: str, sites: Sequence[str] = C.LAKE_SITES) -> DataFrame:
    return targets.filter((F.col("variable") == variable) & F.col("site_id").isin(list(sites)))


def date_parts(targets: DataFrame, focal_year: int) -> DataFrame:
    """Year, month, day of year and whether the year is the focal one."""
    return targets.withColumns(
        {
            "year": F.year("datetime"),
            "month": F.month("datetime"),
            "doy": F.dayofyear("datetime"),
            "period": F.when(F.year("datetime") == focal_year, "focal").otherwise("historic"),
        }
    )


def _masked(value: str):
    return F.when(F.col("n") >= C.MIN_MONTHLY_SAMPLE, F.col(value)).alias(value)


def monthly_mean_focal(targets: DataFrame, focal_year: int, variable: str = "temperature") -> DataFrame:
    """Monthly site means of the focal year; too small samples are masked."""
    return (
        restrict(targets, variable)
        .filter(F.year("datetime") == focal_year)
        .groupBy(F.month("datetime").alias("month"), "site_id")
        .agg(F.avg("observation").alias("mean_obs"), F.count(F.lit(1)).alias("n"))
        .select("month", "site_id", _masked("mean_obs"), "n")
    )


def seasonal_anomaly(
    targets: DataFrame, focal_year: int, variable: str = "temperature", sites: Sequence[str] = C.LAKE_SITES
) -> DataFrame:
    """Median of the focal year minus that of all other years, by month and site."""
    parts = date_parts(restrict(targets, variable, sites), focal_year)
    medians = exact_quantiles(parts, ["month", "site_id", "period"], "observation", {"median_obs": 0.5}, count="n")
    masked = medians.select("month", "site_id", "period", _masked("median_obs"))
    wide = masked.groupBy("month", "site_id").agg(
        F.max(F.when(F.col("period") == "focal", F.col("median_obs"))).alias("focal"),
        F.max(F.when(F.col("period") == "historic", F.col("median_obs"))).alias("historic"),
    )
    return wide.select(
        F.make_date(F.lit(focal_year), F.col("month"), F.lit(1)).alias("month"),
        "site_id",
        "focal",
        "historic",
        (F.col("focal") - F.col("historic")).alias("delta"),
    )


def observation_cv(targets: DataFrame, before: int, variable: str = "temperature") -> DataFrame:
    """Sample standard deviation over mean, by site and year."""
    return (
        restrict(targets, variable)
        .filter(F.year("datetime") < before)
        .groupBy("site_id", F.year("datetime").alias("year"), "variable")
        .agg(F.try_divide(F.stddev_samp("observation"), F.avg("observation")).alias("cv"))
    )


def observation_coverage(targets: DataFrame, before: int, sites: Sequence[str] = C.LAKE_SITES) -> DataFrame:
    """Which site, variable and date was observed before a year."""
    return targets.filter((F.year("datetime") < before) & F.col("site_id").isin(list(sites))).select(
        "site_id", "variable", "datetime"
    )
