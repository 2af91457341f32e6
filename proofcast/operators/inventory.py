"""What was submitted: models, their attributes and their forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofcast.functions import columns as C
from proofcast.functions.frames import columns_like


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def variable_flags(models: DataFrame) -> DataFrame:
    """Which of the variables and air temperature each model mentions."""
    return models.select(
        "model_id",
        C.mentions("variable", "temperature").alias("tw"),
        C.mentions("variable", "oxygen").alias("do"),
        C.mentions("NOAA_var", "air_temperature").alias("uses_AT"),
        C.yes_no("uses_NOAA").alias("uses_NOAA"),
    )


def flag_totals(models: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Number of models with each flag; 0 where no value is known."""
    return models.agg(*[F.coalesce(F.sum(F.col(f).cast("int")), F.lit(0)).cast("bigint").alias(f) for f in flags])


def models_by_class(models: DataFrame, variable: str) -> DataFrame:
    """Models of each class that forecast a variable."""
    return count_by(models.filter(C.mentions("variable", variable)), "model_type")


def uncertainty_count_hist(models: DataFrame, variable: str | None = None) -> DataFrame:
    """Models by number of uncertainty sources; null if any is unknown."""
    if variable is not None:
        models = models.filter(C.mentions("variable", variable))
    return count_by(models.select(C.row_sum(columns_like(models, "unc_")).alias("unc_n")), "unc_n")


def covariate_matrix(models: DataFrame) -> DataFrame:
    """One truth column per weather covariate."""
    return models.select("model_id", *[C.mentions("NOAA_var", v).alias(v) for v in C.WEATHER_COVARIATES])


def covariate_usage(models: DataFrame) -> DataFrame:
    """Models per covariate, most used first."""
    totals = flag_totals(covariate_matrix(models), C.WEATHER_COVARIATES)
    long = totals.unpivot([], list(C.WEATHER_COVARIATES), "NOAA_vars", "n_models")
    return long.orderBy(F.col("n_models").desc(), "NOAA_vars")


def covariate_count_hist(models: DataFrame) -> DataFrame:
    """Models by number of covariates, most common first."""
    counted = covariate_matrix(models).select(C.row_sum(C.WEATHER_COVARIATES).alias("vars_n"))
    return count_by(counted, "vars_n", "n_models").orderBy(F.col("n_models").desc())


def distinct_forecasts(scores: DataFrame) -> DataFrame:
    return scores.select("model_id", "site_id", "variable", "reference_datetime").distinct()


def forecasts_by_variable(scores: DataFrame) -> DataFrame:
    """Number and percentage of distinct forecasts by variable."""
    counts = count_by(distinct_forecasts(scores), "variable")
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("percent", F.lit(100.0) * F.col("n") / total)


def breadth_hist(scores: DataFrame, what: str, per: str, name: str) -> DataFrame:
    """How many models cover 1, 2, 3, ... different sites or variables."""
    breadth = scores.select("model_id", what).distinct().groupBy("model_id").agg(F.count(F.lit(1)).alias(per))
    return count_by(breadth, per, name)
