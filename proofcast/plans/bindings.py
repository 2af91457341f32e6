"""Forecast tables derived from the supplied order tables.

Every row of lineitem, orders and supplier is used. A line is one ensemble
member of one of ten models; 5,000 order keys make an issue week, so a larger
input means more issue dates. Two combinations of model, site and lead time are
moved to long lead times, which leaves gaps in and next to the baseline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofcast.functions.columns import LAKE_SITES
from proofcast.operators.ensemble import SUBMISSION
from proofcast.operators.scoring import normal_parameters, score

# Size of an issue week and first issue date.
ORDERS_PER_WEEK = 5000
FIRST_DATE = "2023-01-01"
FOCAL_YEAR = 2000

CELL_KEYS = [*SUBMISSION, "datetime"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _site(key: str) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in LAKE_SITES]), (F.col(key) % 7 + 1).cast("int"))


def _model(number: Column) -> Column:
    return (
        F.when(number == 0, "climatology")
        .when(number == 1, "persistenceRW")
        .otherwise(F.concat(F.lit("model_"), number.cast("string")))
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registered model per supplier; ten of them submit forecasts."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        _model(k).alias("model_id"),
        F.concat(F.lit("Model "), k.cast("string")).alias("manuscript_name"),
        F.when(k < 2, "null")
        .when(k % 4 == 0, "process-based")
        .when(k % 4 == 1, "ML")
        .when(k % 4 == 2, "empirical")
        .otherwise("MME")
        .alias("model_type"),
        F.when(k % 3 == 0, "temperature")
        .when(k % 3 == 1, "temperature, oxygen")
        .otherwise("oxygen")
        .alias("variable"),
        F.when(k % 4 == 0, "air_temperature, relative_humidity")
        .when(k % 4 == 1, "air_temperature")
        .when(k % 4 == 2, "precipitation_flux")
        .alias("NOAA_var"),
        F.when(k % 4 < 3, 1).otherwise(0).alias("uses_NOAA"),
        (k % 2).cast("int").alias("unc_driver"),
        F.when(k % 10 != 9, (k % 3).cast("int")).alias("unc_process"),
        F.when(k % 5 == 0, 1).otherwise(0).alias("unc_initial"),
        F.when(k % 2 == 0, 1).otherwise(0).alias("initial_cond"),
        F.when(k % 3 == 0, 1).otherwise(0).alias("updates_parameters"),
        F.when(k % 10 != 7, 1).alias("dynamic"),
    )


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble members where their number does not matter."""
    number = F.col("l_suppkey") % 10
    site = F.col("l_partkey") % 7
    days = F.col("l_quantity").cast("int")
    horizon = (
        F.when((number != 0) & (site == 0) & (days == 7), 44)
        .when((number == 0) & (site == 5) & (days == 9), 45)
        .otherwise(days)
    )
    issued = F.date_add(F.lit(FIRST_DATE).cast("date"), F.expr(f"cast((l_orderkey div {ORDERS_PER_WEEK}) * 7 as int)"))
    offset = F.when(number == 0, 2.0).otherwise(0.4 * number - 0.5)
    lost = (F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08)
    return table(spark, sf_dir, "lineitem").select(
        _model(number).alias("model_id"),
        issued.cast("string").alias("reference_datetime"),
        F.date_add(issued, horizon).alias("datetime"),
        _site("l_partkey").alias("site_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "oxygen").otherwise("temperature").alias("variable"),
        F.lit("sample").alias("family"),
        F.when(~lost, 1.5 + 2.0 * F.log(F.col("l_extendedprice") / 900.0) + offset).alias("prediction"),
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble members, numbered within each forecast by their value.

    A forecast has no more members than an issue week has lines, however many
    weeks there are, so a window may number them.
    """
    within = Window.partitionBy(*CELL_KEYS, "family").orderBy(F.col("prediction").asc_nulls_last())
    return unnumbered(spark, sf_dir).withColumn("parameter", F.row_number().over(within).cast("bigint"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per date, site and variable; the last weeks are not observed yet."""
    days = F.expr(f"cast((o_orderkey div {ORDERS_PER_WEEK}) * 7 + o_orderkey % 25 as int)")
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.date_add(F.lit(FIRST_DATE).cast("date"), days).alias("datetime"),
            _site("o_custkey").alias("site_id"),
            F.when(F.col("o_orderpriority") < "3", "oxygen").otherwise("temperature").alias("variable"),
            (F.sqrt("o_totalprice") / 60.0).alias("value"),
        )
        .groupBy("datetime", "site_id", "variable")
        .agg(F.avg("value").alias("observation"))
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-year observations for the seasonal reports."""
    return table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("datetime"),
        _site("o_custkey").alias("site_id"),
        F.when(F.col("o_orderpriority") < "3", "oxygen").otherwise("temperature").alias("variable"),
        F.when(F.col("o_orderkey") % 50 != 0, F.sqrt("o_totalprice") / 60.0).alias("observation"),
    )


def scores(spark: SparkSession, sf_dir: str, logs: bool = False) -> DataFrame:
    """The score table of those forecasts."""
    return score(unnumbered(spark, sf_dir), observations(spark, sf_dir), logs=logs, families=("sample",))


def normal_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same forecasts as mean and deviation; a single member has no deviation."""
    fitted = (
        unnumbered(spark, sf_dir)
        .groupBy(*CELL_KEYS)
        .agg(
            F.avg("prediction").alias("mu"),
            F.stddev_samp("prediction").alias("sigma"),
        )
    )
    long = fitted.unpivot(CELL_KEYS, ["mu", "sigma"], "parameter", "prediction")
    return long.withColumn("family", F.lit("normal"))


def normal_parameter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal_parameters(normal_forecasts(spark, sf_dir), CELL_KEYS)
