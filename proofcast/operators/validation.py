"""Rule report for a forecast table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofcast.functions.frames import present

# Columns of a forecast table and its families.
REQUIRED = ("datetime", "reference_datetime", "site_id", "variable", "family", "parameter", "prediction")
FAMILIES = ("sample", "ensemble", "normal")


def missing_columns(df: DataFrame) -> list[str]:
    return [n for n in REQUIRED if n not in df.columns]


def validation_report(df: DataFrame) -> DataFrame:
    """Rows breaking each rule, one row per rule.

    A table that lacks columns breaks one rule for each of them, and the others
    are not looked at.

    Duplicates are counted beyond the first; a normal forecast must have both
    parameters. All checks aggregate on the map side first.
    """
    absent = missing_columns(df)
    if absent:
        rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
        named = F.explode(F.array(*[F.lit(f"missing_column_{n}") for n in absent])).alias("rule")
        return rows.select(named, "n_rows", F.lit(False).alias("passed"))
    keys = present(df, ("model_id", "reference_datetime", "site_id", "datetime", "variable", "family"))
    bad = {
        "unknown_family": ~F.coalesce(F.col("family").isin(list(FAMILIES)), F.lit(False)),
        "missing_prediction": F.col("prediction").isNull() | F.isnan("prediction"),
        "not_after_issue_date": ~F.coalesce(
            F.to_date("datetime") > F.to_date("reference_datetime"), F.lit(False)
        ),
    }
    members = df.groupBy(*keys, "parameter").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.when(c, F.lit(1))).alias(n) for n, c in bad.items()]
    )
    forecasts = members.groupBy(*keys).agg(
        *[F.sum(n).alias(n) for n in bad],
        F.sum(F.col("_n") - 1).alias("duplicate_member"),
        F.count(F.when(F.col("parameter").cast("string").isin("mu", "sigma"), F.lit(1))).alias("_named"),
    )
    incomplete = (F.col("family") == "normal") & (F.col("_named") < 2)
    rules = [*bad, "duplicate_member", "incomplete_normal"]
    totals = forecasts.withColumn("incomplete_normal", F.when(incomplete, 1).otherwise(0)).agg(
        *[F.coalesce(F.sum(r), F.lit(0)).cast("bigint").alias(r) for r in rules]
    )
    return totals.unpivot([], rules, "rule", "n_rows").withColumn("passed", F.col("n_rows") == 0)


def structure_report(df: DataFrame) -> DataFrame:
    """Submissions that break a rule about their rows together, one row per rule.

    Members must be the same at every valid date of a submission (model, issue
    date, site, variable), valid dates must follow each other without a gap, and a
    stored `date` must be that of the row. Members of a date are compared by their
    number and a digest of their names, so one row for each date meets the others.
    """
    submission = present(df, ("model_id", "reference_datetime", "site_id", "variable"))
    strays = ~F.to_date("datetime").eqNullSafe(F.to_date("date")) if "date" in df.columns else F.lit(False)
    dates = df.groupBy(*submission, F.to_date("datetime").alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bit_xor(F.xxhash64(F.col("parameter").cast("string"))).alias("_names"),
        F.max(strays).alias("_stray"),
    )
    whole = dates.groupBy(*submission).agg(
        ((F.min("_n") != F.max("_n")) | (F.min("_names") != F.max("_names"))).alias("unequal_members"),
        (F.date_diff(F.max("_day"), F.min("_day")) + 1 != F.count("_day")).alias("gap_in_dates"),
        F.max("_stray").alias("partition_mismatch"),
    )
    return _totals(whole, ["unequal_members", "gap_in_dates", "partition_mismatch"])


def quantile_report(scores: DataFrame) -> DataFrame:
    """Scored forecasts whose quantiles are out of order, or whose median lies outside them."""
    names = present(scores, ("quantile02.5", "quantile10", "median", "quantile90", "quantile97.5"))
    falls = [F.coalesce(F.col(f"`{a}`") > F.col(f"`{b}`"), F.lit(False)) for a, b in zip(names, names[1:], strict=False)]
    flagged = scores.select(F.greatest(*falls).alias("quantiles_out_of_order") if len(falls) > 1 else F.lit(False).alias("quantiles_out_of_order"))
    return _totals(flagged, ["quantiles_out_of_order"])


def _totals(flags: DataFrame, rules: list[str]) -> DataFrame:
    totals = flags.agg(*[F.count(F.when(F.col(r), F.lit(1))).alias(r) for r in rules])
    return totals.unpivot([], rules, "rule", "n_rows").withColumn("passed", F.col("n_rows") == 0)


def duplicate_scores(scores: DataFrame) -> DataFrame:
    """Score keys that occur more than once."""
    keys = present(scores, ("model_id", "reference_datetime", "site_id", "datetime", "variable"))
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
