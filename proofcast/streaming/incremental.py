"""Keeping the score archive up to date as forecasts arrive.

A stored partition holds all issue dates of one model, site and valid date. New
files may touch only one issue date of it, so each step finds the touched model
and date pairs, reads those forecasts back whole, scores them and replaces the
partitions. Repeating a step, after a failure or a restart, gives the same
archive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofcast.operators.scoring import score
from proofcast.session import fresh_folder
from proofcast.sources import schemas
from proofcast.sources.readers import read_forecasts
from proofcast.sources.writers import write_scores


def latest_scored(scores: DataFrame) -> DataFrame:
    """Last valid date scored, by model."""
    return scores.groupBy("model_id").agg(F.max(F.to_date("datetime")).alias("latest"))


def due_for_scoring(forecasts: DataFrame, scores: DataFrame) -> DataFrame:
    """Forecast rows on or after their model's last scored date.

    The last date is scored again because it may have been incomplete; a model
    without scores is due as a whole.
    """
    joined = forecasts.join(latest_scored(scores), "model_id", "left")
    due = F.col("latest").isNull() | (F.to_date("datetime") >= F.col("latest"))
    return joined.filter(due).drop("latest")


def touched_partitions(batch: DataFrame) -> DataFrame:
    return batch.select("model_id", F.to_date("datetime").alias("date")).distinct()


def touched_rows(archive: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the touched model and date pairs, read from their partitions alone.

    A date range for each touched model, one row a model, becomes a filter on
    partition columns; the semi join then picks the pairs within the ranges.
    """
    ranges = pairs.groupBy("model_id").agg(F.min("date").alias("first"), F.max("date").alias("last")).collect()
    inside = [(F.col("model_id") == r["model_id"]) & F.col("date").between(F.lit(r["first"]), F.lit(r["last"])) for r in ranges]
    kept = archive.filter(reduce(lambda a, b: a | b, inside, F.lit(False)))
    return kept.join(pairs, ["model_id", "date"], "left_semi").drop("date")


def rescore(
    spark: SparkSession,
    forecasts_path: str,
    targets: DataFrame,
    scores_path: str,
    touched: DataFrame,
    folder: str | None = None,
) -> None:
    """Score the touched model and date pairs from the archive and store them.

    The pairs often come from the stored scores, which are about to change, so
    they are written to a new folder first: `folder`, or one below the shared
    folder.
    """
    fixed = folder or fresh_folder(spark, "touched")
    touched.write.parquet(fixed)
    pairs = spark.read.schema(touched.schema).parquet(fixed)
    rows = touched_rows(read_forecasts(spark, forecasts_path), pairs)
    write_scores(score(rows, targets), scores_path)


def score_due(
    spark: SparkSession, forecasts_path: str, targets: DataFrame, scores_path: str, scores: DataFrame
) -> None:
    """Batch form: score everything on or after each model's last scored date."""
    due = due_for_scoring(read_forecasts(spark, forecasts_path), scores)
    rescore(spark, forecasts_path, targets, scores_path, touched_partitions(due))


def score_stream(
    spark: SparkSession,
    forecasts_path: str,
    targets: DataFrame,
    scores_path: str,
    checkpoint: str,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Score forecast files as they appear; stops when none is left.

    The stream only tells which partitions changed, so it keeps no state and
    needs no watermark.
    """
    reader = spark.readStream.schema(schemas.FORECASTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def step(batch: DataFrame, _: int) -> None:
        rescore(batch.sparkSession, forecasts_path, targets, scores_path, touched_partitions(batch))

    return (
        reader.parquet(forecasts_path)
        .select("model_id", "datetime")
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_partitions(candidates: DataFrame) -> DataFrame:
    """Partitions to score again because their observation has arrived."""
    return touched_partitions(candidates)
