"""Leaderboards, ranks within a forecast and their distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofcast.functions import columns as C
from proofcast.functions.frames import join_null_safe, present

FORECAST = ("reference_datetime", "horizon", "site_id")


def top_n(
    df: DataFrame, by: str, n: int, direction: str = "max", within: Sequence[str] = ()
) -> DataFrame:
    """The n best rows by a column, ties at the cut kept, nulls out.

    Without groups the cut value comes from a distributed top-n; with groups
    the rank is limited on the map side before anything is shuffled.
    """
    known = df.filter(F.col(by).isNotNull())
    ordered = F.col(by).desc() if direction == "max" else F.col(by).asc()
    if within:
        rank = F.rank().over(Window.partitionBy(*within).orderBy(ordered))
        return known.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    best = known.select(by).orderBy(ordered).limit(n)
    cut = best.agg((F.min(by) if direction == "max" else F.max(by)).alias("cut")).scalar()
    return known.filter(F.col(by) >= cut if direction == "max" else F.col(by) <= cut)


def ranked_rows(scores: DataFrame, lo: int = 1, hi: int = 30) -> DataFrame:
    return C.eval_window(scores, lo, hi, skip=()).filter(F.col("crps").isNotNull())


def forecast_ranks(scores: DataFrame) -> DataFrame:
    """Place of each model in each forecast, best first, ties by model.

    Variables are ranked apart where the table has several. One forecast has one
    row per model, so its window stays small.
    """
    keys = [*FORECAST, *present(scores, ("variable",))]
    window = Window.partitionBy(*keys).orderBy("crps", "model_id")
    return ranked_rows(scores).select(*keys, "model_id", "crps", F.row_number().over(window).alias("rank"))


def rank_distribution(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How often each model takes each rank, and its share of its forecasts.

    `keys` adds lead time and site; without them all are taken together, but never
    two variables. Every ranked forecast has exactly one rank, so the counts also
    give the totals.
    """
    per = ["model_id", *present(scores, ("variable",)), *keys]
    counts = forecast_ranks(scores).groupBy(*per, "rank").agg(F.count(F.lit(1)).alias("n_rank"))
    total = F.sum("n_rank").over(Window.partitionBy(*per))
    return counts.withColumn("n", total).withColumn("proportion", F.col("n_rank") / F.col("n"))


def complete_ranks(
    distribution: DataFrame,
    most: int,
    models: Sequence[str] | None = None,
    sites: Sequence[str] | None = None,
    horizons: Sequence[int] | None = None,
) -> DataFrame:
    """Add the ranks, sites and lead times a model never took, with share 0.

    The grid is one row per model and variable exploded over fixed lists.
    """
    if models is not None:
        distribution = distribution.filter(F.col("model_id").isin(list(models)))
    of = ["model_id", *present(distribution, ("variable",))]
    grid = distribution.select(*of).distinct()
    keys = [*of, "rank"]
    if horizons is not None:
        grid = grid.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
        keys.append("horizon")
    if sites is not None:
        grid = grid.withColumn("site_id", F.explode(F.array(*[F.lit(s) for s in sites])))
        keys.append("site_id")
    grid = grid.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(most))))
    return distribution.join(grid, keys, "full").withColumn("proportion", F.coalesce(F.col("proportion"), F.lit(0.0)))


def rank_deciles(completed: DataFrame, most: int, keys: Sequence[str]) -> DataFrame:
    """Shares summed over ten rank groups; ranks beyond `most` are group 11."""
    return (
        completed.withColumn("group_rank", C.rank_bin(F.col("rank"), most))
        .groupBy("group_rank", *keys)
        .agg(F.sum("proportion").alias("proportion"))
    )


def mean_score_of_best(scores: DataFrame, n: int = 10) -> DataFrame:
    """Mean score by variable, lead time, model and site for the n best models of each variable."""
    of = present(scores, ("variable",))
    sums = C.with_horizon(scores).groupBy(*of, "horizon", "model_id", "site_id").agg(
        F.sum("crps").alias("_s"), F.count("crps").alias("_c")
    )
    per_model = sums.groupBy(*of, "model_id").agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias("mean_crps"))
    best = top_n(per_model, "mean_crps", n, "min", within=of)
    kept = sums.filter(F.col("horizon").between(0, 30))
    return join_null_safe(kept, best.select(*of, "model_id"), [*of, "model_id"], "left_semi").select(
        *of, "horizon", "model_id", "site_id", F.try_divide(F.col("_s"), F.col("_c")).alias("mean_crps")
    )
