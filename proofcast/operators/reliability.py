"""How often observations fall inside the central intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofcast.functions import columns as C
from proofcast.functions.frames import present

# The interval columns of a score table, by central level.
INTERVALS = {80: ("quantile10", "quantile90"), 95: ("quantile02.5", "quantile97.5")}


def reliability(
    scores: DataFrame,
    models: DataFrame | None,
    level: int,
    extra_keys: Sequence[str] = (),
    skip: Sequence[int] = (15,),
) -> DataFrame:
    """Share of observations inside the interval by variable, lead time and model.

    `models` lists model_id and manuscript_name, for each variable if it has that
    column; only those are kept. Rows without a bound count in neither number.
    """
    if level not in INTERVALS:
        raise ValueError("level must be 80 or 95")
    low, high = INTERVALS[level]
    inside = F.col("observation").between(C.quoted(low), C.quoted(high))
    keys = [*present(scores, ("variable",)), "horizon", "model_id", *extra_keys]
    counted = (
        C.eval_window(scores.filter(F.col("observation").isNotNull()), skip=skip)
        .groupBy(*keys)
        .agg(
            F.count(F.when(inside, F.lit(1))).alias("within_TRUE"),
            F.count(F.when(~inside, F.lit(1))).alias("within_FALSE"),
        )
    )
    if models is not None:
        listed = [n for n in ("variable", "model_id") if n in keys and n in models.columns]
        counted = counted.join(models.select(*listed, "manuscript_name"), listed)
        keys.append("manuscript_name")
    total = F.col("within_TRUE") + F.col("within_FALSE")
    return counted.select(
        *keys, "within_TRUE", "within_FALSE", F.try_divide(F.col("within_TRUE"), total * F.lit(1.0)).alias("_share")
    ).select(*keys, "within_TRUE", "within_FALSE", (F.col("_share") * 100.0).alias("perc"))
