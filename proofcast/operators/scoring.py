"""Distribution summaries and scores of ensemble and normal forecasts.

A forecast is one model, issue date, site, valid date and variable. Each value
gets its place among the members; every figure is then a sum or a pick over
(value, place). Members are dealt by their target, once: places, observation and
sums meet where the members are, and what compares models needs no further
shuffle. Targets of more members than a task should sort get their places from
ordered bins of counted values instead: no task sorts more than one bin of one
forecast, and the observation joins the bins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofcast.functions import columns as C
from proofcast.functions.families import PARAMETERS, by_family
from proofcast.functions.frames import bind_rows, present
from proofcast.operators.orderstats import between_picks, bin_offsets, interpolate, merged_counts, pick, quantile_picks

CELL = ("model_id", "reference_datetime", "site_id", "datetime", "family", "variable")
#: Families with a way of their own; the others meet in `score_others`.
SCORED = ("sample", "normal")
TARGET_KEYS = ("site_id", "datetime", "variable")

SUMMARY = ("mean", "median", "sd", "quantile97.5", "quantile02.5", "quantile90", "quantile10")
SCORES = ("crps", "logs")

#: Members of one target that a task sorts together, and the groups of targets
#: they are counted by; a group with more is scored by bins.
GATHERED, GROUPS = 1_000_000, 1 << 16
#: Members that a task gets, some 250 bytes each while they are sorted.
DEALT = 250_000

QUARTILES = {"_q25": 0.25, "_q75": 0.75}

# Kernel density of the members at the observation: the normal reference
# bandwidth, then the sum of kernels relative to the nearest member, whose term
# is the largest, so the sum never vanishes.
BANDWIDTH = "1.06D * least(_sd, (_q75 - _q25) / 1.34D) * power(_n, -0.2D)"
KERNELS = (
    "sum(_w * exp(0.5D * (_nearest / _bw) * (_nearest / _bw)"
    " - 0.5D * ((observation - _x) / _bw) * ((observation - _x) / _bw)))"
)
LOGS = f"ln(m * _bw / _kernels) + 0.5D * (_nearest / _bw) * (_nearest / _bw) + {0.5 * math.log(2.0 * math.pi)}D"


# Sums over the members of a forecast, from its smallest value, and what follows from them.
SUM_1 = "sum(_w * (_x - _base))"
SUM_2 = "sum(_w * (_x - _base) * (_x - _base))"
NEAREST = "min(abs(_x - observation))"


def deviation(s1: str, s2: str, n: str) -> str:
    """SQL: standard deviation from two sums."""
    return f"CASE WHEN {n} > 1 THEN sqrt(greatest(0.0D, ({s2} - {s1} * {s1} / {n}) / ({n} - 1))) END"


def width(sd: str, nearest: str) -> str:
    """SQL: bandwidth of a forecast's kernels; null where members don't spread or nothing is observed."""
    return f"CASE WHEN {sd} IS NOT NULL AND {nearest} IS NOT NULL THEN nullif({BANDWIDTH}, 0.0D) END"


def _probabilities(interval: float) -> dict[str, float]:
    tail = round((1.0 - interval) / 2.0, 12)
    return {
        "median": 0.5,
        "quantile97.5": 0.975,
        "quantile02.5": 0.025,
        "quantile90": 1.0 - tail,
        "quantile10": tail,
    }


def normalise_family(df: DataFrame) -> DataFrame:
    """Files label ensembles either `sample` or `ensemble`."""
    return df.withColumn("family", F.when(F.col("family") == "ensemble", "sample").otherwise(F.col("family")))


def standardise(df: DataFrame) -> DataFrame:
    """Canonical column types for a forecast table."""
    kinds = {
        "model_id": "string",
        "reference_datetime": "string",
        "site_id": "string",
        "variable": "string",
        "family": "string",
        "parameter": "string",
        "prediction": "double",
    }
    named = df.withColumnsRenamed({"start_time": "reference_datetime", "time": "datetime", "predicted": "prediction"})
    typed = named.withColumns({n: F.col(n).cast(kinds[n]) for n in present(named, list(kinds))})
    return typed.withColumn("prediction", C.nan_to_null(F.col("prediction")))


def standardise_targets(targets: DataFrame) -> DataFrame:
    """A target table may call its value `prediction`."""
    if "observation" not in targets.columns:
        targets = targets.withColumnRenamed("prediction", "observation")
    return targets.select("datetime", "site_id", "variable", "observation")


def _agreed(value: Column, name: str) -> Column:
    """The one value of a group; null where its rows disagree."""
    return F.when(F.min(value) == F.max(value), F.max(value)).alias(name)


def normal_parameters(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long `mu` and `sigma` rows as two columns, one row per forecast.

    A parameter that is given twice with different values is null, so such a
    forecast has no score.
    """
    return named_parameters(forecasts, keys, ("mu", "sigma"))


def named_parameters(forecasts: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long rows of some parameters as a column for each, one row per forecast; null where rows disagree."""
    return forecasts.groupBy(*keys).agg(
        *[_agreed(F.when(F.col("parameter").cast("string") == n, F.col("prediction")), n) for n in names]
    )


def one_observation(targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each target; null where rows of one target disagree.

    Two observations of one site, date and variable are an error in the data:
    forecasts of such a target stay unscored and can be scored once it is mended.
    """
    known = targets.filter(F.col("observation").isNotNull())
    return known.groupBy(*keys).agg(_agreed(F.col("observation"), "observation"))


def _placed(counts: DataFrame, targets: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Values (_x, _w times) with places and observation; and the bins they are in.

    `_cell` is a forecast and a bin in one value, so null keys match and the join
    and the order within a bin share one shuffle. `_base` is the smallest value
    of the forecast, from which deviations are taken without cancelling.
    """
    cell = F.struct(*keys, "_bin")
    bins = (
        bin_offsets(counts, keys, lowest="_base")
        .join(one_observation(targets, target_keys := present(counts, TARGET_KEYS)), target_keys, "left")
        .select(cell.alias("_cell"), "_offset", "_n", "_base", "observation")
    )
    order = Window.partitionBy("_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    values = counts.select(cell.alias("_cell"), "_x", "_w").join(bins, "_cell")
    before = F.col("_offset") + F.coalesce(F.sum("_w").over(order), F.lit(0))
    return values.withColumn("_before", before), bins


def score_samples(
    forecasts: DataFrame,
    targets: DataFrame,
    interval: float = 0.8,
    logs: bool = True,
) -> DataFrame:
    """Summaries and scores of ensemble forecasts, one row for each forecast."""
    keys = present(forecasts, CELL)
    members = forecasts.select(*keys, F.col("prediction").alias("_x"), F.lit(1).cast("bigint").alias("_w"))
    return score_members(members, targets, interval, logs)


def score_members(members: DataFrame, targets: DataFrame, interval: float = 0.8, logs: bool = True) -> DataFrame:
    """Summaries and scores of ensemble forecasts given as values (_x), each _w times, in one row or several.

    Members are first counted by groups of targets, a pass over the keys alone;
    the numbers of crowded groups, at most GROUPS, and the number of the other
    members are all that is collected.
    """
    keys, own = present(members, CELL), present(members, TARGET_KEYS)
    group = F.pmod(F.xxhash64(*own), F.lit(GROUPS))
    sizes = members.groupBy(group.alias("_group")).agg(F.count(F.lit(1)).alias("_size"))
    many = F.col("_size") > GATHERED
    found = sizes.agg(F.collect_list(F.when(many, F.col("_group"))).alias("crowded"), F.sum(F.when(~many, F.col("_size"))).alias("rest")).first()
    tasks = max(-(-(found["rest"] or 0) // DEALT), members.sparkSession.sparkContext.defaultParallelism)
    if not found["crowded"]:
        return _score_gathered(members, targets, interval, logs, tasks)
    apart = group.isin(found["crowded"])
    counts = merged_counts(members.filter(apart), keys, "_x", "_w")
    return bind_rows(
        _score_gathered(members.filter(~apart), targets, interval, logs, tasks),
        score_counted(counts, targets, interval, logs),
    )


def _score_gathered(members: DataFrame, targets: DataFrame, interval: float, logs: bool, tasks: int) -> DataFrame:
    """Scores of members that are dealt by their target; what follows needs no other shuffle of them.

    Equal values need no counting first: every figure adds up over them. Members are
    dealt to a number of tasks that follows from their own, so that each sorts its
    part in memory: their shuffle is a tenth of what they take there, and tasks
    sized by it spill.
    """
    keys, own = present(members, CELL), present(members, TARGET_KEYS)
    probs = _probabilities(interval)
    by_value = Window.partitionBy(*own, *[k for k in keys if k not in own]).orderBy(F.col("_x").asc_nulls_last())
    whole = by_value.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_value.rowsBetween(Window.unboundedPreceding, -1)
    placed = members.repartition(tasks, *own).withColumns(
        {
            "_before": F.coalesce(F.sum("_w").over(before), F.lit(0)),
            "_n": F.coalesce(F.sum(F.when(F.col("_x").isNotNull(), F.col("_w"))).over(whole), F.lit(0)),
            "_base": F.min("_x").over(whole),
        }
    )
    # the observations are dealt alike
    values = placed.join(one_observation(targets.repartition(tasks, *own), own), own, "left")
    if not logs:
        return _figures(_summed(values, keys, probs), keys, probs, "CAST(NULL AS DOUBLE)")
    quartiles = {q[1:]: p for q, p in QUARTILES.items()}
    picks = {
        f"_{place}_{name}": F.expr(pick(p, place)).over(whole) for name, p in quartiles.items() for place in ("floor", "ceil")
    }
    sums = {"_sum1": F.expr(SUM_1).over(whole), "_sum2": F.expr(SUM_2).over(whole), "_near": F.expr(NEAREST).over(whole)}
    spread = {"_sd": F.expr(deviation("_sum1", "_sum2", "_n"))} | {q: F.expr(interpolate(q[1:], p, "_n")) for q, p in QUARTILES.items()}
    # a member beside its forecast's figures
    values = values.withColumns(picks | sums).withColumns(spread).withColumn("_bw", F.expr(width("_sd", "_near")))
    values = values.withColumn("_nearest", F.col("_near"))
    more = [F.max("_bw").alias("_bw"), F.expr(f"{KERNELS} AS _kernels")]
    return _figures(_summed(values, keys, probs, more), keys, probs, LOGS)


def _summed(values: DataFrame, keys: Sequence[str], probs: dict[str, float], more: Sequence[Column] = ()) -> DataFrame:
    """Sums and picks over the placed values of every forecast, one row for each."""
    return (
        values.groupBy(*keys)
        .agg(
            F.max("observation").alias("observation"),
            F.max("_n").alias("m"),
            F.expr(
                "sum(_w * (_x - observation)"
                " * (CASE WHEN observation < _x THEN _n ELSE 0 END - _before - _w / 2.0D)) AS _crps"
            ),
            F.max("_base").alias("_base"),
            F.expr(f"{SUM_1} AS _s1"),
            F.expr(f"{SUM_2} AS _s2"),
            F.expr(f"{NEAREST} AS _nearest"),
            *quantile_picks(probs),
            *more,
        )
        .withColumn("sd", F.expr(deviation("_s1", "_s2", "m")))
    )


def _figures(cells: DataFrame, keys: Sequence[str], probs: dict[str, float], logs: str) -> DataFrame:
    """The columns of a score table from the sums of every forecast."""
    return cells.select(
        *keys,
        "observation",
        F.expr("2.0D * _crps / (CAST(m AS DOUBLE) * nullif(m, 0)) AS crps"),
        F.expr(f"{logs} AS logs"),
        F.expr("_base + _s1 / nullif(m, 0) AS mean"),
        "sd",
        *between_picks(probs, "m"),
        "m",
    )


def score_counted(counts: DataFrame, targets: DataFrame, interval: float = 0.8, logs: bool = True) -> DataFrame:
    """Summaries and scores of ensemble forecasts given as counted values (`distinct_counts`).

    Null members do not count; a forecast that has no others keeps its row, with
    m = 0 and null scores. Log scores need the bandwidth first, which meets the
    values bin by bin, so a forecast that holds much of the data is never joined
    or summed in one task.
    """
    keys = present(counts, CELL)
    probs = _probabilities(interval)
    values, bins = _placed(counts, targets, keys)
    own = [F.col(f"_cell.{k}").alias(k) for k in keys]
    picks = probs | ({q[1:]: p for q, p in QUARTILES.items()} if logs else {})
    cells = _summed(values.select(*own, "_x", "_w", "_before", "_n", "_base", "observation"), keys, picks)
    kernels = "CAST(NULL AS DOUBLE)"
    if logs:
        quartiles = {q: F.expr(interpolate(q[1:], p, "m")) for q, p in QUARTILES.items()}
        sized = cells.withColumns({**quartiles, "_sd": F.col("sd"), "_n": F.col("m")})
        cells = sized.withColumn("_bw", F.expr(width("sd", "_nearest")))
        widths = cells.select(F.struct(*keys).alias("_forecast"), "_bw", "_nearest", "observation").filter("_bw IS NOT NULL")
        forecast = F.struct(*[F.col(f"_cell.{k}").alias(k) for k in keys])
        widths = bins.select("_cell", forecast.alias("_forecast")).join(widths, "_forecast").drop("_forecast")
        # places don't matter here, so the counted values meet the widths as they are
        sums = (
            counts.select(F.struct(*keys, "_bin").alias("_cell"), "_x", "_w")
            .join(widths, "_cell")
            .select(*own, "_x", "_w", "_bw", "_nearest", "observation")
            .groupBy(*keys)
            .agg(F.expr(f"{KERNELS} AS _kernels"))
            .select(F.struct(*keys).alias("_forecast"), "_kernels")
        )
        cells = cells.withColumn("_forecast", F.struct(*keys)).join(sums, "_forecast", "left")
        kernels = LOGS
    return _figures(cells, keys, probs, kernels)


def score_normals(forecasts: DataFrame, targets: DataFrame, interval: float = 0.8) -> DataFrame:
    """Summaries and scores of forecasts given by `mu` and `sigma`."""
    keys = present(forecasts, CELL)
    target_keys = present(forecasts, TARGET_KEYS)
    observed = normal_parameters(forecasts, keys).join(one_observation(targets, target_keys), target_keys, "left")
    mu, sigma, y = F.col("mu"), F.col("sigma"), F.col("observation")
    levels = {0.8: C.Z_900, 0.9: C.Z_950, 0.95: C.Z_975}
    if interval not in levels:
        raise ValueError(f"normal forecasts report central intervals {sorted(levels)}")
    z = levels[interval]
    return observed.select(
        *keys,
        "observation",
        C.crps_normal(y, mu, sigma).alias("crps"),
        C.logs_normal(y, mu, sigma).alias("logs"),
        mu.alias("mean"),
        mu.alias("median"),
        sigma.alias("sd"),
        (mu + sigma * C.Z_975).alias("quantile97.5"),
        (mu - sigma * C.Z_975).alias("quantile02.5"),
        (mu + sigma * z).alias("quantile90"),
        (mu - sigma * z).alias("quantile10"),
    )


def score(
    forecasts: DataFrame,
    targets: DataFrame,
    interval: float = 0.8,
    logs: bool = True,
    families: Sequence[str] | None = None,
) -> DataFrame:
    """Score every forecast of a table against the targets.

    Groups by those of model_id, reference_datetime, site_id, datetime, family
    and variable the table has. `interval` is the central level reported as
    quantile10 / quantile90 (0.8, or 0.9 for the weather convention). `logs=False`
    leaves the log score of ensembles null, which saves a second pass. Forecasts
    without an observation keep null scores and can be scored again later, and so
    do forecasts of a family that cannot be scored. `families` restricts the
    forecasts to some families.
    """
    forecasts = normalise_family(standardise(forecasts))
    targets = standardise_targets(targets)
    parts = []
    if families is None or "sample" in families:
        parts.append(score_samples(forecasts.filter(F.col("family") == "sample"), targets, interval, logs))
    if families is None or "normal" in families:
        parts.append(score_normals(forecasts.filter(F.col("family") == "normal"), targets, interval))
    if families is None:
        parts.append(score_others(forecasts, targets, interval))
    elif others := [f for f in families if f not in SCORED]:
        parts.append(score_others(forecasts.filter(F.col("family").isin(others)), targets, interval))
    return bind_rows(*parts)


def score_others(forecasts: DataFrame, targets: DataFrame, interval: float = 0.8) -> DataFrame:
    """Forecasts that are neither ensembles nor normal, one row for each.

    Those of a registered family (`functions.families`) are scored by its closed
    forms. Others, and those whose parameters are missing, disagree or make no
    distribution, keep a row beside their observation, without scores. All meet
    in one aggregate.
    """
    other = forecasts.filter(C.not_one_of("family", SCORED))
    keys, target_keys = present(forecasts, CELL), present(forecasts, TARGET_KEYS)
    observed = named_parameters(other, keys, PARAMETERS).join(one_observation(targets, target_keys), target_keys, "left")
    y = F.col("observation")
    quantiles = [by_family(lambda f, a, b, p=p: f.quantile(a, b, p)).alias(n) for n, p in _probabilities(interval).items()]
    return observed.select(
        *keys,
        "observation",
        by_family(lambda f, a, b: f.crps(y, a, b)).alias("crps"),
        by_family(lambda f, a, b: f.logs(y, a, b)).alias("logs"),
        by_family(lambda f, a, b: f.mean(a, b)).alias("mean"),
        by_family(lambda f, a, b: f.sd(a, b)).alias("sd"),
        *quantiles,
    )


def rescored_layout(scores: DataFrame) -> DataFrame:
    """Lead time in days with time of day, site and depth apart, text date."""
    return scores.withColumns(
        {
            "horizon": C.lead_days_fractional(),
            "depth": C.depth_part(),
            "site_id": C.site_part(),
            "date": F.col("datetime").cast("string"),
        }
    )


def attach_observations(forecasts: DataFrame, targets: DataFrame) -> DataFrame:
    """Forecast rows beside their observation, null where there is none yet."""
    return normalise_family(forecasts).join(standardise_targets(targets), list(TARGET_KEYS), "left")


def rescore_candidates(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Scored before the observation arrived, observed by now."""
    known = standardise_targets(targets).filter(F.col("observation").isNotNull())
    return scores.filter(F.col("observation").isNull()).join(known, list(TARGET_KEYS), "left_semi")


def with_abs_bias(scores: DataFrame) -> DataFrame:
    return scores.withColumn("abs_bias", F.abs(F.col("mean") - F.col("observation")))


def forecast_slice(scores: DataFrame, issued: str, models: Sequence[str]) -> DataFrame:
    """One issue date of chosen models, lead times 1 to 30, beside what was observed."""
    return (
        C.with_horizon(scores)
        .filter(F.to_date("reference_datetime") == F.lit(issued).cast("date"))
        .filter(F.col("horizon").between(1, 30) & F.col("model_id").isin(list(models)))
        .select(*present(scores, ("variable",)), "model_id", "site_id", "datetime", "horizon", "mean", "observation")
    )

