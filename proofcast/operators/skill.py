"""Skill against a baseline model and the reports built on it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofcast.functions import columns as C
from proofcast.functions.frames import bind_rows, complete_rows, join_null_safe, present
from proofcast.operators.orderstats import exact_quantiles

FORECAST_KEYS = ("reference_datetime", "datetime", "site_id", "variable")


def skill(
    scores: DataFrame,
    baseline_id: str = C.CLIMATOLOGY,
    orientation: str = "diff",
    how: str = "full",
    baseline: DataFrame | None = None,
    lo: int = 1,
    hi: int = 30,
    skip: Sequence[int] = (15,),
) -> DataFrame:
    """Every other model's score minus the baseline's for the same forecast.

    Forecasts match on issue date, valid date, site and variable, null keys
    included. `full` also keeps baseline forecasts no model answered, with a
    null model; `left` does not. `orientation='gain'` is baseline minus model.
    `baseline` supplies the baseline's scores when `scores` was restricted.

    A full outer join would scan and shuffle the scores twice. All rows of one
    forecast meet in one window instead, at most one row per model, so groups
    stay small however the data are skewed.
    """
    values = present(scores, ("crps", "logs"))
    keys = list(FORECAST_KEYS)
    wanted = [*keys, "model_id", *values]
    rows = scores.select(*wanted)
    if baseline is not None:
        rows = bind_rows(
            rows.filter(F.col("model_id") != baseline_id),
            baseline.filter(F.col("model_id") == baseline_id).select(*wanted),
        )
    rows = C.eval_window(rows.filter(F.col("model_id").isNotNull()), lo, hi, skip)

    is_base = F.col("model_id") == baseline_id
    forecast = Window.partitionBy(*keys)
    base = {f"{v}_{baseline_id}": F.max(F.when(is_base, F.col(v))).over(forecast) for v in values}
    answers = F.count(F.when(~is_base, F.lit(1))).over(forecast)
    matched = rows.withColumns({**base, "_answers": answers})

    if how == "left":
        kept = matched.filter(~is_base)
    elif how == "full":
        kept = matched.filter(~is_base | (F.col("_answers") == 0))
    else:
        raise ValueError("how must be 'full' or 'left'")
    kept = kept.withColumns({n: F.when(~is_base, F.col(n)) for n in ["model_id", *values]})

    def difference(v: str) -> Column:
        gap = F.col(v) - F.col(f"{v}_{baseline_id}")
        return gap if orientation == "diff" else -gap

    return kept.withColumns({f"skill_{v}": difference(v) for v in values}).select(
        *keys, "horizon", "model_id", *values, *base, *[f"skill_{v}" for v in values]
    )


def canonical_order(df: DataFrame) -> DataFrame:
    """Sort skill rows for output, nulls last."""
    names = present(df, ("reference_datetime", "site_id", "datetime", "model_id", "variable"))
    return df.orderBy(*[F.col(n).asc_nulls_last() for n in names])


def per_variable(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """The keys, and `variable` where the table has it: variables are never taken together."""
    return list(dict.fromkeys([*present(df, ("variable",)), *keys]))


def mean_by(df: DataFrame, keys: Sequence[str], value: str = "skill_crps", name: str = "mean_crps") -> DataFrame:
    """Mean of a value by group and variable; nulls do not count."""
    return df.groupBy(*per_variable(df, keys)).agg(F.avg(value).alias(name))


def better_than_baseline(skill_rows: DataFrame, orientation: str = "diff") -> DataFrame:
    """Models whose mean skill beats the baseline on a variable, with that mean."""
    means = mean_by(skill_rows, ["model_id"])
    return means.filter(F.col("mean_crps") < 0 if orientation == "diff" else F.col("mean_crps") > 0)


def of_models(rows: DataFrame, models: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of the listed models, on the variables they are listed for."""
    keys = per_variable(rows, ["model_id"])
    return rows.join(models.select(*keys), keys, how)


def leaderboard_with_baselines(skill_rows: DataFrame, models: DataFrame) -> DataFrame:
    """Leaders by variable, with name and class; both baselines are always there."""
    names = models.select("model_id", "manuscript_name", "model_type")
    leaders = better_than_baseline(skill_rows).join(names, "model_id", "left")
    ids = F.explode(F.array(F.lit(C.CLIMATOLOGY), F.lit(C.PERSISTENCE))).alias("model_id")
    if "variable" in skill_rows.columns:
        baselines = mean_by(skill_rows, ["model_id"]).select("variable").distinct().select("variable", ids).join(names, "model_id")
    else:
        baselines = names.filter(F.col("model_id").isin(C.CLIMATOLOGY, C.PERSISTENCE))
    return join_null_safe(leaders, baselines, per_variable(skill_rows, ["model_id", "manuscript_name", "model_type"]), "full")


def mean_skill_split(
    skill_rows: DataFrame,
    keys: Sequence[str],
    leaders: bool | None,
    exclude: Sequence[str] = (),
    name: str = "mean_crps",
) -> DataFrame:
    """Mean skill by model, variable and further keys, for the leaders or for the others.

    Sums and counts by model and keys are enough to decide who leads, so the
    skill rows are read and shuffled once for both questions. The null model
    counts among the others.
    """
    groups = per_variable(skill_rows, ["model_id", *keys])
    sums = skill_rows.groupBy(*groups).agg(F.sum("skill_crps").alias("_s"), F.count("skill_crps").alias("_c"))
    per_model = Window.partitionBy(*per_variable(skill_rows, ["model_id"]))
    overall = F.try_divide(F.sum("_s").over(per_model), F.sum("_c").over(per_model))
    leads = F.coalesce(overall < 0, F.lit(False))
    kept = sums.withColumn("_leads", leads)
    if leaders is not None:
        kept = kept.filter(F.col("_leads") == F.lit(leaders))
    for model in exclude:
        # like R, a comparison with a null model drops the row
        kept = kept.filter(F.col("model_id") != model)
    return kept.select(*groups, F.try_divide(F.col("_s"), F.col("_c")).alias(name))


def leader_mean_by(skill_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean skill by variable and keys over all rows of the leading models."""
    groups = per_variable(skill_rows, ["model_id", *keys])
    sums = skill_rows.groupBy(*groups).agg(F.sum("skill_crps").alias("_s"), F.count("skill_crps").alias("_c"))
    per_model = Window.partitionBy(*per_variable(skill_rows, ["model_id"]))
    overall = F.try_divide(F.sum("_s").over(per_model), F.sum("_c").over(per_model))
    return (
        sums.withColumn("_mean", overall)
        .filter(F.col("_mean") < 0)
        .groupBy(*per_variable(skill_rows, keys))
        .agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias("mean_crps"))
    )


def baseline_outcome(vs_climatology: DataFrame, vs_persistence: DataFrame, models: DataFrame) -> DataFrame:
    """Which baselines each leading model beats at each lead time, by variable."""
    leaders = better_than_baseline(vs_climatology)
    keys = per_variable(vs_climatology, ["model_id", "horizon"])
    doy = mean_skill_split(vs_climatology, ["horizon"], leaders=True, exclude=["persistence"], name="mean_crpsDOY")
    rw = mean_by(vs_persistence, ["model_id", "horizon"], name="mean_crpsRW")
    rw = of_models(rw.filter(F.col("model_id") != C.CLIMATOLOGY), leaders)
    both = doy.join(rw, keys, "full").join(
        models.select("model_id", "manuscript_name"), "model_id", "left"
    )
    d, r = F.col("mean_crpsDOY"), F.col("mean_crpsRW")
    beats = (
        F.when(d.isNull() | r.isNull(), F.lit(None))
        .when((d < 0) & (r < 0), "both")
        .when((d > 0) & (r < 0), "RW")
        .when((d < 0) & (r > 0), "DOY")
        .otherwise("none")
    )
    order = F.array_position(F.array(*[F.lit(k) for k in C.OUTCOME_LABELS]), F.col("_beats")).cast("int")
    labelled = both.withColumn("_beats", beats).select(
        *keys,
        "manuscript_name",
        "mean_crpsDOY",
        "mean_crpsRW",
        C.relabel("_beats", C.OUTCOME_LABELS).alias("beats"),
        order.alias("beats_order"),
    )
    return complete_rows(labelled)


def by_class_and_site(skill_rows: DataFrame, models: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Mean skill by variable, model class, model and site, without the null class."""
    means = mean_by(skill_rows, ["model_id", "site_id"], name="mean_skill") if means is None else means
    classes = models.select("model_id", "model_type")
    return (
        means.join(classes, "model_id", "left")
        .filter(F.col("model_type") != "null")
        .select(*per_variable(means, ["model_type", "model_id", "site_id"]), "mean_skill")
    )


def box_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Box-plot figures: hinges, whiskers within 1.5 spreads, points beyond.

    Meant for summaries such as one value per model, yet safe for any size.
    """
    known = df.filter(F.col(value).isNotNull())
    hinges = exact_quantiles(known, keys, value, {"lower": 0.25, "middle": 0.5, "upper": 0.75}, count="n")
    reach = 1.5 * (F.col("upper") - F.col("lower"))
    inside = F.col(value).between(F.col("lower") - reach, F.col("upper") + reach)
    whiskers = (
        join_null_safe(known.select(*keys, value), hinges, keys)
        .groupBy(*keys)
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count(F.when(~inside, F.lit(1))).alias("outliers"),
        )
    )
    return join_null_safe(hinges, whiskers, keys)


def daily_sums(skill_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums and counts of skill by keys and valid date, with the number of complete rows.

    They add up to the mean over any period, so rows are read once for a period and
    for what is reported of it. Without lead time or issue date among the keys a
    model and site have one row a date.
    """
    whole = reduce(lambda a, b: a & b, [C.quoted(n).isNotNull() for n in skill_rows.columns])
    return skill_rows.groupBy(*per_variable(skill_rows, [*keys, "datetime"])).agg(
        F.sum("skill_crps").alias("_s"), F.count("skill_crps").alias("_c"), F.count(F.when(whole, F.lit(1))).alias("_whole")
    )


def common_period(sums: DataFrame) -> DataFrame:
    """The valid dates for which every site has complete rows, by variable, from daily sums."""
    per_site = (
        sums.filter(F.col("_whole") > 0)
        .groupBy(*per_variable(sums, ["site_id"]))
        .agg(F.min("datetime").alias("first_date"), F.max("datetime").alias("last_date"))
    )
    shared = [F.max("first_date").alias("first_date"), F.min("last_date").alias("last_date")]
    return per_site.groupBy(*per_variable(sums, [])).agg(*shared)


def within_period(sums: DataFrame, period: DataFrame) -> DataFrame:
    """Daily sums whose valid date lies in the period of their variable."""
    keys = per_variable(sums, [])
    inside = F.col("datetime").between(F.col("first_date"), F.col("last_date"))
    if not keys:
        sums, period, keys = sums.withColumn("_all", F.lit(1)), period.withColumn("_all", F.lit(1)), ["_all"]
    return sums.join(period, keys).filter(inside).drop("first_date", "last_date", "_all")


def mean_of_sums(sums: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Mean skill by keys and variable from daily sums."""
    total = F.try_divide(F.sum("_s"), F.sum("_c")).alias(name)
    return sums.groupBy(*per_variable(sums, keys)).agg(total)


def scored_models_per_class(skill_rows: DataFrame, models: DataFrame) -> DataFrame:
    """How many models of each class have any skill row, by variable."""
    return (
        skill_rows.select(*per_variable(skill_rows, ["model_id"]))
        .distinct()
        .join(models.select("model_id", "model_type"), "model_id", "left")
        .groupBy(*per_variable(skill_rows, ["model_type"]))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("model_type") != "null")
    )


def pivot_values(df: DataFrame, keys: Sequence[str], by: str, labels: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Several value columns spread by a label: value_label."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(by) == label, F.col(v))).alias(f"{v}_{label}") for v in values for label in labels]
    )
