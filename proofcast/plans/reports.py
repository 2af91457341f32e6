"""The registered queries: each operator over the derived forecast tables.

Doubles are rounded for comparison with another engine; nothing else is done to
the results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from proofcast.functions import columns as C
from proofcast.functions.frames import bind_rows, complete_rows, join_null_safe
from proofcast.operators import ensemble as E
from proofcast.operators import inventory as I
from proofcast.operators import observations as O
from proofcast.operators import ranks as R
from proofcast.operators import scoring as S
from proofcast.operators import skill as K
from proofcast.operators.orderstats import exact_quantiles, numbered_by_value
from proofcast.operators.reliability import reliability
from proofcast.operators.reshape import day_spine, expand_sites
from proofcast.operators.validation import quantile_report, structure_report, validation_report
from proofcast.plans import bindings as B
from proofcast.session import fixed, fresh_folder
from proofcast.sources import readers, schemas, writers
from proofcast.sources.folders import open_folders
from proofcast.sources.readers import available_forecasts, scan_scores
from proofcast.sources.writers import snapshot
from proofcast.streaming import counted
from proofcast.streaming.incremental import latest_scored

# Parameters of the registered queries.
SEED = E.SEED
ENSEMBLE = "all_submissions"
ENSEMBLE_SIZE = 200
OMITTED = ("model_4",)
RANKED_MODELS = ("climatology", "model_2", "model_3", "model_5", "model_7")
SLICE_DATE = "2023-01-08"
SLICE_MODELS = ("climatology", "model_2", "model_3")
RANKS_PER_SITE = 38
RANKS_OVERALL = 31
BEST = 10
SUBMITTED = ("model_id", "reference_datetime")
BROKEN = ("model_2", "2023-01-01", "2023-01-10")
LATE_FROM = "2023-01-12"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under its name; a trailing underscore avoids an import."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def rounded(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Six decimals on every double but the ones to keep."""
    return df.select(
        *[F.expr(f"round(`{n}`, 6) AS `{n}`") if t == "double" and n not in keep else F.col(n) for n, t in df.dtypes]
    )


def significant(df: DataFrame, **scales: str) -> DataFrame:
    """Log scores have no upper limit (two nearly equal members give 10^8), so
    they keep six decimals relative to the leading digit of their scale."""
    for name, scale in scales.items():
        unit = f"power(10D, floor(log10(greatest({scale}, 1D))))"
        df = df.withColumn(name, F.expr(f"round({name} / {unit}, 6) * {unit}"))
    return df


def short_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(
        {"quantile97.5": "q975", "quantile02.5": "q025", "quantile90": "q90", "quantile10": "q10"}
    )


def skill_rows(spark, sf, logs=False, **options):
    return K.skill(B.scores(spark, sf, logs), **options)


def _skill_output(rows: DataFrame, baseline: str) -> DataFrame:
    names = {f"crps_{baseline}": "crps_base", f"logs_{baseline}": "logs_base"}
    scaled = significant(
        rows.withColumnsRenamed(names),
        skill_logs="abs(logs) + abs(logs_base)",
        logs="abs(logs)",
        logs_base="abs(logs_base)",
    )
    return rounded(scaled, keep=("logs", "logs_base", "skill_logs"))


# --- sources ---------------------------------------------------------------


@query
def scan_variable_sites(spark, sf):
    kept = scan_scores(B.scores(spark, sf), "temperature", ("BARC", "CRAM", "LIRO"), B.models(spark, sf))
    return rounded(kept.select("model_id", "reference_datetime", "site_id", "datetime", "crps"))


@query
def available_models(spark, sf):
    return available_forecasts(B.unnumbered(spark, sf), SLICE_DATE, OMITTED)


@query
def snapshot_anti(spark, sf):
    bad = spark.createDataFrame(
        [(m, "TOOK", "temperature") for m in ("model_2", "model_4", "model_6")],
        "model_id string, site_id string, variable string",
    )
    kept = snapshot(
        B.scores(spark, sf),
        ["2023-01-01", "2023-01-08", "2023-01-15"],
        ("temperature", "oxygen"),
        C.LAKE_SITES,
        B.models(spark, sf),
        bad,
    )
    return rounded(kept.select("model_id", "reference_datetime", "site_id", "datetime", "variable", "crps"))


# --- projections and filters -----------------------------------------------


@query
def horizon_days(spark, sf):
    rows = C.with_horizon(B.unnumbered(spark, sf))
    return rows.groupBy("model_id", "horizon").agg(F.count(F.lit(1)).alias("n"))


@query
def horizon_fractional(spark, sf):
    lines = B.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("datetime")
    )
    orders = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        (F.col("o_orderdate") + F.expr("make_dt_interval(0, cast(o_orderkey % 24 as int), 0, 0)")).alias(
            "reference_datetime"
        ),
    )
    rows = lines.join(orders, "l_orderkey").withColumn("horizon", C.lead_days_fractional())
    return rounded(rows.select("l_orderkey", "l_linenumber", "horizon"))


@query
def eval_window(spark, sf):
    rows = C.eval_window(B.unnumbered(spark, sf))
    return rows.groupBy("horizon", "variable").agg(F.count(F.lit(1)).alias("n"))


@query
def top_model_rows(spark, sf):
    rows = skill_rows(spark, sf)
    kept = K.of_models(rows, K.better_than_baseline(rows), "left_semi")
    return rounded(kept.select("model_id", "reference_datetime", "datetime", "site_id", "variable", "skill_crps"))


@query
def other_model_rows(spark, sf):
    rows = skill_rows(spark, sf)
    kept = K.of_models(rows, K.better_than_baseline(rows), "left_anti")
    return rounded(kept.select("model_id", "reference_datetime", "datetime", "site_id", "variable", "skill_crps"))


@query
def complete_rows_(spark, sf):
    return rounded(complete_rows(B.targets(spark, sf)))


@query
def flag_variables(spark, sf):
    return I.variable_flags(B.models(spark, sf))


@query
def covariate_matrix(spark, sf):
    return I.covariate_matrix(B.models(spark, sf))


@query
def uncertainty_count_hist(spark, sf):
    return I.uncertainty_count_hist(B.models(spark, sf), "temperature")


@query
def baseline_outcome(spark, sf):
    scores = B.scores(spark, sf)
    return rounded(
        K.baseline_outcome(K.skill(scores), K.skill(scores, C.PERSISTENCE), B.models(spark, sf))
    )


@query
def observation_seasonality(spark, sf):
    parts = O.date_parts(O.restrict(B.targets(spark, sf), "temperature"), B.FOCAL_YEAR)
    return rounded(parts.select("site_id", "datetime", "year", "month", "doy", "period", "observation"))


@query
def overlap_fixed_dates(spark, sf):
    issued = F.to_date("reference_datetime")
    rows = skill_rows(spark, sf).filter(
        (issued > F.lit("2023-01-01").cast("date")) & (issued < F.lit("2023-01-29").cast("date"))
    )
    return rounded(K.by_class_and_site(rows, B.models(spark, sf)))


@query
def split_site_depth(spark, sf):
    with_depth = F.when(F.col("horizon") % 2 == 0, F.concat("site_id", F.lit("-0.5"))).otherwise(F.col("site_id"))
    rows = C.with_horizon(B.scores(spark, sf)).withColumn("site_id", with_depth)
    parts = rows.select(
        "model_id",
        "reference_datetime",
        "datetime",
        "variable",
        C.site_part().alias("site_id"),
        C.depth_part().alias("depth"),
    )
    return parts


@query
def forecasts_by_variable(spark, sf):
    return rounded(I.forecasts_by_variable(B.unnumbered(spark, sf)))


@query
def pending_dates(spark, sf):
    done = B.unnumbered(spark, sf).select("reference_datetime")
    last = done.agg(F.max(F.to_date("reference_datetime"))).scalar()
    return E.pending_dates(day_spine("2023-01-01", last, done), done)


# --- joins -----------------------------------------------------------------


@query
def skill_vs_climatology(spark, sf):
    return _skill_output(skill_rows(spark, sf, logs=True), C.CLIMATOLOGY)


@query
def skill_vs_persistence(spark, sf):
    rows = K.skill(B.scores(spark, sf, logs=True), C.PERSISTENCE, orientation="gain", how="left", skip=())
    return _skill_output(rows, C.PERSISTENCE)


@query
def forecast_obs_join(spark, sf):
    rows = S.attach_observations(B.unnumbered(spark, sf), B.observations(spark, sf))
    return rounded(
        rows.groupBy("model_id", "variable").agg(
            F.count(F.lit(1)).alias("n"),
            F.count("observation").alias("n_observed"),
            F.sum("observation").alias("total_observed"),
        )
    )


def _overlap(rows, keys):
    """Daily sums of the skill rows within the period that all sites but one share."""
    sums = fixed(K.daily_sums(rows, keys), "daily")
    return sums, K.within_period(sums, K.common_period(sums.filter(F.col("site_id") != "TOOK")))


@query
def overlap_period_skill(spark, sf):
    _, inside = _overlap(skill_rows(spark, sf, logs=True), ["model_id", "site_id"])
    means = K.mean_of_sums(inside, ["model_id", "site_id"], "mean_skill")
    return rounded(K.by_class_and_site(inside, B.models(spark, sf), means))


@query
def overlap_period_curves(spark, sf):
    sums, inside = _overlap(skill_rows(spark, sf, logs=True), ["model_id", "site_id", "horizon"])
    leaders = K.mean_of_sums(sums, ["model_id"], "mean_crps").filter(F.col("mean_crps") < 0)
    return rounded(K.mean_of_sums(K.of_models(inside, leaders), ["site_id", "horizon"], "mean_crps"))


@query
def leaderboard_with_baselines(spark, sf):
    board = K.leaderboard_with_baselines(skill_rows(spark, sf), B.models(spark, sf))
    return rounded(board).orderBy("variable", "model_type", F.col("mean_crps").asc_nulls_last())


# --- aggregations ----------------------------------------------------------


@query
def mean_skill_by_model(spark, sf):
    means = K.mean_by(skill_rows(spark, sf), ["model_id"])
    flags = B.models(spark, sf).select(
        "model_id",
        "manuscript_name",
        "model_type",
        C.yes_no("uses_NOAA").alias("uses_NOAA"),
        C.mentions("NOAA_var", "air_temperature").alias("uses_AT"),
    )
    return rounded(means.join(flags, "model_id", "left"))


@query
def top_models(spark, sf):
    return rounded(K.better_than_baseline(skill_rows(spark, sf)))


@query
def skill_by_horizon(spark, sf):
    curves = K.mean_skill_split(skill_rows(spark, sf), ["horizon"], leaders=True, exclude=[C.PERSISTENCE])
    return rounded(curves.join(B.models(spark, sf).select("model_id", "manuscript_name"), "model_id", "left"))


@query
def skill_by_horizon_others(spark, sf):
    curves = K.mean_skill_split(skill_rows(spark, sf), ["horizon"], leaders=False)
    return rounded(curves.join(B.models(spark, sf).select("model_id", "manuscript_name"), "model_id", "left"))


@query
def persistence_skill_by_horizon(spark, sf):
    scores = B.scores(spark, sf)
    leaders = K.better_than_baseline(K.skill(scores))
    curves = K.mean_by(K.skill(scores, C.PERSISTENCE), ["model_id", "horizon"])
    return rounded(K.of_models(curves.filter(F.col("model_id") != C.CLIMATOLOGY), leaders))


@query
def skill_by_site_horizon(spark, sf):
    return rounded(K.leader_mean_by(skill_rows(spark, sf), ["site_id", "horizon"]))


@query
def skill_by_class_site(spark, sf):
    return rounded(K.by_class_and_site(skill_rows(spark, sf), B.models(spark, sf)))


@query
def skill_boxplot(spark, sf):
    means = fixed(K.by_class_and_site(skill_rows(spark, sf), B.models(spark, sf)), "means")
    return rounded(K.box_summary(means, ["variable", "model_type", "site_id"], "mean_skill"))


@query
def crps_profile(spark, sf):
    # only what is read again is worked out and stored
    scores = fixed(B.scores(spark, sf).select(*E.SUBMISSION, "datetime", "crps"), "scores")
    best = R.top_n(K.mean_by(K.skill(scores), ["model_id"]), "mean_crps", BEST, "min", within=["variable"])
    scores = scores.filter(F.col("crps").isNotNull())
    classes = B.models(spark, sf).select("model_id", "model_type").join(best.select("variable", "model_id"), "model_id")
    rows = scores.select("variable", "model_id", "site_id", "crps").join(classes, ["variable", "model_id"])
    probs = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return rounded(exact_quantiles(rows, ["variable", "model_type", "site_id"], "crps", probs, count="n"))


@query
def baseline_crps_by_horizon(spark, sf):
    rows = C.eval_window(B.scores(spark, sf).filter(F.col("model_id").isin(list(C.BASELINE_LABELS))))
    means = K.mean_by(rows, ["variable", "model_id", "horizon"], "crps")
    return rounded(means.withColumn("model_id", C.relabel("model_id", C.BASELINE_LABELS)))


@query
def baseline_median_by_site(spark, sf):
    rows = C.eval_window(B.scores(spark, sf).filter(F.col("model_id") == C.CLIMATOLOGY))
    return rounded(exact_quantiles(rows, ["variable", "horizon", "site_id"], "crps", {"median_crps": 0.5}))


def _leaders_only(rows: DataFrame, scores: DataFrame) -> DataFrame:
    leaders = K.better_than_baseline(K.skill(scores)).filter(F.col("model_id") != C.PERSISTENCE)
    return K.of_models(rows, leaders)


@query
def spread_by_horizon(spark, sf):
    scores = B.scores(spark, sf)
    spread = K.mean_by(C.eval_window(scores), ["model_id", "horizon"], "sd", "mean_sd")
    return rounded(_leaders_only(spread, scores))


@query
def bias_by_horizon(spark, sf):
    scores = B.scores(spark, sf)
    bias = K.mean_by(C.eval_window(S.with_abs_bias(scores)), ["model_id", "horizon"], "abs_bias", "mean_abs_bias")
    return rounded(_leaders_only(bias, scores))


def _reliability(spark, sf, level):
    scores = B.scores(spark, sf)
    board = K.leaderboard_with_baselines(K.skill(scores), B.models(spark, sf))
    return rounded(reliability(scores, board, level))


@query
def reliability_80(spark, sf):
    return _reliability(spark, sf, 80)


@query
def reliability_95(spark, sf):
    return _reliability(spark, sf, 95)


@query
def reliability_others(spark, sf):
    scores = B.scores(spark, sf)
    models = B.models(spark, sf)
    board = K.leaderboard_with_baselines(K.skill(scores), models)
    shares = reliability(scores, models.drop("variable"), 80)
    return rounded(K.of_models(shares, board, "left_anti"))


@query
def reliability_by_site(spark, sf):
    return rounded(reliability(B.scores(spark, sf), None, 80, extra_keys=["site_id"], skip=()))


@query
def models_by_class(spark, sf):
    models = B.models(spark, sf)
    return bind_rows(
        I.models_by_class(models, "temperature").withColumn("target", F.lit("temperature")),
        I.models_by_class(models, "oxygen").withColumn("target", F.lit("oxygen")),
        I.count_by(models, "variable").select(
            F.col("variable").alias("model_type"), "n", F.lit("listing").alias("target")
        ),
    )


@query
def flag_totals(spark, sf):
    models = B.models(spark, sf).withColumns(
        {"tw": C.mentions("variable", "temperature"), "do": C.mentions("variable", "oxygen")}
    )
    flags = [
        "tw",
        "do",
        "unc_driver",
        "unc_process",
        "unc_initial",
        "initial_cond",
        "updates_parameters",
        "dynamic",
    ]
    return I.flag_totals(models, flags)


@query
def covariate_count_hist(spark, sf):
    return I.covariate_count_hist(B.models(spark, sf))


@query
def sites_per_model_hist(spark, sf):
    return I.breadth_hist(B.scores(spark, sf), "site_id", "site_n", "n_models")


@query
def variables_per_model_hist(spark, sf):
    return I.breadth_hist(B.scores(spark, sf), "variable", "variable_n", "n_models")


@query
def scored_models_per_class(spark, sf):
    return K.scored_models_per_class(skill_rows(spark, sf), B.models(spark, sf))


@query
def common_period(spark, sf):
    sums = fixed(K.daily_sums(skill_rows(spark, sf, logs=True), ["site_id"]), "daily")
    return bind_rows(
        K.common_period(sums).withColumn("sites", F.lit("all")),
        K.common_period(sums.filter(F.col("site_id") != "TOOK")).withColumn("sites", F.lit("without TOOK")),
    )


@query
def monthly_mean_focal(spark, sf):
    return rounded(O.monthly_mean_focal(complete_rows(B.targets(spark, sf)), B.FOCAL_YEAR))


@query
def seasonal_anomaly(spark, sf):
    return rounded(O.seasonal_anomaly(complete_rows(B.targets(spark, sf)), B.FOCAL_YEAR))


@query
def observation_cv(spark, sf):
    return rounded(O.observation_cv(complete_rows(B.targets(spark, sf)), 2002))


@query
def climatology_by_site(spark, sf):
    rows = B.scores(spark, sf).filter(F.col("model_id") == C.CLIMATOLOGY)
    return rounded(K.mean_by(rows, ["site_id"], "crps", "mean_score")).orderBy("mean_score")


@query
def crps_by_horizon_model_site(spark, sf):
    return rounded(R.mean_score_of_best(B.scores(spark, sf), BEST))


@query
def driver_skill(spark, sf):
    rows = C.with_horizon(B.scores(spark, sf)).filter(F.col("horizon") <= 30)
    return rounded(K.mean_by(rows, ["site_id", "variable", "horizon"], "crps", "crps"))


@query
def median_skill_by_model(spark, sf):
    rows = skill_rows(spark, sf, orientation="gain", skip=())
    rows = fixed(rows.filter(F.col("model_id") != "fARIMA").select("variable", "model_id", "skill_crps"), "skill")
    medians = exact_quantiles(rows, ["variable", "model_id"], "skill_crps", {"median_crps": 0.5})
    return rounded(R.top_n(medians, "median_crps", BEST, "max", within=["variable"]))


@query
def rank_distribution(spark, sf):
    return rounded(R.rank_distribution(B.scores(spark, sf)))


@query
def rank_deciles(spark, sf):
    completed = R.complete_ranks(R.rank_distribution(B.scores(spark, sf)), RANKS_OVERALL, RANKED_MODELS)
    return rounded(R.rank_deciles(completed, RANKS_OVERALL, ["variable", "model_id"]))


def _ranks_by_site(spark, sf, models=None):
    shares = R.rank_distribution(B.scores(spark, sf), ["horizon", "site_id"])
    return R.complete_ranks(shares, RANKS_PER_SITE, models, C.LAKE_SITES, range(1, 31))


@query
def rank_distribution_site(spark, sf):
    return rounded(_ranks_by_site(spark, sf).select("variable", "rank", "site_id", "model_id", "horizon", "proportion"))


@query
def rank_deciles_site(spark, sf):
    completed = _ranks_by_site(spark, sf, RANKED_MODELS)
    keys = ["variable", "site_id", "model_id", "horizon"]
    return rounded(R.rank_deciles(completed, RANKS_PER_SITE, keys))


@query
def latest_scored_(spark, sf):
    return latest_scored(B.scores(spark, sf).filter(F.col("observation").isNotNull()))


@query
def ensemble_quota(spark, sf):
    usable = E.submissions(E.relevant(B.unnumbered(spark, sf)), 30)
    return E.quotas(usable, ENSEMBLE_SIZE)


@query
def observation_coverage(spark, sf):
    seen = O.observation_coverage(complete_rows(B.targets(spark, sf)), B.FOCAL_YEAR)
    return seen.groupBy("site_id", "variable", "datetime").agg(F.count(F.lit(1)).alias("n"))


# --- windows ---------------------------------------------------------------


@query
def forecast_ranks(spark, sf):
    return rounded(R.forecast_ranks(B.scores(spark, sf)))


@query
def top10_models(spark, sf):
    means = K.mean_by(skill_rows(spark, sf, orientation="gain", skip=()), ["model_id"], name="mean_skill")
    return rounded(R.top_n(means, "mean_skill", BEST, "max", within=["variable"]))


@query
def top5_per_site(spark, sf):
    means = K.mean_by(skill_rows(spark, sf, orientation="gain", skip=()), ["model_id", "site_id"])
    return rounded(R.top_n(means, "mean_crps", 5, "max", within=["variable", "site_id"]))


@query
def sites_without_gaps(spark, sf):
    return E.submissions(E.relevant(B.unnumbered(spark, sf)), 30).select(*E.SUBMISSION)


@query
def ensemble_members(spark, sf):
    return rounded(_mme(spark, sf).select("reference_datetime", "site_id", "datetime", "variable", "parameter", "prediction"))


@query
def ensemble_sample(spark, sf):
    rows = E.relevant(B.forecasts(spark, sf), omit=OMITTED)
    members = E.sample_members(rows, ENSEMBLE_SIZE, 30)
    return members.select(*E.SUBMISSION, "parameter", "sample").distinct()


@query
def model_order(spark, sf):
    means = K.mean_by(skill_rows(spark, sf), ["model_id"])
    return rounded(numbered_by_value(means, ["variable"], "mean_crps", "model_id", "model_order", descending=True))


@query
def model_order_within_site(spark, sf):
    means = K.mean_by(skill_rows(spark, sf), ["model_id", "site_id"])
    return rounded(numbered_by_value(means, ["variable", "site_id"], "mean_crps", "model_id", "model_order"))


@query
def site_order(spark, sf):
    curves = K.leader_mean_by(skill_rows(spark, sf), ["site_id", "horizon"])
    last = curves.filter(F.col("horizon") == 30).select("variable", "site_id", "mean_crps")
    return rounded(numbered_by_value(last, ["variable"], "mean_crps", "site_id", "site_order", descending=True))


@query
def covariate_usage(spark, sf):
    return I.covariate_usage(B.models(spark, sf))


# --- reshaping -------------------------------------------------------------


@query
def union_forecasts(spark, sf):
    both = bind_rows(
        B.unnumbered(spark, sf), B.normal_forecasts(spark, sf).withColumn("parameter", F.col("parameter"))
    )
    return rounded(
        both.groupBy("model_id", "family", "parameter").agg(
            F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction")
        )
    )


@query
def pivot_baselines(spark, sf):
    rows = B.scores(spark, sf, logs=True).filter(F.col("model_id").isin(list(C.BASELINE_LABELS)))
    keys = ["reference_datetime", "datetime", "site_id", "variable"]
    wide = K.pivot_values(rows, keys, "model_id", list(C.BASELINE_LABELS), ["crps", "logs"])
    logs = ("logs_climatology", "logs_persistenceRW")
    return rounded(significant(wide, **{n: f"abs({n})" for n in logs}), keep=logs)


@query
def normal_params(spark, sf):
    return rounded(B.normal_parameter_rows(spark, sf))


@query
def gap_expansion(spark, sf):
    rows = C.with_horizon(B.scores(spark, sf)).filter(F.col("horizon") <= 30)
    full = expand_sites(rows, ["reference_datetime", "horizon", "model_id", "variable"], "crps", C.LAKE_SITES)
    issued = F.to_date("reference_datetime")
    kept = full.filter((issued > F.lit("2022-12-31").cast("date")) & (issued < F.lit("2024-01-01").cast("date")))
    sums = kept.groupBy("model_id", "variable", "site_id", "horizon").agg(
        F.avg("crps").alias("mean_crps"), F.count(F.lit(1)).alias("n")
    )
    return rounded(sums)


# --- forecasts and ensembles -----------------------------------------------


@query
def usable_forecasts(spark, sf):
    return rounded(E.load_forecast(B.forecasts(spark, sf)))


@query
def normal_to_ensemble(spark, sf):
    drawn = E.normal_to_ensemble(B.normal_forecasts(spark, sf))
    # every draw is computed; the output describes them per forecast
    return rounded(
        drawn.groupBy(*E.SUBMISSION, "datetime").agg(
            F.count("parameter").alias("n_draws"),
            F.min("prediction").alias("lowest"),
            F.max("prediction").alias("highest"),
            F.avg("prediction").alias("mean_draw"),
        )
    )


def _submitted(spark, sf):
    mixed = B.forecasts(spark, sf).withColumn("parameter", F.col("parameter").cast("string"))
    # every third model submits its forecast as a normal distribution instead
    as_normal = ("model_3", "model_6", "model_9")
    names = [*E.SUBMISSION, "datetime", "family", "parameter", "prediction"]
    rows = mixed.filter(~F.col("model_id").isin(*as_normal)).select(*names)
    normal = B.normal_forecasts(spark, sf).filter(F.col("model_id").isin(*as_normal)).select(*names)
    return rows.unionByName(normal)


def _mme(spark, sf):
    return E.build_mme(_submitted(spark, sf), ENSEMBLE, n=ENSEMBLE_SIZE, omit=OMITTED)


@query
def multi_model_ensemble(spark, sf):
    mme = fixed(_mme(spark, sf), "ensemble")
    observed = S.score(mme, B.observations(spark, sf), families=("sample",))
    return rounded(
        observed.select(*E.SUBMISSION, "datetime", "m", "mean", "median", "crps")
    )


@query
def crps_sample(spark, sf):
    return rounded(B.scores(spark, sf).select(*E.SUBMISSION, "datetime", "m", "crps"))


@query
def crps_normal(spark, sf):
    scored = S.score(B.normal_forecasts(spark, sf), B.observations(spark, sf), families=("normal",))
    return rounded(scored.select(*E.SUBMISSION, "datetime", "crps"))


@query
def logs_normal(spark, sf):
    scored = S.score(B.normal_forecasts(spark, sf), B.observations(spark, sf), families=("normal",))
    return significant(scored.select(*E.SUBMISSION, "datetime", "logs"), logs="abs(logs)")


@query
def logs_sample(spark, sf):
    rows = B.scores(spark, sf, logs=True).select(*E.SUBMISSION, "datetime", "m", "logs")
    return significant(rows, logs="abs(logs)")


@query
def forecast_summary(spark, sf):
    wide = S.score(B.unnumbered(spark, sf), B.observations(spark, sf), interval=0.9, logs=False, families=("sample",))
    return rounded(
        short_names(wide).select(
            *E.SUBMISSION, "datetime", "mean", "median", "sd", "q025", "q975", "q10", "q90"
        )
    )


@query
def score_forecasts(spark, sf):
    both = bind_rows(
        B.unnumbered(spark, sf).withColumn("parameter", F.lit(None).cast("string")),
        B.normal_forecasts(spark, sf).withColumn("model_id", F.concat("model_id", F.lit("_normal"))),
    )
    scored = significant(S.rescored_layout(S.score(both, B.observations(spark, sf))), logs="abs(logs)")
    return rounded(
        short_names(scored).select(
            *E.SUBMISSION,
            "datetime",
            "family",
            "observation",
            "crps",
            "logs",
            "mean",
            "sd",
            "q025",
            "q10",
            "q90",
            "q975",
            "horizon",
            "depth",
            "date",
        ),
        keep=("logs",),
    )


@query
def validation_report_(spark, sf):
    return validation_report(B.forecasts(spark, sf))


@query
def forecast_slice(spark, sf):
    return rounded(S.forecast_slice(B.scores(spark, sf), SLICE_DATE, SLICE_MODELS))


@query
def rescore_candidates(spark, sf):
    late = B.observations(spark, sf).withColumn("datetime", F.date_add("datetime", 7))
    return S.rescore_candidates(B.scores(spark, sf), late).select(*E.SUBMISSION, "datetime")


@query
def structure_report_(spark, sf):
    return structure_report(B.forecasts(spark, sf))


@query
def quantile_report_(spark, sf):
    return quantile_report(B.scores(spark, sf))


# --- stored tables ---------------------------------------------------------
#
# What these return was written below the shared folder and read back.


@query
def stored_scores(spark, sf):
    path = fresh_folder(spark, "scores")
    writers.write_scores(B.scores(spark, sf).drop("m"), path, by=("model_id",))
    back = readers.read_scores(spark, path).withColumn("datetime", F.to_date("datetime"))
    return rounded(back.select(*E.SUBMISSION, "datetime", "observation", "crps"))


@query
def stored_targets(spark, sf):
    path = fresh_folder(spark, "targets")
    rows = B.targets(spark, sf).withColumn("datetime", F.col("datetime").cast("timestamp"))
    rows.write.option("header", "true").option("nullValue", "NA").option("compression", "gzip").csv(path)
    return rounded(readers.read_targets(spark, path).withColumn("datetime", F.to_date("datetime")))


@query
def stored_models(spark, sf):
    path = fresh_folder(spark, "models")
    B.models(spark, sf).write.option("header", "true").option("nullValue", "character").csv(path)
    back = readers.read_models(spark, path)
    return back.select("model_id", "manuscript_name", "model_type", "variable", "NOAA_var", "uses_NOAA", "unc_driver", "unc_process", "dynamic")


@query
def stored_csv(spark, sf):
    path = fresh_folder(spark, "csv")
    writers.write_forecast_csv(B.unnumbered(spark, sf), path, "lakes")
    back = spark.read.option("header", "true").csv(path)
    return rounded(
        back.groupBy("forecast", "site_id", "variable").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("prediction").cast("double")).alias("total")
        )
    )


def _stored_forecasts(spark, sf):
    path = fresh_folder(spark, "forecasts")
    rows = B.forecasts(spark, sf).withColumns(
        {"datetime": F.col("datetime").cast("timestamp"), "parameter": F.col("parameter").cast("string")}
    )
    writers.write_forecasts(rows, path)
    return path


@query
def stored_partitions(spark, sf):
    return readers.partition_inventory(spark, _stored_forecasts(spark, sf)).select("model_id", "reference_datetime", F.col("date").cast("date").alias("date"))


@query
def sound_forecasts(spark, sf):
    """One folder gets a file that is no parquet; its forecasts are left out."""
    path = _stored_forecasts(spark, sf)
    broken = "/".join(f"{k}={v}" for k, v in zip(readers.FORECAST_FOLDERS, BROKEN, strict=True))
    spark.range(1).select(F.lit("nothing").alias("value")).write.mode("append").text(f"{path}/{broken}")
    rows, _ = readers.read_sound_forecasts(spark, path)
    return rounded(
        rows.groupBy("model_id", "reference_datetime", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("total"))
    )


@query
def renamed_columns(spark, sf):
    names = {"reference_datetime": "start_time", "datetime": "time", "prediction": "predicted"}
    rows = B.unnumbered(spark, sf).withColumnsRenamed(names)
    scored = S.score(rows, B.observations(spark, sf), logs=False, families=("sample",))
    return rounded(scored.select(*E.SUBMISSION, "datetime", "m", "crps"))


@query
def first_skill_rows(spark, sf):
    rows = readers.preview(K.canonical_order(skill_rows(spark, sf)))
    return rounded(rows.select(*E.SUBMISSION, "datetime", "horizon", "skill_crps"))


# --- incremental runs ------------------------------------------------------


@query
def incremental_ensemble(spark, sf):
    """Two runs, the second with more issue dates, and a third that finds nothing to do."""
    path, rows = fresh_folder(spark, "ensembles"), _submitted(spark, sf)
    for known in (rows.filter(F.col("reference_datetime") <= SLICE_DATE), rows, rows):
        E.store_pending(known, ENSEMBLE, path, n=ENSEMBLE_SIZE, omit=OMITTED)
    stored = E.stored_ensembles(spark, path)
    return rounded(
        stored.select(
            "reference_datetime", "site_id", F.to_date("datetime").alias("datetime"), "variable", F.col("parameter").cast("int").alias("parameter"), "prediction"
        )
    )


def _back(spark, path):
    """A stored score table with the numbers of members."""
    rows = open_folders(spark, path, [path], StructType([*schemas.SCORES, StructField("m", LongType())]))
    return rows.withColumn("datetime", F.to_date("datetime"))


def _as_stored(rows):
    return rows.withColumn("datetime", F.col("datetime").cast("timestamp"))


@query
def incremental_scores(spark, sf):
    """Members of the same forecasts arrive in two batches, the second is delivered twice."""
    folder, targets = fresh_folder(spark, "counted"), _as_stored(B.observations(spark, sf))
    rows = _as_stored(B.unnumbered(spark, sf))
    low = F.coalesce(F.col("prediction") < 4.0, F.lit(True))
    for batch, part in (("low", rows.filter(low)), ("high", rows.filter(~low)), ("high", rows.filter(~low))):
        counted.score_batch(part, targets, f"{folder}/store", f"{folder}/scores", batch, SUBMITTED, logs=False)
    return rounded(_back(spark, f"{folder}/scores").select(*E.SUBMISSION, "datetime", "m", "crps"))


@query
def late_scores(spark, sf):
    """Scores with the observations of a first week, and again when the others have arrived."""
    folder, targets = fresh_folder(spark, "late"), _as_stored(B.observations(spark, sf))
    early = F.col("datetime") < F.lit(LATE_FROM).cast("timestamp")
    store, scores = f"{folder}/store", f"{folder}/scores"
    counted.score_batch(_as_stored(B.unnumbered(spark, sf)), targets.filter(early), store, scores, "all", SUBMITTED, logs=False)
    counted.score_late(spark, store, targets.filter(~early), targets, scores, SUBMITTED, logs=False)
    return rounded(_back(spark, scores).select(*E.SUBMISSION, "datetime", "observation", "crps"))
