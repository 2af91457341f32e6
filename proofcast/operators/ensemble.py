"""Multi-model ensembles, for every issue date in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofcast.functions import columns as C
from proofcast.functions.families import FAMILIES, PARAMETERS, by_family
from proofcast.functions.frames import join_null_safe, present
from proofcast.operators.scoring import named_parameters, normalise_family
from proofcast.operators.validation import validation_report
from proofcast.sources import schemas
from proofcast.sources.published import commit, read_published, state

SITE = ("reference_datetime", "variable", "site_id")
SUBMISSION = (*SITE, "model_id")
DRAWS = 100
SEED = 20230101


def relevant(
    forecasts: DataFrame,
    variable: str | None = None,
    issue_dates: Sequence[str] | DataFrame | None = None,
    omit: Sequence[str] = (),
    name: str | None = None,
) -> DataFrame:
    """Rows after their issue date, of the wanted variable and dates.

    Issue dates are compared as dates; a frame of them (reference_datetime) is
    semi-joined, so nothing is collected.
    """
    rows = normalise_family(forecasts).filter(F.to_date("datetime") > F.to_date("reference_datetime"))
    if variable is not None:
        rows = rows.filter(F.col("variable") == variable)
    if issue_dates is not None:
        issued = F.to_date("reference_datetime")
        if isinstance(issue_dates, DataFrame):
            wanted = issue_dates.select(issued.alias("_issued")).distinct()
            rows = rows.join(wanted, issued == F.col("_issued"), "left_semi")
        else:
            rows = rows.filter(issued.isin([F.lit(str(d)[:10]).cast("date") for d in issue_dates]))
    left_out = [*omit, *([name] if name else [])]
    return rows.filter(C.not_one_of("model_id", left_out)) if left_out else rows


def _unknown_parameter():
    """Whether a row of a registered family holds a parameter that the family doesn't have."""
    out = F.lit(False)
    for name, kind in FAMILIES.items():
        out = out | ((F.col("family") == name) & ~F.col("parameter").cast("string").isin(list(kind.parameters)))
    return F.coalesce(out, F.lit(False))


def submissions(rows: DataFrame, h: int) -> DataFrame:
    """Usable submissions: a model, issue date, variable and site without gaps.

    A site with any missing prediction is dropped as a whole, whatever its lead
    time; what is left must reach into the horizon. Families that give no members
    do not count.
    """
    # rows without names of parameters are all members
    stray = _unknown_parameter() if "parameter" in rows.columns else F.lit(False)
    return (
        rows.filter(F.col("family").isin("sample", "normal", *FAMILIES))
        .groupBy(*SUBMISSION)
        .agg(
            F.max(F.col("prediction").isNull() | stray).alias("_gap"),
            F.max(C.lead_days() <= h).alias("_in_reach"),
            F.max(F.col("family") != "sample").alias("_drawn"),
        )
        .filter(~F.col("_gap") & F.col("_in_reach"))
        .select(*SUBMISSION, "_drawn")
    )


def load_forecast(
    forecasts: DataFrame,
    variable: str | None = None,
    issue_dates: Sequence[str] | DataFrame | None = None,
    h: int = 30,
) -> DataFrame:
    """Usable forecast rows up to lead time h, without helper columns."""
    rows = relevant(forecasts, variable, issue_dates)
    gaps = rows.filter(F.col("prediction").isNull()).select(*SUBMISSION).distinct()
    return (
        join_null_safe(rows, gaps, SUBMISSION, "left_anti")
        .filter(C.lead_days() <= h)
        .drop(*present(rows, ("horizon", "pubDate", "date")))
    )


def _drawn(rows: DataFrame) -> DataFrame:
    """Parameters of forecasts that are given by parameters, a column for each name."""
    given = rows.filter(F.col("family").isin("normal", *FAMILIES))
    return named_parameters(given, [*SUBMISSION, "datetime", "family"], ("mu", "sigma", *PARAMETERS))


def _drawn_key(seed: int):
    """What all draws of a forecast have in common in their digests' text."""
    return F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in (*SUBMISSION, "datetime")])


def _with_values(rows: DataFrame) -> DataFrame:
    """The value of draw `parameter` of a forecast's family, from the text of its key.

    The digest is a column of its own, so that it is worked out once however often
    the families' expressions use it.
    """
    digest = F.col("_digest")
    normal = F.col("mu") + F.col("sigma") * C.standard_normal(digest)
    value = F.when(F.col("family") == "normal", normal).otherwise(by_family(lambda f, a, b: f.draw(a, b, digest)))
    return rows.withColumn("_digest", F.md5(F.concat_ws("|", "_key", "parameter"))).withColumn("prediction", value)


def normal_to_ensemble(forecasts: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """Forecasts given by parameters as ensembles of reproducible draws; others unchanged.

    Normal forecasts and those of a registered family are drawn from; ensembles
    and families that nothing is known of keep their rows.
    """
    rows = normalise_family(forecasts)
    names = [*SUBMISSION, "datetime", "family", "parameter", "prediction"]
    named = _drawn(rows).withColumn("_key", _drawn_key(seed))
    each = named.withColumn("parameter", F.explode(F.sequence(F.lit(1), F.lit(draws)).cast("array<string>")))
    drawn = _with_values(each).withColumn("family", F.lit("ensemble"))
    kept = rows.filter(C.not_one_of("family", ("normal", *FAMILIES))).withColumn("parameter", F.col("parameter").cast("string"))
    return kept.select(*names).unionByName(drawn.select(*names))


def quotas(usable: DataFrame, n: int) -> DataFrame:
    """Members to take from each model so a site's ensemble has about n."""
    counted = usable.groupBy(*SITE).agg(F.count(F.lit(1)).alias("n_models"))
    return counted.withColumn("sample", F.bround(F.lit(float(n)) / F.col("n_models"), 0).cast("int"))


def _digest(seed: int):
    return C.draw_key(seed, *[F.col(k) for k in SUBMISSION], F.col("parameter"))


def _sampled_members(rows: DataFrame, quota: DataFrame, n: int, seed: int) -> DataFrame:
    """Members of ensemble submissions, with all their valid dates.

    No quota exceeds n, so the dense rank is cut at n on the map side: whatever
    its size, a submission leaves each task with the rows of n members at most.
    """
    by_digest = Window.partitionBy(*SUBMISSION).orderBy("_digest", "parameter")
    shuffled = (
        rows.filter(F.col("family") == "sample")
        .select(*SUBMISSION, "datetime", F.col("parameter").cast("string").alias("parameter"), "prediction")
        .withColumn("_digest", _digest(seed))
        .withColumn("_place", F.dense_rank().over(by_digest))
        .filter(F.col("_place") <= n)
    )
    return join_null_safe(shuffled, quota, SUBMISSION).filter(F.col("_place") <= F.col("sample"))


def _sampled_draws(rows: DataFrame, quota: DataFrame, draws: int, seed: int) -> DataFrame:
    """Draws from submissions given by parameters: the names first, then their values per date."""
    by_digest = Window.partitionBy(*SUBMISSION).orderBy("_digest", "parameter")
    names = (
        quota.filter("_drawn")
        .withColumn("parameter", F.explode(F.sequence(F.lit(1), F.lit(draws))))
        .withColumn("parameter", F.col("parameter").cast("string"))
        .withColumn("_digest", _digest(seed))
        .withColumn("_place", F.row_number().over(by_digest))
        .filter(F.col("_place") <= F.col("sample"))
    )
    given = _drawn(rows).withColumn("_key", _drawn_key(seed))
    return _with_values(join_null_safe(given, names.drop("_digest"), SUBMISSION))


def sample_members(
    rows: DataFrame, n: int, h: int, draws: int = DRAWS, seed: int = SEED
) -> DataFrame:
    """Take each model's quota of members without replacement, all dates of each.

    Members are ordered by a digest of their name, a reproducible shuffle. A
    submission is either an ensemble or given by parameters.
    """
    usable = submissions(rows, h)
    quota = join_null_safe(usable, quotas(usable, n), SITE)
    within = rows.filter(C.lead_days() <= h)
    names = [*SUBMISSION, "datetime", "parameter", "prediction", "sample"]
    return (
        _sampled_members(within, quota, n, seed)
        .select(*names)
        .unionByName(_sampled_draws(within, quota, draws, seed).select(*names))
    )


def build_mme(
    forecasts: DataFrame,
    name: str,
    variable: str | None = None,
    issue_dates: Sequence[str] | DataFrame | None = None,
    h: int = 30,
    n: int = 200,
    omit: Sequence[str] = (),
    draws: int = DRAWS,
    seed: int = SEED,
) -> DataFrame:
    """One ensemble per issue date, variable and site from all usable models.

    Every model contributes the same number of members, drawn without
    replacement, with all their valid dates; members are renumbered per date.
    An ensemble already stored under the same name is not an input.
    """
    rows = relevant(forecasts, variable, issue_dates, omit, name)
    members = sample_members(rows, n, h, draws, seed)
    per_date = Window.partitionBy(*SITE, "datetime").orderBy("model_id", "parameter")
    return members.select(
        F.lit(name).alias("model_id"),
        "reference_datetime",
        "datetime",
        "site_id",
        "variable",
        F.lit("ensemble").alias("family"),
        F.row_number().over(per_date).alias("parameter"),
        "prediction",
    )


def pending_dates(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Issue dates that have no ensemble yet."""
    finished = done.select(F.to_date("reference_datetime").alias("reference_datetime")).distinct()
    return candidates.join(finished, "reference_datetime", "left_anti")


def _issued(forecasts: DataFrame) -> DataFrame:
    return forecasts.select(F.to_date("reference_datetime").alias("reference_datetime")).distinct()


def build_pending(forecasts: DataFrame, stored: DataFrame, name: str, **options) -> DataFrame:
    """Ensembles for the issue dates that have forecasts but no stored ensemble.

    `stored` is a frame with the issue dates (reference_datetime) done so far;
    `options` are those of `build_mme`. With nothing pending there are no rows.
    """
    return build_mme(forecasts, name, issue_dates=pending_dates(_issued(forecasts), stored), **options)


def stored_ensembles(spark: SparkSession, path: str) -> DataFrame:
    """The ensembles published below a folder, in the forecast schema."""
    return read_published(spark, path, schemas.FORECASTS)


def store_pending(forecasts: DataFrame, name: str, path: str, **options) -> bool:
    """Build the ensembles of issue dates that are not published yet, and publish them.

    They are computed once, stored by model, issue date and valid date, and the
    stored rows are checked; if a rule of the validation report is broken nothing
    is published. A run that fails on the way shows nothing, the next one starts
    from what is published. `options` are those of `build_mme`. False if nothing
    was pending.
    """
    spark = forecasts.sparkSession
    seen = state(spark, path)[0]
    done = stored_ensembles(spark, path).filter(F.col("model_id") == name).select("reference_datetime")
    if seen and pending_dates(_issued(forecasts), done).isEmpty():
        return False
    built = build_pending(forecasts, done, name, **options).withColumn("date", F.to_date("datetime"))

    def check(rows: DataFrame) -> None:
        broken = [r["rule"] for r in validation_report(rows).filter(~F.col("passed")).collect()]
        if broken:
            raise ValueError(f"ensemble not published, rules broken: {', '.join(broken)}")

    keys = ("model_id", "reference_datetime", "date")
    return commit(built, path, keys, schemas.FORECASTS, f"{name} {seen + 1}", seen, check)
