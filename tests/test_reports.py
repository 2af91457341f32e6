import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofcast.operators import inventory as I
from proofcast.operators import observations as O
from proofcast.operators import ranks as R
from proofcast.operators import skill as K
from proofcast.operators.reliability import reliability
from proofcast.operators.reshape import expand_sites

SCORES = (
    "model_id string, reference_datetime string, site_id string, datetime timestamp, variable string, "
    "crps double, logs double"
)
REF = "2023-01-01"


def day(h):
    return dt.datetime(2023, 1, 1) + dt.timedelta(days=h)


def row(model, crps, h=1, site="BARC", logs=None, ref=REF, variable="temperature"):
    return (model, ref, site, day(h) if h is not None else None, variable, crps, logs)


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(
        [
            row("climatology", 2.0, logs=1.0),
            row("m1", 1.5, logs=3.0),
            row("m2", None),
            row("m1", 1.0, h=2),  # no baseline
            row("climatology", 4.0, h=3),  # no model
            row("climatology", 1.0, h=15),
            row("m3", 9.0, h=15),  # lead time 15 is skipped
            row("m1", 1.0, h=31),
            row("m1", 8.0, variable="oxygen"),
            row(None, 7.0),
            row("climatology", 3.0, h=4, site=None),
            row("m1", 5.0, h=4, site=None),
        ],
        SCORES,
    )


def test_full_skill_keeps_unmatched_rows(scores):
    got = {
        (r.variable, r.horizon, r.site_id, r.model_id): (r.crps, r.crps_climatology, r.skill_crps, r.skill_logs)
        for r in K.skill(scores).collect()
    }
    assert got == {
        ("temperature", 1, "BARC", "m1"): (1.5, 2.0, -0.5, 2.0),
        ("temperature", 1, "BARC", "m2"): (None, 2.0, None, None),
        ("temperature", 2, "BARC", "m1"): (1.0, None, None, None),
        ("temperature", 3, "BARC", None): (None, 4.0, None, None),
        ("oxygen", 1, "BARC", "m1"): (8.0, None, None, None),
        ("temperature", 4, None, "m1"): (5.0, 3.0, 2.0, None),  # null keys match
    }


def test_left_skill_gain_and_open_window(scores):
    rows = K.skill(scores, orientation="gain", how="left", skip=()).collect()
    assert all(r.model_id is not None for r in rows)
    assert {r.model_id for r in rows} == {"m1", "m2", "m3"}
    assert [r.skill_crps for r in rows if r.horizon == 1 and r.model_id == "m1" and r.variable == "temperature"] == [0.5]
    with pytest.raises(ValueError):
        K.skill(scores, how="right")


def test_baseline_against_itself_has_no_rows_and_separate_baseline_is_used(spark, scores):
    assert K.skill(scores.filter("model_id = 'climatology'")).filter("model_id is not null").count() == 0
    other = spark.createDataFrame([row("climatology", 10.0)], SCORES)
    r = K.skill(scores, baseline=other).filter("model_id = 'm1' and horizon = 1 and variable = 'temperature'").first()
    assert r.skill_crps == -8.5


def test_leaders_and_split_means(spark):
    rows = []
    for h in (1, 2):
        rows += [row("climatology", 2.0, h), row("good", 1.0 + h / 10, h), row("bad", 3.0, h), row("even", 2.0, h)]
    rows.append(row("climatology", 2.0, 3))
    sk = K.skill(spark.createDataFrame(rows, SCORES))
    assert [r.model_id for r in K.better_than_baseline(sk).collect()] == ["good"]
    lead = {r.horizon: r.mean_crps for r in K.mean_skill_split(sk, ["horizon"], leaders=True).collect()}
    assert lead == {1: pytest.approx(-0.9), 2: pytest.approx(-0.8)}
    others = {(r.model_id, r.horizon) for r in K.mean_skill_split(sk, ["horizon"], leaders=False).collect()}
    assert others == {("bad", 1), ("bad", 2), ("even", 1), ("even", 2), (None, 3)}
    by_site = K.leader_mean_by(sk, ["site_id"]).first()
    assert by_site.mean_crps == pytest.approx(-0.85)


def test_outcome_classes(spark):
    models = spark.createDataFrame([("m", "M"), ("z", "Z")], "model_id string, manuscript_name string")
    doy = spark.createDataFrame([("m", 1, -3.0), ("m", 2, 1.0), ("m", 3, -1.0), ("m", 4, -1.0), ("m", 5, -1.0)], "model_id string, horizon int, skill_crps double")
    rw = spark.createDataFrame([("m", 1, -1.0), ("m", 2, -1.0), ("m", 3, 1.0), ("m", 4, 0.0)], "model_id string, horizon int, skill_crps double")
    got = {r.horizon: (r.beats, r.beats_order) for r in K.baseline_outcome(doy, rw, models).collect()}
    assert got == {1: ("Both", 4), 2: ("Persistence", 2), 3: ("Day-of-year", 3), 4: ("Neither", 1)}


def test_leaderboard_always_has_both_baselines(spark):
    models = spark.createDataFrame(
        [("climatology", "DOY", "null"), ("persistenceRW", "RW", "null"), ("good", "Good", "ML")],
        "model_id string, manuscript_name string, model_type string",
    )
    sk = K.skill(spark.createDataFrame([row("climatology", 2.0), row("good", 1.0)], SCORES))
    board = {r.model_id: r.mean_crps for r in K.leaderboard_with_baselines(sk, models).collect()}
    assert board == {"good": -1.0, "climatology": None, "persistenceRW": None}


def test_box_summary_finds_outliers(spark):
    values = [float(v) for v in range(1, 12)] + [100.0]
    df = spark.createDataFrame([("c", v) for v in values] + [("c", None)], "k string, v double")
    r = K.box_summary(df, ["k"], "v").first()
    assert (r.lower, r.middle, r.upper) == tuple(np.quantile(values, [0.25, 0.5, 0.75]))
    assert (r.whisker_low, r.whisker_high, r.outliers, r.n) == (1.0, 11.0, 1, 12)


def test_common_period_uses_complete_rows(spark):
    rows = [("A", day(1), 1.0), ("A", day(9), 1.0), ("B", day(3), 1.0), ("B", day(7), 1.0), ("B", day(12), None)]
    df = spark.createDataFrame(rows, "site_id string, datetime timestamp, skill_crps double")
    sums = K.daily_sums(df, ["site_id"])
    period = K.common_period(sums)
    assert tuple(period.first()) == (day(3), day(7))
    assert K.within_period(sums, period).count() == 2
    later = df.withColumn("datetime", F.expr("datetime + interval 30 days"))
    both = df.withColumn("variable", F.lit("temperature")).unionByName(later.withColumn("variable", F.lit("oxygen")))
    sums = K.daily_sums(both, ["site_id"])
    found = {r.variable: (r.first_date, r.last_date) for r in K.common_period(sums).collect()}
    assert found == {"temperature": (day(3), day(7)), "oxygen": (day(33), day(37))}
    assert K.within_period(sums, K.common_period(sums)).count() == 4
    assert {r.variable: r.m for r in K.mean_of_sums(sums, [], "m").collect()} == {"temperature": 1.0, "oxygen": 1.0}


def test_variables_have_leaders_of_their_own(spark):
    rows = [row("climatology", 2.0), row("warm", 1.0), row("airy", 3.0)]
    rows += [row("climatology", 2.0, variable="oxygen"), row("warm", 3.0, variable="oxygen"), row("airy", 1.0, variable="oxygen")]
    sk = K.skill(spark.createDataFrame(rows, SCORES))
    assert {(r.variable, r.model_id) for r in K.better_than_baseline(sk).collect()} == {("temperature", "warm"), ("oxygen", "airy")}
    assert {(r.variable, r.mean_crps) for r in K.leader_mean_by(sk, ["horizon"]).collect()} == {("temperature", -1.0), ("oxygen", -1.0)}
    assert {(r.variable, r.model_id) for r in K.of_models(sk, K.better_than_baseline(sk), "left_anti").collect()} == {("temperature", "airy"), ("oxygen", "warm")}
    models = spark.createDataFrame([(m, m, "ML") for m in ("climatology", "persistenceRW", "warm", "airy")], "model_id string, manuscript_name string, model_type string")
    board = {(r.variable, r.model_id) for r in K.leaderboard_with_baselines(sk, models).collect()}
    assert board == {(v, m) for v, lead in (("temperature", "warm"), ("oxygen", "airy")) for m in (lead, "climatology", "persistenceRW")}


def test_top_n_keeps_ties_and_drops_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 3.0), ("e", None)], "m string, v double")
    assert {r.m for r in R.top_n(df, "v", 2, "max").collect()} == {"b", "c", "d"}
    assert {r.m for r in R.top_n(df, "v", 1, "min").collect()} == {"a"}
    grouped = df.withColumn("g", F.when(F.col("m") < "c", 1).otherwise(2))
    assert {r.m for r in R.top_n(grouped, "v", 1, "max", within=["g"]).collect()} == {"b", "d"}


def test_ranks_have_no_gaps_and_shares_sum_to_one(spark):
    rng = np.random.default_rng(2)
    rows = [
        row(f"m{m}", float(rng.integers(0, 3)) if rng.random() > 0.2 else None, h, ref=ref)
        for m in range(5)
        for h in range(0, 32)
        for ref in ("2023-01-01",)
    ]
    scores = spark.createDataFrame(rows, SCORES)
    ranks = R.forecast_ranks(scores).toPandas()
    for _, part in ranks.groupby(["reference_datetime", "horizon", "site_id"]):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, len(part) + 1))
        assert list(part.sort_values(["crps", "model_id"]).model_id) == list(part.model_id)
    assert set(ranks.horizon) <= set(range(1, 31))
    dist = R.rank_distribution(scores)
    assert all(s == pytest.approx(1.0) for s in dist.toPandas().groupby("model_id").proportion.sum())
    grid = R.complete_ranks(dist, 31, ["m0", "m1"])
    assert grid.count() == 62
    deciles = R.rank_deciles(grid, 31, ["model_id"]).toPandas()
    assert len(deciles) == 20 and deciles.proportion.sum() == pytest.approx(2.0)


def test_variables_are_ranked_apart(spark):
    rows = [row(m, c, 1) for m, c in (("a", 1.0), ("b", 2.0))]
    scores = spark.createDataFrame(rows, SCORES)
    both = scores.unionByName(scores.withColumn("variable", F.lit("oxygen")).withColumn("crps", F.col("crps") + 0.5))
    got = {(r.variable, r.model_id): r["rank"] for r in R.forecast_ranks(both).collect()}
    assert got == {(v, m): n for v in ("temperature", "oxygen") for m, n in (("a", 1), ("b", 2))}
    assert R.complete_ranks(R.rank_distribution(both), 5).count() == 20


def test_reliability_counts_inclusive_and_skips_unknown_bounds(spark):
    rows = [
        ("m", day(1), 5.0, 5.0, 6.0),
        ("m", day(1), 7.0, 5.0, 6.0),
        ("m", day(1), None, 5.0, 6.0),
        ("m", day(1), 5.0, None, None),
        ("n", day(1), 5.0, None, 9.0),
        ("m", day(15), 5.0, 5.0, 6.0),
        ("x", day(1), 5.0, 5.0, 6.0),
    ]
    df = spark.createDataFrame(rows, "model_id string, datetime timestamp, observation double, quantile10 double, quantile90 double")
    df = df.withColumn("reference_datetime", F.lit(REF))
    models = spark.createDataFrame([("m", "M"), ("n", "N")], "model_id string, manuscript_name string")
    got = {(r.model_id, r.horizon): (r.within_TRUE, r.within_FALSE, r.perc) for r in reliability(df, models, 80).collect()}
    assert got == {("m", 1): (1, 1, 50.0), ("n", 1): (0, 0, None)}
    with pytest.raises(ValueError):
        reliability(df, models, 90)


def test_seasonal_reports_mask_small_samples(spark):
    rows = [(dt.datetime(y, 1, d), "BARC", "temperature", float(d + y - 2000)) for y in (2022, 2023) for d in range(1, 19)]
    rows += [(dt.datetime(2023, 2, d), "BARC", "temperature", 1.0) for d in range(1, 18)]
    rows += [(dt.datetime(2023, 1, 1), "ELSE", "temperature", 1.0)]
    targets = spark.createDataFrame(rows, "datetime timestamp, site_id string, variable string, observation double")
    got = {r.month: (r.focal, r.historic, r.delta) for r in O.seasonal_anomaly(targets, 2023).collect()}
    assert got == {dt.date(2023, 1, 1): (32.5, 31.5, 1.0), dt.date(2023, 2, 1): (None, None, None)}
    monthly = {r.month: (r.mean_obs, r.n) for r in O.monthly_mean_focal(targets, 2023).collect()}
    assert monthly == {1: (32.5, 18), 2: (None, 17)}
    cv = O.observation_cv(targets, 2023).first()
    assert cv.cv == pytest.approx(np.std(range(1, 19), ddof=1) / 31.5)
    assert O.observation_coverage(targets, 2023).count() == 18


def test_inventory(spark):
    models = spark.createDataFrame(
        [
            ("a", "temperature", "ML", "air_temperature, eastward_wind", 1, 1, 0),
            ("b", "temperature, oxygen", "ML", None, 0, None, 1),
            ("c", "oxygen", "null", "air_temperature", 1, 1, 1),
        ],
        "model_id string, variable string, model_type string, NOAA_var string, uses_NOAA int, unc_driver int, unc_process int",
    )
    assert {r.model_type: r.n for r in I.models_by_class(models, "oxygen").collect()} == {"ML": 1, "null": 1}
    assert tuple(I.flag_totals(models, ["unc_driver", "unc_process"]).first()) == (2, 2)
    assert tuple(I.flag_totals(models.filter("model_id = 'b'"), ["unc_driver"]).first()) == (0,)
    assert {r.unc_n: r.n for r in I.uncertainty_count_hist(models, "temperature").collect()} == {1: 1, None: 1}
    usage = I.covariate_usage(models).collect()
    assert usage[0].NOAA_vars == "air_temperature" and usage[0].n_models == 2 and len(usage) == 8
    assert {r.vars_n: r.n_models for r in I.covariate_count_hist(models).collect()} == {2: 1, None: 1, 1: 1}
    scores = spark.createDataFrame([row("a", 1.0), row("a", 1.0, h=2), row("a", 1.0, site="SUGG"), row("b", 1.0, variable="oxygen")], SCORES)
    assert {r.variable: (r.n, r.percent) for r in I.forecasts_by_variable(scores).collect()} == {
        "temperature": (2, pytest.approx(200 / 3)),
        "oxygen": (1, pytest.approx(100 / 3)),
    }
    assert {r.site_n: r.n for r in I.breadth_hist(scores, "site_id", "site_n", "n").collect()} == {1: 1, 2: 1}


def test_sites_are_expanded_to_show_gaps(spark):
    df = spark.createDataFrame([("a", "BARC", 1.0)], "model_id string, site_id string, crps double")
    got = {(r.model_id, r.site_id, r.crps) for r in expand_sites(df, ["model_id"], "crps", ["BARC", "SUGG"]).collect()}
    assert got == {("a", "BARC", 1.0), ("a", "SUGG", None)}
