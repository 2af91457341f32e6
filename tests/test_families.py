"""Closed forms of registered families against numerical integrals, and what becomes of unknown ones."""

import math

import pytest

from proofcast.functions.families import FAMILIES
from proofcast.operators import ensemble as E
from proofcast.operators import scoring as S

np = pytest.importorskip("numpy")

FORECAST = (
    "model_id string, reference_datetime string, site_id string, datetime string, variable string, "
    "family string, parameter string, prediction double"
)
TARGET = "datetime string, site_id string, variable string, observation double"
GIVEN = {
    "lognormal": [(0.4, 0.6), (1.0, 1.1)],
    "logistic": [(2.0, 0.7), (-1.0, 3.0)],
    "uniform": [(0.5, 3.0), (-4.0, 2.0)],
}
OBSERVED = [-6.0, 0.0, 0.3, 1.7, 2.5, 9.0]


def cdf(family, a, b, x):
    if family == "lognormal":
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.where(x > 0, (np.log(np.where(x > 0, x, 1.0)) - a) / b, -np.inf)
        return 0.5 * (1.0 + np.vectorize(math.erf)(z / math.sqrt(2.0)))
    if family == "logistic":
        return 1.0 / (1.0 + np.exp(-np.clip((x - a) / b, -700, 700)))
    return np.clip((x - a) / (b - a), 0.0, 1.0)


def forecast(model, family, names, values, day="2023-01-02"):
    return [(model, "2023-01-01", "BARC", day, "temperature", family, n, v) for n, v in zip(names, values, strict=True)]


@pytest.mark.parametrize("family", sorted(FAMILIES))
def test_scores_match_numerical_integrals(spark, family):
    data, targets, cases = [], [], {}
    for i, values in enumerate(GIVEN[family]):
        for k, y in enumerate(OBSERVED):
            day = f"2023-01-{10 + k}"
            data += forecast(f"m{i}", family, FAMILIES[family].parameters, values, day)
            cases[f"m{i}", day] = (*values, y)
            targets += [(day, "BARC", "temperature", y)] if not i else []
    scores = S.score(spark.createDataFrame(data, FORECAST), spark.createDataFrame(targets, TARGET), interval=0.9).collect()
    assert len(scores) == len(cases)
    for r in scores:
        a, b, y = cases[r["model_id"], r["datetime"]]
        top = 400.0 if family == "lognormal" else 80.0
        x = np.unique(np.concatenate([np.linspace(-80.0, 40.0, 400_001), np.linspace(40.0, top, 100_001), [y]]))
        f = cdf(family, a, b, x)
        gap = (f - (x >= y)) ** 2
        assert r["crps"] == pytest.approx(float(np.sum((gap[1:] + gap[:-1]) / 2 * np.diff(x))), abs=2e-3)
        step = 1e-5
        density = float(np.diff(cdf(family, a, b, np.array([y - step, y + step])))[0]) / (2 * step)
        if density > 1e-6:
            assert r["logs"] == pytest.approx(-math.log(density), abs=1e-3)
        elif family != "logistic":
            assert r["logs"] is None
        for name, p in {"median": 0.5, "quantile97.5": 0.975, "quantile02.5": 0.025, "quantile90": 0.95, "quantile10": 0.05}.items():
            assert float(cdf(family, a, b, np.array([r[name]]))[0]) == pytest.approx(p, abs=1e-9)
        mass = np.diff(f)
        middle = (x[1:] + x[:-1]) / 2
        mean = float(np.sum(mass * middle))
        assert r["mean"] == pytest.approx(mean, abs=0.02)
        assert r["sd"] == pytest.approx(math.sqrt(float(np.sum(mass * (middle - mean) ** 2))), rel=0.03)


def test_parameters_that_make_no_distribution_and_unknown_families_keep_a_row(spark):
    data = forecast("flat", "uniform", ("min", "max"), (2.0, 2.0)) + forecast("half", "logistic", ("location",), (2.0,))
    data += forecast("twice", "logistic", ("location", "scale", "scale"), (2.0, 1.0, 3.0))
    data += forecast("odd", "gamma", ("shape", "rate"), (2.0, 1.0)) + forecast("none", None, ("x",), (1.0,))
    data += forecast("late", "logistic", ("location", "scale"), (2.0, 1.0), "2023-01-05")
    df, targets = spark.createDataFrame(data, FORECAST), spark.createDataFrame([("2023-01-02", "BARC", "temperature", 2.0)], TARGET)
    got = {r["model_id"]: r for r in S.score(df, targets).collect()}
    assert set(got) == {"flat", "half", "twice", "odd", "none", "late"}
    assert all(r["crps"] is None and r["logs"] is None for r in got.values())
    assert got["late"]["median"] == 2.0 and got["late"]["observation"] is None
    only = S.score(df, targets, families=("logistic",)).collect()
    assert {r["model_id"] for r in only} == {"half", "twice", "late"}
    unchanged = E.normal_to_ensemble(df, draws=5).where("family is null or family = 'gamma'").collect()
    assert sorted((r["model_id"], r["parameter"], r["prediction"]) for r in unchanged) == [("none", "x", 1.0), ("odd", "rate", 1.0), ("odd", "shape", 2.0)]


def test_draws_follow_the_family_and_join_ensembles(spark):
    data = [r for f in sorted(FAMILIES) for r in forecast(f, f, FAMILIES[f].parameters, GIVEN[f][0])]
    data += forecast("stray", "uniform", ("low", "high"), (0.0, 1.0)) + forecast("odd", "gamma", ("shape",), (2.0,))
    df = spark.createDataFrame(data, FORECAST)
    drawn = E.normal_to_ensemble(df, draws=4000).where("family = 'ensemble'").toPandas()
    for f in FAMILIES:
        places = np.sort(cdf(f, *GIVEN[f][0], drawn[drawn.model_id == f].prediction.to_numpy()))
        assert len(places) == 4000 and np.abs(places - (np.arange(4000) + 0.5) / 4000).max() < 0.03
    mme = E.build_mme(df, "all", n=60).toPandas()
    assert len(mme) == 60 and mme.prediction.notna().all()
