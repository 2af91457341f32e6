import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofcast.operators import scoring as S
from proofcast.operators.validation import duplicate_scores, validation_report

DAY = dt.datetime(2023, 1, 2)
FORECAST = (
    "model_id string, reference_datetime string, site_id string, datetime timestamp, variable string, "
    "family string, parameter string, prediction double"
)
TARGET = "datetime timestamp, site_id string, variable string, observation double"


def rows(model, values, site="BARC", family="sample", day=DAY, names=None):
    names = names or [str(i + 1) for i in range(len(values))]
    return [(model, "2023-01-01", site, day, "temperature", family, n, v) for n, v in zip(names, values)]


def brute_crps(x, y):
    x = np.asarray(x)
    return np.abs(x - y).mean() - 0.5 * np.abs(x[:, None] - x[None, :]).mean()


def brute_logs(x, y):
    x = np.asarray(x)
    q25, q75 = np.quantile(x, [0.25, 0.75])
    bw = 1.06 * min(x.std(ddof=1), (q75 - q25) / 1.34) * len(x) ** -0.2
    return -math.log(np.mean(np.exp(-0.5 * ((y - x) / bw) ** 2) / (bw * math.sqrt(2 * math.pi))))


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    members = {
        "hot": np.round(rng.normal(10, 2, 600), 1),  # many ties
        "a": rng.normal(9, 1, 40),
        "b": rng.normal(12, 3, 7),
        "one": np.array([4.0]),
        "flat": np.full(5, 10.0),
    }
    data = [r for m, v in members.items() for r in rows(m, [float(x) for x in v], family="ensemble" if m == "a" else "sample")]
    data += rows("a", [None, 1.0, 2.0], site="SUGG")
    data += rows("n", [10.0, 2.0], family="normal", names=["mu", "sigma"])
    forecasts = spark.createDataFrame(data, FORECAST)
    targets = spark.createDataFrame([(DAY, "BARC", "temperature", 9.3)], TARGET)
    return forecasts, targets, members


def test_scores_match_brute_force(tables):
    forecasts, targets, members = tables
    got = {(r.model_id, r.site_id): r.asDict() for r in S.score(forecasts, targets).collect()}
    assert len(got) == 7
    for m, x in members.items():
        r = got[m, "BARC"]
        assert r["m"] == len(x)
        assert r["family"] == "sample"
        assert r["crps"] == pytest.approx(brute_crps(x, 9.3), abs=1e-10)
        assert r["mean"] == pytest.approx(x.mean())
        assert r["median"] == pytest.approx(np.median(x))
        for name, p in (("quantile97.5", 0.975), ("quantile02.5", 0.025), ("quantile90", 0.9), ("quantile10", 0.1)):
            assert r[name] == pytest.approx(np.quantile(x, p))
        if m in ("hot", "a", "b"):
            assert r["sd"] == pytest.approx(x.std(ddof=1))
            assert r["logs"] == pytest.approx(brute_logs(x, 9.3), rel=1e-9)
        else:
            assert r["logs"] is None
    assert got["one", "BARC"]["crps"] == pytest.approx(5.3)
    late = got["a", "SUGG"]
    assert late["m"] == 2 and late["observation"] is None and late["crps"] is None and late["mean"] == 1.5
    normal = got["n", "BARC"]
    assert normal["mean"] == 10.0 and normal["sd"] == 2.0
    assert normal["quantile97.5"] == pytest.approx(10 + 2 * 1.959964, abs=1e-5)


def test_no_forecast_is_lost(spark):
    data = rows("empty", [None, None]) + rows("odd", [1.0, 2.0], family="lognormal", names=["mu", "sigma"])
    data += rows("half", [1.0, None]) + rows("m", [2.0], family="normal", names=["mu"])
    targets = spark.createDataFrame([(DAY, "BARC", "temperature", 2.0)], TARGET)
    got = {r.model_id: r for r in S.score(spark.createDataFrame(data, FORECAST), targets).collect()}
    assert set(got) == {"empty", "odd", "half", "m"}
    assert got["empty"].m == 0 and got["half"].m == 1 and got["half"].crps == 1.0
    for name in ("empty", "odd", "m"):
        assert got[name].crps is None and got[name].logs is None and got[name].observation == 2.0
    assert got["odd"].family == "lognormal"


def test_observations_that_disagree_leave_the_score_null(spark):
    forecasts = spark.createDataFrame(rows("a", [float(v) for v in range(10)]), FORECAST)
    once, twice, differ = ([(DAY, "BARC", "temperature", v) for v in vs] for vs in ([1.0], [1.0, 1.0], [1.0, 5.0]))
    a, b, c = (S.score(forecasts, spark.createDataFrame(t, TARGET)).collect() for t in (once, twice, differ))
    assert len(a) == len(b) == len(c) == 1
    assert a[0].crps == b[0].crps == pytest.approx(2.05) and a[0].m == b[0].m == 10
    assert c[0].crps is None and c[0].observation is None and c[0].m == 10


def test_members_never_join_targets(spark, tables):
    forecasts, targets, _ = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.score_samples(S.normalise_family(forecasts), targets, logs=False)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "Join" in line and "site_id" in line and "_cell" not in line]
    assert len(joins) == 1 and "prediction" not in joins[0]


def test_crowded_targets_give_the_same_scores(spark, tables, monkeypatch):
    forecasts, targets, _ = tables
    nowhere = spark.createDataFrame([("hot", "2023-01-01", None, None, "temperature", "sample", "1", 2.0)], FORECAST)
    rows = forecasts.filter(F.col("family") != "normal").unionByName(nowhere)

    def found():
        scored = S.score(rows, targets).orderBy("model_id", F.col("site_id").asc_nulls_last()).collect()
        return [{n: pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for n, v in r.asDict().items()} for r in scored]

    whole = found()
    monkeypatch.setattr(S, "GATHERED", 100)  # BARC is crowded, SUGG is not
    some = found()
    monkeypatch.setattr(S, "GATHERED", 0)
    assert len(whole) == 7 and found() == some == whole


def test_members_are_dealt_to_tasks_by_their_number(spark, tables, monkeypatch):
    df, targets, members = tables
    monkeypatch.setattr(S, "DEALT", 10)
    tasks = -(-df.count() // 10)
    plan = S.score_samples(df, targets)._jdf.queryExecution().executedPlan().toString()
    assert tasks > 8 and plan.count(f", {tasks}), REPARTITION_BY_NUM") == 2  # members and observations alike


def test_scores_and_skill_shuffle_the_members_once(spark, tables):
    from proofcast.operators.skill import skill

    forecasts, targets, _ = tables
    scored = S.score(forecasts, targets, families=("sample",))
    plan = skill(scored, "a", skip=())._jdf.queryExecution().executedPlan().toString()
    # members once; observations once
    assert plan.count("Exchange hashpartitioning") == 2


def test_large_sample_approaches_the_normal_score(spark):
    rng = np.random.default_rng(8)
    data = rows("s", [float(v) for v in rng.normal(10, 2, 20_000)])
    data += rows("n", [10.0, 2.0], family="normal", names=["mu", "sigma"])
    targets = spark.createDataFrame([(DAY, "BARC", "temperature", 11.0)], TARGET)
    got = {r.model_id: r for r in S.score(spark.createDataFrame(data, FORECAST), targets).collect()}
    assert got["s"].crps == pytest.approx(got["n"].crps, abs=0.02)
    assert got["s"].logs == pytest.approx(got["n"].logs, abs=0.05)


def test_shifting_members_and_observation_keeps_the_score(spark):
    x = [1.0, 2.5, 7.0]
    data = rows("a", x) + rows("b", [v + 100 for v in x], site="SUGG")
    targets = spark.createDataFrame(
        [(DAY, "BARC", "temperature", 3.0), (DAY, "SUGG", "temperature", 103.0)], TARGET
    )
    a, b = S.score(spark.createDataFrame(data, FORECAST), targets, logs=False).orderBy("model_id").collect()
    assert a.crps == pytest.approx(b.crps) and a.crps >= 0 and a.logs is None


def test_weather_interval_is_ninety_percent(spark):
    x = [float(v) for v in range(101)]
    targets = spark.createDataFrame([], TARGET)
    r = S.score(spark.createDataFrame(rows("a", x), FORECAST), targets, interval=0.9).first()
    assert (r["quantile10"], r["quantile90"]) == (pytest.approx(5.0), pytest.approx(95.0))


def test_target_column_may_be_called_prediction(spark):
    targets = spark.createDataFrame([(DAY, "BARC", "temperature", 2.0)], TARGET.replace("observation", "prediction"))
    r = S.score(spark.createDataFrame(rows("a", [1.0]), FORECAST), targets).first()
    assert r.crps == 1.0
    joined = S.attach_observations(spark.createDataFrame(rows("a", [1.0]), FORECAST), targets)
    assert joined.first().observation == 2.0


def test_rescored_layout_splits_site_and_depth(spark):
    scored = S.score(
        spark.createDataFrame(rows("a", [1.0], site="BARC-0.5", day=dt.datetime(2023, 1, 2, 12)), FORECAST),
        spark.createDataFrame([], TARGET),
    )
    r = S.rescored_layout(scored).first()
    assert (r.site_id, r.depth, r.horizon, r.date) == ("BARC", 0.5, 1.5, "2023-01-02 12:00:00")


def test_nan_members_are_left_out(spark):
    targets = spark.createDataFrame([(DAY, "BARC", "temperature", 2.0)], TARGET)
    r = S.score(spark.createDataFrame(rows("a", [1.0, float("nan"), 3.0]), FORECAST), targets).first()
    assert r.m == 2 and r["mean"] == 2.0


def test_rescore_candidates_need_a_new_observation(spark):
    scores = spark.createDataFrame(
        [("a", DAY, "BARC", "temperature", None), ("b", DAY, "BARC", "temperature", 1.0), ("c", DAY, "SUGG", "temperature", None)],
        "model_id string, " + TARGET,
    )
    targets = spark.createDataFrame(
        [(DAY, "BARC", "temperature", 5.0), (DAY, "SUGG", "temperature", None)], TARGET
    )
    assert [r.model_id for r in S.rescore_candidates(scores, targets).collect()] == ["a"]


def test_validation_report_counts_each_rule(spark):
    data = rows("a", [1.0, None, 3.0], names=["1", "2", "2"])
    data += rows("b", [1.0], family="gamma")
    data += rows("c", [1.0], family="normal", names=["mu"])
    data += rows("d", [1.0], day=dt.datetime(2023, 1, 1))
    got = {r.rule: r.n_rows for r in validation_report(spark.createDataFrame(data, FORECAST)).collect()}
    assert got == {
        "unknown_family": 1,
        "missing_prediction": 1,
        "not_after_issue_date": 1,
        "duplicate_member": 1,
        "incomplete_normal": 1,
    }
    lacking = validation_report(spark.createDataFrame(data, FORECAST).drop("prediction")).collect()
    assert [tuple(r) for r in lacking] == [("missing_column_prediction", 6, False)]


def test_duplicate_scores(spark):
    df = spark.createDataFrame(rows("a", [1.0, 2.0]), FORECAST)
    assert duplicate_scores(df).first().n == 2
    assert duplicate_scores(df.filter(F.col("parameter") == "1")).count() == 0
