import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from proofcast.operators import ensemble as E
from proofcast.sources import published

FORECAST = (
    "model_id string, reference_datetime string, site_id string, datetime timestamp, variable string, "
    "family string, parameter string, prediction double"
)


def day(h):
    return dt.datetime(2023, 1, 1) + dt.timedelta(days=h)


@pytest.fixture(scope="module")
def forecasts(spark):
    rows = []
    for m, members in (("a", 50), ("b", 4)):
        for p in range(1, members + 1):
            for h in (0, 1, 2, 31):
                rows.append((m, "2023-01-01", "BARC", day(h), "temperature", "sample", str(p), p + h / 100))
    for h in (1, 2):
        rows.append(("n", "2023-01-01", "BARC", day(h), "temperature", "normal", "mu", 10.0))
        rows.append(("n", "2023-01-01", "BARC", day(h), "temperature", "normal", "sigma", 0.5))
    # a gap beyond the horizon still removes the whole site
    rows += [("gap", "2023-01-01", "BARC", day(1), "temperature", "sample", "1", 1.0)]
    rows += [("gap", "2023-01-01", "BARC", day(40), "temperature", "sample", "1", None)]
    rows += [("gap", "2023-01-01", "SUGG", day(1), "temperature", "sample", "1", 1.0)]
    rows += [("late", "2023-01-01", "BARC", day(35), "temperature", "sample", "1", 1.0)]
    rows += [("omitted", "2023-01-01", "BARC", day(1), "temperature", "sample", "1", 1.0)]
    rows += [("a", "2023-01-08", "BARC", day(9), "temperature", "sample", str(p), 1.0 * p) for p in range(1, 6)]
    return spark.createDataFrame(rows, FORECAST).repartition(5)


def test_ensemble_takes_equal_shares(forecasts):
    mme = E.build_mme(forecasts, "all", "temperature", n=30, omit=["omitted"]).toPandas()
    assert set(mme.model_id) == {"all"} and set(mme.family) == {"ensemble"}
    first = mme[(mme.reference_datetime == "2023-01-01") & (mme.site_id == "BARC")]
    # three usable models, ten members each; model b has only four
    for _, part in first.groupby("datetime"):
        assert sorted(part.parameter) == list(range(1, 25))
    assert set(first.datetime) == {day(1), day(2)}
    assert len(mme[mme.site_id == "SUGG"]) == 1
    assert len(mme[mme.reference_datetime == "2023-01-08"]) == 5
    drawn = first[first.prediction.between(7, 13) & (first.prediction % 1 > 0.05)]
    assert len(drawn) >= 10


def test_sample_is_a_repeatable_subset_with_all_dates(forecasts):
    rows = E.relevant(forecasts, "temperature", ["2023-01-01"], ["omitted"])
    once = E.sample_members(rows, 30, 30).toPandas()
    again = E.sample_members(rows.repartition(3), 30, 30).toPandas()
    key = ["site_id", "model_id", "datetime", "parameter"]
    assert once.sort_values(key).prediction.tolist() == again.sort_values(key).prediction.tolist()
    a = once[once.model_id == "a"]
    assert a.parameter.nunique() == 10 and len(a) == 20
    for _, r in a.iterrows():
        assert r.prediction == pytest.approx(int(r.parameter) + (r.datetime - day(0)).days / 100)
    other = E.sample_members(rows, 30, 30, seed=7).toPandas()
    assert set(other[other.model_id == "a"].parameter) != set(a.parameter)


def test_quota_rounds_half_to_even(spark):
    usable = spark.createDataFrame(
        [("r", "v", "s", f"m{i}") for i in range(4)] + [("r", "v", "t", f"m{i}") for i in range(8)],
        "reference_datetime string, variable string, site_id string, model_id string",
    )
    got = {r.site_id: (r.n_models, r["sample"]) for r in E.quotas(usable, 10).collect()}
    assert got == {"s": (4, 2), "t": (8, 1)}


def test_load_forecast_drops_gappy_sites_and_trims(forecasts):
    rows = E.load_forecast(forecasts.withColumn("pubDate", F.current_timestamp()), "temperature", ["2023-01-01"]).toPandas()
    assert "pubDate" not in rows
    assert set(rows.datetime) == {day(1), day(2)}
    assert set(zip(rows.model_id, rows.site_id)) == {
        ("a", "BARC"),
        ("b", "BARC"),
        ("n", "BARC"),
        ("gap", "SUGG"),
        ("omitted", "BARC"),
    }


def test_normal_forecasts_become_a_hundred_draws(forecasts):
    out = E.normal_to_ensemble(forecasts).filter("model_id = 'n'").toPandas()
    assert len(out) == 200 and set(out.family) == {"ensemble"}
    assert out.prediction.mean() == pytest.approx(10, abs=0.15)
    assert out.prediction.std() == pytest.approx(0.5, abs=0.1)


def test_a_draw_has_one_digest(spark):
    rows = [("m", "2023-01-01", "BARC", dt.datetime(2023, 1, 2), "oxygen", "normal", n, v) for n, v in (("mu", 3.0), ("sigma", 0.5))]
    drawn = E.normal_to_ensemble(spark.createDataFrame(rows, FORECAST))
    plan = drawn.select("prediction")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    digest = hashlib.md5(f"{E.SEED}|2023-01-01|oxygen|BARC|m|2023-01-02 00:00:00|7".encode()).hexdigest()
    u1, u2 = int(digest[:8], 16), int(digest[8:16], 16)
    want = 3.0 + 0.5 * math.sqrt(-2 * math.log((u1 + 1) / 4294967297)) * math.cos(2 * math.pi * u2 / 4294967296)
    assert drawn.filter("parameter = '7'").first()["prediction"] == pytest.approx(want)


def test_pending_dates(spark):
    want = spark.createDataFrame([(dt.date(2023, 1, d),) for d in (1, 2, 3)], "reference_datetime date")
    done = spark.createDataFrame([("2023-01-02",)], "reference_datetime string")
    assert sorted(r[0].day for r in E.pending_dates(want, done).collect()) == [1, 3]
    none = spark.createDataFrame([], "reference_datetime string")
    assert E.pending_dates(want, none).count() == 3


def test_families_without_members_do_not_count(spark):
    day = dt.datetime(2023, 1, 3)
    data = [("a", "2023-01-01", "BARC", day, "temperature", "sample", str(i), float(i)) for i in range(12)]
    data += [("odd", "2023-01-01", "BARC", day, "temperature", "lognormal", p, 1.0) for p in ("mu", "sigma")]
    assert E.build_mme(spark.createDataFrame(data, FORECAST), "mme", n=10).count() == 10


def test_issue_dates_compare_as_dates(spark):
    day = dt.datetime(2023, 1, 3)
    data = [("a", "2023-01-01 00:00:00", "BARC", day, "temperature", "sample", str(i), float(i)) for i in range(5)]
    df = spark.createDataFrame(data, FORECAST)
    assert E.build_mme(df, "mme", issue_dates=["2023-01-01"], n=5).count() == 5
    wanted = spark.createDataFrame([("2023-01-01",)], "reference_datetime string")
    assert E.build_mme(df, "mme", issue_dates=wanted, n=5).count() == 5


@pytest.fixture
def two_weeks(spark):
    data = [(m, f"2023-01-0{i}", "BARC", dt.datetime(2023, 1, 5), "temperature", "sample", str(k), float(k)) for m in "ab" for i in (1, 2) for k in range(6)]
    return data, spark.createDataFrame(data, FORECAST)


def test_pending_ensembles_are_published_once_and_only_valid_ones(spark, two_weeks, tmp_path):
    data, df = two_weeks
    path = str(tmp_path / "ensembles")
    assert E.store_pending(df.filter("reference_datetime = '2023-01-01'"), "mme", path, n=4)
    first = E.stored_ensembles(spark, path)
    assert first.count() == 4 and [r[0] for r in first.select("reference_datetime").distinct().collect()] == ["2023-01-01"]
    assert E.store_pending(df, "mme", path, n=4)
    both = sorted(map(tuple, E.stored_ensembles(spark, path).select("reference_datetime", "parameter", "prediction").collect()))
    whole = sorted(map(tuple, E.build_mme(df, "mme", n=4).select("reference_datetime", F.col("parameter").cast("string"), "prediction").collect()))
    assert both == whole
    assert not E.store_pending(df, "mme", path, n=4) and published.state(spark, path)[0] == 2
    broken = spark.createDataFrame([(*r[:7], float("nan")) for r in data], FORECAST)
    with pytest.raises(ValueError, match="missing_prediction"):
        E.store_pending(broken, "bad", str(tmp_path / "bad"), n=4)
    assert E.stored_ensembles(spark, str(tmp_path / "bad")).count() == 0
    assert len(published.unpublished(spark, str(tmp_path / "bad"))) == 1


def test_a_run_that_fails_before_publishing_shows_nothing(spark, two_weeks, tmp_path, monkeypatch):
    _, df = two_weeks
    path = str(tmp_path / "ensembles")

    def crash(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(published, "publish", crash)
        with pytest.raises(RuntimeError, match="lost"):
            E.store_pending(df, "mme", path, n=4)
    assert E.stored_ensembles(spark, path).count() == 0 and len(published.unpublished(spark, path)) == 1
    assert E.store_pending(df, "mme", path, n=4)
    assert E.stored_ensembles(spark, path).count() == 8


def test_nothing_is_built_where_nothing_is_pending(spark, two_weeks, tmp_path, monkeypatch):
    _, df = two_weeks
    path = str(tmp_path / "ensembles")
    assert E.store_pending(df, "mme", path, n=4)

    def built(*args, **options):
        raise AssertionError("built again")

    monkeypatch.setattr(E, "build_pending", built)
    assert not E.store_pending(df, "mme", path, n=4)


def test_two_runs_at_once_publish_once(spark, two_weeks, tmp_path):
    _, df = two_weeks
    path = str(tmp_path / "ensembles")
    folder = published.stage(df, path, ["model_id"])
    assert E.store_pending(df, "mme", path, n=4)
    with pytest.raises(published.PublishConflict):
        published.publish(spark, path, folder, "another", 24, seen=0)
    assert not published.publish(spark, path, folder, "mme 1", 24)
    assert E.stored_ensembles(spark, path).count() == 8
