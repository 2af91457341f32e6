import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofcast.operators import orderstats as O


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows, half of those one single value."""
    rng = np.random.default_rng(11)
    hot = np.concatenate([np.full(1000, 2.5), rng.normal(2, 5, 1000)])
    rest = pd.DataFrame({"k": rng.integers(0, 40, 4000).astype(str), "x": rng.lognormal(0, 3, 4000) - 1})
    pdf = pd.concat([pd.DataFrame({"k": "hot", "x": hot}), rest], ignore_index=True)
    pdf.loc[rng.choice(len(pdf), 100, replace=False), "x"] = np.nan
    pdf = pd.concat([pdf, pd.DataFrame({"k": ["void"] * 3 + [None], "x": [np.nan] * 3 + [7.0]})])
    rows = [(k, None if np.isnan(x) else float(x)) for k, x in zip(pdf.k, pdf.x)]
    return spark.createDataFrame(rows, "k string, x double").repartition(8), pdf


def test_exact_quantiles_match_brute_force(skewed):
    df, pdf = skewed
    probs = {"p02": 0.025, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.k: r for r in O.exact_quantiles(df, ["k"], "x", probs, count="n").collect()}
    assert set(got) == set(pdf.k.where(pdf.k.notna(), None))
    for k, r in got.items():
        part = pdf[pdf.k.isna() if k is None else pdf.k == k]
        assert r.n == len(part)
        values = part.x.dropna().to_numpy()
        for name, p in probs.items():
            if len(values):
                assert r[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
            else:
                assert r[name] is None


def test_places_are_those_of_one_sort(skewed):
    df, pdf = skewed
    counts = O.distinct_counts(df, ["k"], "x")
    for r in O.place_values(counts, O.bin_offsets(counts, ["k"]), ["k"]).filter("_x is not null").collect():
        values = pdf.x[pdf.k.isna() if r.k is None else pdf.k == r.k].dropna()
        assert (r._before, r._w, r._n) == ((values < r._x).sum(), (values == r._x).sum(), len(values))


def test_numbering_matches_one_big_sort(skewed):
    df, pdf = skewed
    rows = df.withColumn("id", F.monotonically_increasing_id())
    out = O.numbered_by_value(rows, [], "x", "id", "place").toPandas().sort_values("place")
    assert list(out.place) == list(range(1, len(pdf) + 1))
    known = out.x.dropna().to_numpy()
    assert (np.diff(known) >= 0).all() and out.x.iloc[len(known) :].isna().all()
    down = O.numbered_by_value(rows, ["k"], "x", "id", "place", descending=True)
    for _, part in down.filter("k is not null").toPandas().groupby("k"):
        part = part.sort_values("place")
        assert list(part.place) == list(range(1, len(part) + 1))
        assert (np.diff(part.x.dropna()) <= 0).all()


def test_median_of_two_and_of_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 3.0)], "k string, x double")
    got = {r.k: r.m for r in O.exact_quantiles(df, ["k"], "x", {"m": 0.5}).collect()}
    assert got == {"a": 2.5, "b": 3.0}


def test_values_are_numbered(skewed, monkeypatch):
    df, pdf = skewed
    monkeypatch.setattr(O, "PIECE", 300)
    out = O.numbered_values(df, ["k"], "x", "place").toPandas()
    assert len(out) == len(pdf)
    for k, part in out.groupby("k", dropna=False):
        part = part.sort_values("place")
        assert list(part.place) == list(range(1, len(part) + 1))
        expected = np.sort(pdf.x[pdf.k.isna() if pd.isna(k) else pdf.k == k].dropna().to_numpy())
        assert np.array_equal(part.x.dropna().to_numpy(), expected)
        assert part.x.iloc[len(expected) :].isna().all()
