import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofcast.functions import columns as C
from proofcast.functions.frames import bind_rows, columns_like, complete_rows, join_null_safe


def test_normal_cdf_matches_erfc(spark):
    xs = [float(x) for x in np.linspace(-9, 9, 181)] + [-40.0, 40.0, 1.959963984540054]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", C.normal_cdf(F.col("x")).alias("p"))
    for r in rows.collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=1e-15)


def test_crps_normal_matches_numerical_integral(spark):
    cases = [(0.7, 0.0, 1.0), (3.0, 2.0, 0.5), (-4.0, 1.0, 2.0)]
    df = spark.createDataFrame(cases, "y double, mu double, sigma double")
    got = [r[0] for r in df.select(C.crps_normal(F.col("y"), F.col("mu"), F.col("sigma"))).collect()]
    for (y, mu, sigma), value in zip(cases, got):
        grid = np.linspace(mu - 12 * sigma - 6, mu + 12 * sigma + 6, 400_001)
        cdf = 0.5 * np.array([math.erfc(-(g - mu) / sigma / math.sqrt(2)) for g in grid])
        step = (cdf - (grid >= y)) ** 2
        assert value == pytest.approx(np.trapezoid(step, grid), abs=1e-4)


def test_degenerate_normal_scores_the_distance(spark):
    row = spark.range(1).select(
        C.crps_normal(F.lit(3.0), F.lit(1.0), F.lit(0.0)).alias("c"),
        C.logs_normal(F.lit(3.0), F.lit(1.0), F.lit(0.0)).alias("l"),
    )
    assert tuple(row.first()) == (2.0, None)


def test_rank_bins_are_right_closed(spark):
    df = spark.range(0, 45).select(F.col("id").cast("int").alias("rank"))
    edges38 = [0, 4, 8, 12, 16, 19, 23, 27, 31, 35, 38]
    edges31 = [0, 4, 7, 10, 13, 16, 19, 22, 25, 28, 31]
    for most, edges in ((38, edges38), (31, edges31)):
        for r in df.select("rank", C.rank_bin(F.col("rank"), most).alias("b")).collect():
            expected = next((i for i in range(1, 11) if edges[i - 1] < r["rank"] <= edges[i]), 11 if r["rank"] > most else None)
            assert r.b == expected


def test_order_bin_never_decreases(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate(
        [rng.normal(0, 1, 2000), rng.lognormal(0, 30, 2000), -rng.lognormal(0, 30, 2000), [0.0, -0.0, 5e-324, 1e308, -1e308]]
    )
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    rows = df.select("x", C.order_bin(F.col("x")).alias("b")).orderBy("x").collect()
    bins = [r.b for r in rows]
    assert bins == sorted(bins)


def test_lead_time_and_window(spark):
    df = spark.createDataFrame(
        [("2023-01-01", f"2023-01-{d:02d} 18:00:00") for d in range(1, 32)], "reference_datetime string, datetime string"
    ).withColumn("datetime", F.col("datetime").cast("timestamp"))
    kept = C.eval_window(df)
    assert sorted(r.horizon for r in kept.collect()) == [h for h in range(1, 31) if h != 15]
    assert C.eval_window(df, skip=()).count() == 30
    first = df.select(C.lead_days_fractional().alias("h")).orderBy("h").first()
    assert first.h == 0.75


def test_null_flags(spark):
    df = spark.createDataFrame([("a", 1), (None, None), ("b", 0)], "t string, f int")
    assert [r[0] for r in df.select(C.mentions("t", "a")).collect()] == [True, None, False]
    assert [r[0] for r in df.select(C.yes_no("f")).collect()] == ["yes", None, "no"]
    assert df.filter(C.not_one_of("t", ["a"])).count() == 2
    assert [r[0] for r in df.select(C.relabel("t", {"a": "x"})).collect()] == ["x", None, "b"]


def test_row_sum_is_null_if_any_part_is(spark):
    df = spark.createDataFrame([(1, 1), (1, None)], "unc_a int, Unc_b int")
    names = columns_like(df, "unc")
    assert names == ["unc_a", "Unc_b"]
    assert [r[0] for r in df.select(C.row_sum(names)).collect()] == [2, None]


def test_site_and_depth(spark):
    df = spark.createDataFrame([("BARC-0.5",), ("BARC",), ("BARC-x",)], "site_id string")
    got = [tuple(r) for r in df.select(C.site_part(), C.depth_part()).collect()]
    assert got == [("BARC", 0.5), ("BARC", None), ("BARC", None)]


def test_null_safe_join_and_binding(spark):
    a = spark.createDataFrame([("k", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("z", 4)], "k string, b int")
    full = {(r.k, r.a, r.b) for r in join_null_safe(a, b, ["k"], "full").collect()}
    assert full == {("k", 1, None), (None, 2, 3), ("z", None, 4)}
    assert [r.a for r in join_null_safe(a, b, ["k"], "left_anti").collect()] == [1]
    assert bind_rows(a, b).columns == ["k", "a", "b"]
    assert complete_rows(bind_rows(a, b)).count() == 0


def test_draws_are_reproducible_and_normal(spark):
    df = spark.range(20_000).select(C.standard_normal(C.draw_key(1, F.col("id"))).alias("z"))
    z = np.array([r.z for r in df.collect()])
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03
    again = np.array([r.z for r in df.collect()])
    assert (z == again).all()
