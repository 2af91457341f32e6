"""Registered queries against their SQL, on the smallest supplied tables."""

import glob
import importlib.util
import os

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = "/root/testdata/sf0.001"

spec = importlib.util.spec_from_file_location("spark_entry", f"{ROOT}/__spark_entry__.py")
spark_entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(spark_entry)

QUERIES, SQL = spark_entry.queries(), spark_entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no supplied tables")

# every kind of operator once; the full list is compared by the driver
COMPARED = (
    "skill_vs_climatology",
    "leaderboard_with_baselines",
    "reliability_95",
    "rank_deciles_site",
    "seasonal_anomaly",
    "median_skill_by_model",
    "skill_boxplot",
    "multi_model_ensemble",
    "score_forecasts",
    "model_order_within_site",
    "flag_totals",
    "pending_dates",
    "overlap_period_curves",
    "crps_profile",
    "incremental_ensemble",
    "incremental_scores",
    "late_scores",
    "sound_forecasts",
    "stored_scores",
    "structure_report",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = [tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(names), sorted(clean, key=repr)


def test_every_query_has_sql():
    assert set(SQL) <= set(QUERIES)
    assert set(spark_entry.reports.QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", COMPARED)
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    assert got == canonical([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_returns_rows(spark):
    assert spark_entry.entry(spark).count() > 0


def test_scores_are_shared_within_a_report(spark):
    df = QUERIES["reliability_80"](spark, SF_DIR)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # the scores feed both the leaderboard and the reliability counts
    assert "ReusedExchange" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    df = QUERIES["crps_sample"](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "l_orderkey" in line]
    assert scans and all("l_shipdate" not in line and "l_returnflag" not in line for line in scans)
