"""Wall-clock of the headline queries; prints one JSON line.

Every query starts from the raw tables and is run to completion without
collecting its result.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from proofcast.plans.reports import QUERIES  # noqa: E402
from proofcast.session import local_session  # noqa: E402

HEADLINE = (
    "crps_sample",
    "logs_sample",
    "skill_vs_climatology",
    "mean_skill_by_model",
    "skill_by_horizon",
    "reliability_80",
    "rank_distribution",
    "median_skill_by_model",
    "multi_model_ensemble",
    "seasonal_anomaly",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cores, shuffle_partitions=cores)
    # one untimed scan, so the first query does not pay for starting the session
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cores": cores,
                "shuffle_partitions": cores,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
