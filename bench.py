"""Times the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Stages (attempts, cases, scenarios, ...) are built in order and timed as queries
of their own; a later query reads the stages before it, as a study does.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark import SparkConf
from pyspark.sql import SparkSession

from fieldwise.catalog import balance, views
from fieldwise.catalog.all import QUERIES
from fieldwise.stages import drop_stages

HEADLINE = [
    "attempt_sequence", "progress_flags", "last_attempt", "unpivot_attempts", "long_histories",
    "covariate_cells", "cohens_d", "effect_table", "weighted_moments", "ave_window",
    "equal_count_bins", "fit_stats", "coef_table", "score_previous", "rank_split",
    "alternating_pick", "attempts_saved", "calibration_full_sim2", "r_indicator_one_factor",
    "r_indicator_full", "r_indicator_stsi", "r_indicator_pps", "indicator_grid",
    "scenario_means",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    if not SparkConf().contains("spark.checkpoint.dir"):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
    spark = (
        builder
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.time()
        out = run()
        if out is not None and hasattr(out, "write"):
            out.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)

    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    timed("stage_attempts", lambda: views.attempts(spark, sf_dir))
    timed("stage_cases", lambda: views.cases(spark, sf_dir))
    timed("stage_fits", lambda: views.fits(spark, sf_dir) and None)
    timed("stage_scenarios", lambda: views.scenarios(spark, sf_dir))
    timed("stage_partials", lambda: balance.partials(spark, sf_dir) and None)
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir))
    print(json.dumps({
        "metric": "fieldwork queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))
    drop_stages(spark)
    spark.stop()


if __name__ == "__main__":
    main()
