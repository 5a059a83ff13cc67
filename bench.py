"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "agg02_tail_quantiles", "agg03_tail_ratio_change", "agg04_feature_block", "agg21_rank_correlation", "jn08_ball_history",
    "win02_rolling_mean", "win04_robust_z", "win16_mean_split_scores", "dst01_ks_statistic", "dst02_wasserstein",
    "dst03_shift_per_game", "smp06_bootstrap_mean", "trk01_play_segments", "trk03_gap_fill", "trk07_error_table",
    "det01_page_hinkley", "det02_mean_split", "det03_bucket_window", "det04_recent_sample", "grd01_smoother_sweep",
    "grd02_split_grid", "ens05_width_sweep", "evl01_alarm_metrics", "evl03_hold_out", "dst12_lsif_weights", "chg02_break_curve",
]


def main() -> None:
    from tidemark.plans import all_queries
    from tidemark.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=tempfile.mkdtemp(prefix="tidemark-bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in queries]
    # start the Python workers and load the classes before timing
    queries["win04_robust_z"](spark, sf_dir.replace("sf0.1", "sf0.001")).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").split("/")[-1].removeprefix("sf")}))


if __name__ == "__main__":
    main()
