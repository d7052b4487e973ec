"""Time the queries and print one JSON line.

Each query is built and fully materialised (no-op sink) once untimed, then
up to ``BENCH_RUNS`` times, no more once they have taken ``ENOUGH`` seconds; the figure is
the median.  One whose first run takes ``LONG`` seconds isn't run again: that run is its figure.  Every figure goes to the error stream as it
comes, forests come last, no query is begun after ``BENCH_SECONDS``, and one still running after ``BENCH_DEADLINE`` is cancelled and
left out, so a slow one can't cost the others.
``BENCH_QUERIES`` is a comma separated list, or ``all``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import threading
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from panelcast.session import build_session  # noqa: E402
from workloads.queries import QUERIES  # noqa: E402

HEADLINE = (
    "segment_report", "vintage_union", "clean_sentinel", "pct_to_count", "drop_zero_metrics", "prepare_panel",
    "descriptive_report", "complete_history", "lags", "ema", "window_samples", "target_features", "standardize",
    "stratified_holdout", "cluster_split", "cluster_series", "exact_quantile", "kde", "trimmed_mape", "cqr_calibrate",
    "project_linear", "backtest_linear", "evaluation_table", "projection_report", "quantile_forest", "project_forest",
    "backtest_forest",
)
#: Seconds after which a query isn't run again.
ENOUGH = 8.0
#: Seconds of a first run that is run once only.
LONG = 20.0
#: Run before anything is timed, so that the first query doesn't pay for a cold JVM.
WARM_UP = ("segment_report", "evaluation_table", "segment_report")



def run(fn, spark, sf) -> float:
    start = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def cancel_after(spark, seconds: float, over: threading.Event) -> None:
    """Once ``seconds`` are over, cancel whatever runs, again and again, as a query may start many jobs."""
    def watch() -> None:
        while not over.wait(1.0):
            if time.perf_counter() - begun > seconds:
                spark.sparkContext.cancelAllJobs()

    begun = time.perf_counter()
    threading.Thread(target=watch, daemon=True).start()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    asked = os.environ.get("BENCH_QUERIES", "")
    chosen = list(QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or list(HEADLINE)
    spark = build_session(f"local[{cpus}]", "panelcast-bench", shuffle_partitions=int(cpus), **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        run(QUERIES[name], spark, sf)
    times, begun, limit = {}, time.perf_counter(), float(os.environ.get("BENCH_SECONDS", "900"))
    deadline, over = float(os.environ.get("BENCH_DEADLINE", "1500")), threading.Event()
    cancel_after(spark, deadline, over)
    for name in sorted(chosen, key=lambda n: ("forest" in n) + (n == "project_forest")):
        if time.perf_counter() - begun > limit:
            print(f"{name}: not run, {limit:.0f} s are over", file=sys.stderr, flush=True)
            continue
        try:
            took = [run(QUERIES[name], spark, sf)]
            if took[0] < LONG:
                took = [run(QUERIES[name], spark, sf)]
                while len(took) < runs and sum(took) < ENOUGH:
                    took.append(run(QUERIES[name], spark, sf))
        except Exception as error:
            if time.perf_counter() - begun < deadline:
                raise
            print(f"{name}: cancelled, {deadline:.0f} s are over ({type(error).__name__})", file=sys.stderr, flush=True)
            break
        times[name] = round(statistics.median(took), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    over.set()
    print(json.dumps({"metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
