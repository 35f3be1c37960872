"""Benchmark: build the warehouse, then run every report against it.

Usage: ``BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py``

* ``raw_extract`` — the driver's tables mapped onto the raw source layout
  and stored once (the raw layer is stored tables in the original system);
* ``warehouse_build`` — stored raw tables -> 12 stored models
  (staging, intermediate, dimensions, fact), the way the reference is run;
* every other registered query — executed against the stored warehouse
  (exploration / staging keys read the raw sources, as in the reference),
  forced with a ``noop`` write so the whole result is computed, nothing
  collected.

Each timing is the median of ``BENCH_RUNS`` warm runs (default 5) after one
warm-up.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tierline.plans.build import materialise  # noqa: E402
from tierline.plans.warehouse import Warehouse  # noqa: E402
from tierline.queries import MODEL_QUERIES, QUERIES, testdata_warehouse  # noqa: E402
from tierline.session import build_session, scratch_path  # noqa: E402
from tierline.sources.testdata import materialise_raw  # noqa: E402


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _median_time(fn, runs: int) -> float:
    fn()  # warm-up
    samples = []
    for _ in range(runs):
        t0 = time.perf_counter()
        fn()
        samples.append(time.perf_counter() - t0)
    return statistics.median(samples)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = build_session(
        f"local[{cpus}]",
        app_name="tierline-bench",
        shuffle_partitions=2 * cpus,
        conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("ERROR")

    timings: dict[str, float] = {}
    built = {}
    adapter = testdata_warehouse(spark, sf_dir)

    def extract():
        built["raw"] = materialise_raw(adapter.raw, scratch_path(spark, "raw"))

    timings["raw_extract"] = _median_time(extract, runs)
    stored_raw = Warehouse(spark, built["raw"], adapter.params, adapter.state_names, adapter.state_regions)

    def build():
        built["wh"] = materialise(stored_raw, replaces=built.get("wh"))

    timings["warehouse_build"] = _median_time(build, runs)
    wh = built["wh"]
    for key, fn in MODEL_QUERIES.items():
        if key == "warehouse_build":
            continue
        timings[key] = _median_time(lambda fn=fn: _run(fn(wh)), runs)
    for key in sorted(set(QUERIES) - set(MODEL_QUERIES)):  # queries over the driver tables directly
        timings[key] = _median_time(lambda key=key: _run(QUERIES[key](spark, sf_dir)), runs)

    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "sum_of_median_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in timings.items()},
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
                "runs": runs,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
