"""Benchmark: every registered query on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

The model tables are flattened once (``model_tables``: the adapter joins of
lineitem/orders/customer/part, written as Parquet -- the analogue of
flattening the model's output database), then every query runs in full
(``noop`` sink: all rows computed, nothing collected) ``BENCH_RUNS`` times;
the median is reported.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from expcurve.plans import catalog  # noqa: E402
from expcurve.session import get_session  # noqa: E402
from expcurve.sources import testdata as TD  # noqa: E402


def run_full(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_session("expcurve-bench", master=f"local[{cpus}]", shuffle_partitions=cpus)

    t = time.time()
    TD.domain(spark, sf_dir).prepare()
    times = {"model_tables": round(time.time() - t, 3)}

    qs = catalog.queries()
    for name, fn in qs.items():
        if only and name not in only:
            continue
        samples = []
        for _ in range(runs + 1):           # first run warms up (and stores calibration params)
            t = time.time()
            run_full(fn(spark, sf_dir))
            samples.append(time.time() - t)
        times[name] = round(statistics.median(samples[1:]), 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(v for k, v in times.items()), 3)
    print(json.dumps({"metric": "total_query_sec", "value": total, "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
