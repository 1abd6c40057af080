"""Run every registered query and print row counts and timings."""
import sys
import time

sys.path.insert(0, ".")
from expcurve.session import get_session  # noqa: E402
from expcurve.plans.catalog import queries  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = sys.argv[2:] or None
spark = get_session(master="local[8]", shuffle_partitions=8)
for name, fn in queries().items():
    if only and name not in only:
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        n = df.count()
        print(f"{name:32s} rows={n:7d} {time.time()-t:6.2f}s cols={df.columns}", flush=True)
    except Exception as e:  # noqa: BLE001
        print(f"{name:32s} ERROR {type(e).__name__}: {str(e)[:400]}", flush=True)
