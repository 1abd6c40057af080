"""Join helpers: size-checked broadcast and null-safe equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when the optimizer's size estimate of it is below
# this bound; above it the join is left to the planner (sort-merge / shuffled
# hash join), and AQE can still switch to a broadcast at run time from the
# real shuffle sizes.  File-based estimates are compressed sizes, so the
# bound is kept well below what an executor can hold.
BROADCAST_MAX_BYTES = 16 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the (already analyzed) plan; no job and
    no optimizer run.  Without column pruning it is an upper bound."""
    try:
        stats = df._jdf.queryExecution().analyzed().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # noqa: BLE001 - e.g. Spark Connect: no JVM handle
        return None


def small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint for a side whose estimated size is proven small."""
    size = estimated_bytes(df)
    if size is not None and size <= max_bytes:
        return F.broadcast(df)
    return df


def join_dim(fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left",
             null_safe: bool = False) -> DataFrame:
    """Join a fact table to a dimension table on same-named keys (the
    dimension broadcast when its size is proven small).  ``null_safe`` makes
    missing keys match each other, as data-frame joins do, with ``<=>``."""
    on = list(on)
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"join_dim keeps the fact side: {how}")
    if not null_safe:
        return fact.join(small(dim), on, how)
    d = dim.select(*[F.col(k).alias(f"__k_{k}") for k in on],
                   *[c for c in dim.columns if c not in on])
    cond = None
    for k in on:
        e = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        cond = e if cond is None else cond & e
    out = fact.join(small(d), cond, how)
    return out.drop(*[f"__k_{k}" for k in on])
