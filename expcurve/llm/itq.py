"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation is learnt on a bounded sample so that the signs of the rotated,
centred unit vectors are balanced 64-bit codes.  Codes are cut into 8 chunks;
each pair of chunks is a hash table keyed with the label, so two codes that
differ in at most 6 chunks (any 6 bits, mostly many more) meet in a bucket.
Vectors that meet are compared by the cosine of the original vectors.

Centring balances the codes, but where all vectors share a direction it turns
small angles into large ones.  So the share of the mean that is taken away, and
whether keys have two chunks or one, are chosen by measurement: for vectors of
the sample, partners at exactly the threshold are made, along differences of
the data and in random directions, and the first choice that finds 95 in 100
of them is taken (else the one that finds most).  Vectors of other lengths
than the commonest have random hyperplanes of their own and meet their like.

Scale: equal vectors are one class with a count.  Buckets with one class go
before any vector is moved.  Larger buckets are cut into blocks of bounded size
and every pair of blocks is one bounded group, compared as a matrix product; it
returns a count and a spanning-forest edge per class, never its pairs.  A pair
that meets in several tables counts in the first of them only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expcurve.llm.common import map_arrow, stored
from expcurve.llm.graph import connected_components

BITS = 64
CHUNKS = 8
PAIR_TABLES = list(combinations(range(CHUNKS), 2))
SINGLE_TABLES = [(i,) for i in range(CHUNKS)]
CENTRES = (1.0, 0.75, 0.5, 0.25, 0.0)
RECALL = 0.95
SAMPLE_ROWS = 8192
BLOCK_ROWS = 256


def learn_rotation(x: np.ndarray, dim: int, rounds: int = 50, seed: int = 7,
                   centre: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(``centre`` times the mean, dim x 64 projection) by iterative quantisation of unit vectors.

    More than 64 dimensions are reduced by principal components; fewer are
    lifted by a random orthonormal map.  Without a sample the map is random.
    """
    rng = np.random.default_rng(seed)
    mean = centre * x.mean(axis=0) if len(x) else np.zeros(dim)
    centred = x - mean
    if dim > BITS:
        _, _, axes = np.linalg.svd(centred.T @ centred)
        base = axes[:BITS].T
    else:
        base = np.linalg.qr(rng.standard_normal((BITS, BITS)))[0][:dim]
    turn = np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
    if len(x) > 1:
        v = centred @ base
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
    return mean, base @ turn


def codes_of(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    bits = (unit - mean) @ projection >= 0
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def random_hyperplanes(dim: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection for vectors of a length that no rotation was learnt for."""
    return np.zeros(dim), np.random.default_rng([seed, dim]).standard_normal((dim, BITS))


def equal_chunks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a ^ b).astype(">u8").view(np.uint8).reshape(-1, CHUNKS) == 0


def found_at_threshold(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, threshold: float, chunks: int,
                       seed: int = 7) -> float:
    """Share of unit vectors whose made partner, at cosine ``threshold``, has ``chunks`` equal chunks; the
    smaller of the shares for partners along differences of the data and for those in random directions."""
    rng, shares = np.random.default_rng(seed), []
    for step in (rng.standard_normal(x.shape), x[rng.permutation(len(x))] - x):
        step = step - (step * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(step, axis=1)
        real = size > 1e-9
        if real.any():
            u = x[real]
            v = threshold * u + np.sqrt(max(0.0, 1 - threshold ** 2)) * step[real] / size[real, None]
            same = equal_chunks(codes_of(u, mean, projection), codes_of(v, mean, projection))
            shares.append((same.sum(axis=1) >= chunks).mean())
    return min(shares, default=1.0)


def fit_codes(x: np.ndarray, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple], float]:
    """(mean, projection, tables, measured share) for unit vectors ``x``."""
    best = None
    for tables in (PAIR_TABLES, SINGLE_TABLES):
        for centre in CENTRES:
            mean, projection = learn_rotation(x, dim, centre=centre)
            share = found_at_threshold(x[:2048], mean, projection, threshold, len(tables[0]))
            if best is None or share > best[3]:
                best = (mean, projection, tables, share)
            if share >= RECALL:
                return best
    return best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _with_codes(classes: DataFrame, mean: np.ndarray, projection: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                rows = b.filter(pa.array(sizes == dim))
                own = (mean, projection) if dim == len(mean) else random_hyperplanes(dim)
                codes = codes_of(_matrix(rows.column(1), dim), *own)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(codes.view(np.int64))], ["cid", "code"])

    return map_arrow(classes.select("cid", "embedding"), run, "cid long, code long")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal values in the first ``keys`` columns."""
    carry = None
    for b in batches:
        rows = pa.Table.from_batches([b])
        rows = rows if carry is None else pa.concat_tables([carry, rows])
        if not len(rows):
            continue
        new = np.zeros(len(rows), dtype=bool)
        new[0] = True
        for i in range(keys):
            k = rows.column(i).to_numpy()
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new).tolist()
        for lo, hi in zip(starts, starts[1:], strict=False):
            yield rows.slice(lo, hi - lo)
        carry = rows.slice(starts[-1])
    if carry is not None and len(carry):
        yield carry


def linked_pairs(x: np.ndarray, own: np.ndarray, codes: np.ndarray, table: tuple[int, ...], across: bool,
                 threshold: float) -> np.ndarray:
    """Boolean matrix of the links of a group that ``table`` is the first to show."""
    norms = np.linalg.norm(x, axis=1)
    linked = (x @ x.T) / (norms[:, None] * norms[None, :]) >= threshold
    np.fill_diagonal(linked, False)
    if across:
        linked &= own[:, None] != own[None, :]
    i, j = np.nonzero(linked)
    equal = equal_chunks(codes[i], codes[j])
    a, b = table[0], table[-1]
    first = equal[:, a] & equal[:, b] & (equal[:, :b].sum(axis=1) == len(table) - 1) & ~equal[:, :a].any(axis=1)
    linked[i[~first], j[~first]] = False
    return linked


def _compare(tables: list[tuple], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for group in _runs(batches, 4):
            if len(group) < 2:
                continue
            lo, hi = group.column(2)[0].as_py(), group.column(3)[0].as_py()
            cid, own, n, code = (group.column(i).to_numpy() for i in (4, 5, 6, 7))
            dim, table = divmod(group.column(1)[0].as_py() >> 16, 32)
            x = _matrix(group.column(8).combine_chunks(), dim)
            linked = linked_pairs(x, own, code.view(np.uint64), tables[table], lo != hi, threshold)
            at = np.flatnonzero(linked.any(axis=1))
            if not len(at):
                continue
            parent = np.full(len(cid), -1)
            for root in at.tolist():
                if parent[root] < 0:
                    parent[root], todo = root, [root]
                    while todo:
                        k = todo.pop()
                        new = np.flatnonzero(linked[k] & (parent < 0))
                        parent[new] = k
                        todo += new.tolist()
            out.append((cid[at], cid[parent[at]], linked[at] @ n))
            size += len(at)
            if size > 50_000:
                yield _links(out)
                out, size = [], 0
        yield _links(out)

    return run


def _links(parts) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["a", "b", "links"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, sample_rows: int = SAMPLE_ROWS,
                    block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Rows link when their labels are equal and not null and the cosine of their
    vectors is at least ``threshold``; vectors of different lengths have no
    cosine.  Null and zero vectors and vectors with null or non-finite
    components link with nothing.  Equal vectors with equal labels
    always link; a repeated row is a vector of its own.  component_id is the
    smallest id reachable, itself included; a null id is never the smallest and
    is not kept.  Other columns are ignored; an empty table gives no row.
    ``sample_rows`` vectors of the commonest length, those with the least
    hashes, train the codes; all are indexed.
    """
    v = F.col(vector_col)
    usable = (F.col(label_col).isNotNull() & v.isNotNull()
              & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
              & F.exists(v, lambda c: c != 0))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                          v.cast("array<double>").alias("embedding"), F.coalesce(usable, F.lit(False)).alias("usable"))
    common = (rows.where("usable").groupBy(F.size("embedding").alias("dim")).count()
              .orderBy(F.desc("count"), F.desc("dim")).first())
    dim = common["dim"] if common else 1
    rows = rows.withColumn("cid", F.when(F.col("usable"), F.xxhash64("label", "embedding")))
    rows = stored(rows.select("vec_id", "label", "embedding", "cid"), "vectors")
    classes = stored(rows.where("cid is not null").groupBy("cid", "label", "embedding")
                     .agg(F.count("*").alias("n"), F.min("vec_id").alias("low")), "classes")

    sample = [r[0] for r in classes.where(F.size("embedding") == dim).orderBy(F.xxhash64("cid")).select("embedding").limit(sample_rows).collect()]
    x = np.array(sample, dtype=np.float64).reshape(-1, dim)
    mean, projection, tables, _ = fit_codes(x / np.linalg.norm(x, axis=1, keepdims=True), dim, threshold)
    coded = stored(_with_codes(classes, mean, projection).join(classes.select("cid", "label", F.size("embedding").alias("dim")), "cid"),
                   "codes")

    byte = [F.shiftrightunsigned("code", BITS - 8 * (i + 1)).bitwiseAND(F.lit(255)) for i in range(CHUNKS)]
    # the vector's length, the table's number and its chunks in one number
    keys = F.array(*(((F.col("dim").cast("long") * 32 + t) * 256 + byte[c[0]]) * 256
                     + (byte[c[1]] if len(c) > 1 else F.lit(0)) for t, c in enumerate(tables)))
    entries = coded.select("cid", "label", "code", F.explode(keys).alias("key"))
    full = (entries.groupBy("label", "key").agg(F.count("*").alias("m")).where("m > 1")
            .withColumn("blocks", F.ceil(F.col("m") / block_rows).cast("int")).drop("m"))
    placed = (entries.join(stored(full, "buckets"), ["label", "key"])
              .withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("label", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                      "cid", "own", "code"))
    groups = (placed.join(classes.select("cid", "n", "embedding"), "cid")
              .select("label", "key", "lo", "hi", "cid", "own", "n", "code", "embedding")
              .repartition("label", "key", "lo", "hi").sortWithinPartitions("label", "key", "lo", "hi"))
    links = stored(map_arrow(groups, _compare(tables, threshold), "a long, b long, links long"), "links")

    counts = links.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = connected_components(links).select(F.col("node").alias("cid"), "root")
    rooted = stored(classes.select("cid", "n", "low").join(counts, "cid", "left").join(roots, "cid", "left")
                    .withColumn("root", F.coalesce("root", "cid")), "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(rooted.join(lows, "root")
                   .select("cid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"),
                   "named")
    return (rows.select("vec_id", "cid").join(named, "cid", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
