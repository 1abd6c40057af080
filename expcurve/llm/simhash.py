"""SimHash near-duplicates, candidates by pigeonring chains.

A document's fingerprint holds, for each of 64 bits, the majority over the
hashes of its word shingles.  Fingerprints within ``max_distance`` bits are
linked.

Pigeonring filter.  Put the 64 bits on a ring of ``segments`` segments.  If
two fingerprints differ in at most t bits, then some segment starts a chain
in which, for every length l, the first l segments differ in at most
floor(l*t/segments) bits.  The chain's first lengths have budget 0 (equal
bits), the next have budget 1 (so one half of those bits is equal): that
makes an equi-join key of 28 of the 64 bits at the defaults.  The remaining
chain budgets are checked inside the join, before any row leaves it; the last
budget is the full Hamming check.

Scale: only distinct fingerprints are joined, so copies cost nothing.  Buckets
with more than ``dense_bucket`` distinct fingerprints are cut into blocks; each
pair of blocks is one bounded group which returns a spanning forest of its
links instead of its pairs.  No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expcurve.llm.common import map_arrow, stored, text_key
from expcurve.llm.graph import connected_components

HASH_SEED = 42
BITS = 64
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text.

    Lower-cases A-Z only; words are separated by ASCII white space.  Shingles
    count as often as they occur; with fewer words than ``shingle`` the whole
    sequence is one shingle; without words the fingerprint is 0.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, n, _CHUNK):
        part = words[lo:min(n, lo + _CHUNK) + shingle - 1]
        rows = zip(*(part[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [part]
        hashes = [xxhash.xxh64_intdigest(b" ".join(r), HASH_SEED) for r in rows]
        by_byte = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.concatenate([np.bincount(by_byte[:, j], minlength=256) @ _BITS_OF_BYTE for j in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """(id, fp, text_key): the fingerprint as a signed long and a hash of the text, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)],
                                             ["id", "fp", "text_key"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"),
                                 text_key(text_col).alias("text_key")), run, "id long, fp long, text_key long")


def chain(segments: int, max_distance: int) -> tuple[list[tuple[int, int]], list[int]]:
    """([(mask, budget) for each chain length], [key masks]) in a segment's own rotation."""
    if BITS % segments or not 0 <= max_distance < segments:
        raise ValueError("segments must divide 64 and exceed max_distance")
    width = BITS // segments
    budgets = [(l * max_distance) // segments for l in range(1, segments + 1)]
    equal = sum(b == 0 for b in budgets) * width
    one_off = sum(b <= 1 for b in budgets) * width
    if one_off > equal:
        half = equal + (one_off - equal) // 2
        keys = [(1 << half) - 1, ((1 << one_off) - 1) ^ ((1 << half) - 1) | ((1 << equal) - 1)]
    else:
        keys = [(1 << equal) - 1]
    return [((1 << (l * width)) - 1, budgets[l - 1]) for l in range(1, segments + 1)], keys


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(max_distance: int):
    def run(group: pa.Table) -> pa.Table:
        x = np.unique(group.column("fp").to_numpy()).view(np.uint64)
        left = np.ones(len(x), dtype=bool)
        found: list[tuple[int, int]] = []
        for first in range(len(x)):
            if not left[first]:
                continue
            left[first], todo = False, [first]
            while todo:
                at = todo.pop()
                rest = np.flatnonzero(left)
                new = rest[np.bitwise_count(x[rest] ^ x[at]) <= max_distance]
                left[new] = False
                todo += new.tolist()
                found += [(at, i) for i in new.tolist()]
        signed = x.view(np.int64)
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": signed[pairs[:, 0]], "b": signed[pairs[:, 1]]})

    return run


def fingerprint_links(fps: DataFrame, max_distance: int = 3, segments: int = 8,
                      dense_bucket: int = 4096) -> DataFrame:
    """Edges (a, b) whose components are those of all links of the distinct ``fp`` column."""
    checks, key_masks = chain(segments, max_distance)
    width = BITS // segments
    slots = []
    for i in range(segments):
        # Java shifts count modulo 64, so the rotation by 0 is the value itself
        rot = F.expr(f"shiftrightunsigned(fp, {i * width}) | shiftleft(fp, {BITS - i * width})")
        slots += [F.struct(F.lit(i * len(key_masks) + k).alias("slot"), rot.alias("rot"),
                           rot.bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(key_masks)]
    keys = stored(fps.select("fp", F.explode(F.array(*slots)).alias("s")).select("fp", "s.*"), "keys")
    dense = stored(keys.groupBy("slot", "key").agg(F.count("*").alias("n"))
                   .where(F.col("n") > dense_bucket), "dense")
    small = keys.join(dense, ["slot", "key"], "left_anti")

    a, b = small.alias("a"), small.alias("b")
    diff = F.col("a.rot").bitwiseXOR(F.col("b.rot"))
    on = [F.col("a.slot") == F.col("b.slot"), F.col("a.key") == F.col("b.key"), F.col("a.fp") < F.col("b.fp")]
    on += [F.bit_count(diff.bitwiseAND(F.lit(_signed(m)))) <= n for m, n in checks]
    pairs = a.join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    blocks = F.ceil(F.col("n") / dense_bucket).cast("int")
    forests = (keys.join(dense, ["slot", "key"])
               .select("slot", "key", "fp", F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"),
                       F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
               .select("slot", "key", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
               .groupBy("slot", "key", "lo", "hi").applyInArrow(_forest(max_distance), "a long, b long"))
    return pairs.union(forests)


def fingerprint_roots(rows: DataFrame, max_distance: int = 3, segments: int = 8,
                      dense_bucket: int = 4096) -> DataFrame:
    """(fp, low, root) of the distinct fingerprints of ``rows`` (id, fp): the smallest id that has one, and the
    fingerprint that stands for its component."""
    each = stored(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    links = fingerprint_links(each.select("fp"), max_distance, segments, dense_bucket)
    linked = connected_components(links).select(F.col("node").alias("fp"), "root")
    rooted = each.join(linked, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return stored(rooted, "rooted")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   max_distance: int = 3, segments: int = 8, dense_bucket: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    component_id is the smallest id reachable over links (itself included).
    Null and empty texts, or texts of white space, have fingerprint 0 and link
    like any other.  A row with a null id gets its group's smallest id (null if
    there is none).  Repeated rows are each returned.  Other columns of
    ``docs`` are ignored; an empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle).drop("text_key"), "fingerprints")
    rooted = fingerprint_roots(rows, max_distance, segments, dense_bucket)
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(rooted.join(low, "root").select("fp", "component_id"), "named")
    return (rows.join(named, "fp")
            .select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    "component_id"))


def group_choice(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 max_distance: int = 3, segments: int = 8, dense_bucket: int = 4096) -> DataFrame:
    """(id, text_key, chosen, n): every different (id, text) with its number of rows, and whether it is the one
    that stands for its group: that with the smallest id (a null id is larger than all), then text hash."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    rooted = fingerprint_roots(rows, max_distance, segments, dense_bucket)
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "text_key")
    # a fingerprint's least row first, so a group's choice is made among distinct fingerprints
    least = rows.groupBy("fp").agg(F.min(order).alias("least")).join(rooted.select("fp", "root"), "fp")
    chosen = (least.groupBy("root").agg(F.min("least").alias("least"))
              .select(F.col("least.id").alias("_id"), F.col("least.text_key").alias("_key"), F.lit(True).alias("chosen")))
    texts = rows.groupBy("id", "text_key").agg(F.count("*").alias("n"))
    same = texts["id"].eqNullSafe(chosen["_id"]) & (texts["text_key"] == chosen["_key"])
    return texts.join(chosen, same, "left").select("id", "text_key", F.coalesce("chosen", F.lit(False)).alias("chosen"), "n")
