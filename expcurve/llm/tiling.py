"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds (hashes of
``min_match`` consecutive words).  For each pair, running Karp-Rabin matching
marks the longest common runs of words first, none overlapping, down to
``min_match`` words.  Marked tiles may stand in any order, so a passage with
its sentences moved about is still covered.  A document is contaminated by an
item when tiles cover at least ``min_coverage`` of the item's words.

Scale: one scan of the documents keeps the words around possible seeds alone.
It tests a bitmap of a fixed size (2 MB) that Spark builds from the benchmark's
seeds; a hit is only a hint, the join on seeds decides.  No text is shuffled,
and the join is a plain shuffle join that adaptive execution may broadcast or
split.  A seed that very many documents share would give a row per document and
item that has it; each item leaves out as many places of its commonest seeds
as a copy can do without (a copy must share more seeds than these), and what
they might have added is allowed for in the bound on shared places.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from expcurve.llm.common import map_arrow, stored, text_or_empty
from expcurve.llm.rolling import window_hashes, word_hashes

MIN_MATCH = 5
MIN_COVERAGE = 0.8
FIRST_LENGTH = 20
STOCK_DOCUMENTS = 100
BITMAP_BITS = 1 << 24
_BUCKET_BITS = 1 << 15                    # of Spark's bitmap functions
#: Unicode blocks of scripts written without spaces; each of their characters is a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(f"[{_UNSPACED}]|[^\\W{_UNSPACED}]+")
_PRIME = (1 << 61) - 1
_RADIX = 1_000_003


def words_of(text: str) -> list[bytes]:
    """Lower-cased words, without punctuation; in scripts without spaces, characters."""
    return [w.encode() for w in _WORD.findall(text.lower())]


# ------------------------------------------------------------ one pair

def _runs(marked: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Unmarked stretches of at least ``length`` tokens."""
    start = None
    for i, m in enumerate([*marked, True]):
        if m:
            if start is not None and i - start >= length:
                yield start, i
            start = None
        elif start is None:
            start = i


def _rolled(tokens: list, marked: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(place, hash) of every unmarked window of ``length`` tokens, the hash updated from place to place."""
    top = pow(_RADIX, length - 1, _PRIME)
    for lo, hi in _runs(marked, length):
        h = 0
        for t in tokens[lo:lo + length]:
            h = (h * _RADIX + t) % _PRIME
        yield lo, h
        for i in range(lo + 1, hi - length + 1):
            h = ((h - tokens[i - 1] * top) * _RADIX + tokens[i + length - 1]) % _PRIME
            yield i, h


def _scan(item, doc, item_marked, doc_marked, length):
    """(matches, longest): maximal matches of at least ``length``; stops early at one over twice that,
    or at the first one with all that is left of the item, as nothing can come before it or beside it."""
    places, left = defaultdict(list), len(item) - sum(item_marked)
    for i, h in _rolled(item, item_marked, length):
        places[h].append(i)
    matches, after = [], -1
    for d, h in _rolled(doc, doc_marked, length):
        for i in places.get(h, ()):
            if d < after and i > 0 and item[i - 1] == doc[d - 1] and not item_marked[i - 1] and not doc_marked[d - 1]:
                continue                # the inside of a match found one place before
            n = 0
            while (i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                   and not item_marked[i + n] and not doc_marked[d + n]):
                n += 1
            if n == left:
                return [(n, i, d)], 0
            if n > 2 * length:
                return [], n
            if n >= length:
                matches.append((n, i, d))
                after = max(after, d + n)
    return matches, 0


def greedy_string_tiling(item: list[int], doc: list[int], min_match: int = MIN_MATCH,
                         first_length: int = FIRST_LENGTH) -> list[tuple[int, int, int]]:
    """(length, item place, document place) of tiles, longest first; no token is in two tiles.

    Tokens are non-negative integers.  Of equally long matches the first in the
    document is taken, then the first in the item.
    """
    item_marked, doc_marked = [False] * len(item), [False] * len(doc)
    tiles, length = [], max(min_match, min(first_length, len(item)))
    while True:
        matches, longer = _scan(item, doc, item_marked, doc_marked, length)
        if longer:
            length = longer
            continue
        queue = [(-n, d, i) for n, i, d in matches]
        heapq.heapify(queue)
        while queue:
            n, d, i = heapq.heappop(queue)
            n = -n
            taken = [item_marked[i + k] or doc_marked[d + k] for k in range(n)]
            if not any(taken):
                item_marked[i:i + n] = [True] * n
                doc_marked[d:d + n] = [True] * n
                tiles.append((n, i, d))
                continue
            for lo, hi in _runs(taken, length):     # what an earlier tile left of this match
                heapq.heappush(queue, (lo - hi, d + lo, i + lo))
        if length == min_match:
            return tiles
        length = length // 2 if length > 2 * min_match else min_match


# ------------------------------------------------------------ tables

def item_seeds(benchmark: DataFrame, min_match: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item_key, words, seeds) of the items with a seed at least; words are their hashes,
    seeds are distinct and come with the number of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [word_hashes(words_of(t.as_py())) for t in b.column(1)]
            seeds = [np.unique(window_hashes(w, min_match), return_counts=True) for w in words]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())),
                 pa.array([s.view(np.int64) for s, _ in seeds], pa.list_(pa.int64())),
                 pa.array([n.astype(np.int32) for _, n in seeds], pa.list_(pa.int32()))],
                ["item_id", "words", "seeds", "counts"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), text_or_empty(text_col).alias("text"))
    rows = map_arrow(rows, run, "item_id long, words array<long>, seeds array<long>, counts array<int>")
    return rows.where("size(seeds) > 0").withColumn("item_key", F.xxhash64("words"))


def seed_bitmap(seeds: DataFrame) -> np.ndarray:
    """Bits of the seeds that occur, folded to BITMAP_BITS: at most 2 MB, whatever the benchmark's size."""
    slot = F.pmod(F.col("seed"), F.lit(BITMAP_BITS))
    rows = (seeds.select(slot.alias("slot"))
            .groupBy(F.floor(F.col("slot") / _BUCKET_BITS).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(_BUCKET_BITS))).alias("bits")).collect())
    bits = np.zeros(BITMAP_BITS, dtype=bool)
    for r in rows:
        part = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), bitorder="little")
        bits[r["bucket"] * _BUCKET_BITS:][:len(part)] = part
    return bits


def hinted_documents(docs: DataFrame, bits: np.ndarray, min_match: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_key, places, words, seeds, counts) of documents with a hint: the words in hinted windows alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(shared.value).astype(bool)
        fold = np.uint64(BITMAP_BITS - 1)
        for b in batches:
            rows = []
            for doc_id, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = word_hashes(words_of(text.as_py()))
                seeds = window_hashes(words, min_match)
                at = np.flatnonzero(bitmap[(seeds & fold).astype(np.int64)])
                if len(at):
                    places = np.unique((at[:, None] + np.arange(min_match)).ravel())
                    hinted, count = np.unique(seeds[at], return_counts=True)
                    rows.append((doc_id, key, places.astype(np.int32), words[places].view(np.int64),
                                 hinted.view(np.int64), count.astype(np.int32)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()),
                     pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             ["doc_id", "doc_key", "places", "words", "seeds", "counts"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_key"), text.alias("text"))
    return map_arrow(rows, run, "doc_id long, doc_key long, places array<int>, words array<long>, seeds array<long>, "
                                "counts array<int>")


def _counted_seeds(rows: DataFrame, *keys: str, count: str) -> DataFrame:
    """One row per key and distinct seed, with the number of the seed's places."""
    return (rows.select(*keys, F.explode(F.arrays_zip("seeds", "counts")).alias("_s"))
            .select(*keys, F.col("_s.seeds").alias("seed"), F.col("_s.counts").alias(count)))


def left_out_seeds(doc_seeds: DataFrame, seeds: DataFrame, items: DataFrame, min_match: int, min_coverage: float,
                   stock_documents: int) -> DataFrame:
    """(item_id, item_key, seed, left_out): seeds that an item need not be probed with.

    A text that covers enough of an item of n words shares n * min_coverage /
    min_match seed places with it at least.  While fewer places than that are
    left out, it still shares one of the others.  Seeds in more than
    ``stock_documents`` texts are left out, commonest first; ``left_out`` is
    the item's number of places up to this seed.
    """
    stock = doc_seeds.groupBy("seed").agg(F.count("*").alias("texts")).where(F.col("texts") > stock_documents)
    size = items.select("item_id", "item_key", F.size("words").alias("n")).distinct()
    common = seeds.join(stock, "seed").alias("s").join(
        size.alias("i"), F.expr("s.item_id <=> i.item_id and s.item_key = i.item_key"))
    first = Window.partitionBy("s.item_id", "s.item_key").orderBy(F.desc("texts"), "seed")
    return (common.select("s.item_id", "s.item_key", "seed", "n", F.sum("item_places").over(first).alias("left_out"))
            .where(F.col("left_out") * min_match < F.col("n") * min_coverage).drop("n"))


def probes(seeds: DataFrame, left_out: DataFrame) -> DataFrame:
    """The seeds of items that are not left out."""
    same = F.expr("s.item_id <=> c.item_id and s.item_key = c.item_key and s.seed = c.seed")
    return seeds.alias("s").join(left_out.alias("c"), same, "left_anti")


def _tile(min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, key, item_id, places, words, item in zip(*(c.to_pylist() for c in b.columns), strict=True):
                doc, last = [], None
                number: dict[int, int] = {}
                for p, w in zip(places, words, strict=True):
                    if last is not None and p != last + 1:
                        doc.append(0)   # a gap; no item token is 0
                    doc.append(number.setdefault(w, len(number) + 1))
                    last = p
                tokens = [number.setdefault(w, len(number) + 1) for w in item]
                tiles = greedy_string_tiling(tokens, doc, min_match)
                out.append((doc_id, key, item_id, len(tokens), sum(n for n, _, _ in tiles), len(tiles)))
            columns = zip(*out, strict=True) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             ["doc_id", "doc_key", "item_id", "item_words", "covered_words", "tiles"])

    return run


def tiled_documents(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH,
                    min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text",
                    item_id_col: str = "item_id", item_text_col: str = "text",
                    stock_documents: int = STOCK_DOCUMENTS) -> DataFrame:
    """(doc_id, doc_key, item_id, item_words, covered_words, tiles, coverage) of every text that covers enough
    of an item; doc_key is the hash of the text.  ``stock_documents`` changes the work, not the result."""
    items = stored(item_seeds(benchmark, min_match, item_id_col, item_text_col), "items")
    seeds = stored(_counted_seeds(items, "item_id", "item_key", count="item_places").distinct(), "seeds")
    hinted = stored(hinted_documents(docs, seed_bitmap(seeds.select("seed").distinct()), min_match, id_col, text_col)
                    .dropDuplicates(["doc_id", "doc_key"]), "hinted")
    pair = ["doc_id", "doc_key", "item_id", "item_key"]
    size = items.select(F.col("item_id").alias("_item"), F.col("item_key").alias("_key"), F.size("words").alias("_n"),
                        F.col("words").alias("item")).dropDuplicates(["_item", "_key"])
    doc_seeds = _counted_seeds(hinted, "doc_id", "doc_key", count="doc_places")
    common = stored(left_out_seeds(doc_seeds, seeds, items, min_match, min_coverage, stock_documents), "common")
    of_item = F.expr("s.item_id <=> c.item_id and s.item_key = c.item_key")
    hits = (doc_seeds.join(probes(seeds, common), "seed")
            .groupBy(*pair).agg(F.sum(F.least("item_places", "doc_places")).alias("hits")))
    spare = common.groupBy("item_id", "item_key").agg(F.max("left_out").alias("left_out"))
    hits = hits.alias("s").join(spare.alias("c"), of_item, "left").select("s.*", F.coalesce("left_out", F.lit(0)).alias("spare"))
    # a tile of n words has n - min_match + 1 seeds at as many places on either side, so fewer than this can't cover enough
    pairs = (hits.join(size, hits["item_id"].eqNullSafe(F.col("_item")) & (F.col("item_key") == F.col("_key")))
             .where((F.col("hits") + F.col("spare")) * min_match >= F.col("_n") * min_coverage)
             .select(*pair, "item"))
    text = hinted.select(F.col("doc_id").alias("_doc"), F.col("doc_key").alias("_dkey"), "places", "words")
    both = pairs.join(text, pairs["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("doc_key") == F.col("_dkey")))
    tiled = map_arrow(both.select("doc_id", "doc_key", "item_id", "places", "words", "item"), _tile(min_match),
                      "doc_id long, doc_key long, item_id long, item_words int, covered_words int, tiles int")
    tiled = tiled.withColumn("coverage", F.col("covered_words") / F.col("item_words"))
    return tiled.where(F.col("coverage") >= min_coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH,
                 min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, tiles, coverage) of contaminated documents.

    Words are runs of letters, digits and underscores, lower-cased, and single
    characters in scripts written without spaces; whole texts are read.  Null and empty texts have no words.  Items under ``min_match``
    words have no tile of that length and match nothing.  Rows that repeat an
    id count once, with the best coverage among their texts; null ids are ids
    like any other.  Other columns are ignored; with an empty table on either
    side the result is empty.
    """
    tiled = tiled_documents(docs, benchmark, min_match, min_coverage, id_col, text_col, item_id_col, item_text_col)
    return (tiled.groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("coverage", "item_words", "covered_words", "tiles")).alias("b"))
            .select("doc_id", "item_id", "b.item_words", "b.covered_words", "b.tiles", "b.coverage"))
