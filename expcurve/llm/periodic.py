"""Periodic runs of words, found by internal pattern matching.

A run is a maximal stretch of words with a smallest period q, repeated at least
``min_exponent`` (4) times.  For q in [2b, 4b) with b a power of two, some
aligned (dyadic) block of b words lies in the run well away from its ends, and
the block occurs again q words further on.  So for every dyadic block that
occurs more than once in its document, its next occurrences within 4b words are
asked for: the block is an interval of the suffix array, and a wavelet matrix
over the array gives the smallest position in that interval past a place (range
successor).  Occurrences at most b/2 apart form an arithmetic progression with
the block's own period; a progression is crossed in one step, and the distance
from the first member of the block's progression to the first member of a later
one is the candidate period.  A candidate is extended to both sides with
longest common extensions and counts if the stretch is long enough; of equal
stretches the smallest period stands.

Suffixes are sorted by prefix doubling, one document after the other in one
array, so a batch of short documents costs as many numpy calls as a long one.
The ranks of every doubling step are kept: they name the dyadic blocks and
answer the extension queries.  Documents in which no four words occur twice
have their suffixes sorted after two steps and hold no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expcurve.llm.common import map_arrow, text_or_empty

MIN_LENGTH = 6
MIN_EXPONENT = 4
_BATCH_WORDS = 150_000


class SuffixRanks:
    """Suffixes of documents laid one after another, sorted by document, then by words.

    ``ranks[k][i]`` is the first place in the sorted array of the suffixes that
    share document and 2**k words with suffix i; a suffix with fewer words has
    a place of its own.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        n = len(words)
        self.n, self.doc = n, doc
        self.end = np.searchsorted(doc, doc, side="right")
        key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        key = key[order]
        self.sa = order.copy()
        rank = np.empty(n, dtype=np.int64)
        first = self._firsts(key)
        rank[order] = first
        self.ranks = [rank]
        self.active = order[self._repeated(first)]      # in sorted order

    @staticmethod
    def _firsts(key: np.ndarray) -> np.ndarray:
        """For every place of a sorted array, the first place with the same key."""
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        return starts[np.cumsum(new) - 1]

    @staticmethod
    def _repeated(first: np.ndarray) -> np.ndarray:
        return np.bincount(first, minlength=len(first))[first] > 1

    def refine(self) -> None:
        """Sort by twice as many words; only suffixes that are not alone yet take part."""
        step, rank, act = 1 << (len(self.ranks) - 1), self.ranks[-1], self.active
        after = np.minimum(act + step, self.n - 1)
        second = np.where(act + step < self.end[act], rank[after], -1)
        key = rank[act] * (self.n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        act, key = act[order], key[order]
        group = self._firsts(rank[act])
        slot = rank[act] + np.arange(len(act)) - group
        first = self._firsts(key)
        rank = rank.copy()
        rank[act] = slot[first]
        self.sa[slot] = act
        self.ranks.append(rank)
        self.active = act[self._repeated(first)]

    def sort(self) -> None:
        while len(self.active):
            self.refine()

    def common_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from places i < j of one document on."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i + out, np.minimum(j + out, self.n - 1)
            out += np.where((j + out < self.end[i]) & (self.ranks[k][a] == self.ranks[k][b]), 1 << k, 0)
        return out

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words before places i < j of one document."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i - out - (1 << k), j - out - (1 << k)
            out += np.where((a >= 0) & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)]), 1 << k, 0)
        return out


class WaveletMatrix:
    """Range queries over an array of numbers below 2**bits, many at a time."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros = []                       # zeros before each place, by bit from the highest
        values = values.copy()
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~ones, dtype=np.int32)]).astype(np.int32))
            values = np.concatenate([values[~ones], values[ones]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of places lo..hi-1 are under x."""
        over = x >= 1 << self.bits
        total = hi - lo
        count = np.zeros(len(lo), dtype=np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (x >> (self.bits - 1 - level) & 1).astype(bool)
            lo0, hi0 = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            count += np.where(one, hi0 - lo0, 0)
            lo = np.where(one, zeros[-1] + lo - lo0, lo0)
            hi = np.where(one, zeros[-1] + hi - hi0, hi0)
        return np.where(over, total, count)

    def smallest(self, lo: np.ndarray, hi: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The nth smallest (from 0) of the values of places lo..hi-1."""
        out = np.zeros(len(lo), dtype=np.int64)
        for level, zeros in enumerate(self.zeros):
            lo0, hi0 = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            one = nth >= hi0 - lo0
            nth = np.where(one, nth - (hi0 - lo0), nth)
            out |= np.where(one, 1 << (self.bits - 1 - level), 0)
            lo = np.where(one, zeros[-1] + lo - lo0, lo0)
            hi = np.where(one, zeros[-1] + hi - hi0, hi0)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value >= x of places lo..hi-1, or -1."""
        rank = self.below(lo, hi, x)
        out = np.full(len(lo), -1, dtype=np.int64)
        has = np.flatnonzero(rank < hi - lo)
        out[has] = self.smallest(lo[has], hi[has], rank[has])
        return out

    def predecessor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The largest value < x of places lo..hi-1, or -1."""
        rank = self.below(lo, hi, x)
        out = np.full(len(lo), -1, dtype=np.int64)
        has = np.flatnonzero(rank > 0)
        out[has] = self.smallest(lo[has], hi[has], rank[has] - 1)
        return out


def _near_occurrences(tree: WaveletMatrix, i: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple]:
    """(place, period) candidates of periods 1 to 3: occurrences of one word within three words."""
    at = i
    for _ in range(3):
        nxt = tree.successor(lo, hi, at + 1)
        ok = (nxt >= 0) & (nxt - i <= 3)
        i, lo, hi, at = i[ok], lo[ok], hi[ok], nxt[ok]
        if not len(i):
            return
        yield i, at - i


def _block_occurrences(ranks: SuffixRanks, tree: WaveletMatrix, b: int, i: np.ndarray, lo: np.ndarray,
                       hi: np.ndarray) -> Iterator[tuple]:
    """(place, period) candidates of periods 2b to 4b - 1 for blocks of b words at places i."""
    at = tree.successor(lo, hi, i + 1)
    near = (at >= 0) & (at - i < 4 * b)
    i, lo, hi, nxt = i[near], lo[near], hi[near], at[near]
    if not len(i):
        return
    before = tree.predecessor(lo, hi, i)
    first = i.copy()                          # the first member of the progression that i is in
    m = np.flatnonzero((before >= 0) & (2 * (i - before) <= b))
    step = i[m] - before[m]
    first[m] = before[m] - ranks.common_before(before[m], i[m]) // step * step
    at = i
    while len(i):
        m = np.flatnonzero(2 * (nxt - at) <= b)          # cross the progression
        step = nxt[m] - at[m]
        last = at[m] + (step + ranks.common_after(at[m], nxt[m]) - b) // step * step
        nxt[m] = tree.successor(lo[m], hi[m], last + 1)
        ok = (nxt >= 0) & (nxt - first < 4 * b)
        i, lo, hi, first, at = i[ok], lo[ok], hi[ok], first[ok], nxt[ok]
        far = at - first >= 2 * b
        yield first[far], (at - first)[far]
        nxt = tree.successor(lo, hi, at + 1)
        ok = (nxt >= 0) & (nxt - first < 4 * b)
        i, lo, hi, first, at, nxt = i[ok], lo[ok], hi[ok], first[ok], at[ok], nxt[ok]


def runs_of(words: np.ndarray, doc: np.ndarray, min_length: int = MIN_LENGTH,
            min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; starts are places in ``words``.

    ``words`` has a number for each word, ``doc`` the ascending number of its document.
    """
    none = np.zeros(0, dtype=np.int64)
    short = SuffixRanks(words, doc)
    for _ in range(2):
        if len(short.active):
            short.refine()
    if not len(short.active):                 # no four words occur twice in a document
        return none, none, none
    has = np.zeros(int(doc[-1]) + 1, dtype=bool)
    has[doc[short.active]] = True
    kept = np.flatnonzero(has[doc])
    ranks = SuffixRanks(words[kept], doc[kept])
    ranks.sort()
    tree = WaveletMatrix(ranks.sa)

    found: list[tuple] = []
    longest = int(np.bincount(ranks.doc).max())
    for k, rank in enumerate(ranks.ranks):
        b = 1 << k
        if k and 2 * b * min_exponent > longest:
            break
        size = np.bincount(rank, minlength=ranks.n)
        if k:
            i = np.arange(0, ranks.n, b)
            i = i[size[rank[i]] > 1]
            found.extend(_block_occurrences(ranks, tree, b, i, rank[i], rank[i] + size[rank[i]]))
        else:
            four = ranks.ranks[2]
            i = np.flatnonzero(np.bincount(four, minlength=ranks.n)[four] > 1)
            found.extend(_near_occurrences(tree, i, rank[i], rank[i] + size[rank[i]]))
    if not found:
        return none, none, none
    i, q = (np.concatenate(c) for c in zip(*found, strict=True))
    i, q = np.divmod(np.unique(i * (ranks.n + 1) + q), ranks.n + 1)
    start = i - ranks.common_before(i, i + q)
    length = ranks.common_after(i, i + q) + i - start + q
    ok = length >= np.maximum(min_length, min_exponent * q)
    start, length, q = start[ok], length[ok], q[ok]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])]) if len(q) else []
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    return kept[start[order]], length[order], q[order]


_RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs_batch(ids: list, texts: list[list[bytes]], min_length: int, min_exponent: int) -> pa.RecordBatch:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    numbers: dict[bytes, int] = {}
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), dtype=np.int64,
                       count=int(offset[-1]))
    doc = np.repeat(np.arange(len(texts)), sizes)
    start, length, period = runs_of(flat, doc, min_length, min_exponent)
    owner = doc[start]
    change = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)      # a word goes if a run has it after its first period
    np.add.at(change, start + length, -1)
    dropped = np.cumsum(change) > 0
    collapsed = [b" ".join(t) for t in texts]
    for d in np.unique(owner):
        gone = dropped[offset[d]:offset[d + 1]]
        collapsed[d] = b" ".join(w for w, g in zip(texts[d], gone, strict=True) if not g)
    per_doc = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)
    parts = [pa.array(x) for x in (start - offset[owner], length, period)]
    runs = pa.ListArray.from_arrays(pa.array(per_doc), pa.StructArray.from_arrays(parts, fields=list(_RUN)))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(sizes), runs, pa.array(collapsed, pa.binary()).cast(pa.string())],
        ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row: the periodic runs of its words, by start and period,
    and its text with one period of every run left, words joined by one space.

    Words are separated by ASCII white space and compared byte by byte.  A run
    has at least ``min_length`` words and ``min_exponent`` (4 or more) periods
    and can't be extended; runs may overlap.  Null and empty texts have no
    words, no runs and an empty collapsed text.  Rows are judged one by one, so
    a null or repeated id is kept as it is; other columns are ignored; an empty
    table gives no rows.  A document is worked on whole by one task, in memory
    that grows with its words times their logarithm.
    """
    if min_exponent < 4:
        raise ValueError("a run must repeat four times to be sure to hold a block away from its ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py().encode("utf-8", "replace").split())
                size += len(texts[-1])
                if size >= _BATCH_WORDS:
                    yield _runs_batch(ids, texts, min_length, min_exponent)
                    ids, texts, size = [], [], 0
            if ids:
                yield _runs_batch(ids, texts, min_length, min_exponent)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")),
                     run, _RUNS)


def digest(found: DataFrame) -> DataFrame:
    """One row per row of ``periodic_runs``: number of runs, the longest one (ties: smallest start, then
    period; nulls if there is none) and SHA-256 digests of the list of runs and of the collapsed text."""
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct(
        (-r.length).alias("less"), r.start.alias("start"), r.period.alias("period")))), 1)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    best = F.when(F.size("runs") > 0, best)
    listing = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return (found.withColumn("_best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
                    (-F.col("_best.less")).alias("length"), F.col("_best.period").alias("period"),
                    F.floor(1000 * -F.col("_best.less") / F.col("_best.period")).alias("exponent_milli"),
                    F.sha2(listing.cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a periodic tail in about one text of ten, chosen by the CRC-32 of the id.

    With h the CRC-32 of the id in decimals, g = h div 10 and n > 0 words, a
    text with h mod 10 = 0 has word i >= a replaced by word a + (i - a) mod p,
    where a = g mod n and p = 1 + (n - a) div (3 + g mod 8); its words are
    joined by one space.  Other texts, and rows with a null id, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(text_or_empty(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(ws):
        n = F.size(ws)
        g = F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        at = F.sequence(F.lit(0), n - 1)
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(ws, F.when(i < a, i).otherwise(
            a + (i - a) % p))), " ")).otherwise("")

    changed = F.get(F.transform(F.array(words), planted), F.lit(0))
    return docs.withColumn(text_col, F.when(h % 10 == 0, changed).otherwise(F.col(text_col)))
