"""Harmonic packing of tokenised documents into fixed-length sequences.

Harmonic packing puts a document of length n into the reciprocal-capacity
class k = capacity // n and gives every bin of class k exactly k documents.
Classes never meet, so a worker fills its bins alone: no shuffle, no shared
state, and a task that is run again only replaces its own sequences.

Documents stay whole in their class.  What k documents leave of a bin's
capacity is filled afterwards: with a whole document that fits, or by cutting
one.  Documents longer than a sequence, which are cut anyway, are cut for this
first; others only when many bins wait for a filling.  A filling always ends
its sequence, and none that has another place leaves a document's end id alone.
At a worker's end the open bins and what waits are packed best-fit, largest
first; the emptiest are cut to fill the fullest, and the last one is cut into
sequences whose lengths are powers of two, which need no padding.  So there is
no padding at all, and a worker cuts few documents that fit into one sequence.

Tokens.  A byte-level BPE splits a text into pieces before it merges, and a
single space always opens a new piece, so the ids of a text are the ids of its
space-separated units in order.  Units repeat much more than texts: each worker
keeps the ids of recent units (bounded) and merges only new ones.  Texts with
runs of white space are merged whole.  The vocabulary is read from the given
tokenizer file; its merge ranks are its ids, which tiktoken applies about four
times as fast as the library that the file is made for.  Tests compare the two.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expcurve.llm.common import map_arrow, text_or_empty

TOKENIZER = "byte_bpe_50k.json"
END_ID = 1
CAPACITY = 2048
KEPT_UNITS = 150_000
LONGEST_KEPT = 64


class _Whole(Exception):
    """The text has to be merged whole."""


class _Units(dict):
    """Ids of " " + unit as bytes, for the units met lately."""

    def __init__(self, encode, kept: int):
        super().__init__()
        self.encode, self.kept, self.before = encode, kept, {}

    def __missing__(self, unit: str) -> bytes:
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise _Whole
        ids = self.before.get(unit)
        if ids is None:
            ids = self.encode(" " + unit)
        if len(unit) <= LONGEST_KEPT:
            if len(self) >= self.kept:
                self.before = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class ByteBpe:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kept: int = KEPT_UNITS):
        import public_tokenizers
        import tiktoken
        from tokenizers import pre_tokenizers

        self.path = path
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        vocabulary = stated["model"]["vocab"]
        self.added = {t["content"] for t in stated["added_tokens"]}
        # the file writes every byte as a printable character; this finds each one's character
        alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
        plain = {c: ord(c) for c in alphabet if ord(c) < 256}
        moved = iter(sorted(c for c in alphabet if ord(c) >= 256))
        byte_of = plain | {next(moved): b for b in range(256) if b not in set(plain.values())}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in vocabulary.items() if word not in self.added}
        self.merge = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={})._core_bpe.encode_ordinary
        self.units = _Units(self._merged, kept)

    def forget(self) -> None:
        """Drop the units kept, so a worker that goes on with other work does not hold them."""
        self.units.before = {}
        self.units.clear()

    def _merged(self, text: str) -> bytes:
        return array("I", self.merge(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return array("I", reference_ids(self.path, text)).tobytes()
        head, *rest = text.split(" ")
        if head and head[-1].isspace():
            return self._merged(text)
        try:
            return self._merged(head) + b"".join(map(self.units.__getitem__, rest))
        except _Whole:
            return self._merged(text)


def reference_ids(path: str, text: str) -> list[int]:
    """Ids as the file's own library gives them; used for the rare texts that hold a special token."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


_LOADED: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def powers_of_two(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


class _Bin:
    """A sequence in the making: pieces (doc_id, start, ids, doc_tokens) and the ids it has room for."""

    __slots__ = ("free", "pieces")

    def __init__(self, free: int):
        self.free, self.pieces = free, []

    def put(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.free -= len(piece[2]) // 4


def _split(piece: tuple, n: int) -> tuple[tuple, tuple]:
    doc_id, start, ids, total = piece
    return (doc_id, start, ids[:4 * n], total), (doc_id, start + n, ids[4 * n:], total)


class HarmonicBins:
    """One worker's bins: an open bin for each reciprocal-capacity class, and the bins of full classes that
    wait for a filling, by the room they have (``waiting`` at most, so memory is bounded)."""

    def __init__(self, capacity: int, first_id: int, waiting: int = 256):
        self.capacity, self.next_id, self.most_waiting = capacity, first_id, waiting
        self.open: dict[int, _Bin] = {}
        self.waiting: list[tuple[int, int, _Bin]] = []      # ascending room
        self.order = 0

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for p in pieces:
            out.append((p, self.next_id, at))
            at += len(p[2]) // 4
        self.next_id += 1
        return out

    def _wait(self, bin_: _Bin) -> list[tuple]:
        """The bin's pieces if it is full; else it waits."""
        if not bin_.free:
            return self._close(bin_.pieces)
        self.order += 1
        insort(self.waiting, (bin_.free, self.order, bin_))
        return []

    def _into_room(self, piece: tuple) -> list[tuple] | None:
        """The piece whole in the waiting bin with the least room for it, if there is one."""
        i = bisect_left(self.waiting, (len(piece[2]) // 4,))
        if i == len(self.waiting):
            return None
        _, _, bin_ = self.waiting.pop(i)
        bin_.put(piece)
        return self._wait(bin_)

    def _fill(self, piece: tuple, bins: int) -> tuple[list[tuple], tuple | None]:
        """Full bins made by cutting the piece into up to ``bins`` waiting bins, most room first, and its rest."""
        out: list[tuple] = []
        i = len(self.waiting) - 1
        while bins and i >= 0:
            room, n = self.waiting[i][0], len(piece[2]) // 4
            if room >= n:
                return out + self._into_room(piece), None
            if room != n - 1:                   # else the document's end id would be left alone
                bin_ = self.waiting.pop(i)[2]
                head, piece = _split(piece, room)
                bin_.put(head)
                out += self._close(bin_.pieces)
                bins -= 1
            i -= 1
        return out, piece

    def add(self, piece: tuple) -> list[tuple]:
        """Take in a document; the pieces of the sequences that are ready, with sequence id and offset."""
        out: list[tuple] = []
        if len(piece[2]) // 4 > self.capacity:
            while len(piece[2]) // 4 > self.capacity:
                whole, piece = _split(piece, self.capacity)
                out += self._close([whole])
            ready, rest = self._fill(piece, self.most_waiting)
            out += ready
        else:
            ready = self._into_room(piece)
            if ready is not None:
                return ready
            rest = piece
            if len(self.waiting) >= self.most_waiting:
                ready, rest = self._fill(piece, self.most_waiting)
                out += ready
        return out + self._classed(rest) if rest else out

    def _classed(self, piece: tuple) -> list[tuple]:
        k = self.capacity // (len(piece[2]) // 4)
        bin_ = self.open.setdefault(k, _Bin(self.capacity))
        bin_.put(piece)
        if len(bin_.pieces) < k:
            return []
        del self.open[k]
        return self._wait(bin_)

    def finish(self) -> Iterator[tuple]:
        """The pieces of all sequences that are left."""
        rest = sorted((p for b in self.open.values() for p in b.pieces), key=lambda p: -len(p[2]))
        self.open = {}
        for piece in rest:
            ready = self._into_room(piece)
            if ready is None:
                bin_ = _Bin(self.capacity)
                bin_.put(piece)
                ready = self._wait(bin_)
            yield from ready
        while len(self.waiting) > 1:
            for piece in sorted(self.waiting.pop()[2].pieces, key=lambda p: len(p[2])):
                while piece and self.waiting:
                    bin_ = self.waiting[0][2]   # the fullest one
                    n = len(piece[2]) // 4
                    room = bin_.free if bin_.free != n - 1 or n == 1 else max(1, n - 2)
                    head, piece = (piece, None) if n <= bin_.free else _split(piece, room)
                    del self.waiting[0]
                    bin_.put(head)
                    yield from self._wait(bin_)
                if piece:                       # all others are full
                    if not self.waiting:
                        bin_ = _Bin(self.capacity)
                        self.order += 1
                        bin_.put(piece)
                        yield from self._wait(bin_)
        for _, _, bin_ in self.waiting:
            todo = list(reversed(bin_.pieces))
            for length in reversed(powers_of_two(self.capacity - bin_.free)):
                taken: list[tuple] = []
                while length:
                    piece = todo.pop()
                    if len(piece[2]) // 4 > length:
                        piece, later = _split(piece, length)
                        todo.append(later)
                    taken.append(piece)
                    length -= len(piece[2]) // 4
                yield from self._close(taken)
        self.waiting = []


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, ids binary")
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                              "sequence_id", "offset")] + [("ids", pa.binary())])


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    start is the number of the document's ids before the piece; offset its
    place in the sequence, gapless from 0.  ``ids`` has the piece's ids as
    little-endian unsigned 32-bit bytes, or null without ``with_ids``.
    A null or empty text is the end id alone; a null doc_id stays null; rows
    with equal ids are packed as documents of their own.  Texts of any length
    are tokenised whole.  An empty table gives no row.  Other columns of
    ``docs`` are ignored.
    """
    path = path or tokenizer_path()
    end = array("I", [end_id]).tobytes()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)],
                                          schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_bpe(path)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 40)
        out: list[tuple] = []

        def ready(pieces):
            for (doc_id, start, ids, total), seq, offset in pieces:
                out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, seq, offset, ids if with_ids else None))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = tokenizer.encode(text.as_py()) + end
                ready(bins.add((doc_id, 0, ids, len(ids) // 4)))
                if len(out) > 4_000:
                    yield batch(out)
                    out = []
        ready(bins.finish())
        yield batch(out)
        tokenizer.forget()

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")),
                     run, PIECES)
