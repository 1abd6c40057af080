"""Repeated passages by a sparse suffix array.

Only suffixes at content-selected positions are kept: of the ``seed_words``-
grams in each window of ``min_words`` words, the one with the least hash (its
minimiser) marks its suffix.  Equal windows select the same place in them, so
no passage of ``min_words`` words is lost, while 2 in 27 suffixes are kept at
the defaults.  A kept suffix carries the hashes of the windows that chose it.

Equal texts are one text to the array: the smallest id with a text stands for
it, and every other id with the text repeats it whole.

Kept suffixes are dealt to tasks by their leading seed and sorted there, and
neighbours with equal seeds are compared: their windows to the left and right
of the seed either repeat or not, which extends a match on both sides.  Seeds
that a sample of the texts shows to be very frequent are spread over all tasks
instead; their suffixes, and a run of equal seeds longer than a task should
hold, are compared in a second, aggregated pass, where suffixes with the same
windows meet as one class.  Either way a window's source is the smallest id
that has it, so the layout of the tasks leaves no trace in the result.  Matches
of consecutive windows are merged to maximal spans.

A window is repeated in a document if a document with a smaller id has it; the
document with the smallest id keeps it.  Repeats inside one document are left
alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from expcurve.llm.common import fresh, map_arrow, row_key, split_by_keys, stored, text_key, text_or_empty
from expcurve.llm.rolling import mixed, window_hashes, word_hashes

MIN_WORDS = 50
SEED_WORDS = 25
RUN_ROWS = 50_000
SAMPLE_SHARE = 16
_GROUP_WORDS = 200_000
_NAMELESS = 1 << 62
_HASH_BYTES = 6


def _kept_suffixes(doc_ids: list[int], keys: list[int], words: list[list[bytes]], min_words: int, seed_words: int):
    """(seed, doc_id, key, first, shift, hashes) arrays of the kept suffixes of some documents."""
    flat = [w for ws in words for w in ws]
    lengths = np.array([len(ws) for ws in words], dtype=np.int64)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    n = len(flat) - min_words + 1
    if n <= 0:
        return None
    hashes = word_hashes(flat)
    seeds = window_hashes(hashes, seed_words)
    windows = window_hashes(hashes, min_words)
    width = min_words - seed_words + 1
    at = np.lib.stride_tricks.sliding_window_view(mixed(seeds), width).argmin(axis=1) + np.arange(n)
    inside = np.flatnonzero(owner[:n] == owner[min_words - 1:])
    if not len(inside):
        return None
    at = at[inside]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (owner[inside[1:]] != owner[inside[:-1]])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    place = inside[first]
    raw = windows[inside].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES]
    offsets = np.concatenate([[0], np.cumsum(count)]) * _HASH_BYTES
    data = pa.Array.from_buffers(pa.binary(), len(count), [
        None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
    ids, keys = (np.array(v, dtype=np.int64)[owner[place]] for v in (doc_ids, keys))
    return pa.RecordBatch.from_arrays(
        [pa.array(seeds[at[first]].view(np.int64)), pa.array(ids), pa.array(keys),
         pa.array((place - starts[place]).astype(np.int32)), pa.array((at[first] - place).astype(np.int16)), data],
        ["seed", "doc_id", "key", "first", "shift", "hashes"])


_SUFFIX = "seed long, doc_id long, key long, first int, shift short, hashes binary"


def kept_suffixes(texts: DataFrame, min_words: int, seed_words: int) -> DataFrame:
    """One row per kept suffix of ``texts`` (doc_id, key, text): its seed, document, the first window that chose
    it (in words), the seed's place in that window, and the hashes of all windows that chose it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, words, size = [], [], [], 0
            for doc_id, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids.append(doc_id)
                keys.append(key)
                words.append(text.as_py().encode("utf-8", "replace").split())
                size += len(words[-1])
                if size >= _GROUP_WORDS:
                    out = _kept_suffixes(ids, keys, words, min_words, seed_words)
                    if out is not None:
                        yield out
                    ids, keys, words, size = [], [], [], 0
            out = _kept_suffixes(ids, keys, words, min_words, seed_words)
            if out is not None:
                yield out

    return map_arrow(texts.select("doc_id", "key", "text"), run, _SUFFIX)


def _windows(rows: pa.Table) -> dict[str, np.ndarray]:
    """The windows of suffix rows: row number, place of the seed in them, hash and start."""
    data = rows.column("hashes").combine_chunks()
    if isinstance(data, pa.ChunkedArray):
        data = data.chunk(0)
    ends = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset:data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]].reshape(-1, _HASH_BYTES)
    full = np.zeros((len(raw), 8), dtype=np.uint8)
    full[:, :_HASH_BYTES] = raw
    count = np.diff(ends) // _HASH_BYTES
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return {"row": row, "shift": rows.column("shift").to_numpy().astype(np.int64)[row] - step,
            "hash": full.view(np.uint64).ravel(), "start": rows.column("first").to_numpy().astype(np.int64)[row] + step,
            "doc": rows.column("doc_id").to_numpy()[row], "key": rows.column("key").to_numpy()[row]}


def _repeats(rows: pa.Table, run_of_row: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc_id, key, first, last, source): runs of windows that a document with a smaller id has too."""
    w = _windows(rows)
    run = run_of_row[w["row"]]
    order = np.lexsort((w["start"], w["doc"], w["hash"], w["shift"], run))
    run, shift, value = run[order], w["shift"][order], w["hash"][order]
    doc, key, start = w["doc"][order], w["key"][order], w["start"][order]
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (shift[1:] != shift[:-1]) | (value[1:] != value[:-1])])
    source = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    again = doc > source
    doc, key, start, source = doc[again], key[again], start[again], source[again]
    order = np.lexsort((start, source, key, doc))
    doc, key, start, source = doc[order], key[order], start[order], source[order]
    if not len(doc):
        return doc, key, start, start, source
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (source[1:] != source[:-1])
                          | (start[1:] > start[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], key[first], start[first], start[last], source[first]


_MEMBER = "array<struct<doc_id: long, key: long, first: int>>"
_COMPARED = ("doc_id long, key long, first int, last int, source long, seed long, shift short, hashes binary, "
             f"members {_MEMBER}")
_NAMES = ["doc_id", "key", "first", "last", "source", "seed", "shift", "hashes", "members"]


def _one(column) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _undecided(rows: pa.Table) -> pa.RecordBatch:
    """One row for every class of suffixes with equal windows, with its members."""
    g = rows.group_by(["seed", "shift", "hashes"], use_threads=False).aggregate(
        [("doc_id", "list"), ("key", "list"), ("first", "list")])
    lists = [_one(g.column(f"{c}_list")) for c in ("doc_id", "key", "first")]
    members = pa.ListArray.from_arrays(lists[0].offsets, pa.StructArray.from_arrays(
        [x.flatten() for x in lists], names=["doc_id", "key", "first"]))
    n = len(g)
    none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())]
    return pa.RecordBatch.from_arrays([*none, *(_one(g.column(c)) for c in ("seed", "shift", "hashes")), members], _NAMES)


def _decided(rows: pa.Table, runs: np.ndarray) -> pa.RecordBatch:
    doc, key, first, last, source = _repeats(rows, runs)
    n = len(doc)
    member = pa.list_(pa.struct([("doc_id", pa.int64()), ("key", pa.int64()), ("first", pa.int32())]))
    none = [pa.nulls(n, t) for t in (pa.int64(), pa.int16(), pa.binary(), member)]
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(first.astype(np.int32)),
                                       pa.array(last.astype(np.int32)), pa.array(source), *none], _NAMES)


def _compare_neighbours(run_rows: int):
    """Decide the runs of equal seeds of a task, which come sorted; hot rows and runs over ``run_rows`` stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        long_seed = None                # the seed of a run that is too long, as far as it was seen

        def decided(rows: pa.Table, runs: np.ndarray) -> Iterator[pa.RecordBatch]:
            many = np.bincount(runs)[runs] > 1
            if many.any():
                yield _decided(rows.filter(pa.array(many)).combine_chunks(), runs[many])

        for b in batches:
            rows = pa.Table.from_batches([b])
            hot = rows.column("hot").to_numpy()
            if hot.any():
                yield _undecided(rows.filter(pa.array(hot)))
                rows = rows.filter(pa.array(~hot))
            rows = rows.combine_chunks() if carry is None else pa.concat_tables([carry, rows]).combine_chunks()
            if not len(rows):
                continue
            seed = rows.column("seed").to_numpy()
            if long_seed is not None:
                same = int((seed == long_seed).sum())       # they come first
                if same:
                    yield _undecided(rows.slice(0, same))
                    rows, seed = rows.slice(same).combine_chunks(), seed[same:]
                carry = None
                if not len(rows):
                    continue
                long_seed = None
            starts = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
            runs = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(seed))))
            if starts[-1]:
                yield from decided(rows.slice(0, starts[-1]).combine_chunks(), runs[:starts[-1]])
            carry = rows.slice(starts[-1]).combine_chunks()
            if len(carry) > run_rows:
                yield _undecided(carry)
                long_seed, carry = seed[-1], None
        if carry is not None and len(carry):
            yield from decided(carry, np.zeros(len(carry), dtype=np.int64))

    return run


def _undecided_repeats(classes: DataFrame) -> DataFrame:
    """(doc_id, key, first, last, source): repeats among suffixes of very frequent seeds.

    Suffixes whose windows are all equal are one class; single windows are
    compared for the smallest document of every class alone, so a passage in
    very many documents costs a row per task and class, not per window.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = pa.Table.from_batches([b])
                w = _windows(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(rows.column(c).to_numpy()[w["row"]]) for c in ("class", "seed")),
                     pa.array(w["shift"].astype(np.int32)), pa.array(w["hash"].view(np.int64)), pa.array(w["doc"]),
                     pa.array(w["key"]), pa.array(w["start"].astype(np.int32))],
                    ["class", "seed", "place", "hash", "doc_id", "key", "start"])

    same = ["seed", "shift", "hashes"]
    classes = classes.select(*same, F.xxhash64(*same).alias("class"), "members")
    low = F.array_min(F.transform("members", lambda m: m.doc_id))
    lows = stored(classes.groupBy("class").agg(F.min(low).alias("low")), "lows")
    classes = stored(classes.join(lows, "class"), "classes")
    lowest = classes.select("class", "low", *same, F.explode(F.filter("members", lambda m: m.doc_id == F.col("low"))).alias("m"))
    windows = stored(map_arrow(lowest.select("class", *same, "m.doc_id", "m.key", "m.first"), explode,
                               "class long, seed long, place int, hash long, doc_id long, key long, start int"), "windows")
    key = ["seed", "place", "hash"]
    shared = (windows.groupBy(*key).agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("high"))
              .where("high > source").drop("high"))
    again = stored(windows.join(shared, key).where("doc_id > source"), "again")
    # a member repeats every window of its class, whose sources are the class's own least document or smaller ones
    sources = again.groupBy("class").agg(F.min("source").alias("source"))
    late = (classes.join(sources, "class", "left")
            .select(F.coalesce("source", "low").alias("source"), F.length("hashes").alias("size"),
                    F.explode(F.filter("members", lambda m: m.doc_id > F.col("low"))).alias("m")))
    whole = late.select("m.doc_id", "m.key", "m.first",
                        (F.col("m.first") + F.col("size") / _HASH_BYTES - 1).cast("int").alias("last"), "source")
    return whole.union(again.select("doc_id", "key", F.col("start").alias("first"), F.col("start").alias("last"), "source"))


def _hot_seeds(suffixes: DataFrame, tasks: int) -> DataFrame:
    """(seed, hot) of the seeds with over an eighth of a task's share of the sample: at most 8 a task."""
    counts = stored(suffixes.groupBy("seed").agg(F.count("*").alias("n")), "seed-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") > max(8, total / (8 * tasks))).select("seed", F.lit(True).alias("hot"))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS,
                   run_rows: int = RUN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, n_words, source_doc_id, text_key): maximal spans of words that repeat.

    Every word of a span (end exclusive) lies in a window of ``min_words`` words
    that a document with a smaller id has too; spans that touch are one.
    source_doc_id is the smallest such id over the span.  Words are separated by
    ASCII white space and compared byte by byte.  Null and empty texts and texts
    under ``min_words`` words have no spans.  text_key is the hash of the text:
    an id that stands for several texts has the spans of each.  Repeated rows
    with one id and text count as one document.  A null id counts as larger
    than all others, null ids among themselves by the hash of the text; as a
    source it is null.  Ids must be under 2**62.  Other columns are ignored; an
    empty table has no spans.
    """
    if not 0 < seed_words <= min_words:
        raise ValueError("0 < seed_words <= min_words")
    spark = docs.sparkSession
    nameless = F.lit(_NAMELESS) + F.pmod(text_key(text_col), F.lit(_NAMELESS))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), nameless).alias("doc_id"), text_key(text_col).alias("key"),
                       text_or_empty(text_col).alias("text"))
    several = stored(rows.groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("high"))
                     .where("high > owner").select("key", "owner"), "several")
    alone, copied = split_by_keys(rows, F.col("key"), several.select("key"))
    texts = alone.unionByName(copied.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text")))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = kept_suffixes(texts.where(F.pmod("key", F.lit(SAMPLE_SHARE)) == 0), min_words, seed_words)
    hot = _hot_seeds(sample, tasks)
    suffixes = kept_suffixes(texts, min_words, seed_words).join(F.broadcast(hot), "seed", "left")
    suffixes = suffixes.withColumn("hot", F.coalesce("hot", F.lit(False)))
    dealt = (suffixes.repartition(tasks, F.when(F.col("hot"), F.col("key")).otherwise(F.col("seed")))
             .sortWithinPartitions("hot", "seed", "doc_id", "key", "first"))
    compared = stored(map_arrow(dealt, _compare_neighbours(run_rows), _COMPARED), "compared")
    found = (compared.where("source is not null").select("doc_id", "key", "first", "last", "source")
             .union(_undecided_repeats(compared.where("source is null"))))
    found = found.groupBy("doc_id", "key", "first", "last").agg(F.min("source").alias("source"))
    order = Window.partitionBy("doc_id", "key").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = stored(found.withColumn("gap", F.when(F.col("first") <= reached + min_words, 0).otherwise(1))
                   .withColumn("island", island).groupBy("doc_id", "key", "island")
                   .agg(F.min("first").alias("start_word"), (F.max("last") + min_words).alias("end_word"),
                        F.min("source").alias("source")).drop("island"), "spans")

    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    copies = (copied.select("doc_id", "key", size.alias("end_word")).where(F.col("end_word") >= min_words)
              .groupBy("doc_id", "key").agg(F.max("end_word").alias("end_word"))
              .join(several, "key").where("doc_id > owner")
              .join(spans.groupBy("key").agg(F.min("source").alias("least")), "key", "left")
              .select("doc_id", "key", F.lit(0).alias("start_word"), "end_word", F.coalesce("least", "owner").alias("source")))

    def named(column: str):
        return F.when(F.col(column) < _NAMELESS, F.col(column))

    return (spans.unionByName(copies)
            .select(named("doc_id").alias("doc_id"), "start_word", "end_word",
                    (F.col("end_word") - F.col("start_word")).alias("n_words"), named("source").alias("source_doc_id"),
                    F.col("key").alias("text_key")))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+\s*")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (ascending, end exclusive) and the white space after them."""
    data = text.encode("utf-8", "replace")
    ends = [(m.start(), m.end()) for m in _WORD.finditer(data)]
    out, at = [], 0
    for lo, hi in spans:
        out.append(data[at:ends[lo][0]])
        at = ends[hi - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8")


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  length_col: str | None = None, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the spans of ``repeated_spans`` cut out of the text column, and its length in characters
    put into ``length_col``.  Rows without a span are as they were and are not moved; a text that repeats whole
    becomes empty, or its row goes with ``drop_emptied``."""
    cuts = stored(spans.groupBy("doc_id", "text_key")
                  .agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("cuts")), "cuts")
    clear, touched = split_by_keys(docs, row_key(id_col, text_col),
                                   cuts.select(F.xxhash64("doc_id", "text_key").alias("key")))
    columns, cut_col, of = docs.columns, fresh(docs, "_cuts"), fresh(docs, "_of")
    at = [columns.index(next(c for c in columns if c.lower() == n.lower())) for n in (text_col, length_col or text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, cut = b.column(at[0]).to_pylist(), b.column(len(columns)).to_pylist()
            left = [t if not c else cut_words(t, [(s["start_word"], s["end_word"]) for s in c])
                    for t, c in zip(text, cut, strict=True)]
            if length_col is not None:
                sizes = [n if not c else len(t) for n, t, c in zip(b.column(at[1]).to_pylist(), left, cut, strict=True)]
                b = b.set_column(at[1], b.schema.field(at[1]), pa.array(sizes, b.schema.field(at[1]).type))
            b = b.set_column(at[0], b.schema.field(at[0]), pa.array(left, b.schema.field(at[0]).type))
            if drop_emptied:
                b = b.filter(pa.array([t == x or bool(x) for t, x in zip(text, left, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(b.columns[:len(columns)], schema=pa.schema(list(b.schema)[:len(columns)]))

    cuts = cuts.select(F.struct("doc_id", "text_key").alias(of), F.col("cuts").alias(cut_col))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(of)["doc_id"]) & (text_key(text_col) == F.col(of)["text_key"])
    joined = touched.join(cuts, same, "left").select(*[F.col(f"`{c}`") for c in columns], cut_col)
    return clear.unionByName(map_arrow(joined, run, docs.schema))
