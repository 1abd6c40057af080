"""The corpus operators against brute-force versions, with nulls, ties, empty tables and clashing columns."""

import base64
import hashlib
import io
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from expcurve.llm import (common, graph, itq, packing, perspectives, rules, sharding, simhash, suffixes, tiling,
                          toxicity, warc)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def corpus():
    rng = random.Random(4)
    base = words(rng, 200, 5000)
    passage = words(rng, 60, 5000)
    rows = [(1, base), (2, base), (3, base.replace("w1", "W1", 1)), (4, words(rng, 30) + " " + passage + " " + words(rng, 9)),
            (5, passage + " " + words(rng, 80)), (6, None), (7, ""), (8, " \t\n"), (9, "one"), (9, "one"), (10, "one two"),
            (None, base), (11, "for " * 300), (12, "for " * 290), (13, "é ü 한 " * 500), (14, words(rng, 20_000)),
            (15, base + " " + words(rng, 3))]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def clashing(df):
    names = ["key", "fp", "slot", "seed", "source", "a", "b", "_doc", "label", "score", "shard"]
    return df.withColumns({c: F.lit("x") for c in names if c not in df.columns})


# ------------------------------------------------------------ components

@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)],
                                   [(0, i) for i in range(1, 30)] + [(100, 101), (101, 102), (102, 100), (None, 3)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in parent:
        for a, b in edges:
            if a in parent and b in parent:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


# ------------------------------------------------------------ 1: SimHash

def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def brute_groups(fps):
    """Component of every (id, fp) row, by the smallest id."""
    group = list(range(len(fps)))
    for _ in fps:
        before = list(group)
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    low = defaultdict(list)
    for g, (i, _) in zip(group, fps):
        low[g].append(i)
    return [min((x for x in low[g] if x is not None), default=None) for g in group]


@pytest.mark.parametrize("dense", [4096, 1])
def test_simhash_groups(docs, dense):
    rows = [(r[0], brute_fingerprint(r[1])) for r in corpus()]
    want = sorted((str(i), f"{fp:016x}", g) for (i, fp), g in zip(rows, brute_groups(rows)))
    got = simhash.simhash_groups(clashing(docs), dense_bucket=dense).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


@pytest.mark.parametrize("dense", [4096, 3])
def test_links_keep_every_component(spark, dense):
    rng = random.Random(2)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in rows], "fp long")
    links = simhash.fingerprint_links(table, dense_bucket=dense)
    root = {r.node: r.root for r in graph.connected_components(links).collect()}
    together = defaultdict(set)
    for (i, f), g in zip(rows, brute_groups(rows)):
        s = f - (1 << 64) if f >> 63 else f
        together[g].add(root.get(s, ("alone", s)))
    assert all(len(x) == 1 for x in together.values())
    assert len({next(iter(x)) for x in together.values()}) == len(together)


# ------------------------------------------------------------ 2: packing

def test_ids_equal_the_librarys():
    path = packing.tokenizer_path()
    bpe, rng = packing.ByteBpe(path, kept=50), random.Random(3)
    letters = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0ab'sé1!-") + [chr(c) for c in (0x1680, 0x2003, 0x2028, 0x3000, 0x200B,
                                                                 0xFEFF, 0x663, 0xB2, 0xD55C, 0x1F600)]
    texts = ["".join(rng.choice([*letters, "  ", "'s"]) for _ in range(rng.randrange(16))) for _ in range(3000)]
    texts += ["", "a <|endoftext|> b", words(rng, 500), "x" * 5000]
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path)
    assert all(bpe.encode(t) == array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts)


def test_packing_is_exact(docs):
    rows = packing.pack_documents(clashing(docs).repartition(3), with_ids=True).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0            # no padding anywhere
    bpe, by_doc = packing.byte_bpe(packing.tokenizer_path()), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, t, *_ in corpus():
        ids = bpe.encode(t or "") + array("I", [1]).tobytes()
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        if i == 9:                                          # two equal rows
            pieces = pieces[::2]
        assert b"".join(p.ids for p in pieces) == ids
        assert all(p.doc_tokens == len(ids) // 4 for p in pieces)


def packed(lengths, capacity, waiting=256):
    """{sequence: [(document, start, length)]} of documents with these lengths, ids all different."""
    bins, sequences = packing.HarmonicBins(capacity, 0, waiting), defaultdict(list)

    def take(pieces):
        for (doc, start, ids, total), seq, offset in pieces:
            assert total == lengths[doc] and ids == array("I", range(start, start + len(ids) // 4)).tobytes()
            assert offset == sum(n for *_, n in sequences[seq])
            sequences[seq].append((doc, start, len(ids) // 4))
    for i, n in enumerate(lengths):
        take(bins.add((i, 0, array("I", range(n)).tobytes(), n)))
    take(bins.finish())
    return sequences


@pytest.mark.parametrize("capacity,waiting", [(64, 256), (64, 3), (2048, 256)])
@pytest.mark.parametrize("seed", range(6))
def test_harmonic_bins_lose_nothing_and_pad_nothing(capacity, waiting, seed):
    rng = random.Random(seed)
    top = [4 * capacity, capacity, capacity // 2 + 3, 9, capacity, 2][seed]
    lengths = [rng.randint(1, top) for _ in range(700)]
    sequences = packed(lengths, capacity, waiting)
    spans = defaultdict(list)
    for pieces in sequences.values():
        size = sum(n for *_, n in pieces)
        assert size <= capacity and size & (size - 1) == 0
        for doc, start, n in pieces:
            spans[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(spans[doc]):
            assert start == at and size > 0
            at += size
        assert at == n


def test_harmonic_bins_keep_documents_whole():
    rng = random.Random(9)
    lengths = [min(6000, int(rng.lognormvariate(6, 1)) + 1) for _ in range(4000)]
    pieces, alone = defaultdict(int), 0
    for taken in packed(lengths, 2048).values():
        for doc, start, n in taken:
            pieces[doc] += 1
            alone += n == 1 and 0 < start == lengths[doc] - 1      # an end id without its text
        assert len(taken) == 1 or any(n > 1 for *_, n in taken)
    fit = [d for d, n in enumerate(lengths) if n <= 2048]
    assert sum(pieces[d] == 1 for d in fit) >= 0.85 * len(fit) and alone <= 12


def test_harmonic_classes_hold_a_fixed_count():
    """Documents of one class alone: every bin starts with exactly k of them."""
    sequences = packed([40 + i % 10 for i in range(900)], 200)      # class 4 (41 to 50), 40 is class 5
    firsts = [[n for _, start, n in p if start == 0] for p in sequences.values()]
    assert sum(len(f) in (4, 5) for f in firsts) >= 0.9 * len(firsts)


# ------------------------------------------------------------ 3: tiling

def brute_tiles(item, doc, least):
    """Greedy string tiling straight from its definition."""
    im, dm, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while (i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                       and not im[i + n] and not dm[d + n]):
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least:
            return covered
        im[i:i + n], dm[d:d + n], covered = [True] * n, [True] * n, covered + n


def test_tiling_equals_its_definition():
    rng = random.Random(8)
    for _ in range(150):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(30))]
        doc = [rng.randrange(1, 5) for _ in range(rng.randrange(40))]
        cut = rng.randrange(len(item) + 1)
        doc += item[cut:] + [9] + item[:cut]
        tiles = tiling.greedy_string_tiling(item, doc, 3, first_length=rng.choice([3, 6, 20]))
        assert sum(t[0] for t in tiles) == brute_tiles(item, doc, 3)
        used = [i + k for n, i, _ in tiles for k in range(n)]
        assert len(used) == len(set(used)) and all(item[i:i + n] == doc[d:d + n] for n, i, d in tiles)


def test_contaminated_documents(spark, docs):
    rng = random.Random(5)
    first, second = words(rng, 20, 9000), words(rng, 24, 9000).split()
    moved = " ".join([*second[12:], "and", *second[:12]])
    rows = [(20, f"x y {first.upper().replace(' ', ', ')} z", 1), (21, "so " + moved, 1), (22, " ".join(second[:12]), 1),
            (23, None, 1), (24, "", 1), (20, "no leak", 1), (25, words(rng, 3000, 9000) + " " + first, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, item_id long").unionByName(
        docs.select("doc_id", "text", F.lit(1).cast("long").alias("item_id")))
    items = spark.createDataFrame([(1, first), (2, " ".join(second)), (3, None), (4, ""), (5, "one two")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in tiling.contaminated(table, items).collect()}
    assert got == {(20, 1): 1.0, (21, 2): 1.0, (25, 1): 1.0}
    assert tiling.contaminated(table, items.limit(0)).count() == 0
    assert tiling.contaminated(table.limit(0), items).count() == 0


def test_copies_of_repetitive_items(spark):
    one, five = "row " * 20, "a b c d e " * 8
    docs = spark.createDataFrame([(1, one), (2, five), (3, "x " + one + "y"), (4, "row " * 10), (5, "z " + five * 50),
                                  (6, "a b c d e " * 3), (7, "row " * 100_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, one), (2, five), (2, five), (3, "row " * 1000)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in tiling.contaminated(docs, items).collect()}
    assert got == {(1, 1): 1.0, (2, 2): 1.0, (3, 1): 1.0, (5, 2): 1.0, (7, 1): 1.0, (7, 3): 1.0}


def test_stock_phrases_make_few_rows(spark):
    """A phrase of a tenth of every item that every document has: copies are found, and its seeds are not joined."""
    rng = random.Random(12)
    phrase = words(rng, 10, 9000)
    items = [(i, f"{words(rng, 45, 9000)} {phrase} {words(rng, 45, 9000)}") for i in range(100)]
    docs = [(i, f"{words(rng, 20, 9000)} {phrase} {words(rng, 20, 9000)}") for i in range(1000)]
    docs += [(1000 + i, "so " + " ".join(t.split()[50:] + t.split()[:50])) for i, t in items[:5]]
    docs += [(2000 + i, " ".join(t.split()[:60])) for i, t in items[:5]]
    items += [(100, phrase), (None, items[7][1])]
    items = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(str, tiling.contaminated(docs, items).collect()))
    all_seeds = tiling.tiled_documents(docs, items, stock_documents=10 ** 9)
    assert got == sorted(map(str, all_seeds.select("doc_id", "item_id", "item_words", "covered_words", "tiles", "coverage").collect()))
    assert sum("item_id=100," in r for r in got) == 1010 and len(got) == 1015
    kept = tiling.item_seeds(items, 5, "item_id", "text")
    seeds = tiling._counted_seeds(kept, "item_id", "item_key", count="item_places").cache()
    bits = tiling.seed_bitmap(seeds)
    doc_seeds = tiling._counted_seeds(tiling.hinted_documents(docs, bits, 5, "doc_id", "text"), "doc_id", "doc_key", count="doc_places")
    left = tiling.left_out_seeds(doc_seeds, seeds, kept, 5, 0.8, 100)
    assert doc_seeds.join(seeds, "seed").count() > 600_000
    assert doc_seeds.join(tiling.probes(seeds, left), "seed").count() < 10 * 1100


def test_scripts_without_spaces(spark):
    item = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\uff0c\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65\u5427"
    docs = spark.createDataFrame([(1, f"\u4ed6\u8bf4{item}\u3002"), (2, item[:6]), (3, "a b c d e")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.doc_id, r.coverage) for r in tiling.contaminated(docs, items).collect()] == [(1, 1.0)]
    assert tiling.words_of("Ab_1 c\u4eca\u5929d") == [b"ab_1", b"c", "\u4eca".encode(), "\u5929".encode(), b"d"]


def test_tiling_of_many_short_repeats():
    doc = ([1] * 15 + [2]) * 200
    tiles = tiling.greedy_string_tiling([1] * 300, doc)
    assert sum(t[0] for t in tiles) == 300 and max(t[0] for t in tiles) == 15


# ------------------------------------------------------------ 4: WARC

def test_archives_round_trip(spark):
    rows = [(i, f"http://x/{i}", t, "z") for i, t in enumerate(["<p>a</p>" * 200, "", None, "é" * 99, "<p>a</p>" * 200] * 12)]
    rows += [(None, None, "no id", "z"), (3, "http://x/3", "é" * 99, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = warc.archive_round_trip(pages, archive_bytes=4000).collect()
    last = defaultdict(int)
    for i, _, t, _ in rows:
        last[t or ""] = max(last[t or ""], i or 0)
    want = []
    for i, _, t, _ in rows:
        data = (t or "").encode()
        again = i is not None and i < last[t or ""]
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "revisit" if again else "response", last[t or ""] if again else None))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda x: x[:4])
    assert all(r.html == (rows[r.page_id][2] or "") for r in got if r.record_type == "response" and r.page_id is not None)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def archive(tmp_path, n=400):
    records = [warc.record_bytes("response", warc.record_id(i), [], warc.http_head(40) + b"payload of record %06d....." % i
                                 + b"x" * 11) for i in range(n)]
    writer = warc.ArchiveWriter(str(tmp_path))
    done = [d for r in records for d in writer.add(r)] + list(writer.finish())
    return open(done[0][0], "rb").read()


def test_reader_loads_the_dictionary_and_refuses_damage(tmp_path):
    data = archive(tmp_path)
    assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC
    assert len(list(warc.read_records(io.BytesIO(data)))) == 400
    skipped = 8 + int.from_bytes(data[4:8], "little")
    for broken in (data[:-5], data[skipped:], data + b"junk", data[:skipped] + b"\0" + data[skipped:]):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(broken)))
    assert list(warc.read_records(io.BytesIO(b""))) == []
    good = warc.record_bytes("response", "urn:page:1", [], b"abc")
    for broken in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"Content-Length: 3", b"Content-Length: 4"),
                   good[1:], good.replace(b"WARC-Type", b"Type")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(broken)


# ------------------------------------------------------------ 5: sharding

def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_and_slots(docs):
    keys = np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64)
    for n in (1, 2, 16, 17):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    rows = sharding.shard_documents(clashing(docs)).collect()
    assert len(rows) == len(corpus())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {i: t or "" for i, t, *_ in corpus()}
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


# ------------------------------------------------------------ 6: suffixes

def brute_spans(rows, least):
    """{(id, start, end, source)} by comparing all windows of all different (id, text); null ids come last, by hash."""
    def order(i, t):
        return (1 << 62) + xxhash.xxh64_intdigest(t.encode(), 42) % (1 << 62) if i is None else i

    texts = {(order(i, t or ""), t or ""): (t or "").encode().split() for i, t in rows}
    first = {}
    for (n, _), w in sorted(texts.items()):
        for s in range(len(w) - least + 1):
            first.setdefault(tuple(w[s:s + least]), n)
    spans = set()
    for (n, _), w in texts.items():
        source = {s: first[tuple(w[s:s + least])] for s in range(len(w) - least + 1)}
        covered = sorted({p for s, low in source.items() if low < n for p in range(s, s + least)})
        for k, p in enumerate(covered):
            if k == 0 or covered[k - 1] != p - 1:
                start = p
            if k == len(covered) - 1 or covered[k + 1] != p + 1:
                low = min(low for s, low in source.items() if low < n and start <= s <= p + 1 - least)
                spans.add((n if n < 1 << 62 else None, start, p + 1, low if low < 1 << 62 else None))
    return spans


def found_spans(table, **options):
    rows = [(r.doc_id, r.start_word, r.end_word, r.source_doc_id) for r in suffixes.repeated_spans(table, **options).collect()]
    assert len(rows) == len(set(rows)) or None in {r[0] for r in rows}
    return set(rows)


@pytest.mark.parametrize("run_rows", [50_000, 1])
def test_repeated_spans(spark, docs, run_rows):
    got = found_spans(clashing(docs.drop("source")), run_rows=run_rows)
    assert got == brute_spans([r[:2] for r in corpus()], 50)
    assert any(i == 5 and e - s >= 60 and source == 4 for i, s, e, source in got)
    assert (None, 0, 200, 1) in got


@pytest.fixture
def layout(spark, request):
    names = ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, request.param, strict=True):
        spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("layout", [("1", "10000"), ("4", "1"), ("32", "10000")], indirect=True)
@pytest.mark.parametrize("hot", [False, True])
def test_spans_and_sources_do_not_depend_on_the_layout(spark, layout, hot, monkeypatch):
    """Groups of documents that share windows in chains, whether their seeds are frequent or not."""
    rng = random.Random(6)
    rows, parts = [], [words(rng, 30, 12) for _ in range(6)]
    for g in range(8):
        a, b, c = (words(rng, 25, 900) for _ in range(3))
        rows += [(10 * g + 5, f"{a} {b}"), (10 * g + 7, f"{a} {b} {c}"), (10 * g + 3, f"{b} {c}"), (10 * g + 9, f"{b} {c} x")]
    rows += [(100 + i, " ".join(rng.choice(parts) for _ in range(rng.randrange(6)))) for i in range(40)]
    rows += [(None, rows[0][1]), (None, "n " + rows[1][1]), (None, "m " + rows[1][1]), (200, rows[3][1]), (5, rows[2][1] + " y")]
    if hot:
        monkeypatch.setattr(suffixes, "_hot_seeds", lambda s, n: s.sparkSession.createDataFrame(
            s.select("seed").distinct().collect(), "seed long").withColumn("hot", F.lit(True)))
        monkeypatch.setattr(suffixes, "SAMPLE_SHARE", 1)
    table = spark.createDataFrame(rows + rows[:2], "doc_id long, text string").repartition(3)
    want = brute_spans(rows, 20)
    assert found_spans(table, min_words=20, seed_words=8) == want
    assert found_spans(table, min_words=20, seed_words=8, run_rows=2) == want
    assert suffixes.repeated_spans(table.limit(0)).count() == 0


def test_ids_with_two_texts(spark):
    t = words(random.Random(1), 70)
    rows = [(1, t), (2, t), (2, "x " + t), (3, t)]
    assert found_spans(spark.createDataFrame(rows, "doc_id long, text string")) == brute_spans(rows, 50)


def test_split_by_keys(spark):
    df = spark.range(20_000).selectExpr("xxhash64(id) as _bits", "id as _slot", "id as `a.b`")
    keys = df.where("_slot % 7 = 0").select("_bits")
    clear, rest = common.split_by_keys(df, F.col("_bits"), keys)
    assert clear.columns == rest.columns == df.columns
    assert clear.where("_slot % 7 = 0").count() == 0 and clear.count() + rest.count() == 20_000
    assert rest.where("_slot % 7 = 0").count() == 2858 and rest.count() < 2900
    clear, rest = common.split_by_keys(df, F.col("_bits"), keys.limit(0))
    assert clear.count() == 20_000 and rest.count() == 0


def test_cut_words():
    assert suffixes.cut_words("a b  c\nd é", [(1, 3)]) == "a d é"
    assert suffixes.cut_words("a b", [(0, 2)]) == ""


# ------------------------------------------------------------ 7, 8: classifiers

def labelled(spark, n=1500):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        text = words(rng, rng.randrange(20, 200), 3000)
        if bad:
            w = text.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["scum!", "zorkling", "zorkest", "Moron,"]))
            text = " ".join(w) + " !!! $$$" * 10
        rows.append((i, text, rng.choice(["en", "fr"]), "s", len(text)))
        labels.append((i, int(not bad), int(bad)))
    rows += [(None, "null id", "en", "s", 1), (n, None, None, "s", 0), (n + 1, "", "en", "s", 0)]
    labels += [(None, 1, 0), (n, None, None), (n + 1, 7, 7), (0, *labels[0][1:])]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_on_the_held_out_fold(spark, kind):
    docs, labels = labelled(spark)
    folds, fold, at = (4, 2, 0.7) if kind == "quality" else (5, 0, 0.5)
    score = rules.score_quality if kind == "quality" else toxicity.score_toxicity
    rows = score(clashing(docs), labels).collect()
    truth = {r.doc_id: r[kind] for r in labels.collect()}
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    for r in rows:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= at)
    flipped = labels.withColumn(kind, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold,
                                             1 - F.col(kind)).otherwise(F.col(kind)))
    again = {r.doc_id: r.score for r in score(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)     # held-out labels are not learnt


@pytest.mark.parametrize("score", [rules.score_quality, toxicity.score_toxicity])
def test_classifiers_without_labels(spark, score):
    docs, labels = labelled(spark, 20)
    assert len({r.score for r in score(docs, labels.limit(0)).collect()}) == 1
    assert score(docs.limit(0), labels).count() == 0


def test_best_threshold():
    assert toxicity.best_threshold(np.array([.1, .2, .8, .9]), np.array([0, 0, 1, 1])) == 0.5
    assert toxicity.best_threshold(np.array([.1, .6, .3, .9]), np.array([0, 0, 0, 1])) == pytest.approx(0.75)


def test_best_threshold_by_weight():
    s, y = np.array([.1, .3, .4, .5, .6, .9]), np.array([0, 1, 0, 0, 1, 1])
    assert toxicity.best_threshold(s, y, np.array([1, 9, 1, 1, 9, 9])) == pytest.approx(0.2)
    assert toxicity.best_threshold(s, y, np.array([9, 1, 9, 9, 1, 1])) == pytest.approx(0.55)
    assert toxicity.best_threshold(np.array([.3, .3, .3, .7]), np.array([1, 1, 0, 1])) == pytest.approx(0.15)


def test_thresholds_of_all_rows_outside_the_training_sample(spark):
    model = toxicity.ConvModel(None, None, None, None, 0.0, trained_ids=[-1, -2])
    rows = [(i, 0.5 if i < 60 else 0.1, "en") for i in range(2000)]                   # clean
    rows += [(i, 0.3 if i < 2020 else 0.9, "en") for i in range(2000, 2040)]          # toxic
    rows += [(i, 0.3 if i % 2 else 0.7, None) for i in range(3000, 3020)] + [(-1, 0.99, "en"), (-2, 0.01, "en"), (0, 0.95, "en")]
    labels = [(i, int(2000 <= i < 2040 or i >= 3000 and not i % 2)) for i, _, _ in rows if i >= 0] + [(-1, 0), (-2, 1), (None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, score double, lang string")
    cuts = toxicity.lang_cuts(model, table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {r.lang: r.cut for r in cuts.collect()} == {"en": pytest.approx(0.7), "": pytest.approx(0.5)}


def test_thresholds_of_2000_languages(spark, monkeypatch):
    model = toxicity.ConvModel(None, None, None, None, 0.0, trained_ids=[-1])
    rows = [(8 * i + k, 0.1 * (k + 1), f"l{i}") for i in range(2000) for k in range(8)]
    labels = spark.createDataFrame([(i, int(i % 8 > 2 + i // 8 % 4)) for i, _, _ in rows], "doc_id long, toxic int")
    table = spark.createDataFrame(rows, "doc_id long, score double, lang string")
    for bound in (toxicity.BROADCAST_LANGS, 10):
        monkeypatch.setattr(toxicity, "BROADCAST_LANGS", bound)
        got = toxicity.with_threshold(table, toxicity.lang_cuts(model, table, labels), "cut").collect()
        assert len(got) == len(rows)
        assert all(r.cut == pytest.approx(0.35 + 0.1 * (r.doc_id // 8 % 4)) for r in got)
    plain = toxicity.with_threshold(spark.createDataFrame([(1, "x")], "_lang long, cut0 string"), spark.createDataFrame(
        [("en", .3)], "lang string, cut double"), "cut").first()
    assert plain.cut == 0.5 and plain["_lang"] == 1


def test_forward_pass_equals_a_plain_convolution():
    rng = np.random.default_rng(3)
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    emb = rng.normal(0, 1, (toxicity.BUCKETS, toxicity.DIM)).astype(np.float32)
    emb[0] = 0
    model = toxicity.ConvModel(emb, rng.normal(0, 1, (toxicity.DIM, sum(toxicity.WIDTHS) * toxicity.FILTERS)).astype(np.float32),
                               rng.normal(0, 1, n).astype(np.float32), rng.normal(0, 1, n).astype(np.float32), 0.3)
    docs = [["bad", "words,", "longer"], [], ["one"], [f"w{i}" for i in range(toxicity._GROUP_WORDS + 5)], ["a", "b"] * 9, []]

    def plain(words):
        x = np.array([emb[list(toxicity.feature_ids(w))].sum(axis=0) for w in [*words, "", ""]])
        best, at = [], 0
        for w in toxicity.WIDTHS:
            kernel = model.kernels[:, at:at + w * toxicity.FILTERS].reshape(toxicity.DIM, w, toxicity.FILTERS)
            at += w * toxicity.FILTERS
            sums = [np.einsum("pd,dpf->f", x[i:i + w], kernel) for i in range(len(words))]
            best.append(np.max(sums, axis=0) if sums else np.zeros(toxicity.FILTERS))
        return np.maximum(np.concatenate(best) + model.bias, 0) @ model.output + model.intercept

    want = np.array([plain(d) for d in docs])
    assert np.allclose(model.raw(toxicity.WordTable(model.project), docs), want, atol=1e-3)
    assert np.allclose([model.raw_of(toxicity.text_features(" ".join(d), {})) for d in docs], want, atol=1e-3)


def test_thresholds_do_not_depend_on_the_sample(spark):
    docs, labels = labelled(spark)
    known = toxicity.training_labels(labels)
    model = toxicity.train(docs, known, sample_rows=200)
    cuts = {r.lang: r.cut for r in toxicity.lang_cuts(model, toxicity.score_texts(docs, model), known).collect()}
    scores = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    out = [(r.doc_id, r.toxic) for r in known.where("doc_id < 1500 and toxic in (0, 1)").distinct().collect()
           if r.doc_id not in set(model.trained_ids)]
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(model.trained_ids) < 250 and len(out) > 800 and set(cuts) >= {"en", "fr"}
    for k in ("en", "fr"):
        s, y = np.array([(scores[i], t) for i, t in out if lang[i] == k]).T
        n, n1 = len(out), sum(t for _, t in out)
        every = known.where("doc_id < 1500 and toxic in (0, 1)").distinct()
        rate = every.where("toxic = 1").count() / every.count()
        w = np.where(y > 0, rate / n1, (1 - rate) / (n - n1))

        def errors(t):
            return (w * ((s >= t) != (y > 0))).sum()
        assert errors(cuts[k]) <= min(errors(t) for t in np.linspace(0.05, 0.95, 91)) + 0.003


# ------------------------------------------------------------ 9: embeddings

def vectors(spark, dim=64):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(30):
        x = rng.normal(size=dim)
        for _ in range(12):
            rows.append((len(rows), (x + rng.normal(size=dim) * 0.17).astype(np.float32).tolist(), c % 3))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (901, rows[0][1], 0), (902, rows[0][1], None), (903, None, 0),
             (904, [0.0] * dim, 0), (905, [float("nan")] * dim, 0), (906, [None] * dim, 0), (907, [1.0], 0), (908, [], 0),
             (909, [float("inf")] + [1.0] * (dim - 1), 0)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n string")


@pytest.mark.parametrize("dim,block", [(64, 256), (64, 4), (16, 256), (96, 256)])
def test_embedding_links(spark, dim, block):
    rows, table = vectors(spark, dim)
    got = sorted(itq.near_duplicates(table, 0.98, block_rows=block).collect())
    links = defaultdict(set)
    good = [k for k, (_, e, lab) in enumerate(rows) if lab is not None and e and len(e) == dim and None not in e
            and np.isfinite(e).all() and np.any(e)]
    x = {k: np.array(rows[k][1]) for k in good}
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.98:
                links[a].add(b)
    root = list(range(len(rows)))
    for _ in rows:
        for a, ns in links.items():
            for b in ns:
                root[a] = root[b] = min(root[a], root[b])
    want = sorted((r[0], len(links[k]), rows[root[k]][0]) for k, r in enumerate(rows))
    found, total = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert total > 150 and found >= 0.9 * total and all(r.n_links <= w[1] for r, w in zip(got, want))
    if dim >= 64 and found == total:
        assert [(r.vec_id, r.n_links, r.component_id) for r in got] == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert itq.near_duplicates(table.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r.label for r in rows])
    want = ((x @ x.T >= 0.9) & (lab[:, None] == lab[None, :])).sum() - len(rows)
    got = itq.near_duplicates(table, 0.9).agg(F.sum("n_links")).first()[0]
    assert got <= want and got >= 0.9 * want


@pytest.mark.parametrize("share", [0.0, 0.5, 0.8, 0.9])
@pytest.mark.parametrize("dim", [64, 384])
def test_codes_find_pairs_whatever_the_vectors_share(dim, share):
    """Vectors with a common direction: their mean cosine is ``share``."""
    rng = np.random.default_rng(5)
    common = rng.normal(size=dim)
    common /= np.linalg.norm(common)

    def unit(v):
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    x = unit(np.sqrt(share) * common + np.sqrt(1 - share) * unit(rng.normal(size=(3000, dim))))
    mean, projection, tables, _ = itq.fit_codes(x, dim, 0.98)
    near = unit(x + unit(rng.normal(size=x.shape)) * 0.2)
    cosine = (x * near).sum(axis=1)
    same = itq.equal_chunks(itq.codes_of(x, mean, projection), itq.codes_of(near, mean, projection)).sum(axis=1)
    linked = cosine >= 0.98
    assert linked.sum() > 500 and (same[linked] >= len(tables[0])).mean() >= 0.9


def test_tight_clusters_and_mixed_lengths(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.01).tolist(), 1) for i in range(100)]
    rows += [(200, [1.0, 2.0, 3.0], 1), (201, [1.0, 2.0, 3.1], 1), (202, [1.0, 2.0], 1), (203, [2.0, 4.0], 1),
             (204, [1.0, 2.0], 2), (205, [1.0, 2.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id)
           for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(got[i][0] for i in range(100)) >= 0.9 * 100 * 99 and {got[i][1] for i in range(100)} == {0}
    assert got[200] == (1, 200) and got[201] == (1, 200) and got[202] == (1, 202) and got[203] == (1, 202)
    assert got[204] == (0, 204) and got[205] == (0, 205)


# ------------------------------------------------------------ 10: rotation

def test_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "who"),
             (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, None, "ann", "")]
    table = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, name string")
    got = perspectives.rotate(table)
    want = []
    for conv, turn, role, text in turns:
        people = {r for c, _, r, _ in turns if c == conv and r not in (None, "system")}
        for p in people:
            head = "<|assistant|>" if role == p else "<|system|>" if role == "system" else f"<|user name={role or 'unknown'}|>"
            want.append((str(conv), p, str(turn), f"{head}{text or ''}<|end|>\n", len(head), int(role == p)))
    assert sorted((str(r.conv_id), r.perspective, str(r.turn), r.segment, r.prefix_chars, r.loss_mask)
                  for r in got.collect()) == sorted(want)
    assert perspectives.rotate(table.limit(0)).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_rendering(spark):
    """Texts and masks of whole dialogues against a plain loop: ties, nulls, a long and a repetitive conversation."""
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "who"),
             (2, 0, "system", "alone"), (None, 0, "ann", "x"), (None, 0, "cy", "\U0001f600é"), (3, None, "ann", ""), (3, -1, "ann", "b")]
    turns += [(4, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(23)]
    turns += [(5, 7, ("ann", "bob", "cy")[i % 3], f"t{i % 11}") for i in range(40)]
    table = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, part string")
    per_row, want = 8, {}
    for conv in {t[0] for t in turns}:
        mine = [(n, r or "unknown", r is None, t or "") for c, n, r, t in turns if c == conv]
        for p in {s for _, s, nameless, _ in mine if not nameless and s != "system"}:
            parts = {}
            for t in sorted(mine, key=lambda t: (t[0] is not None, *t)):
                parts.setdefault((t[0] or 0) // per_row, []).append(t)
            for part, rows in parts.items():
                for at in range(0, len(rows), per_row):
                    text, mask = "", []
                    for _, s, nameless, body in rows[at:at + per_row]:
                        own = s == p and not nameless
                        head = "<|assistant|>" if own else "<|system|>" if s == "system" else f"<|user name={s}|>"
                        text += f"{head}{body}<|end|>\n"
                        mask += [0] * len(head) + [int(own)] * (len(body) + 8)
                    want[conv, p, part, at // per_row] = (len(rows[at:at + per_row]), text, mask)
    got = perspectives.render(table, turns_per_row=per_row)
    assert {(r.conv_id, r.perspective, r.part, r.piece): (r.n_turns, r.text, [b for m in r.masks for b in [m.mask] * m.chars])
            for r in got.collect()} == want
    assert max(n for n, _, _ in want.values()) == per_row and (5, "ann", 0, 4) in want and (4, "ann", 2, 0) in want
    assert perspectives.render(table.limit(0)).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# ------------------------------------------------------------ pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs, labels = labelled(spark, 600)
    leak = words(random.Random(9), 25, 9000)
    more = spark.createDataFrame(corpus() + [(5000, "see " + leak, "en", "s", 1)], DOCS).where("doc_id is null or doc_id < 100 or doc_id = 5000")
    table = docs.where("doc_id >= 100").unionByName(more).withColumn("fp", F.lit(1))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, sizes = common.table(spark, str(tmp_path), "documents"), {}
    for name, stage in pipeline.STAGES[:-1]:
        at = common.stored(stage(spark, at, str(tmp_path)), name)
        assert at.columns == table.columns
        sizes[name] = {r.doc_id for r in at.collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1 and doc_id >= 100").collect()}
    assert len(sizes["toxicity"] & toxic) <= 0.05 * len(toxic)
    assert 1 in sizes["simhash"] and not {2, 7, 8} & sizes["simhash"] and 6 in sizes["simhash"] and None not in sizes["simhash"]
    text = {r.doc_id: r for r in at.collect()}
    assert 5000 in sizes["suffixes"] and 5000 not in sizes["decontamination"]
    assert len(text[5].text.split()) == 80 and text[5].n_chars == len(text[5].text) and len(text[4].text.split()) == 99
    pieces = pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == sizes["decontamination"]
    empty = table.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_judges_rows_by_id_and_text(spark, tmp_path):
    """Clashing columns, null ids, ids with several texts and repeated rows, stage by stage."""
    import corpus_pipeline as pipeline

    rng = random.Random(12)
    base, leak, passage = words(rng, 120, 9000), words(rng, 25, 9000), words(rng, 60, 9000)
    rows = [(4, base), (None, base), (None, base), (3, base + " end"), (None, "alone " + words(rng, 60, 9000)), (7, words(rng, 70, 9000)),
            (7, "see " + leak), (8, passage + " " + words(rng, 80, 9000)), (None, passage + " " + words(rng, 70, 9000)),
            (9, passage), (10, words(rng, 90, 9000)), (10, None)]
    rows += [rows[10]] * 2 + [(11, rows[10][1] + " " + rows[10][1])]
    df = spark.createDataFrame([(*r, "en", len(r[1] or ""), "z") for r in rows],
                               "doc_id long, text string, lang string, n_chars int, _before string")
    for c in ("_doc", "_copy", "_cuts", "_toxicity", "_id", "_key", "_chosen", "_slot", "_bits", "fp", "_lang", "cut"):
        df = df.withColumn(c, F.lit("k"))
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def out(stage, at):
        kept = common.stored(stage(spark, at, str(tmp_path)), "kept")
        assert kept.columns == df.columns and kept.where("_before <> 'z' or _cuts <> 'k' or n_chars <> length(coalesce(text, ''))").count() == 0
        return kept

    def texts(at):
        return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in at.collect())

    def plain(rs):
        return sorted((i if i is not None else -1, t or "") for i, t in rs)

    assert texts(out(pipeline.drop_toxic, df)) == plain(rows)
    once = out(pipeline.drop_near_duplicates, df)
    fps = {r: simhash.fingerprint(r[1]) for r in rows}
    near = [r for r in set(rows) if not any(bin(fps[r] ^ fps[o]).count("1") <= 3 and (o[0] is None, o[0] or 0) < (r[0] is None, r[0] or 0)
                                            for o in rows)]
    assert texts(once) == plain(near) and (3, base + " end") in texts(once) and (4, base) not in texts(once)
    cut = out(pipeline.cut_repeated_passages, once)
    want = []
    for i, t in near:
        w = (t or "").split()
        if i is None and t.startswith(passage):
            t = " ".join(w[60:])
        if i == 9:
            continue
        want.append((i, t))
    assert texts(cut) == plain(want)
    clean = out(pipeline.drop_contaminated, cut)
    assert texts(clean) == plain(r for r in want if leak not in (r[1] or ""))


def test_registered_queries(spark):
    from expcurve.llm import queries

    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert queries.oracle_sql().keys() <= names.keys()
