"""Periodic runs, the filter audit and main texts of pages against brute-force versions."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from expcurve.llm import interactions, periodic, queries, wrappers

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df):
    names = ["id", "part", "hash", "chars", "mask", "n", "text_", "runs", "host", "keep", "blocks", "shape_id", "words"]
    return df.withColumns({c: F.lit("x") for c in names if c not in df.columns})


# ------------------------------------------------------------ periodic runs

def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, q, n) for (s, n), q in found.items())


def odd_words(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(80))]
    if kind == 1:
        return [x for _ in range(rng.randrange(1, 5))
                for x in [rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randrange(1, 14))] * rng.randrange(1, 8)]
    if kind == 2:
        unit = [rng.randrange(2) for _ in range(rng.randrange(1, 30))] * 2 + [5] * rng.randrange(9)
        return (unit * 5)[rng.randrange(9):][:rng.randrange(1, 400)]
    if kind == 3:
        return [0] * rng.randrange(40)
    if kind == 4:
        out = (([0] * rng.randrange(1, 20) + [1] * rng.randrange(1, 3)) * rng.randrange(3, 7))[rng.randrange(10):]
        return out[:-1] + [rng.randrange(3)]
    a, b = [0], [0, 1]
    while len(b) < rng.randrange(10, 200):
        a, b = b, b + a
    return b * rng.choice([1, 4, 5])


def test_runs_equal_brute_force():
    rng = random.Random(3)
    seen = 0
    for _ in range(400):
        docs = [odd_words(rng) for _ in range(rng.randrange(1, 5))]
        flat = np.array([w for d in docs for w in d], dtype=np.int64)
        start, length, period = periodic.runs_of(flat, np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
        offset = np.cumsum([0] + [len(d) for d in docs])
        want = [(s + o, q, n) for d, o in zip(docs, offset, strict=False) for s, q, n in brute_runs(d)]
        assert list(zip(start.tolist(), period.tolist(), length.tolist(), strict=True)) == want
        seen += len(want)
    assert seen > 1000


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    tree = periodic.WaveletMatrix(values)
    lo = rng.integers(0, 300, 500)
    hi = np.minimum(lo + rng.integers(0, 60, 500), 300)
    x = rng.integers(0, 600, 500)
    for a, b, v, up, down in zip(lo, hi, x, tree.successor(lo, hi, x), tree.predecessor(lo, hi, x), strict=True):
        part = values[a:b]
        assert up == min(part[part >= v], default=-1) and down == max(part[part < v], default=-1)


def expected_digest(doc_id, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if planted and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, q, n in runs), default=None)
    best = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *best, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def periodic_docs():
    rng = random.Random(5)
    texts = [None, "", " \t\n ", "one", "a a a a a", "a a a a a a", "a a " * 7, "x y " * 4 + "x", "\x1f \x1c " * 9]
    texts += [" ".join(f"w{w}" for w in odd_words(rng)) for _ in range(60)]
    texts += ["é ü 한 " * 500, " ".join(f"w{rng.randrange(400)}" for _ in range(1200)), "long " * 20_000]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "b " * 9, "en", "s", 1), (None, None, "en", "s", 1)]


@pytest.mark.parametrize("plant", [False, True])
def test_periodic_digest(spark, plant):
    rows = [r for r in periodic_docs() if len(r[1] or "") < 9_000]
    df = clashing(spark.createDataFrame(rows, DOCS)).repartition(3)
    df = periodic.with_planted_periods(df) if plant else df
    got = Counter(tuple(r) for r in periodic.digest(periodic.periodic_runs(df)).collect())
    assert got == Counter(expected_digest(r[0], r[1], plant) for r in rows)


def test_periodic_long_and_empty(spark):
    df = spark.createDataFrame(periodic_docs(), DOCS)
    longest = periodic.periodic_runs(df.where("length(text) > 90000")).collect()
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in longest] == [(20_000, [(0, 20_000, 1)], "long")]
    assert periodic.digest(periodic.periodic_runs(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, min_exponent=3)


def test_periodic_query(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len((r.text or "").split()) < 900]
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(got[r.doc_id] == expected_digest(r.doc_id, r.text) for r in rows)


# ------------------------------------------------------------ filter audit

def audit_docs():
    rng = random.Random(8)
    prose = " ".join(f"w{rng.randrange(3000)}" for _ in range(230))
    texts = [None, "", prose, prose, prose.upper(), "AB " * 300, prose + " #", "a" * 5, prose + " Ab|", prose + " x",
             " ".join(f"w{rng.randrange(90)}" for _ in range(240))]
    rows = [(i, t, "en", s, 1) for i, (t, s) in enumerate(
        (rng.choice(texts), rng.choice(["web", "web", "web", "book", "", None])) for _ in range(160))]
    return rows + [rows[3], rows[3], (None, prose, "en", "web", 1), (None, prose, "en", "web", 1), (7, prose, "en", "book", 1)]


def brute_audit(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, _, source, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and first[t] < i}
        parts[source or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part, members in parts.items():
        steps, shapley = [], Counter()
        for order in permutations("ABCDE"):
            alive = members
            for n, f in enumerate(order, 1):
                gone = [m for m in alive if f in m[0]]
                alive = [m for m in alive if f not in m[0]]
                shapley[f] += len(gone)
                failing = sum(f in m[0] for m in members)
                steps.append((part, "".join(order), n, f, len(alive), len(gone), failing - len(gone),
                              sum(m[0] == {f} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone)))
        out += [(*s[:3], *s[4:], shapley[s[3]]) for s in steps]
    return out


LABELS = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9, None, None), (999, 1, 1)]
AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_brute_force(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = interactions.audit_filters(clashing(spark.createDataFrame(audit_docs(), DOCS)).repartition(5), clashing(labels))
    assert got.columns == AUDIT
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_audit(audit_docs(), LABELS))
    none = interactions.audit_filters(spark.createDataFrame([], DOCS), labels.limit(0))
    assert none.columns == AUDIT and none.count() == 0


def test_audit_without_labels_and_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, None)], "doc_id long, text string")
    counts = interactions.failure_counts(df, {"S": F.length("text") < 2}, None)
    assert sorted(tuple(r) for r in counts.collect()) == [("", 0, 1), ("", 1, 2)]
    again = interactions.failure_counts(df, {"S": F.length("text") < 2}, "R")
    assert sorted(tuple(r) for r in again.collect()) == [("", 0, 1), ("", 1, 1), ("", 3, 1)]


def test_repeats_with_colliding_hashes(spark):
    rows = [(i, 1, f"t{i % 3}") for i in range(90)] + [(None, 1, "t0"), (200, 2, "alone"), (200, 2, "alone")]
    got = interactions.repeated_texts(spark.createDataFrame(rows, "id long, hash long, text string"), rows_a_part=7)
    assert sorted(r.id for r in got.collect()) == list(range(3, 90))


def test_audit_oracle(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()["op12_interactions"]).fetchall()
    assert sorted(tuple(r) for r in queries.op12_interactions(spark, SF).select(*AUDIT).collect()) == sorted(want)


# ------------------------------------------------------------ main texts

def texts_of(spark, rows, partitions=3):
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(partitions)
    return {r.page_id: r.text for r in wrappers.main_texts(df).collect()}


def marked_page(rng, i):
    body = [f"Paragraph {i}.{j} " + " ".join(f"w{rng.randrange(500)}" for _ in range(20)) for j in range(rng.randrange(1, 6))]
    title = f"Title &amp; {i}"
    parts = "".join(f"<p class=x{rng.randrange(9)}>{b}\n <b>bold</b>{i}<br>more" for b in body)
    advert = f"<div class='sky ad-slot'>Buy {rng.randrange(99)}<p>now</div>" if rng.random() < .5 else ""
    page = f"""<!DOCTYPE html><html><HEAD><title>{title} - Site<title></title><script>if (a<b) document.write("<article>");</script>
      <body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li>News</ul></nav><article><header><h2>{title}</h2>
      <p class="share">Share this</p></header>{advert}{parts}<aside>See also {i}</aside><section id="comments"><article
      class="comment"><p>First! {rng.randrange(99)}</p></article></section></article><!-- <p>no --><form>Your mail<input
      value="a>b"></form><footer>&copy; {i}</footer>"""
    return page, "\n".join([f"Title & {i}", *(f"{b} bold{i} more" for b in body)])


def plain_page(rng, i):
    """No article element and no telling names: what the host's pages have in common is template."""
    body = [f"Sentence {i}.{j} " + " ".join(f"w{rng.randrange(500)}" for _ in range(25)) for j in range(rng.randrange(1, 5))]
    menu = "<div class=a1><ul><li><a href=/>Start</a></li><li><a href=/b>Books and more books</a></li></ul></div>"
    box = "<div class=a2>Welcome to the site. We have been here since 1998.</div>" if rng.random() < .7 else ""
    page = f"<html><body>{menu}{box}<div class=a3><h1>Story {i}</h1>" + "".join(f"<p>{b}</p>" for b in body) + \
        "<div class=a4>Read the rules before you write to us.</div></div></body></html>"
    return page, "\n".join([f"Story {i}", *body])


def test_main_texts_of_two_layouts(spark):
    rng = random.Random(2)
    pages = {i: (marked_page if i % 2 else plain_page)(rng, i) for i in range(60)}
    rows = [(i, f"https://{'a' if i % 2 else 'B'}.example.org:80/p{i}", p[0]) for i, p in pages.items()]
    got = texts_of(spark, rows)
    assert got == {i: p[1] for i, p in pages.items()}
    assert texts_of(spark, rows, 1) == got


def test_main_texts_edges(spark):
    rows = [(1, None, None), (2, "http://h.example.org/", ""), (3, "http://h.example.org/", "no markup at all < 3 &lt; 4"),
            (4, "not a url", "<p>a&nbsp;b&am c&ampd&#x41;"), (5, "http://u.example.org", "<article><p>" + "word " * 200_000),
            (6, "http://v.example.org", "<div>" * 3000 + "deep" + "</div>" * 3000), (7, "http://w.example.org", "<p title='x>y"),
            (8, "http://x.example.org", "<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul>"),
            (9, "http://y.example.org", "<main><p>only</p><div hidden>x</div><div style='display: none'>y</div></main>tail"),
            (10, "http://z.example.org", "<article><h1>T</h1>text<hr>after</article>")]
    rows += [(20 + i, "http://same.example.org", "<article><h1>Same</h1><p>Same text.</p></article>") for i in range(9)]
    got = texts_of(spark, rows + [rows[2]])
    assert got == {1: "", 2: "", 3: "no markup at all < 3 < 4", 4: "a b&am c&dA", 5: ("word " * 200_000).strip(), 6: "deep",
                   7: "", 8: "a\nb\nc\nd\ne", 9: "only", 10: "T\ntext\nafter", **{20 + i: "Same\nSame text." for i in range(9)}}
    df = spark.createDataFrame(rows + [rows[2], rows[2]], "page_id long, url string, html string")
    out = wrappers.main_texts(df)
    assert out.count() == len(rows) + 2 and out.columns == ["page_id", "url", "text", "n_chars"]
    assert out.where("n_chars <> length(text) or text is null").count() == 0
    assert wrappers.main_texts(df.limit(0)).count() == 0


def test_alignment_covers_both_streams():
    """Every slot of either page has its place in the common wrapper, and page texts are told from template."""
    a, _, _ = wrappers.read_page("<div><h2>x</h2><p>1<p>2<h2>y</h2><p>3</div>")
    b, _, _ = wrappers.read_page("<div><ul><li>l</ul><h2>z</h2><p>4</div><table><td>c</table>")
    assert " ".join(p.pattern() for p in a) == "<div> ( <h2> # </h2> (<p> # </p>)+ )+ </div>"
    both = wrappers.aligned(wrappers._loaded(wrappers._dumped(a)), wrappers._loaded(wrappers._dumped(b)))
    assert " ".join(p.pattern() for p in both) == ("<div> (<ul> <li> # </li> </ul>)? ( <h2> # </h2> (<p> # </p>)+ )+ </div> "
                                                   "(<table> <td> # </td> </table>)?")
    for page in (a, b):
        assert all(w is not None for _, w in wrappers.matched(page, both))


def test_main_texts_of_the_given_pages(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        want[r.page_id] = (r.url, "\n".join(b for b in blocks if b))
    assert {r.page_id: (r.url, r.text) for r in queries.op13_html(spark, SF).collect()} == want
