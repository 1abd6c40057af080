"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of tokens: opening and closing tags of block elements (with
their class names), one token ``#`` for a stretch of text, one for an element
that is no part of any article by its name, role or class (menus, footers,
adverts, forms, comments, scripts ...).  Repeated neighbours fold into a
repeated group.  The wrapper of a host is inferred by aligning the streams of
its pages one after the other: equal tokens stay, texts that differ make the
slot variable, and a token without a partner is resolved into a repetition of
the group before it or else into an optional part.  No alternatives are needed,
so every two streams have a common wrapper.

Pages with the same stream (the page's *shape*) differ in their texts only, so
a host's distinct shapes are aligned, in the order of their digests, first in
4096 groups, then 64, then one: no task sees all pages of a host, a group is
streamed, and the result is the same for every layout of the input.

Wrapper and shape give for each slot of a page whether it is template or data.
The article of the shape is its ``article`` or ``main`` part with most words,
or without one the part of the page that holds nearly all data; its slots are
kept unless the host repeats them as template.  Texts never move: a second scan
of the pages takes the kept slots, with a table of one row per host and shape.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expcurve.llm.common import map_arrow, stored

BROADCAST_BYTES = 32 << 20
TEMPLATE_PAGES = 5
_LEVELS = (4096, 64, 1)
_MAX_DEPTH = 200

# fixed values: elements of HTML by how they are laid out, and names that mark what is not an article
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("iframe noembed noframes script style textarea title".split())
_NEVER = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input map menu nav noembed noframes noscript object "
    "script search select style svg template textarea title video".split())
_IN_HEAD = frozenset("base link meta noscript script style template title head html".split())
_ENDS_P = _BLOCKS - {"body", "caption", "html", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
         "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
         "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
                   "toolbar".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner banners breadcrumb breadcrumbs comment commentlist "
    "comments consent cookie cookies disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promos promotion recommended related replies reply respond "
    "share sharing sidebar signup skyscraper social sponsor sponsored sponsors subscribe subscription toolbar widget "
    "widgets".split())
_HEADERS = frozenset(["header", "topbar"])
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|))*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


class Part:
    """A token or group of a stream: ``#`` is a text, a key in brackets a repeated group of several parts."""

    __slots__ = ("key", "optional", "many", "parts", "blocks", "stat")

    def __init__(self, key: str, parts: list | None = None, optional: bool = False, many: bool = False):
        self.key, self.parts, self.optional, self.many = key, parts or [], optional, many
        self.blocks: list[int] = []               # texts of one page
        self.stat: list | None = None             # [pages, words, words in links, least, greatest digest]

    def absorb(self, other: Part) -> None:
        """Make this part match the other one as well."""
        self.optional |= other.optional
        self.many |= other.many
        if self.key == "#":
            self.blocks += other.blocks
            self.stat = joined_stat(self.stat, other.stat)
        else:
            self.parts = aligned(self.parts, other.parts)

    def pattern(self) -> str:
        """The part as a regular expression over tokens."""
        inner = " ".join(p.pattern() for p in self.parts)
        text = self.key if self.key == "#" or not inner else f"( {inner} )" if self.key[0] == "(" else \
            f"<{self.key}> {inner} </{self.key}>"
        sign = ("*" if self.many else "?") if self.optional else "+" if self.many else ""
        return f"({text}){sign}" if sign and text[0] != "(" else text + sign

    def dumped(self) -> list:
        return [self.key, self.optional + 2 * self.many, [p.dumped() for p in self.parts], self.stat]

    @classmethod
    def loaded(cls, data: list) -> Part:
        part = cls(data[0], [cls.loaded(p) for p in data[2]], bool(data[1] & 1), bool(data[1] & 2))
        part.stat = data[3]
        return part


def joined_stat(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return a or b
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4])]


def slots(parts: list[Part]) -> Iterator[Part]:
    for p in parts:
        if p.key == "#":
            yield p
        else:
            yield from slots(p.parts)


def folded(parts: list[Part]) -> list[Part]:
    """The parts with repeated neighbours, single or in groups of up to four, as repeated groups."""
    out: list[Part] = []
    for p in parts:
        if out and out[-1].key == p.key:
            out[-1].absorb(p)
            out[-1].many = True
        else:
            out.append(p)
    for size in (2, 3, 4):
        at, parts, out = 0, out, []
        while at < len(parts):
            keys = [p.key for p in parts[at:at + size]]
            here = at + size
            while len(keys) == size and [p.key for p in parts[here:here + size]] == keys:
                here += size
            if here > at + size:
                group = Part(f"({' '.join(keys)})", parts[at:at + size], many=True)
                for start in range(at + size, here, size):
                    group.absorb(Part(group.key, parts[start:start + size]))
                out.append(group)
                at = here
            else:
                out.append(parts[at])
                at += 1
    return out


def _places(parts: list[Part]) -> dict[str, list[int]]:
    places: dict[str, list[int]] = {}
    for i, p in enumerate(parts):
        places.setdefault(p.key, []).append(i)
    return places


def _next(places: dict[str, list[int]], key: str, at: int) -> int | None:
    found = places.get(key, [])
    i = bisect_left(found, at)
    return found[i] if i < len(found) else None


def _one_turn(group: Part, parts: list[Part], at: int) -> int:
    """Number of parts from ``at`` on that are one turn of the group, or 0."""
    if group.key[0] != "(":
        return 0
    keys = [p.key for p in group.parts]
    return len(keys) if keys and [p.key for p in parts[at:at + len(keys)]] == keys else 0


def _partner(part: Part, parts: list[Part], places: dict[str, list[int]], at: int) -> int | None:
    """The first place from ``at`` on where the part, or one turn of it, stands."""
    found = _next(places, part.key, at)
    if part.key[0] == "(" and part.parts:
        turns = places.get(part.parts[0].key, [])
        turn = next((i for i in turns[bisect_left(turns, at):] if _one_turn(part, parts, i)), None)
        found = min((i for i in (found, turn) if i is not None), default=None)
    return found


def aligned(a: list[Part], b: list[Part]) -> list[Part]:
    """The parts of a common wrapper of two sequences (both are used up)."""
    in_a, in_b = _places(a), _places(b)
    out: list[Part] = []

    def option(p: Part) -> None:
        if out and out[-1].key == p.key:          # a repetition of the part before
            out[-1].absorb(p)
            out[-1].many = True
        else:
            p.optional = True
            out.append(p)

    i = j = 0
    while i < len(a) and j < len(b):
        if a[i].key == b[j].key:
            a[i].absorb(b[j])
            out.append(a[i])
            i, j = i + 1, j + 1
            continue
        if n := _one_turn(a[i], b, j):
            a[i].absorb(Part(a[i].key, b[j:j + n]))
            out.append(a[i])
            i, j = i + 1, j + n
            continue
        if n := _one_turn(b[j], a, i):
            b[j].absorb(Part(b[j].key, a[i:i + n]))
            out.append(b[j])
            i, j = i + n, j + 1
            continue
        skip_a, skip_b = _partner(b[j], a, in_a, i), _partner(a[i], b, in_b, j)
        if skip_a is not None and (skip_b is None or skip_a - i <= skip_b - j):
            for p in a[i:skip_a]:
                option(p)
            i = skip_a
        elif skip_b is not None:
            for p in b[j:skip_b]:
                option(p)
            j = skip_b
        else:
            option(a[i])
            option(b[j])
            i, j = i + 1, j + 1
    for p in [*a[i:], *b[j:]]:
        option(p)
    return out


def matched(shape: list[Part], wrapper: list[Part]) -> Iterator[tuple[Part, Part | None]]:
    """(slot of the shape, the wrapper's slot it matches or None), in page order."""
    places, i, j = _places(wrapper), 0, 0
    groups = [n for n, p in enumerate(wrapper) if p.key[0] == "("]
    while i < len(shape):
        p = shape[i]
        found = _next(places, p.key, j)
        turn = next((g for g in groups if g >= j and _one_turn(wrapper[g], shape, i)), None)
        if turn is not None and (found is None or turn < found):
            n = _one_turn(wrapper[turn], shape, i)
            yield from matched(shape[i:i + n], wrapper[turn].parts)
            i, j = i + n, turn + 1
            continue
        if found is None:
            yield from ((s, None) for s in ([p] if p.key == "#" else slots(p.parts)))
        elif p.key == "#":
            yield p, wrapper[found]
        else:
            yield from matched(p.parts, wrapper[found].parts)
        i, j = i + 1, j if found is None else found + 1


# ------------------------------------------------------------ one page

def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _no_article(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Is the element no part of an article, by its name, role, class or id?"""
    if tag in _NEVER or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", "").lower()):
        return True
    if attributes.get("role", "").lower() in _ROLES:
        return True
    if tag in ("html", "body", "main") or tag in _HEADINGS:
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if tag == "article":
        return any(n.lower() in _NAMES for n in names.split())
    parts = {m.lower() for m in _NAME_PART.findall(names)}
    return bool(parts & _NAMES) or (not in_article and bool(parts & _HEADERS))


def _key(tag: str, attributes: dict[str, str]) -> str:
    names = sorted(n for n in attributes.get("class", "").split() if not re.search(r"\d", n))
    return ".".join([tag, *names]).replace("(", "").replace(")", "") or tag


class _Reader:
    """The folded token stream of a page and its texts."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.links: list[int] = []
        self.root: list[Part] = []
        self.stack: list[tuple] = []              # (tag, key, parts or None for an inline element, skipped)
        self.pieces: list[str] = []
        self.link_words = self.in_links = self.skipped = self.in_article = 0
        self.read(page)
        self.close(0)
        self.flush()
        self.parts = folded(self.root)

    def here(self) -> list[Part]:
        return next((e[2] for e in reversed(self.stack) if e[2] is not None), self.root)

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            part = Part("#")
            part.blocks.append(len(self.texts))
            self.here().append(part)
            self.texts.append(text)
            self.links.append(self.link_words)
        self.pieces, self.link_words = [], 0

    def close(self, down_to: int) -> None:
        """Close open elements until that many are left."""
        while len(self.stack) > down_to:
            tag, key, parts, skipped = self.stack[-1]
            if parts is not None:
                self.flush()
            elif tag in _BLOCKS and not self.skipped:
                self.flush()
            self.stack.pop()
            self.skipped -= skipped
            self.in_links -= tag == "a"
            self.in_article -= tag in ("article", "main")
            if parts:
                self.here().append(Part(key, folded(parts)))

    def close_tag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                return self.close(i)
            if self.stack[i][0] in ("td", "th", "table") and tag not in ("tr", "td", "th", "tbody", "thead", "tfoot", "table"):
                return

    def imply_ends(self, tag: str) -> None:
        if tag not in _IN_HEAD and self.stack and any(e[0] == "head" for e in self.stack):
            self.close(next(i for i, e in enumerate(self.stack) if e[0] == "head"))
        if tag in _ENDS_P:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    self.close(i)
                    break
                if self.stack[i][0] in _BLOCKS or self.stack[i][0] == "button":
                    break
        ends, until = _ENDS.get(tag, ((), ()))
        cut = None
        for i in range(len(self.stack) - 1 if ends else -1, -1, -1):
            if self.stack[i][0] in until:
                break
            if self.stack[i][0] in ends:
                cut = i
        if cut is not None:
            self.close(cut)

    def open_tag(self, tag: str, attribute_text: str) -> None:
        self.imply_ends(tag)
        if tag in _VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br" and not self.skipped:
                self.pieces.append(" ")
            return
        attributes = _attributes(attribute_text) if attribute_text.strip(" /") else {}
        skip = not self.skipped and _no_article(tag, attributes, self.in_article > 0)
        block = tag in _BLOCKS
        key, parts = tag, None
        if block and not self.skipped:
            self.flush()
        if skip and (block or tag in _NEVER):
            if tag not in ("head", "script", "style", "title", "noscript", "template"):
                self.here().append(Part(f"{_key(tag, attributes)}!"))
        elif block and not self.skipped and len(self.stack) < _MAX_DEPTH:
            key, parts = _key(tag, attributes), []
        self.stack.append((tag, key, parts, skip))
        self.skipped += skip
        self.in_links += tag == "a"
        self.in_article += tag in ("article", "main")

    def read(self, page: str) -> None:
        at = 0
        while at < len(page):
            m = _TOKEN.search(page, at)
            end = m.start() if m else len(page)
            if end > at and not self.skipped:
                text = page[at:end]
                if not text.isspace() and any(e[0] == "head" for e in self.stack):
                    self.imply_ends("body")
                text = html_lib.unescape(text) if "&" in text else text
                self.pieces.append(text)
                if self.in_links:
                    self.link_words += len(text.split())
            if not m:
                break
            at = m.end()
            if m[1]:
                self.close_tag(m[1].lower())
            elif m[2]:
                tag = m[2].lower()
                self.open_tag(tag, m[3])
                if tag in _RAW:                   # text up to the end tag, whatever it looks like
                    end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
                    at = end.start() if end else len(page)


def read_page(page: str) -> tuple[list[Part], list[str], list[int]]:
    """(folded stream, texts of its blocks, their words in links)."""
    reader = _Reader(page)
    return reader.parts, reader.texts, reader.links


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _dumped(parts: list[Part]) -> str:
    return json.dumps([p.dumped() for p in parts], ensure_ascii=False, separators=(",", ":"))


def _loaded(text: str) -> list[Part]:
    return [Part.loaded(p) for p in json.loads(text)]


def _digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


# ------------------------------------------------------------ a host's pages

_SHAPES = "host string, shape_id string, shape string, slots string"


def _page_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shape, statistics of its slots), one row per host and shape of a batch."""
    for b in batches:
        seen: dict[tuple[str, str], list] = {}
        for url, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            parts, texts, links = read_page(page.as_py())
            found = []
            for s in slots(parts):
                digest = _digest("\n".join(texts[i] for i in s.blocks))
                found.append([1, sum(len(texts[i].split()) for i in s.blocks), sum(links[i] for i in s.blocks), digest, digest])
            key = (host_of(url), _dumped(parts))
            known = seen.get(key)
            seen[key] = found if known is None else [joined_stat(x, y) for x, y in zip(known, found, strict=True)]
        yield pa.RecordBatch.from_pylist(
            [{"host": h, "shape_id": _digest(s), "shape": s, "slots": json.dumps(v)} for (h, s), v in seen.items()],
            schema=pa.schema([(n, pa.string()) for n in ("host", "shape_id", "shape", "slots")]))


def _wrapper_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align the rows of each (host, part), which come sorted, into one wrapper; one is held at a time."""
    names = ["host", "part", "shape_id", "shape"]
    types = [pa.string(), pa.int32(), pa.string(), pa.string()]

    def row(key, first, parts):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, first, _dumped(parts)), types, strict=True)],
                                          names)

    key = first = shape = None
    wrapper: list[Part] = []

    def whole():
        return aligned(wrapper, shape[1]) if wrapper else shape[1]

    for b in batches:
        for r in b.to_pylist():
            parts = _loaded(r["shape"])
            if r["slots"] is not None:
                for s, stat in zip(slots(parts), json.loads(r["slots"]), strict=True):
                    s.stat = stat
            if key != (r["host"], r["part"]):
                if key is not None:
                    yield row(key, first, whole())
                key, first, wrapper, shape = (r["host"], r["part"]), r["shape_id"], [], None
            elif shape[0] == r["shape_id"]:       # the same shape from another task
                for s, t in zip(slots(shape[1]), slots(parts), strict=True):
                    s.stat = joined_stat(s.stat, t.stat)
                continue
            if shape is not None:
                wrapper = whole()
            shape = (r["shape_id"], parts)
    if key is not None:
        yield row(key, first, whole())


def host_wrappers(shapes: DataFrame) -> DataFrame:
    """(host, wrapper) from the shapes of ``page_shapes``: groups of shapes, then groups of wrappers, are aligned."""
    tasks = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("shape_id"), F.lit(_LEVELS[0])).cast("int")
    rows = shapes.select("host", part.alias("part"), "shape_id", "shape", "slots")
    for level, size in enumerate(_LEVELS):
        if level:
            rows = rows.select("host", (F.col("part") % size).alias("part"), "shape_id", "shape",
                               F.lit(None).cast("string").alias("slots"))
        rows = rows.repartition(tasks, "host", "part").sortWithinPartitions("host", "part", "shape_id", "slots")
        rows = map_arrow(rows, _wrapper_step, "host string, part int, shape_id string, shape string")
    return rows.select("host", F.col("shape").alias("wrapper"))


def _tag(part: Part) -> str:
    return part.key.split(".", 1)[0]


def _all_parts(parts: list[Part]) -> Iterator[Part]:
    for p in parts:
        yield p
        yield from _all_parts(p.parts)


def kept_slots(shape: list[Part], wrapper: list[Part]) -> list[bool]:
    """Which slots of a shape hold the article, by what the host's wrapper says of them."""
    stat = {id(s): w.stat for s, w in matched(shape, wrapper) if w is not None and w.stat}
    varies = {k: v[3] != v[4] for k, v in stat.items()}
    heading = {id(s) for p in _all_parts(shape) if _tag(p) in _HEADINGS for s in slots(p.parts)}

    def words(parts: list[Part]) -> float:
        """Words of data, as a mean over the pages that have the slot, not counting links."""
        total = 0.0
        for s in slots(parts):
            pages, n, links = stat.get(id(s), (1, 1, 0))[:3]
            total += (n - links) / pages
        return total

    def outermost(names: tuple[str, ...], parts: list[Part]) -> Iterator[Part]:
        for p in parts:
            if _tag(p) in names:
                yield p
            else:
                yield from outermost(names, p.parts)

    def template(s: Part, pages: int) -> bool:
        """The same text in all of the host's pages that have the slot, while others of the region vary."""
        return id(s) in stat and not varies[id(s)] and stat[id(s)][0] >= pages

    def region() -> tuple[list[Part], bool]:
        mains = list(outermost(("main",), shape))
        articles = list(outermost(("article",), mains or shape)) if not mains else \
            [a for m in mains for a in outermost(("article",), m.parts)]
        main = max(mains, key=lambda p: words(p.parts), default=None)
        best = max(articles, key=lambda p: words(p.parts), default=None)
        if best is not None and (main is None or 2 * words(best.parts) >= words(main.parts)):
            return best.parts, True
        if main is not None:
            return main.parts, True
        parts = shape
        while True:                               # go down while one part holds nearly all data and no title is left out
            total = words(parts)
            inner = next((p for p in parts if p.parts and p.parts[0].key != "#" and words(p.parts) >= 0.8 * total), None)
            if inner is None or any(id(s) in heading and varies.get(id(s), True)
                                    for p in parts if p is not inner for s in ([p] if p.key == "#" else slots(p.parts))):
                return parts, False
            parts = inner.parts

    chosen, marked = region()
    inside = list(slots(chosen))
    some_vary = any(varies.get(id(s), False) for s in inside)
    keep = set()
    for s in inside:
        pages, n, links = stat.get(id(s), (1, 1, 0))[:3]
        if marked:
            drop = some_vary and id(s) not in heading and template(s, TEMPLATE_PAGES)
        else:
            drop = (some_vary and template(s, 2)) or 2 * links > n
        if not drop:
            keep.add(id(s))
    return [id(s) in keep for s in slots(shape)]


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    host = wrapper = None
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["host"] != host:
                host, wrapper = r["host"], _loaded(r["wrapper"])
            out.append(kept_slots(_loaded(r["shape"]), wrapper))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(out, pa.list_(pa.bool_()))], ["host", "shape_id", "keep"])


def _page_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of the page but its html, with host, shape and (slot, text) of its blocks in page order."""
    block = pa.struct([("slot", pa.int32()), ("text", pa.string())])
    for b in batches:
        hosts, shapes, blocks = [], [], []
        for url, page in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            parts, texts, _ = read_page(page.as_py())
            slot_of = {i: n for n, s in enumerate(slots(parts)) for i in s.blocks}
            hosts.append(host_of(url))
            shapes.append(_digest(_dumped(parts)))
            blocks.append([{"slot": slot_of[i], "text": t} for i, t in enumerate(texts)])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(hosts, pa.string()), pa.array(shapes, pa.string()),
             pa.array(blocks, pa.list_(block))], ["page_id", "url", "host", "shape_id", "blocks"])


def page_rules(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """((host, wrapper), (host, shape_id, keep)): the hosts' wrappers and, for every stream of tokens that a
    host's pages have, which of its slots hold the article."""
    source = pages.select(F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    shapes = stored(map_arrow(source, _page_shapes, _SHAPES), "shapes")
    wrappers = stored(host_wrappers(shapes), "wrappers")
    distinct = shapes.groupBy("host", "shape_id").agg(F.min("shape").alias("shape"))
    pairs = distinct.join(wrappers, "host").select("host", "shape_id", "shape", "wrapper")
    return wrappers, stored(map_arrow(pairs, _decide, "host string, shape_id string, keep array<boolean>"), "rules")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the article of every page, its blocks joined by line feeds.

    Character references are decoded; white space in a block, line breaks
    included, becomes one space.  A null or empty page and a page without text
    have an empty text; pages without a host in their url form one host, named
    by the empty string.  Rows are judged one by one, so repeated and null ids
    are kept; other columns are ignored; an empty table gives no rows.  Broken
    markup is read as browsers read it, elements nested over 200 deep as if
    they stood at that depth.
    """
    _, rules = page_rules(pages, url_col, html_col)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                          F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    found = map_arrow(source, _page_texts, "page_id long, url string, host string, shape_id string, "
                      "blocks array<struct<slot: int, text: string>>")
    size = rules.agg(F.sum(F.octet_length("host") + F.size("keep") + 64)).first()[0] or 0
    joined = found.join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, ["host", "shape_id"], "left")
    kept = F.filter("blocks", lambda x: F.get(F.col("keep"), x.slot))
    text = F.array_join(F.transform(kept, lambda x: x.text), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
