"""Toxicity scores by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its
beginnings of 3 to 6 letters, so unseen inflections of a known stem still
carry its meaning.  Filters one, two and three words wide run over the whole
text; each keeps its maximum, and a logistic layer reads the maxima.  A filter
is linear before its maximum, so scoring projects every distinct word once and
adds rows of that table.

Training uses a bounded sample of labelled rows (SAMPLE_ROWS texts and
SAMPLE_CHARS characters at most in all, a documented bound of the fit only);
the workers turn it into feature numbers, so the driver holds no text.  Part of
it calibrates the probability.  All labelled rows that were not trained on set
a decision threshold for each language, weighted to the labels' rates; the
thresholds are a table with one row a language.  The language decides on the
threshold only: it is no input of the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expcurve.llm.common import crc_of, fresh, label_sample, map_arrow, ship_package, stored, text_or_empty

BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
STEMS = (3, 4, 5, 6)
_NONE = (0,) * (1 + len(STEMS))
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 32_000_000
KEPT_WORDS = 1 << 16
SCORE_STEPS = 500
BROADCAST_LANGS = 100_000
_GROUP_WORDS = 100_000
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_"


def words_of(text: str) -> list[str]:
    return text.lower().split()


@lru_cache(maxsize=1 << 14)
def _stem_ids(start: str) -> tuple[int, ...]:
    """Buckets of the beginnings of all words longer than STEMS that start like this, or of this one short word."""
    return tuple(1 + zlib.crc32(start[:n].encode("utf-8", "replace"), n) % (BUCKETS - 1) if len(start) > n else 0
                 for n in STEMS)


def feature_ids(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its proper beginnings; bucket 0 is no feature."""
    w = word.strip(_STRIP)
    if not w:
        return _NONE
    return (1 + zlib.crc32(w.encode("utf-8", "replace")) % (BUCKETS - 1), *_stem_ids(w[:STEMS[-1] + 1]))


class WordTable:
    """Numbers of distinct words, with a row of values each, up to a bound."""

    def __init__(self, values):
        self.values, self.number = values, {"": 0}
        self.rows = values([""])

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > KEPT_WORDS:
            self.number, self.rows = {"": 0}, self.rows[:1].copy()
        number, before = self.number, len(self.number)
        out = np.fromiter([number.setdefault(w, len(number)) for w in words], dtype=np.int64, count=len(words))
        if len(number) > before:
            if len(number) > len(self.rows):
                grown = np.empty((2 * len(number), self.rows.shape[1]), dtype=self.rows.dtype)
                grown[:before] = self.rows[:before]
                self.rows = grown
            new = list(islice(reversed(number), len(number) - before))[::-1]
            self.rows[before:len(number)] = self.values(new)
        return out


def _positions() -> list[tuple[int, int]]:
    return [(w, p) for w in WIDTHS for p in range(w)]


@dataclass
class ConvModel:
    embeddings: np.ndarray
    kernels: np.ndarray                   # DIM x (positions of all widths * FILTERS)
    bias: np.ndarray                      # widths * FILTERS
    output: np.ndarray                    # widths * FILTERS
    intercept: float
    slope: float = 1.0                    # calibration
    offset: float = 0.0
    trained_ids: list[int] = field(default_factory=list)

    def project(self, words: list[str]) -> np.ndarray:
        ids = np.array([feature_ids(w) for w in words], dtype=np.int64)
        return (self.embeddings[ids].sum(axis=1) @ self.kernels).astype(np.float32)

    def raw(self, table: WordTable, docs: list[list[str]]) -> np.ndarray:
        """The logistic layer's input for whole documents."""
        # two empty words end each document; no filter starts at them, so none reaches into the next
        flat = [w for d in docs for w in (*d, "", "")]
        number = table.numbers(flat)
        starts = np.cumsum([0] + [len(d) + 2 for d in docs[:-1]])
        ends = starts + np.array([len(d) for d in docs], dtype=np.int64)
        maxima = np.full((len(docs), len(self.bias)), -np.inf, dtype=np.float32)
        for lo in range(0, len(flat), _GROUP_WORDS):
            part = table.rows[number[lo:lo + _GROUP_WORDS + max(WIDTHS) - 1]]
            n = min(_GROUP_WORDS, len(flat) - lo)
            at = np.flatnonzero((starts < lo + n) & (np.append(starts[1:], len(flat)) > lo))
            cuts = np.maximum(starts[at] - lo, 0)
            out = np.empty((n, len(self.bias)), dtype=np.float32)
            column = 0
            for k, w in enumerate(WIDTHS):
                total = part[:n, column:column + FILTERS].copy()
                for p in range(1, w):
                    shifted = part[p:p + n, column + p * FILTERS:column + (p + 1) * FILTERS]
                    total[:len(shifted)] += shifted
                out[:, k * FILTERS:(k + 1) * FILTERS] = total
                column += w * FILTERS
            for pad in (ends - lo, ends + 1 - lo):
                out[pad[(pad >= 0) & (pad < n)]] = -np.inf
            maxima[at] = np.maximum(maxima[at], np.maximum.reduceat(out, cuts, axis=0))
        maxima[np.isneginf(maxima)] = 0           # documents without words
        hidden = np.maximum(maxima + self.bias, 0)
        return hidden @ self.output + self.intercept

    def raw_of(self, features: np.ndarray) -> float:
        """The same for the ``text_features`` of one document, filter by filter."""
        words = self.embeddings[features].sum(axis=1)
        n = len(features) - 2
        kernels = self.kernels.reshape(DIM, -1, FILTERS)
        maxima = [sum(words[p:p + n] @ kernels[:, at + p] for p in range(w)).max(axis=0) if n else np.zeros(FILTERS)
                  for w, at in zip(WIDTHS, np.cumsum([0, *WIDTHS[:-1]]), strict=True)]
        return float(np.maximum(np.concatenate(maxima) + self.bias, 0) @ self.output + self.intercept)

    def scores(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -30, 30)))


def _log_odds(ids: list[np.ndarray], y: np.ndarray, sure: float = 1.5) -> np.ndarray:
    """How much more often a feature occurs in documents of label 1, less what chance explains."""
    n1, n0 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for f, label in zip(ids, y, strict=True):
        (n1 if label else n0)[np.unique(f)] += 1
    odds = np.log((n1 + 0.5) / (y.sum() + 1)) - np.log((n0 + 0.5) / (len(y) - y.sum() + 1))
    error = np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
    odds = np.sign(odds) * np.maximum(np.abs(odds) - sure * error, 0)
    odds[0] = 0
    return odds


def text_features(text: str, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Feature numbers of a text's words, one row each, and of two empty words that end it."""
    words = [*words_of(text), "", ""]
    for w in words:
        if w not in known:
            known[w] = feature_ids(w)
    return np.array([known[w] for w in words], dtype=np.uint16)


def fit(docs: list[np.ndarray], y: np.ndarray, seen: int = 24_000, batch: int = 32, seed: int = 5) -> ConvModel:
    """Train on the ``text_features`` of documents: embeddings, filters and output layer by Adam on the logistic
    loss, classes weighted alike.

    The embeddings' first component starts as the feature's log odds and the
    first narrow filter as its sum; the rest start at random.  About ``seen``
    documents are visited, in 4 to 12 rounds.
    """
    rng = np.random.default_rng(seed)
    odds = _log_odds(docs, y)
    emb = rng.normal(0, 0.05, (BUCKETS, DIM))
    emb[:, 0] += odds
    emb[0] = 0
    places = _positions()
    ker = rng.normal(0, 0.1, (DIM, len(places), FILTERS))
    ker[0, 0, 0] = 1.0
    nf = len(WIDTHS) * FILTERS
    bias, out, inter = np.zeros(nf), rng.normal(0, 0.1, nf), np.zeros(1)
    out[0] = 0.5
    first = {w: places.index((w, 0)) for w in WIDTHS}
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in
             {"ker": ker, "bias": bias, "out": out, "inter": inter}.items()}
    emb_v = np.zeros((BUCKETS, DIM))
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    steps = 0

    def adam(name, value, grad, rate):
        m, v = state[name]
        m += 0.1 * (grad - m)
        v += 0.001 * (grad ** 2 - v)
        value -= rate * (m / (1 - 0.9 ** steps)) / (np.sqrt(v / (1 - 0.999 ** steps)) + 1e-8)

    for _ in range(min(12, max(4, seen // max(len(docs), 1)))):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            steps += 1
            grad = {"ker": np.zeros_like(ker), "bias": np.zeros_like(bias), "out": np.zeros_like(out),
                    "inter": np.zeros_like(inter)}
            touched, moves = [], []
            pick = order[lo:lo + batch]
            for d in pick:
                ids = docs[d]
                n = len(ids) - 2
                if n <= 0:
                    continue
                words = emb[ids].sum(axis=1)
                best, raw = np.empty(nf, dtype=np.int64), np.empty(nf)
                for k, w in enumerate(WIDTHS):
                    total = sum(words[p:p + n] @ ker[:, first[w] + p] for p in range(w))
                    s = slice(k * FILTERS, (k + 1) * FILTERS)
                    best[s] = total.argmax(axis=0)
                    raw[s] = total[best[s], np.arange(FILTERS)]
                hidden = np.maximum(raw + bias, 0)
                error = (1 / (1 + np.exp(-np.clip(hidden @ out + inter[0], -30, 30))) - y[d]) * weight[d] / len(pick)
                grad["out"] += error * hidden
                grad["inter"] += error
                back = error * out * (raw + bias > 0)
                grad["bias"] += back
                for k, w in enumerate(WIDTHS):
                    s = slice(k * FILTERS, (k + 1) * FILTERS)
                    for p in range(w):
                        at = best[s] + p
                        grad["ker"][:, first[w] + p] += words[at].T * back[s]
                        delta = back[s][:, None] * ker[:, first[w] + p].T
                        touched.append(ids[at].ravel())
                        moves.append(np.repeat(delta, ids.shape[1], axis=0))
            if not touched:
                continue
            rows, where = np.unique(np.concatenate(touched).astype(np.int64), return_inverse=True)
            g = np.zeros((len(rows), DIM))
            np.add.at(g, where, np.concatenate(moves))
            emb_v[rows] += g ** 2
            emb[rows] -= 0.05 * g / (np.sqrt(emb_v[rows]) + 1e-6)
            emb[0] = 0
            for name, value in (("ker", ker), ("bias", bias), ("out", out), ("inter", inter)):
                adam(name, value, grad[name], 0.01)
    return ConvModel(emb.astype(np.float32), ker.reshape(DIM, -1).astype(np.float32), bias.astype(np.float32),
                     out.astype(np.float32), float(inter[0]))


def best_threshold(scores: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The middle of the widest gap between scores that makes fewest errors by weight; 0.5 without both labels."""
    if len(y) == 0 or y.min() == y.max():
        return 0.5
    weight = np.ones(len(y)) if weight is None else weight
    s, at = np.unique(scores, return_inverse=True)
    toxic, clean = np.bincount(at, weight * y), np.bincount(at, weight * (1 - y))
    errors = np.append(0, np.cumsum(toxic)) + clean.sum() - np.append(0, np.cumsum(clean))
    low, high = np.concatenate([[0.0], s]), np.concatenate([s, [1.0]])
    at = np.flatnonzero(errors <= errors.min() + 1e-9 * weight.sum())
    i = at[(high - low)[at].argmax()]
    return float(np.clip((low[i] + high[i]) / 2, 0.05, 0.95))


def calibrate(model: ConvModel, raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Fit slope and offset to rows not trained on, weighted to the labels' rates."""
    if len(y) and y.min() < y.max():
        target = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            g = weight * (p - target)
            h = weight * np.maximum(p * (1 - p), 1e-6)
            grad = np.array([(g * raw).sum() + 1e-3 * (a - 1), g.sum()])
            hess = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-6]])
            move = np.linalg.solve(hess, grad)
            a, b = a - 0.5 * move[0], b - 0.5 * move[1]
        if np.isfinite(a) and np.isfinite(b) and a > 0:
            model.slope, model.offset = float(a), float(b)


def _sampled_features(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(_id, _y, features) of the texts of the broadcast ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str, tuple[int, ...]] = {}
            data = [text_features(t.as_py(), known).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], ["_id", "_y", "features"])

    rows = (docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("text"))
            .join(F.broadcast(ids), "_id").select("_id", "_y", "text"))
    return map_arrow(rows, run, "_id long, _y int, features binary")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS,
          sample_chars: int = SAMPLE_CHARS) -> ConvModel:
    """Fit on about ``sample_rows`` labelled texts, up to half of them of either label, taken by their id's hash,
    as long as they have ``sample_chars`` characters together: a text that no longer fits is left out of the fit.
    Every fifth of them calibrates instead of training.  The bounds make the sampled ids fit for a broadcast, so
    no text is shuffled or comes to the driver."""
    spark = docs.sparkSession
    ids, rate = label_sample(labels, label_col, sample_rows, balanced=True)
    sizes = (docs.select(F.col("doc_id").cast("long").alias("_id"), F.length(text_or_empty()).alias("n"))
             .join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.max("n").alias("n"))
             .orderBy(F.xxhash64("_id"), "_id", "_y").collect())
    taken, chars = [], 0
    for r in sizes:
        if chars + r["n"] <= sample_chars:
            taken.append((r["_id"], r["_y"]))
            chars += r["n"]
    sample = (_sampled_features(docs, spark.createDataFrame(taken, "_id long, _y int"))
              .groupBy("_id", "_y").agg(F.min("features").alias("features"))             # one row for a repeated id
              .orderBy("_id", "_y").collect())
    y = np.array([r["_y"] for r in sample], dtype=np.float64)
    ids = [r["_id"] for r in sample]
    width = len(_NONE)
    features = [np.frombuffer(r["features"], dtype=np.uint16).reshape(-1, width) for r in sample]
    del sample
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 2.0)            # without evidence a document passes
        nf = len(WIDTHS) * FILTERS
        return ConvModel(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, len(_positions()) * FILTERS), np.float32),
                         np.zeros(nf, np.float32), np.zeros(nf, np.float32), float(np.log(share / (1 - share))))
    tests = np.array([zlib.crc32(b"c%d" % i) % 5 == 0 for i in ids])
    model = fit([f for f, t in zip(features, tests, strict=True) if not t], y[~tests])
    model.trained_ids = sorted({i for i, t in zip(ids, tests, strict=True) if not t})
    if tests.any():
        raw = np.array([model.raw_of(f) for f, t in zip(features, tests, strict=True) if t])
        count = {v: max((y == v).sum(), 1) for v in (0, 1)}
        weight = np.array([rate[int(v)] / count[int(v)] for v in y[tests]])
        calibrate(model, raw.astype(np.float64), y[tests], weight / weight.mean())
    return model


def lang_cuts(model: ConvModel, scored: DataFrame, labels: DataFrame, label_col: str = "toxic",
              score_col: str = "score") -> DataFrame:
    """(lang, cut): a threshold per language from all labelled rows of ``scored`` (doc_id, score, perhaps lang)
    that were not trained on; languages without such rows have none.

    Each id counts once a label; the labels weigh by their rates among all labelled ids, as the sample took more
    of the one than of the other.  Only ids and scores are shuffled; a language's scores meet as counts, rounded
    to SCORE_STEPS, so a group has twice that many rows at most, however many documents and languages there are.
    """
    spark = scored.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in scored.columns else F.lit("")
    ids = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"))
           .where("_id is not null and _y in (0, 1)").distinct())
    trained = spark.createDataFrame([(i,) for i in model.trained_ids], "_id long")
    rows = (scored.select(F.col("doc_id").cast("long").alias("_id"), F.struct(F.col(score_col).alias("s"), lang.alias("lang")).alias("d"))
            .where("_id is not null").groupBy("_id").agg(F.min("d").alias("d"))       # one row for a repeated id
            .join(ids, "_id").join(F.broadcast(trained), "_id", "left_anti"))
    counts = stored(rows.groupBy(F.col("d.lang").alias("lang"), "_y", F.round(F.col("d.s") * SCORE_STEPS).alias("step"))
                    .agg(F.count("*").alias("n")), "scores")
    rate = {r["_y"]: r["count"] for r in ids.groupBy("_y").count().collect()}
    outside = {r["_y"]: r["n"] for r in counts.groupBy("_y").agg(F.sum("n").alias("n")).collect()}
    weight = {y: rate[y] / n for y, n in outside.items()}

    def cut(group: pa.Table) -> pa.Table:
        group = group.sort_by([("step", "ascending"), ("_y", "ascending")])
        y = group.column("_y").to_numpy()
        w = group.column("n").to_numpy() * np.where(y > 0, weight.get(1, 0.0), weight.get(0, 0.0))
        best = best_threshold(group.column("step").to_numpy() / SCORE_STEPS, y.astype(np.float64), w)
        return pa.table({"lang": group.column("lang").slice(0, 1), "cut": pa.array([best])})

    if not model.trained_ids:
        return spark.createDataFrame([], "lang string, cut double")
    ship_package(spark)
    return stored(counts.groupBy("lang").applyInArrow(cut, "lang string, cut double"), "cuts")


def with_threshold(df: DataFrame, cuts: DataFrame, column: str, default: float = 0.5) -> DataFrame:
    """``df`` with its language's threshold in ``column``, the default where none was calibrated.  The table of
    languages is broadcast up to BROADCAST_LANGS rows; a larger one is joined by shuffling."""
    if "lang" not in df.columns:
        cuts = cuts.where("lang = ''")
    key = fresh(df, "_lang")
    side = cuts.select(F.col("lang").alias(key), F.col("cut").alias(column))
    side = F.broadcast(side) if cuts.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS else side
    own = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in df.columns else F.lit("")
    return df.join(side, own == F.col(key), "left").drop(key).withColumn(column, F.coalesce(column, F.lit(default)))


def score_texts(docs: DataFrame, model: ConvModel, text_col: str = "text", score_col: str = "score", shared=None) -> DataFrame:
    """``docs`` with the score of every whole text in ``score_col``; ``shared`` is the model's broadcast, if there is one."""
    shared = shared or docs.sparkSession.sparkContext.broadcast(model)   # a few MB, set by BUCKETS and DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = WordTable(model.project)
        for b in batches:
            scores, group, size = [np.empty(0)], [], 0
            for text in b.column(b.schema.get_field_index(text_col)):
                group.append(words_of(text.as_py() or ""))
                size += len(group[-1])
                if size >= _GROUP_WORDS:
                    scores.append(model.scores(model.raw(table, group)))
                    group, size = [], 0
            if group:
                scores.append(model.scores(model.raw(table, group)))
            yield b.append_column(score_col, pa.array(np.concatenate(scores).astype(np.float64)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, run, f"{fields}, `{score_col}` double")


def scored_and_cut(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", score_col: str = "score",
                   sample_rows: int = SAMPLE_ROWS, dropped: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with scores and without the dropped columns, thresholds by language), both stored; the model is
    freed then, on the driver and in the workers."""
    model = train(docs, labels, label_col, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = stored(score_texts(docs, model, score_col=score_col, shared=shared).drop(*dropped), "scored")
    shared.destroy()
    return scored, lang_cuts(model, scored, labels, label_col, score_col)


def training_labels(labels: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    return labels.where(crc_of("doc_id") % folds != held_fold)


def score_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 5, held_fold: int = 0,
                   threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, rejected), one row per row of ``docs``.

    Labels are learnt from rows whose crc32 of the id, as text, modulo ``folds``
    is not ``held_fold``; only the text is an input of a score.  ``rejected``
    compares the score with the threshold of the row's language instead (set
    by all of those rows that were not trained on).  Null and empty texts are scored as empty.  Repeated rows are each scored; a null
    id is hashed as the empty text and has no label.  Without labels of both
    kinds the score is one constant.  Other columns are ignored; an empty table
    gives no row.
    """
    known = training_labels(labels, folds, held_fold)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text_or_empty().alias("text"))
    scored, cuts = scored_and_cut(rows, known, label_col, sample_rows=sample_rows, dropped=("text",))
    return (with_threshold(scored, cuts, "cut")
            .select("doc_id", (crc_of("doc_id") % folds == held_fold).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"),
                    (F.col("score") >= F.col("cut")).alias("rejected")))
