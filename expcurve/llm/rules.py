"""Quality scores by a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on a bounded sample of labelled rows; every
path to a node is a conjunctive rule.  A logistic regression with an L1 penalty
keeps few of the rules, and those become one Spark column expression over the
statistics, so scoring is a projection.  Statistics cover whole texts.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from expcurve.llm.common import crc_of, label_sample, map_arrow, stored, text_or_empty

SAMPLE_ROWS = 20_000
STATISTICS = ("n_bytes", "n_words", "bytes_per_word", "distinct_words", "top_word", "adjacent_repeats",
              "upper", "digits", "punctuation", "symbols", "bars", "marks", "high_bytes", "white_space",
              "n_lines", "words_per_line", "distinct_lines", "capitalised", "ended", "longest_word")
_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_WHITE = np.array([9, 10, 11, 12, 13, 32])
_PLAIN = np.array([ord(c) for c in ".,;:'\"-()?"])
_SYMBOL = np.array([ord(c) for c in "#$%&*+/<=>@[]\\^_`{}~"])


def statistics(text: str) -> list[float]:
    """The values of STATISTICS for a whole text; shares are 0 where there is nothing to share."""
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, w, ln = max(len(data), 1), max(len(words), 1), max(len(lines), 1)
    letters = max(int(counts[_UPPER].sum() + counts[_LOWER].sum()), 1)
    seen = Counter(words)
    firsts = b"".join([x[:1] for x in words])
    lasts = b"".join([x[-1:] for x in words])
    return [len(data), len(words), len(data) / w, len(seen) / w, max(seen.values(), default=0) / w,
            sum(map(operator.eq, words, words[1:])) / w, counts[_UPPER].sum() / letters, counts[_DIGIT].sum() / n,
            counts[_PLAIN].sum() / n, counts[_SYMBOL].sum() / n, counts[124] / n, counts[33] / n,
            counts[128:].sum() / n, counts[_WHITE].sum() / n, len(lines), len(words) / ln, len(set(lines)) / ln,
            sum(map(firsts.count, [bytes([c]) for c in _UPPER])) / w,
            (lasts.count(b".") + lasts.count(b",")) / w, max(map(len, words), default=0)]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics...), one row per input row."""
    schema = pa.schema([("doc_id", pa.int64())] + [(s, pa.float64()) for s in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([statistics(t.as_py()) for t in b.column(1)], dtype=np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(values[:, i]) for i in range(len(STATISTICS)))],
                                             schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


# ------------------------------------------------------------ model

Condition = tuple[int, bool, float]           # statistic, True for "greater", threshold


@dataclass
class RuleModel:
    intercept: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self) -> Column:
        """The probability of label 1, over the statistics' columns."""
        def holds(rule):
            tests = [F.col(STATISTICS[s]) > t if more else F.col(STATISTICS[s]) <= t for s, more, t in rule]
            return reduce(operator.and_, tests)

        total = reduce(operator.add, [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules],
                       F.lit(float(self.intercept)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int,
          least: int) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """(paths to all nodes but the root, step per row) of one regression tree on binned statistics."""
    paths: list[tuple[Condition, ...]] = []
    step = np.zeros(len(gradient))

    def best(rows):
        g, h = gradient[rows], hessian[rows]
        top, found = 1e-6, None
        base = g.sum() ** 2 / (h.sum() + 1.0)
        for s, e in enumerate(edges):
            if not len(e):
                continue
            size = len(e) + 1
            gs = np.cumsum(np.bincount(binned[rows, s], g, size))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, s], h, size))[:-1]
            ns = np.cumsum(np.bincount(binned[rows, s], minlength=size))[:-1]
            gain = gs ** 2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base
            gain[(ns < least) | (len(rows) - ns < least)] = -1
            i = int(gain.argmax())
            if gain[i] > top:
                top, found = gain[i], (s, i)
        return found

    def split(rows, path):
        found = best(rows) if len(path) < depth and len(rows) >= 2 * least else None
        if found is None:
            step[rows] = gradient[rows].sum() / (hessian[rows].sum() + 1.0)
            return
        s, i = found
        right = binned[rows, s] > i
        for more, part in ((False, rows[~right]), (True, rows[right])):
            paths.append((*path, (s, more, float(edges[s][i]))))
            split(part, paths[-1])

    split(np.arange(len(gradient)), ())
    return paths, step


def _lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights, by accelerated proximal gradient steps."""
    n = len(y)
    spread = np.maximum(x.std(axis=0), 1e-6)
    mean = x.mean(axis=0)
    z = ((x - mean) / spread).astype(np.float32)
    v = np.ones(z.shape[1])
    for _ in range(30):                 # largest curvature, by power iteration
        v = z.T @ (z @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 3.6 / (np.linalg.norm(z @ v) ** 2 / n + 1.0)
    w, w0 = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    b = b0 = float(np.log(y.mean() / (1 - y.mean())))
    for k in range(rounds):
        m = k / (k + 3)
        u, c = w + m * (w - w0), b + m * (b - b0)
        error = 1 / (1 + np.exp(-(z @ u + c))) - y
        w0, b0 = w, b
        w = u - rate * (z.T @ error) / n
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        b = c - rate * error.mean()
    return b - float((w / spread) @ mean), w / spread


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, shrinkage: float = 0.3, bins: int = 48,
              penalty: float = 1e-3) -> RuleModel:
    """A rule model from statistics and 0/1 labels; with fewer than two classes it is their constant rate."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1.0) / (len(y) + 2.0)
        return RuleModel(float(np.log(rate / (1 - rate))))
    edges = []
    for s in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, s], np.linspace(0, 1, bins + 1)[1:-1]))
        edges.append(values[values < x[:, s].max()])
    binned = np.stack([np.searchsorted(e, x[:, s], side="left") for s, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple[Condition, ...], None] = {}
    least = max(5, len(y) // 500)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        pick = np.random.default_rng(t).random(len(y)) < 0.7
        paths, step = _grow(binned[pick], edges, (y - p)[pick], (p * (1 - p))[pick] + 1e-6, depth, least)
        rules.update(dict.fromkeys(paths))
        paths, step = _grow(binned, edges, y - p, p * (1 - p) + 1e-6, depth, least)
        rules.update(dict.fromkeys(paths))
        raw += shrinkage * step
    names = list(rules)
    if not names:
        return RuleModel(float(raw[0]))
    hold = np.ones((len(y), len(names)), dtype=np.float32)
    for i, rule in enumerate(names):
        for s, more, t in rule:
            hold[:, i] *= (x[:, s] > t) == more
    b, w = _lasso_logistic(hold, y.astype(np.float64), penalty)
    return RuleModel(float(b), [(r, float(v)) for r, v in zip(names, w, strict=True) if abs(v) > 1e-9])


def train(stats: DataFrame, labels: DataFrame, label_col: str, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on about ``sample_rows`` labelled ids, taken by hash; that bound makes the sample fit for a broadcast."""
    sample, _ = label_sample(labels, label_col, sample_rows, balanced=False)
    values = F.min(F.struct(*STATISTICS)).alias("s")    # one row for a repeated id
    rows = (stats.join(F.broadcast(sample), stats["doc_id"] == sample["_id"])
            .groupBy("_id", "_y").agg(values).orderBy("_id", "_y").select("s.*", "_y").toPandas())
    return fit_rules(rows[list(STATISTICS)].to_numpy(np.float64), rows["_y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 4, held_fold: int = 2,
                  threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    Labels are learnt from rows whose crc32 of the id, as text, modulo ``folds``
    is not ``held_fold``; only the text is an input of a score.  Null and empty
    texts are scored as empty.  Repeated rows are each scored; a null id is
    hashed as the empty text and has no label.  Labels other than 0 and 1 are
    ignored; without both of them the score is one constant.  Other columns are
    ignored; an empty table gives no row.
    """
    stats = stored(with_statistics(docs), "statistics")
    model = train(stats, labels.where(crc_of("doc_id") % folds != held_fold), label_col, sample_rows)
    return (stats.withColumn("score", model.score())
            .select("doc_id", (crc_of("doc_id") % folds == held_fold).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
