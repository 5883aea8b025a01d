"""Text quality by a generalised additive model with pairwise interactions.

Each feature is cut into bins. Boosting goes round the features in turn; each time a shallow tree
over one feature's bins is fitted to the gradient and added, scaled down, to that feature's lookup
table. Then the feature pairs that reduce the remaining loss the most get two-way tables, boosted
in turn in the same way. A score is the logistic function of a sum of table entries.

The features come from the whole text alone. Labels are the only other input of the fit, which uses
up to ``max_train`` labelled rows, the first by a hash of their id: a documented bound. Scoring
covers every row.

Nulls: a null text counts as empty and is scored. A null id has no label and isn't held out. Labels
that are null are left out; of several labels of an id the smallest counts. Without labels each score
is 0.5. Other columns are ignored, whatever their names; rows that repeat come out as often.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.llm import words
from kithgraph.llm.scratch import Scratch

FEATURES = ["log_words", "word_bytes", "symbols", "upper", "exclaims", "repeats", "distinct", "tripled", "stops", "digits", "line_words", "dup_lines", "single", "top_word", "wide", "long_words"]


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _STOP, _DIGIT = _class("#*$%&|<>"), _class(".,;:"), _class("0123456789")
_UPPER, _LOWER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz")
_WIDE = np.arange(256) >= 0x80


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    return np.concatenate([_of(w) for w in words.words_of(column)] or [np.zeros((0, len(FEATURES)))])


def _sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[at])


def _repeated(doc: np.ndarray, hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and count of the commonest, of each document."""
    if not len(hashed):
        return np.zeros(n), np.zeros(n)
    order = np.argsort(words.mix(hashed + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    d, h = doc[order], hashed[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, d[at], size)
    return np.bincount(d[at], minlength=n).astype(float), most


def _of(w: words.Words) -> np.ndarray:
    n, data = len(w), w.data
    count = np.diff(w.word_at)
    per = np.maximum(1, count)
    doc = np.repeat(np.arange(n), count)
    size = w.end - w.start
    byword = lambda v: np.bincount(doc, weights=v, minlength=n)
    upper, lower = _sums(_UPPER[data], w.text_at), _sums(_LOWER[data], w.text_at)
    lead = np.zeros(len(data), bool)  # capital letters of Latin-1, two bytes each
    lead[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    wide_upper = _sums(lead, w.text_at)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    distinct, top = _repeated(doc, w.hash, n)
    three, valid = words.runs(w, 3)
    kinds, _ = _repeated(doc[valid], three[valid], n)
    triples = np.maximum(1, np.bincount(doc[valid], minlength=n))
    newline = data == 0x0A
    newline_at = np.concatenate([[0], np.cumsum(newline)])
    line = newline_at[w.start]  # the line of each word, by number in the chunk
    first = np.ones(len(line), bool)
    first[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    lines = np.bincount(doc[at], minlength=n)
    place = (np.arange(len(line)) - np.repeat(at, np.diff(np.append(at, len(line))))).astype(np.uint64) if len(at) else np.zeros(0, np.uint64)
    sums = np.add.reduceat(words.mix(w.hash + place), at) if len(at) else np.zeros(0, np.uint64)
    line_kinds, _ = _repeated(doc[at], sums, n)
    many = np.maximum(1, lines)
    return np.stack([
        np.log1p(count), byword(size) / per, _sums(_SYMBOL[data], w.text_at) / per, (upper + wide_upper) / np.maximum(1, upper + lower + wide_upper),
        _sums(data == 0x21, w.text_at) / per, byword(same) / per, distinct / per, 1 - kinds / triples, _sums(_STOP[data], w.text_at) / per,
        _sums(_DIGIT[data], w.text_at) / per, count / many, 1 - line_kinds / many, byword(size == 1) / per, top / per,
        _sums(_WIDE[data], w.text_at) / np.maximum(1, np.diff(w.text_at)), byword(size > 12) / per,
    ], axis=1)


@dataclass
class Model:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_cuts[i], x[:, i], side="right"), np.searchsorted(self.pair_cuts[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _cuts(x: np.ndarray, most: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, most + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradient sums g and curvature sums h."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int) -> np.ndarray:
    """A step for each bin: the tree's leaf value."""
    gain, k = _best_cut(g, h, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:k], h[:k], ridge, depth - 1), _tree(g[k:], h[k:], ridge, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and steps of a tree that cuts on the first feature, then each side on the second."""
    best, out = 0.0, np.zeros_like(g)
    for k in range(1, len(g)):
        gain, steps = 0.0, np.empty_like(g)
        for part in (slice(0, k), slice(k, len(g))):
            a, b = g[part].sum(axis=0), h[part].sum(axis=0)
            gain += a.sum() ** 2 / (b.sum() + ridge) + _best_cut(a, b, ridge)[0]
            steps[part] = _tree(a, b, ridge, 1)[None, :]
        gain -= g.sum() ** 2 / (h.sum() + ridge)
        if gain > best:
            best, out = gain, steps
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pairs: int = 5, bins: int = 48, pair_bins: int = 10, rate: float = 0.15, ridge: float = 4.0) -> Model:
    model = Model()
    if not len(y):
        return model
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model.base = float(np.log(p / (1 - p)))
    if len(np.unique(y)) < 2:
        return model
    model.cuts = [_cuts(x[:, j], bins) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return q - y, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)), ridge, 2)
            table += step
            total += step[at[j]]
    model.pair_cuts = [_cuts(x[:, j], pair_bins) for j in range(x.shape[1])]
    grid = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]

    def sums(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1
        cell = grid[i] * b + grid[j]
        return np.bincount(cell, g, a * b).reshape(a, b), np.bincount(cell, h, a * b).reshape(a, b)

    g, h = slopes()
    gains = sorted(((-_pair_tree(*sums(i, j, g, h), ridge)[0], (i, j)) for i, j in itertools.combinations(range(x.shape[1]), 2)))
    model.pairs = [ij for gain, ij in gains[:pairs] if gain < 0]
    model.pair_tables = [np.zeros((len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)) for i, j in model.pairs]
    for _ in range(rounds // 4):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = rate * _pair_tree(*sums(i, j, g, h), ridge)[1]
            table += step
            total += step[grid[i], grid[j]]
    return model


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(1))
        at = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))], ["doc_id", "x"])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], ["doc_id", "score"])

    return run


def accepted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, max_train: int = 20_000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold.

    Each row is judged by its own text in the task that reads it (texts go to Python, scores alone come back);
    the labelled sample alone is joined by id.
    """
    spark = docs.sparkSession
    known = _known(labels, label_col, max_train, folds, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known.select("doc_id")), "doc_id")  # max_train ids at most
    model = spark.sparkContext.broadcast(_model(rows.mapInArrow(_extract, "doc_id long, x array<double>"), known))

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.value.score(features(texts)))

    return docs.where(F.arrow_udf(score, "double")(F.col(text_col)) >= threshold)


def _known(labels: DataFrame, label_col: str, max_train: int, folds: int, id_col: str) -> DataFrame:
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isNotNull() & ~_held(folds))
    return known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)


def _held(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0


def _model(table: DataFrame, known: DataFrame):
    """Fitted to the features of the known documents, max_train at most; of rows that repeat an id the least features count."""
    train = table.join(known, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in train], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] >= 0.5 for r in train], float))


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, max_train: int = 20_000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; rows whose id's crc32 modulo ``folds`` is 0 are held out of the fit."""
    spark = docs.sparkSession
    tmp = scratch or Scratch(spark, "quality")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = tmp.save(rows.mapInArrow(_extract, "doc_id long, x array<double>"), "features")
    model = spark.sparkContext.broadcast(_model(table, _known(labels, label_col, max_train, folds, id_col)))
    out = table.mapInArrow(_score(model), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(_held(folds), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
