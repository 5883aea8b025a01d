"""Benchmark decontamination by SimHash windows.

A benchmark item of L words gets windows of c words, c the largest step of a ladder (about 4/3 apart)
up to 3/4 of L: one for each offset in the item. Documents get windows of each c in use, at strides so
short that at least two windows lie inside any passage of L words. A window's fingerprint has 64 bits,
the signs of sums over its word pairs. Within the radius r, two fingerprints agree up to r // 3 bits in
at least one of three blocks; tables list each item block's whole neighbourhood, so that no fingerprint
within the radius is missed. A candidate is verified exactly, at item size: the weighted Jaccard
similarity (weight: occurrences) of the item's and the passage's word shingles, at the best of the
starts up to ``slack`` words around the place that the fingerprint gives.

Everything about a document happens in the task that reads it: there is no shuffle and no skew. The
index holds the benchmark only. It is built for up to ``most_prints`` item fingerprints at a time; a
larger benchmark takes several passes.

Nulls: a null text is empty, in either table; rows with a null id are compared like others. Items of
fewer words than a shingle are skipped: they say nothing about a leak. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm import words

_U = np.uint64
#: Bits of the blocks, and their shift.
BLOCKS = ((21, 0), (21, 21), (22, 42))
LINKS = "doc_id long, item_id long, similarity double, first_word long, n_words int"


def _ladder(length: int) -> int:
    c, step = 2, 2.0
    while int(step) <= 0.75 * length and step <= 1 << 15:
        c, step = int(step), step * 4 / 3
    return c


def _lanes(pairs: np.ndarray, lane: int) -> list[np.ndarray]:
    """Running sums of the 64 bits, 64 / lane of them in each word.

    A difference of two sums is exact in each lane as long as the window's own count fits: what the
    running sums carry from lane to lane cancels out.
    """
    ones = _U(sum(1 << k for k in range(0, 64, lane)))
    out = []
    for j in range(lane):
        total = np.zeros(len(pairs) + 1, np.uint64)
        np.cumsum((pairs >> _U(j)) & ones, out=total[1:])
        out.append(total)
    return out


def _prints(sums: list[np.ndarray], at: np.ndarray, c: int) -> np.ndarray:
    """Fingerprints of the windows of c words from each place on; sums: by _lanes with _lane(c), over word pairs."""
    lane = len(sums)
    low = sum(1 << k for k in range(0, 64, lane))
    lift = _U(low * ((1 << lane - 1) - 1 - (c - 1) // 2))  # more than half reaches the lane's top bit
    out, end = np.zeros(len(at), np.uint64), at + (c - 1)
    for j, total in enumerate(sums):
        out |= (((total[end] - total[at] + lift) >> _U(lane - 1)) & _U(low)) << _U(j)
    return out


def _lane(c: int) -> int:
    return 8 if c <= 128 else 16


class Index:
    def __init__(self, items: list[tuple[int | None, str | None]], size: int, radius: int):
        self.ids, self.length, self.shingles, self.stride, prints, self.size, self.radius = [], [], [], {}, {}, size, radius
        for item_id, text in items:
            w = next(words.words_of(pa.array([text], pa.string()), limit=1 << 62))
            n = len(w.hash)
            if n < size:
                continue
            k, c = len(self.ids), _ladder(n)
            self.ids.append(item_id)
            self.length.append(n)
            self.shingles.append(np.unique(words.runs(w, size)[0][: n - size + 1], return_counts=True))
            at = np.arange(n - c + 1)
            prints.setdefault(c, []).append((_prints(_lanes(words.runs(w, 2)[0], _lane(c)), at, c), np.full(len(at), k), at))
            self.stride[c] = min(self.stride.get(c, 1 << 30), max(1, (n - c + 1) // 2))
        self.prints = {c: [np.concatenate(x) for x in zip(*v, strict=True)] for c, v in prints.items()}
        self.tables = {c: [self._table(v[0], bits, shift) for bits, shift in BLOCKS] for c, v in self.prints.items()}

    def _table(self, prints: np.ndarray, bits: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """For each value of the block where its list starts, and the lists of fingerprints."""
        near = self.radius // len(BLOCKS)
        flips = np.array([sum(1 << b for b in x) for k in range(near + 1) for x in itertools.combinations(range(bits), k)], np.uint32)
        block = ((prints >> _U(shift)) & _U((1 << bits) - 1)).astype(np.uint32)
        keys = (block[:, None] ^ flips[None, :]).ravel()
        starts = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount(keys, minlength=1 << bits), out=starts[1:])
        return starts, (np.argsort(keys, kind="stable") // len(flips)).astype(np.uint16 if len(prints) < 1 << 16 else np.int32)

    def candidates(self, c: int, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item fingerprint) within the radius; a pair may come from more than one block."""
        own = self.prints[c][0]
        for (bits, shift), (starts, which) in zip(BLOCKS, self.tables[c], strict=True):
            block = ((found >> _U(shift)) & _U((1 << bits) - 1)).astype(np.int64)
            lo = starts[block]
            size = starts[block + 1] - lo
            window = np.flatnonzero(size)
            lo, size, k = lo[window], size[window], 0
            while len(window):  # the k-th of each list
                item = which[lo + k]
                close = np.bitwise_count(found[window] ^ own[item]) <= self.radius
                if close.any():
                    yield window[close], item[close]
                k += 1
                more = size > k
                window, lo, size = window[more], lo[more], size[more]

    def similarity(self, k: int, window: np.ndarray) -> float:
        own, weight = self.shingles[k]
        held, times = np.unique(window, return_counts=True)
        _, i, j = np.intersect1d(own, held, assume_unique=True, return_indices=True)
        common = np.minimum(weight[i], times[j]).sum()
        return float(common / (weight.sum() + times.sum() - common))

    def matches(self, w: words.Words, percent: int, slack: int) -> dict[tuple[int, int], tuple[float, int]]:
        """(document, item) -> (similarity, first word of the passage), of a chunk's documents."""
        out: dict[tuple[int, int], tuple[float, int]] = {}
        if not len(w.hash):
            return out
        pairs = words.runs(w, 2)[0]
        sums = {lane: _lanes(pairs, lane) for lane in {_lane(c) for c in self.prints}}
        full = words.runs(w, self.size)[0]
        counts = np.diff(w.word_at)
        doc_of = np.repeat(np.arange(len(w)), counts)
        place = np.arange(len(w.hash)) - np.repeat(w.word_at[:-1], counts)
        left = np.repeat(w.word_at[1:], counts) - np.arange(len(w.hash))
        for c, (_, items, offsets) in self.prints.items():
            at = np.flatnonzero((left >= c) & (place % self.stride[c] == 0))
            tried: set[tuple[int, int]] = set()
            for window, print_ in self.candidates(c, _prints(sums[_lane(c)], at, c)):
                for p, f in zip(at[window].tolist(), print_.tolist(), strict=True):
                    k, d = int(items[f]), int(doc_of[p])
                    if out.get((d, k), (0.0, 0))[0] == 1.0:
                        continue
                    first, end = int(w.word_at[d]), int(w.word_at[d + 1])
                    for q in range(p - int(offsets[f]) - slack, p - int(offsets[f]) + slack + 1):
                        q = max(q, first)
                        if (q, k) in tried:
                            continue
                        tried.add((q, k))
                        held = full[q : max(q, min(q + self.length[k], end) - self.size + 1)]
                        s = self.similarity(k, held)
                        if 100 * s >= percent and s > out.get((d, k), (0.0, 0))[0]:
                            out[d, k] = (s, q - first)
        return out


_indexes: dict[tuple, Index] = {}


def _index(items, size: int, radius: int) -> Index:
    """Once in each worker."""
    key = (items.id if hasattr(items, "id") else id(items), size, radius, len(items.value), hash(tuple(items.value)))
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(items.value, size, radius)
    return _indexes[key]


def _found(items, size: int, percent: int, radius: int, slack: int, text_at: int, keep):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items, size, radius)
        for batch in batches:
            hits = {}
            for w in words.words_of(batch.column(text_at), limit=1 << 17):
                hits |= {(w.first + d, k): v for (d, k), v in index.matches(w, percent, slack).items()}
            yield keep(index, batch, hits)

    return run


def _as_links(index: Index, batch: pa.RecordBatch, hits: dict) -> pa.RecordBatch:
    keys = sorted(hits)
    ids = batch.column(0).cast(pa.int64()).take(pa.array([d for d, _ in keys], pa.int64()))
    return pa.RecordBatch.from_arrays([ids, pa.array([index.ids[k] for _, k in keys], pa.int64()), pa.array([hits[x][0] for x in keys], pa.float64()), pa.array([hits[x][1] for x in keys], pa.int64()), pa.array([index.length[k] for _, k in keys], pa.int32())], [x.split()[0] for x in LINKS.split(", ")])


def _as_rest(index: Index, batch: pa.RecordBatch, hits: dict) -> pa.RecordBatch:
    clean = np.ones(batch.num_rows, bool)
    clean[[d for d, _ in hits]] = False
    return batch.filter(pa.array(clean))


def _portions(benchmark: DataFrame, most_prints: int, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in portions whose size is bounded: about a quarter of an item's words are its fingerprints."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).orderBy("item_id", "text")
    held, prints = [], 0
    for r in rows.toLocalIterator():
        n = len((r["text"] or "").split()) // 4 + 1
        if held and prints + n > most_prints:
            yield held
            held, prints = [], 0
        held.append((r["item_id"], r["text"]))
        prints += n
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80, radius: int = 11, slack: int = 2, most_prints: int = 4000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Passages of benchmark items in documents: doc_id, item_id, similarity, first_word, n_words; the best passage of each pair."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], LINKS)
    for k, portion in enumerate(_portions(benchmark, most_prints, item_col, item_text_col)):
        found = rows.mapInArrow(_found(spark.sparkContext.broadcast(portion), size, percent, radius, slack, 1, _as_links), LINKS)
        out = found if k == 0 else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80, radius: int = 11, slack: int = 2, most_prints: int = 4000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no passage of the benchmark."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for portion in _portions(benchmark, most_prints, item_col, item_text_col):
        docs = docs.mapInArrow(_found(spark.sparkContext.broadcast(portion), size, percent, radius, slack, at, _as_rest), docs.schema)
    return docs
