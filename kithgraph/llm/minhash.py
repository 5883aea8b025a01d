"""Near-duplicate groups by bottom-k sketches of one hash function.

A document's sketch is the k smallest hashes of its distinct word shingles. The steps are:

1. Documents with the same set are one node (its smallest id stands for it).
2. Inverted lists of retained values generate overlaps. Two sketches of a linked pair share at
   least ``shared(n)`` values, so that each document need only be listed under its rarest
   ``size - shared(n) + 1`` values (the prefix principle, with list lengths as the order).
3. In lists of up to ``short`` documents the pairs are compared by the estimate of the union's
   sketch. In longer lists, which hold near copies of one text, all documents are tied to the
   first one, without a test: this only widens the group in which the next step looks.
4. Each tied group is cut into blocks. In a block all pairs are verified on the full sets, by
   products of 0/1 matrices. A group of many blocks shares one pivot document among them; only
   documents that no block has connected with the pivot are then held against the other blocks.

Links are exact (full sets). What can be missed is bounded by the sketch alone: a linked pair of
which the union's k smallest values hold fewer than ``shared(n)`` common ones, less than one in 10^9.

Nulls: a null text is empty; an empty set is linked with nothing. A null id takes part in no group
(its component is null, kept is true). Rows that repeat an id are one node. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import words
from kithgraph.llm.components import components
from kithgraph.llm.scratch import Scratch

SETS = "doc_id long, n long, k1 long, k2 long, sketch array<long>"
_U = np.uint64


@lru_cache(maxsize=None)
def _likely(k: int, percent: int) -> int:
    """The most values t such that fewer than t of k are common with a chance below 1e-9 at that similarity."""
    p, below = percent / 100, 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > 1e-9:
            return t
    return k


@lru_cache(maxsize=None)
def shared(n: int, k: int, percent: int) -> int:
    """Values that the sketch of a set of n shares at least with that of any linked set."""
    union = n * 100 // percent
    apart = k - union * (100 - percent) // 100
    if n > k:
        return max(1, _likely(k, percent), apart)
    need = -(-n * percent // 100)
    return max(1, need if union <= k else min(need, apart))


def _sets(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, k1, k2, sketches = batch.column(0), [], [], [], []
            for _, found in words.shingle_sets(batch.column(1), size):
                n.append(len(found))
                other = words.mix(found + _U(0x51ED270B))
                k1.append(found.sum(dtype=np.uint64).astype(np.int64))
                k2.append(np.bitwise_xor.reduce(other).astype(np.int64) if len(found) else np.int64(0))
                sketches.append(found[:k].view(np.int64))
            at = np.cumsum([0, *(len(x) for x in sketches)]).astype(np.int32)
            flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(k1, np.int64)), pa.array(np.array(k2, np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "n", "k1", "k2", "sketch"])

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tie(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _common(sets: list[np.ndarray], columns: int = 1 << 15) -> np.ndarray:
    """Sizes of all intersections of a block's sets; ``columns`` values are multiplied at a time."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    if not sets:
        return out
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count[column] > 1
    row, column = row[often], column[often]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    place = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        lo, hi = np.searchsorted(place, [at, at + columns])
        marks = np.zeros((len(sets), int(place[hi - 1]) - at + 1), np.float32)
        marks[row[lo:hi], place[lo:hi] - at] = 1
        out += marks @ marks.T
    return out


def _block(table: pa.Table, size: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids, and the places of all its linked pairs."""
    sets = [x for _, x in words.shingle_sets(table.column("text"), size)]
    n = np.array([len(x) for x in sets], np.int64)
    common = np.rint(_common(sets)).astype(np.int64)
    a, b = np.nonzero(np.triu(100 * common >= percent * (n[:, None] + n[None, :] - common), 1) & (common > 0))
    return table.column("doc_id").to_numpy(), a, b


def _connect(size: int, percent: int):
    """For a whole group in one block: (node, component) of its linked documents."""

    def run(table: pa.Table) -> pa.Table:
        ids, a, b = _block(table.sort_by("doc_id"), size, percent)
        forest = _Forest(len(ids))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            forest.tie(x, y)
        held = np.unique(np.concatenate([a, b]))
        return pa.table({"node": pa.array(ids[held], pa.int64()), "component": pa.array([int(ids[forest.root(x)]) for x in held.tolist()], pa.int64())})

    return run


def _verify(size: int, percent: int):
    """Links that connect what a block can connect, beyond what column ``same`` says is connected already.

    role 0 is one side of the pairs, 1 the other; without 1 all pairs of the block count.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, a, b = _block(table, size, percent)
        role = table.column("role").to_numpy()
        forest, first = _Forest(len(ids)), {}
        for i, c in enumerate(table.column("same").to_pylist()):
            forest.tie(i, first.setdefault(c, i))
        one_side = bool((role == 0).all())
        links = [(int(ids[x]), int(ids[y])) for x, y in zip(a.tolist(), b.tolist(), strict=True) if (one_side or role[x] != role[y]) and forest.tie(x, y)]
        x, y = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, k: int = 48, short: int = 64, block: int = 192, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    size: words of a shingle. percent: smallest Jaccard similarity of a link. k: values of a sketch.
    short: longest inverted list whose pairs are compared one by one. block: documents of a block.
    """
    spark = docs.sparkSession
    tmp = scratch or Scratch(spark, "neardup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = tmp.save(texts.mapInArrow(_sets(size, k), SETS), "sets")
    nodes = sets.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    nodes = tmp.save(nodes, "nodes")
    tied = _tied(nodes, k, percent, short, tmp)
    groups = tmp.save(components(spark, tied, scratch=tmp).withColumnsRenamed({"node": "rep", "component": "g"}), "groups")
    found = tmp.save(_components(texts, groups, size, percent, block, tmp), "found")
    whose = nodes.select("k1", "k2", "n", "rep").join(found, F.col("rep") == F.col("node"), "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("c"))
    joined = sets.drop("sketch").join(whose.withColumnsRenamed({"k1": "r1", "k2": "r2", "n": "r"}), (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & (F.col("n") == F.col("r")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    out = joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    out = tmp.save(out, "out")
    tmp.drop("sets", "nodes", "lists", "tied", "groups", "held", "links1", "so_far", "now", "links2", "found")
    return out


def _tied(nodes: DataFrame, k: int, percent: int, short: int, tmp: Scratch) -> DataFrame:
    """Pairs (a, b) of documents that may be linked, at least by way of others; see the module's steps 2 and 3."""
    needs = F.array(*[F.lit(shared(n, k, percent)) for n in range(1, 8 * k)], F.lit(_likely(k, percent)))
    nodes = nodes.withColumn("own", F.size("sketch")).withColumn("need", F.element_at(needs, F.least(F.col("n"), F.lit(8 * k)).cast("int")))
    listed = nodes.select("rep", "n", "own", "need", F.explode("sketch").alias("v"))
    lengths = listed.groupBy("v").agg(F.count("*").alias("length")).where("length > 1")
    common = listed.join(lengths, "v").groupBy("rep", "n", "own", "need").agg(F.sort_array(F.collect_list(F.struct("length", "v"))).alias("vs"))
    first = F.col("own") - F.col("need") + 1 - (F.col("own") - F.size("vs"))  # places left after the values that no other document has
    lists = common.where(first > 0).select("rep", "n", F.explode(F.slice("vs", 1, F.greatest(first, F.lit(1)))).alias("s")).select("rep", "n", F.col("s.v").alias("v"))
    lists = tmp.save(lists, "lists")
    sizes = lists.groupBy("v").agg(F.count("*").alias("held"), F.min("rep").alias("head")).where("held > 1")
    long = lists.join(sizes.where(F.col("held") > short), "v").where("rep > head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    few = lists.join(sizes.where(F.col("held") <= short), "v").select("v", "rep", "n")
    x, y = few.withColumnsRenamed({"rep": "a", "n": "na"}), few.withColumnsRenamed({"rep": "b", "n": "nb"})
    pairs = x.join(y, "v").where(F.expr(f"a < b and 100 * least(na, nb) >= {percent} * greatest(na, nb)")).select("a", "b").distinct()
    side = lambda n: nodes.select(F.col("rep").alias(n), F.col("sketch").alias(f"s{n}"), F.col("need").alias(f"need{n}"), F.col("own").alias(f"own{n}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    both = pairs.withColumn("i", F.array_intersect("sa", "sb")).withColumn("i", F.when(F.size("i") >= F.least("needa", "needb"), F.col("i"))).where("i is not null")
    hits = F.size(F.array_intersect(F.slice(F.expr("array_sort(array_union(sa, sb), (l, r) -> case when (l ^ (-9223372036854775807L - 1L)) < (r ^ (-9223372036854775807L - 1L)) then -1 when l = r then 0 else 1 end)"), 1, k), F.col("i")))
    exact = (F.col("owna") < k) & (F.col("ownb") < k)
    near = both.where(exact | (hits >= F.least("needa", "needb"))).select("a", "b")
    return tmp.save(long.unionByName(near), "tied")


def _components(texts: DataFrame, groups: DataFrame, size: int, percent: int, block: int, tmp: Scratch) -> DataFrame:
    """(node, component) of the linked documents; see the module's step 4."""
    spark, check = texts.sparkSession, _verify(size, percent)
    sizes = groups.groupBy("g").agg(F.ceil(F.count("*") / block).alias("blocks"))
    member = groups.join(sizes, "g").withColumn("part", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep"), "blocks")).otherwise(0))
    # one plan at every size: the texts are dealt by id
    held = tmp.save(texts.hint("merge").join(member, F.col("rep") == F.col("doc_id")).select("g", "blocks", "part", "doc_id", "text"), "held")
    done = held.where("blocks = 1").groupBy("g").applyInArrow(_connect(size, percent), "node long, component long")
    many = held.where("blocks > 1")
    if many.limit(1).count() == 0:
        return done
    pivot = many.groupBy("g", "blocks").agg(F.min_by(F.struct("doc_id", "text"), F.xxhash64("doc_id")).alias("p"))
    spread = pivot.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "p.doc_id", "p.text")
    one = many.select("g", "part", "doc_id", "text").unionByName(spread).distinct()
    one = one.select("g", "part", "doc_id", "text", F.lit(0).alias("role"), F.col("doc_id").alias("same"))
    first = tmp.save(one.groupBy("g", "part").applyInArrow(check, "a long, b long"), "links1")
    # what the blocks have connected, as seen from the pivots
    so_far = tmp.save(components(spark, first, scratch=tmp), "so_far")
    heads = pivot.select("g", F.col("p.doc_id").alias("head")).join(so_far, F.col("head") == F.col("node"), "left").select("g", F.coalesce("component", "head").alias("main"))
    now = many.join(so_far, F.col("doc_id") == F.col("node"), "left").withColumn("same", F.coalesce("component", "doc_id")).drop("node", "component").join(heads, "g")
    now = tmp.save(now, "now")
    rest = now.where("same <> main")
    parts = rest.groupBy("g").agg(F.ceil(F.count("*") / block).alias("outs"))
    rest = rest.join(parts, "g").withColumn("out", F.pmod(F.xxhash64("doc_id", F.lit(1)), "outs"))
    a = rest.select("g", "out", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "doc_id", "text", F.lit(0).alias("role"), "same")
    b = now.join(parts, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("out"), "part", "doc_id", "text", F.lit(1).alias("role"), "same")
    second = tmp.save(a.unionByName(b).groupBy("g", "out", "part").applyInArrow(check, "a long, b long"), "links2")
    return done.unionByName(components(spark, first.unionByName(second), scratch=tmp))
