"""Repeated and nearly repeated lines across a corpus, by a segment-partition join.

Each line of ``least`` or more characters is cut into ``edits + 1`` even segments. Of two lines within
``edits`` edits, the longer holds a segment of the shorter unchanged, at a place that the lengths and the
segment's number narrow down; the join is on a hash of (shorter's length, segment's number, segment).
Lists of up to ``short`` lines are joined as they are. Longer lists (many lines that share a segment)
are split by what the rest of the line is: the pairs' rests are within ``edits`` edits too, and so share
one text with a character left out (edits = 1) or a segment of their own (edits > 1). Every candidate is
verified by a banded edit distance whose column is one machine word (its vertical and horizontal
differences are bit vectors), updated character by character.

The threshold is relative: one edit for each ``least`` characters at the shortest. A line under ``least``
characters is allowed none, since one edit would make "Page 1" and "Page 2" the same; such lines are
compared for equality alone.

Occurrences are ordered by row (id, then hash of the text) and line number. An occurrence goes if its
very text came before, or if it is the first of its text and a text within ``edits`` edits came before.
Lines without a word stay. Texts are told apart by 96 bits of hash. All of it is SQL functions: no Python
runs on rows.

What is shuffled: for each distinct line and task that reads it one row of hashes (the line's and its
segments'), then each segment's hash; a very common line is one row a task. Texts are fetched in a second pass
over the rows, once the lists are known: a broadcast table of bits (``WORDS`` rows at most) leaves out nearly
all lines that share no segment with another. Where so many do that its bits fill up, it leaves out fewer, and
what is found stays the same.
The plan is the same at every size (sort-merge joins, which split a skewed key).

Nulls: a null text has no lines; null ids come first in the order. Rows that repeat both id and text are
one document; rows of one id with different texts are different documents. Other columns are ignored by
``line_classes`` and ``line_report`` and kept by ``without_repeated_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.scratch import Scratch

_SPACE = "[^\\x20\\x09-\\x0D]"
#: Words of 64 bits in a table of bits; a power of two.
WORDS = 1 << 18


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """at (what tells a row from others: its id and its text's hash) and its lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(_at(id_col, text_col).alias("at"), F.split(text, "\n").alias("lines"))


def _at(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))


def _cut(length: str, edits: int, i: int) -> tuple[str, str]:
    """Start (from 0) and length of segment i (from 0) of a line of that length; later segments take the rest."""
    n = edits + 1
    base = f"({length} div {n})"
    extra = f"({length} % {n})"
    return f"({i} * {base} + greatest(0, {i} - {n} + {extra}))", f"({base} + case when {i} >= {n} - {extra} then 1 else 0 end)"


def segment_keys(line: str, length: str, edits: int) -> Column:
    """Array of (key, role, from, size): role 0 for the line's own segments, 1 for places where a shorter line's (or an equally long one's) may be."""
    own, probes = [], []
    for shorter in range(edits + 1):  # the other line is that much shorter
        other = f"({length} - {shorter})"
        for i in range(edits + 1):
            start, size = _cut(other, edits, i)
            if not shorter:
                own.append(f"named_struct('key', xxhash64({other}, {i}, substring({line}, {start} + 1, {size})), 'role', 0, 'at', {start}, 'n', {size})")
            lo, hi = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            for shift in range(lo, hi + 1):
                if shorter or shift:
                    probes.append(f"case when {start} + {shift} >= 0 and {start} + {shift} + {size} <= {length} then named_struct('key', xxhash64({other}, {i}, substring({line}, {start} + {shift} + 1, {size})), 'role', 1, 'at', {start} + {shift}, 'n', {size}) end")
    return F.expr(f"filter(array({', '.join(own + probes)}), s -> s is not null)")


def banded_distance(a: str, b: str, edits: int) -> Column:
    """Edit distance of strings a and b (columns) if it is at most ``edits``, else something larger.

    One word of 2 * edits + 2 bits holds the column's band; its top bit is the row ``edits`` below the diagonal.
    """
    w = 2 * edits + 2
    full, top = (1 << w) - 1, 1 << (w - 1)
    start = sum(1 << k for k in range(w - 1 - edits, w))
    equal = " | ".join(f"case when i + {edits - (w - 1) + k} >= 0 and i + {edits - (w - 1) + k} < size(s.x) and s.x[greatest(0, least(i + {edits - (w - 1) + k}, size(s.x) - 1))] = s.y[i] then {1 << k}L else 0L end" for k in range(w))
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    # what has moved below the pattern's last row is followed along that row
    last = f"shiftright({1 << (w - 2)}L, i - (size(s.x) - {edits}))"
    moved = f"d.dist + case when i < size(s.x) - {edits} then case when (e & {top}L) = 0 then 1 else 0 end else case when (h.hp & {last}) <> 0 then 1 when (h.hn & {last}) <> 0 then -1 else 0 end end"
    step = f"named_struct('vp', h.hn | ({full}L & ~(shiftright(e, 1) | h.hp)), 'vn', shiftright(e, 1) & h.hp, 'dist', {moved})"
    step = let(f"named_struct('hp', d.vn | ({full}L & ~(e | d.vp)), 'hn', e & d.vp)", "h", step)
    step = let(f"(((((q & d.vp) + d.vp) & {full}L) ^ d.vp) | q | d.vn)", "e", step)
    step = let(f"({equal})", "q", step)
    fold = f"aggregate(sequence(0, size(s.y) - 1), named_struct('vp', {start}L, 'vn', 0L, 'dist', {edits}), (d, i) -> case when d.dist > {3 * edits + 1} then d else {step} end, d -> d.dist)"
    split = lambda v: f"filter(split({v}, ''), c -> c <> '')"
    return F.expr(f"""case when length({a}) = 0 or length({b}) = 0 or least(length({a}), length({b})) <= {edits} then levenshtein({a}, {b})
      when abs(length({a}) - length({b})) > {edits} then {edits + 1}
      else {let(f"case when length({a}) >= length({b}) then named_struct('x', {split(b)}, 'y', {split(a)}) else named_struct('x', {split(a)}, 'y', {split(b)}) end", 's', fold)} end""")


def _rest_keys(edits: int) -> Column:
    """Of key and rest: hashes of which two rests within ``edits`` edits share one at least."""
    if edits == 1:
        return F.expr("array_distinct(concat(array(xxhash64(key, rest)), transform(sequence(1, greatest(1, length(rest))), i -> xxhash64(key, concat(substring(rest, 1, i - 1), substring(rest, i + 1, length(rest)))))))")
    return F.transform(segment_keys("rest", "length(rest)", edits), lambda s: F.xxhash64(F.col("key"), s["key"]))


def _judged(rows: DataFrame, edits: int, least: int, short: int, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """Places (at, pos) of each text's first occurrence, and of those that a near text precedes."""
    lines = rows.select("at", F.posexplode("lines").alias("pos", "line")).where(F.col("line").rlike(_SPACE))
    lines = lines.withColumn("id", F.struct(F.xxhash64("line").alias("h"), F.hash("line").alias("c")))
    held = lines.withColumn("n", F.length("line")).withColumn("keys", F.when(F.col("n") >= least, segment_keys("line", "n", edits)["key"]))
    # one row for each text, without the text: it is fetched once the lists say which are needed
    firsts = held.groupBy("id").agg(F.min(F.struct("at", "pos", "keys")).alias("first"))
    firsts = tmp.save(firsts.select("id", "first.*"), "firsts")
    tmp.release()
    # a line's own segments come first; of a key that a line has twice the first counts
    keys = firsts.select("id", "keys", F.posexplode("keys").alias("i", "key")).where("array_position(keys, key) = i + 1")
    keys = keys.select("key", "id", F.when(F.col("i") <= edits, 0).otherwise(1).alias("role"))
    lists = keys.groupBy("key").agg(F.count("*").alias("held"), F.min("role").alias("least_role")).where("held > 1 and least_role = 0").select("key", "held")
    lists = tmp.save(lists, "lists")
    shared = tmp.save(_likely(keys, "key", lists, tmp, "key_bits").hint("merge").join(lists, "key"), "shared")
    tmp.drop("lists", "key_bits")
    tmp.release()
    texts = _likely(lines, "id.h", shared, tmp, "text_bits").groupBy("id").agg(F.min(F.struct("at", "pos")).alias("first"), F.min("line").alias("line"))
    texts = tmp.save(texts, "texts")
    tmp.drop("text_bits")
    tmp.release()
    few = shared.where(F.col("held") <= short)
    pairs = _pairs(few, "key")
    many = shared.where(F.col("held") > short).select("key", "id")
    placed = texts.select("id", "line", F.explode(segment_keys("line", "length(line)", edits)).alias("s")).select("id", "line", "s.*")
    rests = placed.hint("merge").join(many, ["key", "id"]).select("key", "id", "role", F.expr("concat(substring(line, 1, at), '\n', substring(line, at + n + 1, length(line)))").alias("rest"))
    fine = rests.select("id", "role", F.explode(_rest_keys(edits)).alias("key")).groupBy("key", "id").agg(F.min("role").alias("role"))
    pairs = tmp.save(pairs.unionByName(_pairs(fine, "key")).distinct(), "pairs")
    side = lambda k: texts.select(F.col("id").alias(k), F.col("line").alias(f"line_{k}"), F.col("first").alias(f"first_{k}"))
    known = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").where(banded_distance("line_a", "line_b", edits) <= edits)
    late = tmp.save(known.select(F.greatest("first_a", "first_b").alias("first")).distinct(), "late")
    tmp.drop("shared", "texts", "pairs")
    return firsts.select("at", "pos"), late.select("first.*")


def _likely(rows: DataFrame, h: str, wanted: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """The rows whose hash h is one of ``wanted``, and some others: a later join decides. What is broadcast is bounded: a table of at most WORDS words of 64 bits."""
    word = F.col(h).bitwiseAND(F.lit(WORDS - 1))
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({h}, 58) as int))")
    bits = tmp.save(wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")), name)
    return rows.withColumn("word", word).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def _pairs(rows: DataFrame, key: str) -> DataFrame:
    x = rows.where("role = 0").select(key, F.col("id").alias("x"))
    y = rows.select(key, F.col("id").alias("y"), F.col("role").alias("y_role"))
    return x.hint("merge").join(y, key).where("x < y or (y_role = 1 and x > y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _report(docs: DataFrame, edits: int, least: int, short: int, id_col: str, text_col: str, scratch: Scratch | None) -> DataFrame:
    """For each row (at): held, numbers of its lines with a word; firsts, those that no equal line precedes; lates, of these those that a near one precedes."""
    tmp = scratch or Scratch(docs.sparkSession, "lines")
    rows = _rows(docs, id_col, text_col)
    firsts, late = _judged(rows, edits, least, short, tmp)
    with_word = F.expr(f"filter(transform(lines, (x, i) -> case when x rlike '{_SPACE.replace(chr(92), chr(92) * 2)}' then i end), i -> i is not null)")
    none = F.lit(None).cast("int")
    parts = rows.select("at", with_word.alias("held"), none.alias("first"), none.alias("late"))
    parts = parts.unionByName(firsts.select("at", F.lit(None).cast("array<int>").alias("held"), F.col("pos").alias("first"), none.alias("late")))
    parts = parts.unionByName(late.select("at", F.lit(None).cast("array<int>").alias("held"), none.alias("first"), F.col("pos").alias("late")))
    return parts.groupBy("at").agg(F.first("held", ignorenulls=True).alias("held"), F.collect_set("first").alias("firsts"), F.collect_set("late").alias("lates"))


def line_classes(docs: DataFrame, edits: int = 1, least: int = 16, short: int = 32, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """For each line with a word: doc_id, pos (line number from 0), repeated and near (why it goes; both false: it stays)."""
    rows = _report(docs, edits, least, short, id_col, text_col, scratch).select("at.doc_id", F.explode("held").alias("pos"), "firsts", "lates")
    return rows.select("doc_id", "pos", (~F.array_contains("firsts", F.col("pos"))).alias("repeated"), F.array_contains("lates", F.col("pos")).alias("near"))


def line_report(docs: DataFrame, edits: int = 1, least: int = 16, short: int = 32, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """For each distinct row: doc_id, n_lines (with a word), n_repeated, n_near, and dropped, the numbers of the lines that go."""
    rows = _report(docs, edits, least, short, id_col, text_col, scratch)
    size = lambda c: F.size(c).cast("long")
    gone = F.array_sort(F.array_except("held", F.array_except("firsts", "lates")))
    return rows.select("at.doc_id", size("held").alias("n_lines"), (size("held") - size("firsts")).alias("n_repeated"), size("lates").alias("n_near"), F.array_join(gone, ",").alias("dropped"))


def without_repeated_lines(docs: DataFrame, edits: int = 1, least: int = 16, short: int = 32, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows with all their columns, without the lines that repeat or nearly repeat an earlier one."""
    found = _report(docs, edits, least, short, id_col, text_col, scratch).select("at", F.array_except("held", F.array_except("firsts", "lates")).alias("gone"))
    rows = docs.select(_at(id_col, text_col).alias("at"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.hint("merge").join(found, "at")
    text = F.col(f"row.`{text_col}`")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return joined.select(*[(left if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
