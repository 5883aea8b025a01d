"""Quality rules with thresholds that adapt to each language and source.

Each document's measures are integers. A quantile sketch counts them in buckets whose width grows with
the value (five significant bits, so a quantile is off by 1/32 at most). Sketches merge by adding their
counts: groups of a language and source add up to languages, and languages to the whole. A group's
threshold is ``median + spread * max(upper quartile - median, least)``; groups of fewer than ``enough``
documents use their language's sketch, and small languages the whole corpus's. Documents that fail the
base rules don't shape the sketches. All of it is SQL functions: no Python runs on rows.

Nulls: a null text has no words (and so fails the base rules); null languages and sources are groups of
their own; a null id is kept as it is. Rows that repeat count as often. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kithgraph.llm.scratch import Scratch

#: Measure -> (its value in thousandths, the least spread that counts). Times ``spread`` it must lie below what the
#: base rules allow, or the rule could reject nothing: 6 x 40 of 500 for repeated words.
MEASURES = {
    "symbols": ("1000 * n_symbols div greatest(1, word_chars)", 15),
    "exclaims": ("1000 * n_exclaims div greatest(1, word_chars)", 15),
    "capitals": ("1000 * n_capitals div greatest(1, word_chars)", 60),
    "dup_lines": ("1000 * n_dup_lines div greatest(1, n_lines)", 60),
    "repeats": ("1000 * n_repeat_words div greatest(1, n_words)", 40),
}
SPACE = "[\\x20\\x09-\\x0D]"


def words_col(text: str) -> Column:
    return F.expr(f"filter(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')")


_REPEATED = """
element_at(transform(array(transform(words, w -> xxhash64(w))), h ->
  element_at(transform(array(transform(sequence(0, size(h) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2]))), t ->
    case when size(array_distinct(t)) = size(t) then 0L else
      element_at(transform(array(sort_array(transform(t, (x, i) -> named_struct('h', x, 'p', i)))), s ->
        element_at(transform(array(sort_array(transform(
            filter(s, (x, i) -> (i > 0 and s[greatest(i - 1, 0)].h = x.h) or (i < size(s) - 1 and s[least(i + 1, size(s) - 1)].h = x.h)),
            x -> x.p))), p ->
          aggregate(zip_with(slice(p, 2, size(p)), slice(p, 1, size(p) - 1), (b, a) -> least(3, b - a)), 3L, (n, d) -> n + d)), 1)), 1)
    end), 1)), 1)
"""


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base counts of each row; word triples are told apart by their 64-bit hash, within a text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    left = lambda chars: F.char_length("text") - F.char_length(F.translate("text", chars, ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.select("doc_id", "lang", "source", words_col("text").alias("words"), lines.alias("lines"), F.char_length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"), left("#*$%&|<>").cast("long").alias("n_symbols"), left("!").cast("long").alias("n_exclaims"), left("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"))
    size = F.size("words")
    rows = rows.select("doc_id", "lang", "source", size.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_exclaims", "n_capitals", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.when(size < 4, F.lit(0)).otherwise(F.expr(_REPEATED)).cast("long").alias("n_repeat_words"))
    return rows.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def thresholds(rows: DataFrame, spread: int = 6, enough: int = 30) -> DataFrame:
    """For each lang and source: the most that each measure may be, t_<measure>."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.expr(f"cast({v} as int)").alias("v")) for k, (v, _) in MEASURES.items()])).alias("m")
    bucket = F.expr("(m.v >> greatest(0, length(bin(m.v)) - 6)) << greatest(0, length(bin(m.v)) - 6)")
    groups = rows.where(~F.col("base_failed")).select("lang", "source", each).groupBy("lang", "source", "m.measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    langs = groups.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = langs.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))

    def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
        w = W.partitionBy(*by, "measure")
        ranked = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
        at = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bucket")))
        least = F.create_map(*[x for k, (_, least) in MEASURES.items() for x in (F.lit(k), F.lit(least))])
        q = ranked.groupBy(*by, "measure").agg(F.max("total").alias("docs"), at(50).alias("mid"), at(75).alias("high"))
        q = q.withColumn("t", F.col("mid") + spread * F.greatest(F.col("high") - F.col("mid"), F.element_at(least, F.col("measure"))))
        out = [F.max("docs").alias("docs"), *[F.max(F.when(F.col("measure") == k, F.col("t"))).alias(f"t_{k}") for k in MEASURES]]
        return q.groupBy(*by).agg(*out) if by else q.agg(*out)

    fine, mid = quantiles(groups, ["lang", "source"]), quantiles(langs, ["lang"])
    top = quantiles(whole, [])
    name = lambda df, k: df.select(*[F.col(c).alias(f"{k}_{c}") for c in df.columns])
    keys = rows.select("lang", "source").distinct()
    out = keys.join(name(fine, "f"), F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    out = out.join(name(mid, "l"), F.col("lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(name(top, "w")))  # the whole corpus is one row
    pick = lambda k: F.when(F.col("f_docs") >= enough, F.col(f"f_t_{k}")).when(F.col("l_docs") >= enough, F.col(f"l_t_{k}")).otherwise(F.col(f"w_t_{k}"))
    return out.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[pick(k).alias(f"t_{k}") for k in MEASURES])


def quality_rules(docs: DataFrame, spread: int = 6, enough: int = 30, scratch: Scratch | None = None, **columns: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the first rule broken, of each row."""
    tmp = scratch or Scratch(docs.sparkSession, "rules")
    rows = tmp.save(measured(docs, **columns), "measured")
    limits = tmp.save(thresholds(rows, spread, enough), "limits")
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    broken = F.when(F.col("base_failed"), F.lit("base"))
    for k, (v, _) in MEASURES.items():
        broken = broken.when(F.expr(v) > F.col(f"t_{k}"), F.lit(k))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", broken.isNull().alias("kept"), F.coalesce(broken, F.lit("")).alias("broken"))


SQL = r"""
with d as (select rowid_ as r, doc_id, lang, source, coalesce(text, '') as text from (select row_number() over () as rowid_, * from documents)),
w as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as p from (select r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d)),
t as (select r, p, w, w || chr(32) || lead(w) over o || chr(32) || lead(w, 2) over o as tri from w window o as (partition by r order by p)),
c as (select r, p, tri is not null and count(*) over (partition by r, tri) > 1 as twice from t),
m as (select r, twice or coalesce(lag(twice) over o, false) or coalesce(lag(twice, 2) over o, false) as marked from c window o as (partition by r order by p)),
n as (select r, count(*) as n_words, count(*) filter (marked) as n_repeat_words from m group by r),
l as (select r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
b as (select d.r, d.doc_id, d.lang, d.source, coalesce(n.n_words, 0) as n_words, coalesce(n.n_repeat_words, 0) as n_repeat_words,
  length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  length(regexp_replace(d.text, '[^!]', '', 'g')) as n_exclaims, length(regexp_replace(d.text, '[^A-Z]', '', 'g')) as n_capitals,
  len(l.ls) as n_lines, len(l.ls) - len(list_distinct(l.ls)) as n_dup_lines
  from d left join n using (r) join l using (r)),
x as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b),
e as (select r, lang, source, base_failed, unnest([{MEASURE_LIST}]) as m from x),
k as (select r, lang, source, base_failed, m.measure as measure, m.v as v, m.least as least, greatest(0, length(bin(m.v)) - 6) as s from e),
g as (select r, lang, source, base_failed, measure, v, least, (v >> s) << s as bucket from k),
f as (select lang, source, measure, max(least) as least, count(*) as docs, quantile_disc(bucket, 0.5) as mid, quantile_disc(bucket, 0.75) as high from g where not base_failed group by all),
la as (select lang, measure, max(least) as least, count(*) as docs, quantile_disc(bucket, 0.5) as mid, quantile_disc(bucket, 0.75) as high from g where not base_failed group by all),
wh as (select measure, max(least) as least, count(*) as docs, quantile_disc(bucket, 0.5) as mid, quantile_disc(bucket, 0.75) as high from g where not base_failed group by all),
v as (select g.r, bool_or(g.v > case when f.docs >= 30 then f.mid + 6 * greatest(f.high - f.mid, f.least) when la.docs >= 30 then la.mid + 6 * greatest(la.high - la.mid, la.least) else wh.mid + 6 * greatest(wh.high - wh.mid, wh.least) end) as over,
  min(case when g.v > case when f.docs >= 30 then f.mid + 6 * greatest(f.high - f.mid, f.least) when la.docs >= 30 then la.mid + 6 * greatest(la.high - la.mid, la.least) else wh.mid + 6 * greatest(wh.high - wh.mid, wh.least) end then {RANK} end) as first_over
  from g left join f on g.lang is not distinct from f.lang and g.source is not distinct from f.source and g.measure = f.measure
  left join la on g.lang is not distinct from la.lang and g.measure = la.measure left join wh on g.measure = wh.measure group by g.r)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and not coalesce(over, false) as kept,
  case when base_failed then 'base' when over then list_extract([{NAMES}], first_over) else '' end as broken
from x join v using (r)
""".replace("{MEASURE_LIST}", ", ".join("{'measure': '%s', 'v': cast(%s as integer), 'least': %d}" % (k, v.replace(" div ", " // "), least) for k, (v, least) in MEASURES.items())).replace("{RANK}", "case g.measure " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(MEASURES, 1)) + " end").replace("{NAMES}", ", ".join(f"'{k}'" for k in MEASURES))  # fmt: skip
