"""Funding rounds in announcements: investors after cues, mentions in clusters, one round of a page.

Positions come from cutting a text at its cues: the lengths of the pieces add up to where each cue stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kithgraph.functions import names

# Phrases that an investor list follows, the longest first; what ends such a list; words of roles; limits (fixed values).
CUES = ["with additional participation from", "with participation from", "participation from", "with support from", "investors include", "investment from", "backed by", "joined by", "co-led by", "led by"]
STOPS = "[.;]|\\bto\\s|\\bwhich\\s|\\bthat\\s|\\bwill\\s|\\bsaid\\s"
ROLE_WORDS = ["managing", "general", "partner", "founder", "cofounder", "ceo", "cto", "president", "chairman", "existing", "other", "several", "various", "angel", "angels", "investors", "team"]
SPAN, GAP, MOST_ROUNDS, MOST_INVESTORS, EVIDENCE = 220, 400, 2, 12, 300

_CUE = "(?i)(?:" + "|".join(CUES) + ")"
_LED = "\\b([A-Z][\\w&.'-]*(?:\\s+[A-Z][\\w&.'-]*){0,3})\\s+(?:co-)?led\\s+(?:the|this|a|an)\\s+(?:\\w+\\s+){0,2}?(?:round|investment|financing|raise|seed|series)\\b"
_COMPANY = "(?m)^\\s*([A-Z][\\w.'&-]*(?:\\s+[A-Z][\\w.'&-]*){0,3})\\s+(?i:raises|raised|secures|secured|announces|announced|closes|closed|lands|nets)\\b"
_MONEY = "(?i)(\\$\\s?\\d[\\d.,]*\\s?(?:million|billion|m|bn|k)?\\b)"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def cleaned_candidate(raw: Column) -> Column:
    """A piece of a list as a name: after the last sentence end and cue, without an article, cut after its last organisation word."""
    text = F.trim(F.regexp_replace(raw, "\\s+", " "))
    text = F.regexp_replace(F.regexp_replace(text, "^.*\\.", ""), f"^.*?{_CUE}\\s*", "")
    text = F.trim(F.regexp_replace(F.trim(text), "(?i)^(?:the|a|an)\\s+", ""), F.lit(" .,:;'\"()[]"))
    text = F.trim(F.regexp_replace(text, "['’]s?\\b.*$", ""))

    def upto_org(t: Column) -> Column:
        words = F.split(t, " ")
        last = F.array_max(F.transform(words, lambda x, i: F.when(names.normalize(x).isin(*names.ORG_SUFFIXES), i + 1)))
        return F.when(last.isNull(), t).otherwise(F.array_join(F.slice(words, F.lit(1), last), " "))

    return _let(text, upto_org)


def is_investor(name: Column) -> Column:
    """An organisation of one to five words, no role and no person."""
    t = names.tokens(names.normalize(name))
    return (name != "") & (F.length(name) <= 48) & ~names.is_noise(name, org_ok=True) & F.size(t).between(1, 5) & ~F.exists(t, lambda x: x.isin(*ROLE_WORDS)) & ~names.is_person(name) & names.is_org(name)


def investors_in(span: Column) -> Column:
    pieces = F.transform(F.split(span, "(?i)\\s*(?:,|\\band\\b|&|\\bas well as\\b)\\s*"), cleaned_candidate)
    return F.filter(pieces, is_investor)


def _cut_at(text: Column, pattern: str, kind: str) -> Column:
    """Array of (at, what, after): where the pattern is found, what it found, and the text up to its next place."""
    found, parts = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    upto = lambda n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(found, F.lit(1), n - 1), F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(found, lambda x, i: F.struct(upto(i + 1).alias("at"), x.alias("what"), F.get(parts, i + 1).alias("after"), F.lit(kind).alias("kind")))


def mentions(texts: DataFrame) -> DataFrame:
    """id, start, end, investors: each list of investors. texts: id, text."""
    cues = F.concat(_cut_at(F.col("text"), _LED, "led"), _cut_at(F.col("text"), _CUE, "cue"))
    rows = texts.where(F.col("text").rlike(f"{_CUE}|{_LED}")).select("id", F.explode(cues).alias("m")).select("id", "m.*")
    span = F.regexp_extract(F.substring("after", 1, SPAN), f"(?is)^(.*?)(?:{STOPS}|$)", 1)
    rows = rows.withColumn("span", F.when(F.col("kind") == "led", F.regexp_extract("what", _LED, 1)).otherwise(span))
    size = F.length("what") + F.when(F.col("kind") == "led", 0).otherwise(F.length("span"))
    rows = rows.select("id", F.col("at").alias("start"), (F.col("at") + size).alias("end"), "span")
    # equal spans (a release that many sites print) are judged once; the join deals them by span and splits a frequent one
    judged = rows.select("span").distinct().select("span", investors_in(F.col("span")).alias("investors"))
    return rows.hint("merge").join(judged.where("size(investors) > 0"), "span").select("id", "start", "end", "investors")


def clusters(found: DataFrame, gap: int = GAP) -> DataFrame:
    """id, cluster, start, end, investors (each organisation once, in order), keys: mentions no further apart than ``gap`` are one round."""
    order = W.partitionBy("id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = found.withColumn("cluster", F.sum(F.when(before.isNull() | (F.col("start") - before > gap), 1).otherwise(0)).over(order))
    each = rows.select("id", "cluster", "start", "end", F.posexplode("investors").alias("pos", "name")).withColumn("key", names.org_key(F.col("name")))
    first = each.groupBy("id", "cluster", "key").agg(F.min(F.struct("start", "end", "pos", "name")).alias("f"), F.max("end").alias("end"))
    # a key that is empty counts for the span alone
    held = F.sort_array(F.collect_list(F.when(F.col("key") != "", F.struct("f.start", "f.end", "f.pos", "f.name", "key"))))
    lists = first.groupBy("id", "cluster").agg(F.min("f.start").alias("start"), F.max("end").alias("end"), held.alias("held")).where("size(held) > 0")
    return lists.select("id", "cluster", "start", "end", F.transform("held", lambda x: x["name"]).alias("investors"), F.transform("held", lambda x: x["key"]).alias("keys"))


def rounds(texts: DataFrame, target: str | None = None) -> DataFrame:
    """id, company, amount, investors, evidence: the one round that a text announces.

    A text with more than two rounds is a digest and gives none. target: a column of texts with the key of the
    organisation that the round must name; without it the first round counts.
    """
    found = clusters(mentions(texts.select("id", "text")))
    few = found.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("id"))).where(F.col("n") <= MOST_ROUNDS)
    # texts are larger than Spark's estimates of them: they are dealt by id, never broadcast
    rows = few.hint("merge").join(texts.select("id", "text", *([F.col(target).alias("target")] if target else [])), "id")
    if target:
        rows = rows.where(F.array_contains("keys", F.col("target")))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("start"))).where("k = 1")
    from_ = F.greatest(F.lit(0), F.col("start") - 120)
    window = F.substring(F.col("text"), from_ + 1, F.col("end") - from_)
    amount = F.coalesce(F.nullif(F.regexp_extract(window, _MONEY, 1), F.lit("")), F.regexp_extract("text", _MONEY, 1))
    evidence = F.substring(F.trim(F.regexp_replace(window, "\\s+", " ")), 1, EVIDENCE)
    return rows.select("id", F.trim(F.regexp_extract("text", _COMPANY, 1)).alias("company"), F.trim(amount).alias("amount"), F.slice("investors", 1, MOST_INVESTORS).alias("investors"), F.slice("keys", 1, MOST_INVESTORS).alias("keys"), evidence.alias("evidence"))


def rounds_of_firms(found: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` announcements of each firm that name it among two investors or more.

    found: firm (key), pos, url, and the columns of ``rounds``.
    """
    rows = found.where(F.array_contains("keys", F.col("firm")) & (F.size("keys") >= 2))
    return rows.withColumn("k", F.row_number().over(W.partitionBy("firm").orderBy("pos", "url"))).where(F.col("k") <= most).drop("k")


def round_of_company(found: DataFrame) -> DataFrame:
    """Of each company the announcement that names its firm, else the first with two investors or more. found: company_key, firm, pos, url, keys."""
    rows = found.where(F.size("keys") >= 2).withColumn("other", ~F.array_contains("keys", F.col("firm")))
    return rows.withColumn("k", F.row_number().over(W.partitionBy("company_key", "firm").orderBy("other", "pos", "url"))).where("k = 1").drop("k", "other")
