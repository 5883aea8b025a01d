"""People who appear together in filings, officer registers, papers and boards, each corroborated by the record itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kithgraph.functions import names
from kithgraph.sources.tables import cut

_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def _top(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("k") <= most).drop("k")


def _first(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return _top(rows, by, order, 1)


def bare_display(display: Column) -> Column:
    """Of 'ACME CORP  (ACM)  (CIK 0000000001)' the name."""
    return F.trim(F.substring_index(display, "  (", 1))


def is_company(display: Column) -> Column:
    return display.rlike("\\([A-Z]{1,6}\\)") | names.is_org(bare_display(display))


def person_display(display: Column) -> Column:
    """'LAST FIRST MIDDLE JR' as 'First Middle Last Jr'."""
    t = names.tokens(F.regexp_replace(bare_display(display), "\\s+", " "))
    last = F.lower(F.rtrim(F.element_at(t, -1), F.lit(".")))
    held = F.when(F.size(t) > 0, last.isin(*_SUFFIXES)).otherwise(False)
    core = F.when(held, F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(t)
    turned = F.when(F.size(core) >= 2, F.concat(F.slice(core, F.lit(2), F.size(core) - 1), F.slice(core, 1, 1))).otherwise(core)
    name = F.initcap(F.array_join(turned, " "))
    return F.trim(F.when(held, F.concat(name, F.lit(" "), F.initcap(last))).otherwise(name))


def _each(rows: DataFrame, by: str, made: dict[str, Column]) -> DataFrame:
    """Each value of a column once, with what is made of it; no filter on that passes inline, to be done on every row."""
    return rows.select(by).distinct().select(by, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def filers(hits: DataFrame) -> DataFrame:
    """(cik, low, key, told, filed): who has filed for which issuer, by spelling (low) and key, with the first (hit_id, pos, person) and (hit_id, pos, issuer).

    hits: hit_id, display_names (array of companies and people).
    """
    rows = hits.select("hit_id", F.posexplode("display_names").alias("pos", "display"))
    d = F.col("display")
    person = F.when(~is_company(d), person_display(d))
    read = _each(rows, "display", {"person": person, "low": F.lower(person), "key": names.person_key(person), "cik": F.when(is_company(d), names.filing_cik(d)), "issuer": bare_display(d)})
    rows = rows.join(read, "display")
    firms = rows.where("cik is not null").select("hit_id", "cik", F.struct("hit_id", "pos", "issuer").alias("filed"))
    people = rows.where("person is not null").select("hit_id", "low", "key", F.struct("hit_id", "pos", "person").alias("told"))
    return firms.join(people, "hit_id").groupBy("cik", "low", "key").agg(F.min("told").alias("told"), F.min("filed").alias("filed"))


def issuers(found: DataFrame) -> DataFrame:
    """(key, cik, issuer, n): all issuers whose filings a person has filed, not merely been named in, in order. found: ``filers``."""
    pairs = _first(found.where("key <> ''"), ["key", "cik"], ["filed"])
    return pairs.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("filed"))).select("key", "cik", "filed.issuer", "n")


def insiders(found: DataFrame) -> DataFrame:
    """(cik, low, person): all people who have filed for each issuer, each spelling once. found: ``filers``."""
    return _first(found.where("told.person <> ''"), ["cik", "low"], ["told"]).select("cik", "low", "told.person")


def board_colleagues(hits: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, name, org, cik, members): all others who filed for the subject's issuers, each at the first such issuer. subjects: name."""
    found = cut(filers(hits), "filers")
    mine = _each(subjects.select(F.col("name").alias("subject")), "subject", {"key": names.person_key(F.col("subject"))})
    own, told = issuers(found).join(mine.select("key").distinct(), "key", "left_semi"), insiders(found)
    best = own.select("key", "cik", "n").join(told.select("cik", "low"), "cik").groupBy("key", "low").agg(F.min("n").alias("n"))
    rows = mine.join(best, "key").where(F.col("low") != F.lower("subject")).join(own, ["key", "n"]).join(told, ["cik", "low"])
    rows = rows.join(told.groupBy("cik").agg(F.count("*").alias("members")), "cik")
    return rows.select("subject", F.col("person").alias("name"), F.col("issuer").alias("org"), "cik", "members")


def officer_tie(position: Column) -> Column:
    return F.when(F.lower(F.coalesce(position, F.lit(""))).rlike("director|board|trustee|chair"), "board_member").otherwise("colleague")


def officer_colleagues(officers: DataFrame, subjects: DataFrame, companies: int = 3, each: int = 20, most: int = 30) -> DataFrame:
    """(subject, name, rtype, org, members). officers: company, pos, name, position; subjects: name."""
    listed = _top(officers, ["company"], ["pos", "name"], each)
    listed = listed.join(listed.groupBy("company").agg(F.count("*").alias("members")), "company")
    mine = subjects.select(F.col("name").alias("subject")).distinct().join(officers.select("company", F.col("name").alias("subject")).distinct(), "subject")
    mine = mine.withColumn("n", F.row_number().over(W.partitionBy("subject").orderBy("company"))).where(F.col("n") <= companies)
    rows = mine.join(listed, "company").where(F.lower("name") != F.lower("subject")).withColumn("low", F.lower("name"))
    rows = _first(rows, ["subject", "low"], ["n", "pos", "name"])
    return _top(rows, ["subject"], ["n", "pos", "name"], most).select("subject", "name", officer_tie(F.col("position")).alias("rtype"), F.col("company").alias("org"), "members")


def coauthors(authors: DataFrame, authorships: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, name, work): all who published with a subject, whose author record an organisation of theirs confirms, each at the first of their works.

    authors: author, rank, name, institutions (array). authorships: work, work_pos, pos, author, name.
    subjects: name, orgs (array); without a distinctive word in them nobody is confirmed.
    """
    key = names.person_key
    words = F.array_distinct(F.flatten(F.transform("orgs", lambda o: names.distinctive_tokens(o, _GENERIC_ORG, 3))))
    mine = subjects.select(F.col("name").alias("subject"), key(F.col("name")).alias("key"), words.alias("words")).where("size(words) > 0 and key <> ''")
    known = authors.select("author", "rank", key(F.col("name")).alias("key"), names.normalize(F.array_join("institutions", " ")).alias("inst"))
    found = mine.join(known, "key").where(F.exists("words", lambda w: F.contains(F.col("inst"), w)))
    found = _first(found, ["subject"], ["rank", "author"]).select("subject", F.col("key").alias("own"), "author")
    wrote = found.join(authorships.select("author", "work", "work_pos"), "author").select("subject", "own", "work", "work_pos").distinct()
    rows = wrote.join(authorships.select("work", "pos", F.col("name").alias("other")), "work").withColumn("key", key(F.col("other")))
    rows = rows.where(F.nullif("key", F.lit("")) != F.col("own"))  # one condition of both sides: no keys of works by others
    return _first(rows, ["subject", "key"], ["work_pos", "work", "pos", "other"]).select("subject", F.col("other").alias("name"), "work")


_GENERIC_ORG = ("university", "college", "institute", "school", "inc", "llc", "ventures", "capital", "partners", "the", "of", "and", "company")


def officer_cell(cell: Column) -> Column:
    """Of 'Ana Roe (Chair, Trustee)' the name."""
    return F.trim(F.regexp_extract(F.coalesce(cell, F.lit("")), "^(.*?)\\s*(?:\\(|$)", 1))


def nonprofit_boards(hints: DataFrame, boards: DataFrame, most_hints: int = 3, most: int = 40) -> DataFrame:
    """(subject, name, ein, org, members): fellow officers on boards that list the subject.

    hints: subject, pos, hint (an organisation the subject is known by). boards: hint, rank, ein, org, pos,
    cell. One board for each hint, the first that lists the subject; a board counts for its first hint.
    """
    listed = boards.withColumn("name", officer_cell(F.col("cell"))).where(names.is_person(F.col("name"))).withColumn("key", names.person_key(F.col("name")))
    listed = _first(listed, ["hint", "ein", "key"], ["pos"])
    listed = _top(listed, ["hint", "ein"], ["pos"], most)
    sizes = listed.groupBy("hint", "ein").agg(F.count("*").alias("members"))
    mine = _top(hints, ["subject"], ["pos", "hint"], most_hints).select("subject", F.col("pos").alias("at"), "hint")
    own = mine.withColumn("key", names.person_key(F.col("subject"))).join(listed.select("hint", "ein", "org", "rank", "key"), ["hint", "key"])
    own = _first(own, ["subject", "ein"], ["at", "rank"])
    own = _first(own, ["subject", "hint"], ["rank", "ein"]).withColumnRenamed("key", "own").select("subject", "hint", "ein", "own")
    return own.join(sizes, ["hint", "ein"]).join(listed, ["hint", "ein"]).where("key <> own").select("subject", "name", "ein", "org", "members")


def by_org(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of one organisation as one: subject, org, names (in order), members, of the first row."""
    w = F.sort_array(F.collect_list(F.struct(*order, "name")))
    return rows.groupBy("subject", "org").agg(F.transform(w, lambda x: x["name"]).alias("names"), F.max("members").alias("members"))
