"""Walks over a table of claims: who shares a body, a founding, a work, a band or a team, and who is family.

claims: subject, prop, target, pos (a statement's place). labels: id, label. Entities are ids; a human is
the subject of the claim that it is one. Nothing is looked up by name, so that namesakes are never merged.

People of one group are paired by a join whose right side holds, of each group, only as many members as
anyone may be given: a group of m people gives m x most rows, not m x m.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kithgraph.functions import names
from kithgraph.params import DEFAULT

# Properties that lead from a person to an organisation, with the tie, the wording, and whether sharing it is a tie (fixed values).
ORG_PROPS = [("P108", "colleague", "employed at", False), ("P463", "board_member", "member of", True), ("P488", "board_member", "chairperson of", True)]
# Properties that name a relative, with the wording (fixed values).
FAMILY_PROPS = {"P26": "is married to", "P3373": "is a sibling of", "P22": "is the child of", "P25": "is the child of", "P40": "is a parent of", "P1038": "is a relative of"}
# What a body may not be called, and what it must be called (fixed values).
KIND_DENY = ["order", "award", "prize", "medal", "honorary", "title", "list", "coalition", "political party", "trade union", "union", "disambiguation", "category", "ranking", "class of", "occupation"]
KIND_ALLOW = ["organization", "organisation", "society", "academy", "association", "institute", "institution", "company", "enterprise", "business", "corporation", "board", "committee", "council", "foundation", "university", "college", "school", "agency", "firm", "laboratory"]
IS_A, HUMAN, FOUNDED, CAST, MEMBER, TEAM = "P31", "Q5", "P112", "P161", "P463", "P54"


def _top(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("k") <= most).drop("k")


def _places(values) -> Column:
    return F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)])


def humans(claims: DataFrame) -> DataFrame:
    """(id) of all humans."""
    return claims.where((F.col("prop") == IS_A) & (F.col("target") == HUMAN)).select(F.col("subject").alias("id")).distinct()


def named(labels: DataFrame) -> DataFrame:
    """(id, name) of the entities whose label isn't a bare id."""
    return labels.where((F.trim("label") != "") & ~names.is_qid(F.col("label"))).groupBy("id").agg(F.min("label").alias("name"))


def orgs_of_person(claims: DataFrame, labels: DataFrame, most: int = 6) -> DataFrame:
    """subject, org, name, prop, rtype, phrase, ties: the first organisations of a person, in the order of ORG_PROPS."""
    props = [p for p, *_ in ORG_PROPS]
    rows = claims.where(F.col("prop").isin(*props)).withColumn("n", F.element_at(_places(props), F.col("prop")))
    rows = _top(rows, ["subject"], ["n", "pos", "target"], most).withColumnRenamed("target", "org").join(named(labels).withColumnRenamed("id", "org"), "org")
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for p in ORG_PROPS for x in (p[0], p[i])]), F.col("prop"))
    return rows.select("subject", "org", "name", "prop", of(1).alias("rtype"), of(2).alias("phrase"), of(3).alias("ties"))


def member_counts(claims: DataFrame, props: list[str] | None = None) -> DataFrame:
    """(org, prop, n): how many humans have the property with that target."""
    rows = claims.where(F.col("prop").isin(*(props or [*(p for p, *_ in ORG_PROPS), TEAM])))
    rows = rows.join(humans(claims).withColumnRenamed("id", "subject"), "subject", "left_semi")
    return rows.groupBy(F.col("target").alias("org"), "prop").agg(F.count_distinct("subject").alias("n"))


def org_members(claims: DataFrame, labels: DataFrame, most: int = DEFAULT.clique_cap + 1) -> DataFrame:
    """(org, prop, person, name) of the first humans of each organisation; those without a label are left out."""
    rows = claims.where(F.col("prop").isin(*(p for p, *_ in ORG_PROPS))).join(humans(claims).withColumnRenamed("id", "subject"), "subject", "left_semi")
    rows = rows.groupBy(F.col("target").alias("org"), "prop", F.col("subject").alias("person")).agg(F.min("pos").alias("pos"))
    return _top(rows, ["org", "prop"], ["pos", "person"], most).join(named(labels).withColumnRenamed("id", "person"), "person").select("org", "prop", "person", "name")


def org_kinds(claims: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, kinds): labels of what an entity is, in lower case, in the order of the statements."""
    rows = claims.where(F.col("prop") == IS_A).join(named(labels).withColumnsRenamed({"id": "target", "name": "kind"}), "target")
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("pos", "target", F.lower("kind").alias("kind")))), lambda x: x["kind"])
    return rows.groupBy(F.col("subject").alias("id")).agg(kinds.alias("kinds"))


def is_body(kinds: Column) -> Column:
    """Whether membership implies that people know each other: no kind is denied, one is allowed; without kinds it doesn't."""
    any_of = lambda words: lambda k: F.exists(names.array(words), lambda w: F.contains(k, w))
    return F.coalesce((F.size(kinds) > 0) & ~F.exists(kinds, any_of(KIND_DENY)) & F.exists(kinds, any_of(KIND_ALLOW)), F.lit(False))


def walk_orgs(claims: DataFrame, labels: DataFrame, cap: int = DEFAULT.clique_cap) -> DataFrame:
    """What becomes of each organisation of a person: 'membership' (no ties), 'absorb' (its members are tied), or 'none'.

    An employer, a target that is no body, and an organisation of more than ``cap`` people give membership
    alone; one of whose members fewer than two have a name gives nothing.
    """
    rows = orgs_of_person(claims, labels).join(member_counts(claims), ["org", "prop"], "left").na.fill(0, ["n"])
    rows = rows.join(org_kinds(claims, labels).withColumnRenamed("id", "org"), "org", "left")
    known = org_members(claims, labels, cap + 1).groupBy("org", "prop").agg(F.count("*").alias("known"))
    rows = rows.join(known, ["org", "prop"], "left")
    route = F.when(~F.col("ties") | ~is_body(F.col("kinds")) | (F.col("n") > cap), "membership").when(F.coalesce("known", F.lit(0)) >= 2, "absorb").otherwise("none")
    return rows.select("subject", "org", "prop", "rtype", "n", route.alias("route"))


def family(claims: DataFrame, labels: DataFrame, most: int = 8) -> DataFrame:
    """(subject, other, name, phrase): relatives that a person's own claims name, each once."""
    props = list(FAMILY_PROPS)
    rows = claims.where(F.col("prop").isin(*props)).withColumn("n", F.element_at(_places(props), F.col("prop")))
    rows = _top(rows, ["subject", "target"], ["n", "pos"], 1)
    rows = _top(rows, ["subject"], ["n", "pos", "target"], most).join(named(labels).withColumnRenamed("id", "target"), "target")
    phrase = F.element_at(F.create_map(*[F.lit(x) for kv in FAMILY_PROPS.items() for x in kv]), F.col("prop"))
    return rows.select("subject", F.col("target").alias("other"), "name", phrase.alias("phrase"))


def co_members(claims: DataFrame, labels: DataFrame, prop: str, most: int, of_group: bool, only: DataFrame | None = None, cap: int | None = None, groups: int | None = None) -> DataFrame:
    """(subject, other, name): humans that share a group by a property; a person's first ``most`` by id.

    of_group: the claims are the group's (a work's cast, a company's founders), else the person's (a band, a
    team). only: (id) of the groups that count. cap: groups of more humans are left out. groups: how many of
    a person's groups, the first by pos, count.
    """
    group, person = ("subject", "target") if of_group else ("target", "subject")
    rows = claims.where(F.col("prop") == prop).groupBy(F.col(group).alias("g"), F.col(person).alias("person")).agg(F.min("pos").alias("pos"))
    if only is not None:
        rows = rows.join(only.select(F.col("id").alias("g")).distinct(), "g", "left_semi")
    people = rows.join(humans(claims).withColumnRenamed("id", "person"), "person", "left_semi").select("g", F.col("person").alias("other"))
    if cap is not None:
        small = people.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("g")
        people = people.join(small, "g", "left_semi")
    mine = _top(rows, ["person"], ["pos", "g"], groups) if groups else rows
    shared = mine.select("g", F.col("person").alias("subject")).join(_top(people, ["g"], ["other"], most + 1), "g")
    shared = shared.where("subject <> other").select("subject", "other").distinct()
    return _top(shared, ["subject"], ["other"], most).join(named(labels).withColumnRenamed("id", "other"), "other").select("subject", "other", "name")


def cofounders(claims: DataFrame, labels: DataFrame, most: int = 20) -> DataFrame:
    return co_members(claims, labels, FOUNDED, most, True)


def costars(claims: DataFrame, labels: DataFrame, most: int = 25) -> DataFrame:
    return co_members(claims, labels, CAST, most, True)


def bandmates(claims: DataFrame, labels: DataFrame, ensembles: DataFrame, most: int = 15) -> DataFrame:
    """ensembles: (id) of musical groups."""
    return co_members(claims, labels, MEMBER, most, False, only=ensembles)


def teammates(claims: DataFrame, labels: DataFrame, cap: int = DEFAULT.clique_cap, teams: int = 6) -> DataFrame:
    """Of a person's first teams, those whose whole roster is small enough; all of its members."""
    return co_members(claims, labels, TEAM, teams * (cap + 1), False, cap=cap, groups=teams)


def as_ties(rows: DataFrame, rtype: str, seq: str = "subject") -> DataFrame:
    """Assertions for ``edges.add_edges``: one for each (subject, other), never of a person with themselves."""
    out = rows.where("subject <> other").select("subject", "other").distinct()
    return out.select(F.col(seq).alias("seq"), F.col("subject").alias("person_1"), F.col("other").alias("person_2"), F.lit(rtype).alias("rtype"), F.concat(F.lit("claims://"), "subject").alias("source_url"), F.concat("subject", F.lit(" and "), "other").alias("evidence"))


def sitelink_counts(links: DataFrame) -> DataFrame:
    """(id, n): pages about each entity. links: id, page."""
    return links.groupBy("id").agg(F.count("page").alias("n"))


def best_titles(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(name, title, qid): the first hit whose person key is the query's own; the top hit is never taken blindly.

    queries: name. hits: name (the query), rank, title, qid.
    """
    rows = queries.select("name").distinct().join(hits, "name").where(names.person_key(F.col("title")) == names.person_key(F.col("name")))
    return _top(rows, ["name"], ["rank", "title"], 1).select("name", "title", "qid")


def lookup(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each key with the one row of the table that has it; more than one row of a key is an error."""
    counted = table.withColumn("held", F.count(F.lit(1)).over(W.partitionBy(key)))
    rows = keys.select(key).distinct().join(counted, key, "left")
    sure = F.when(F.col("held") > 1, F.raise_error(F.concat(F.lit("more than one row for "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return rows.where(sure).drop("held")
