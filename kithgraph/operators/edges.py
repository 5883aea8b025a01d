"""Ties between people, from asserted facts and from small groups.

Two rules hold. A tie exists only if a source asserts it: types that aren't structural (or weak, where
allowed) raise. And membership becomes closeness only in groups of up to ``cap`` people, counting the
larger of the members seen and the size that a source has recorded.

Pairs within a group are made by a self-join whose group size has been checked first, so that a row
gives at most ``cap`` pairs whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kithgraph.functions import taxonomy
from kithgraph.params import DEFAULT


def add_edges(assertions: DataFrame, include_weak: bool = True) -> DataFrame:
    """One row for each unordered pair, type and source: the first assertion (by seq).

    seq, person_1, person_2, rtype, source_url, evidence. A null source is a source of its own.
    """
    rtype = F.col("rtype")
    allowed = taxonomy.is_structural(rtype) | (taxonomy.is_weak(rtype) if include_weak else F.lit(False))
    checked = F.when(allowed, rtype).otherwise(F.raise_error(F.concat(F.lit("not a tie that may be stored: "), F.coalesce(rtype, F.lit("null")))).cast("string"))
    rows = assertions.withColumn("rtype", checked).where("person_1 is not null and person_2 is not null and person_1 <> person_2")
    rows = rows.withColumn("a", F.least("person_1", "person_2")).withColumn("b", F.greatest("person_1", "person_2")).withColumn("source_url", F.nullif("source_url", F.lit("")))
    first = F.min(F.struct("seq", "evidence")).alias("f")
    out = rows.groupBy("a", "b", "rtype", "source_url").agg(first, F.count("*").alias("assertions"))
    return out.select("a", "b", "rtype", "source_url", F.col("f.seq").alias("seq"), F.col("f.evidence").alias("evidence"), "assertions")


def cliques(memberships: DataFrame, orgs: DataFrame, cap: int = DEFAULT.clique_cap, recorded: DataFrame | None = None) -> DataFrame:
    """(org, a, b, rtype): all pairs of members of organisations of 2 to ``cap`` people.

    recorded: (org, member_count), of which the largest counts.
    """
    members = memberships.select("org", "person").where("org is not null and person is not null").distinct()
    sizes = members.groupBy("org").agg(F.count("*").alias("n"))
    if recorded is not None:
        sizes = sizes.join(recorded.groupBy("org").agg(F.max("member_count").alias("told")), "org", "left").withColumn("n", F.when(F.col("n") > 1, F.greatest("n", F.coalesce("told", F.lit(0)))).otherwise(F.col("n")))
    small = sizes.where(F.col("n").between(2, cap)).select("org").join(orgs.select(F.col("id").alias("org"), F.col("type")), "org")
    held = members.join(small, "org")
    pairs = held.select("org", "type", F.col("person").alias("a")).join(held.select("org", F.col("person").alias("b")), "org").where("a < b")
    return pairs.select("org", "a", "b", taxonomy.org_tie(F.col("type")).alias("rtype"))


def portfolio_ties(investments: DataFrame, rosters: DataFrame, cap: int = DEFAULT.clique_cap) -> DataFrame:
    """(company, a, b): people of firms that share a company, if its firms' people are 2 to ``cap``."""
    shared = investments.select("company", "firm").distinct()
    shared = shared.join(shared.groupBy("company").agg(F.count("*").alias("firms")).where("firms >= 2"), "company")
    sizes = rosters.select("firm", "person").distinct().groupBy("firm").agg(F.count("*").alias("k")).where(F.col("k") <= cap)
    over = shared.join(sizes, "firm", "left_anti").join(rosters.select("firm").distinct(), "firm", "left_semi").select("company").distinct()
    people = shared.join(over, "company", "left_anti").join(rosters.select("firm", "person").distinct(), "firm").select("company", "person").distinct()
    small = people.groupBy("company").agg(F.count("*").alias("n")).where(F.col("n").between(2, cap)).select("company")
    held = people.join(small, "company")
    return held.withColumnRenamed("person", "a").join(held.withColumnRenamed("person", "b"), "company").where("a < b").select("company", "a", "b")


def co_investments(investments: DataFrame) -> DataFrame:
    """(firm, other, company) of each ordered pair of firms in one company, however many they are.

    The pairs are the result itself; a company with very many firms is one skewed key, which the adaptive
    sort-merge join splits.
    """
    rows = investments.select("company", "firm").distinct()
    return rows.hint("merge").join(rows.withColumnRenamed("firm", "other"), "company").where("firm <> other").select("firm", "other", "company")


def round_ties(listed: DataFrame, rosters: DataFrame, cap: int = DEFAULT.clique_cap) -> DataFrame:
    """(round, a, b): people of different firms of a round; who is in several counts for the first listed.

    listed: (round, firm_pos, firm); rosters: (firm, person).
    """
    own = W.partitionBy("round", "person").orderBy("firm_pos", "firm")
    sizes = rosters.distinct().groupBy("firm").agg(F.count("*").alias("k")).where(F.col("k") <= cap)
    known = listed.join(rosters.select("firm").distinct(), "firm", "left_semi")
    over = known.join(sizes, "firm", "left_anti").select("round").distinct()
    people = known.join(over, "round", "left_anti").join(rosters.distinct(), "firm").withColumn("k", F.row_number().over(own)).where("k = 1")
    small = people.groupBy("round").agg(F.count("*").alias("n"), F.count_distinct("firm").alias("firms")).where((F.col("n") <= cap) & (F.col("firms") >= 2))
    held = people.join(small.select("round"), "round")
    x, y = held.select("round", F.col("person").alias("a"), F.col("firm").alias("firm_a")), held.select("round", F.col("person").alias("b"), F.col("firm").alias("firm_b"))
    return x.join(y, "round").where("firm_a <> firm_b and a < b").select("round", "a", "b")


def podcast_ties(hosts: DataFrame, guests: DataFrame) -> DataFrame:
    """(feed, a, b, rtype): hosts with each other and with guests, never guests with guests."""
    h = hosts.select("feed", "person").distinct()
    pairs = h.withColumnRenamed("person", "a").join(h.withColumnRenamed("person", "b"), "feed").where("a < b").withColumn("rtype", F.lit("cohost"))
    g = guests.select("feed", F.col("person").alias("g")).distinct()
    shows = h.join(g, "feed").where("person <> g").select("feed", F.least("person", "g").alias("a"), F.greatest("person", "g").alias("b")).withColumn("rtype", F.lit("podcast_guest"))
    return pairs.unionByName(shows.distinct())


def mutuals(followers: DataFrame, following: DataFrame) -> DataFrame:
    """(owner, handle, name) of accounts that follow and are followed; the handle stands in for a missing name."""
    back = following.select("owner", "handle").distinct()
    rows = followers.join(back, ["owner", "handle"], "left_semi").groupBy("owner", "handle").agg(F.max("fullname").alias("fullname"))
    return rows.select("owner", "handle", F.coalesce(F.nullif(F.trim("fullname"), F.lit("")), "handle").alias("name"))


def warm_first_degree(ties: DataFrame, roots: DataFrame) -> DataFrame:
    """Neighbours of the roots."""
    both = ties.select("a", "b").unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(roots.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()


def people_of_org(memberships: DataFrame, ties: DataFrame) -> DataFrame:
    """(org, person): members, and ends of ties that name the organisation."""
    parts = memberships.select("org", "person").unionByName(ties.select("org", F.col("a").alias("person"))).unionByName(ties.select("org", F.col("b").alias("person")))
    return parts.where("org is not null and person is not null").distinct()


def promoted(mentions: DataFrame, rosters: DataFrame, least: float = 0.75) -> DataFrame:
    """Co-mentions with a warm, confident label whose roster names the other become ties of that label; the rest are weak.

    mentions: subject, name, label, confidence. rosters: subject, name.
    """
    known = rosters.select("subject", "name").distinct().withColumn("listed", F.lit(True))
    label = F.col("label")
    good = taxonomy.is_structural(label) & (F.col("confidence") >= least) & (taxonomy.tier(label) <= 2) & F.coalesce("listed", F.lit(False))
    return mentions.join(known, ["subject", "name"], "left").select("subject", "name", F.when(good, label).otherwise("co_mention").alias("rtype"), good.alias("promoted"))


def neighbours(ties: DataFrame, *keep: str) -> DataFrame:
    """Each tie from both ends: src, dst and the columns to keep. Instead of a join on either end."""
    return ties.select(F.col("a").alias("src"), F.col("b").alias("dst"), *keep).unionByName(ties.select(F.col("b").alias("src"), F.col("a").alias("dst"), *keep))


def has_edge(pairs: DataFrame, ties: DataFrame) -> Column | DataFrame:
    """The pairs (x, y), in either order, that a structural tie joins."""
    strong = ties.where(taxonomy.is_structural(F.col("rtype"))).select("a", "b").distinct()
    return pairs.withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y")).join(strong, ["a", "b"], "left_semi").select("x", "y")
