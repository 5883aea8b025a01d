"""Checks of a built graph: what looks wrong, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions import names
from kithgraph.operators.edges import neighbours


def role_nodes(people: DataFrame) -> DataFrame:
    """People without an authoritative id whose name can't be one."""
    return people.where(F.col("qid").isNull() & names.is_noise(F.col("name"))).select("id", "name")


def cross_firm_merges(people: DataFrame, memberships: DataFrame, orgs: DataFrame, least: int = 3) -> DataFrame:
    """People without an authoritative id in ``least`` or more firms: probably several people."""
    firms = orgs.where("type = 'firm'").select(F.col("id").alias("org"), F.col("name").alias("firm"))
    counts = memberships.join(firms, "org").groupBy(F.col("person").alias("id")).agg(F.count_distinct("firm").alias("firms")).where(F.col("firms") >= least)
    return people.where("qid is null").join(counts, "id").select("id", "name", "firms")


def org_nodes(people: DataFrame, degrees: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """People whose name marks an organisation, or whose resolved kind isn't human while they have two ties or more."""
    marked = people.where(names.is_org(F.col("name"))).select("id")
    if kinds is not None:
        other = kinds.groupBy("id").agg(F.bool_and(F.lower("kind") != "human").alias("other")).where("other").select("id")
        marked = marked.unionByName(other.join(degrees.where("degree >= 2").select("id"), "id", "left_semi")).distinct()
    return people.join(marked, "id", "left_semi").select("id", "name")


def unanchored(ties: DataFrame, people: DataFrame, rtype: str = "board_member") -> DataFrame:
    """Ties of a type neither of whose ends has an authoritative id."""
    known = people.where("qid is not null").select("id")
    bad = ties.where(F.col("rtype") == rtype).join(known.select(F.col("id").alias("a")), "a", "left_anti").join(known.select(F.col("id").alias("b")), "b", "left_anti")
    return bad.select(*ties.columns)


def damage(bad: DataFrame, limit: int = 20) -> DataFrame:
    return neighbours(bad).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(limit)


def purge(rows: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """The rows none of whose keys is among the ids."""
    for k in keys:
        rows = rows.join(ids.select(F.col("id").alias(k)).distinct(), k, "left_anti")
    return rows


def graph_counts(people: DataFrame, orgs: DataFrame, ties: DataFrame) -> DataFrame:
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(people, "people").unionByName(count(orgs, "orgs")).unionByName(count(ties, "ties"))


def notable_hubs(people: DataFrame, degrees: DataFrame, reach: DataFrame, limit: int = 15) -> DataFrame:
    rows = people.where("qid is not null").join(reach.select("id"), "id", "left_semi").join(degrees, "id")
    return rows.orderBy(F.desc("degree"), "id").limit(limit).select("id", "name", "degree")


def provider_stats(events: DataFrame) -> DataFrame:
    """provider, ok, latency: calls, errors, average latency (3 places) and total (2)."""
    return events.groupBy("provider").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.round(F.avg("latency"), 3).alias("avg_latency"), F.round(F.sum("latency"), 2).alias("total_latency"))


def priority(depth, degree, has_qid, is_warm, noisy):
    """Order of an enrichment queue; the smallest comes first."""
    return depth * 20 - F.least(degree, F.lit(30)) * 10 - F.when(has_qid, 150).otherwise(0) - F.when(is_warm, 50).otherwise(0) + F.when(noisy, 1000).otherwise(0)


def queue(people: DataFrame, distances: DataFrame, degrees: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(id, depth, degree, priority) of reached people that aren't done."""
    rows = people.join(distances.select(F.col("node").alias("id"), F.col("hops").alias("depth")), "id").join(degrees, "id", "left").na.fill(0, ["degree"])
    if done is not None:
        rows = rows.join(done.select("id").distinct(), "id", "left_anti")
    score = priority(F.col("depth"), F.col("degree"), F.col("qid").isNotNull(), F.col("is_warm"), names.queue_noise(F.col("name")))
    return rows.select("id", "depth", "degree", score.cast("long").alias("priority"))
