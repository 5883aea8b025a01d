"""Identities: which mentions are one person, organisation, company or source.

The order of mentions (seq) decides where several fit. Everything is a group or a window over one key,
so that a batch gives what a mention-by-mention run would. Mentions of one seq go by their value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kithgraph.functions import names


def earliest(value: str, *order: str) -> Column:
    """The value that comes first; equal orders go by the value, so that no pick is arbitrary. Nulls count as values."""
    return F.min(F.struct(*order, F.col(value).alias("value")))["value"]


def assign_people(mentions: DataFrame) -> DataFrame:
    """seq, surface, qid, is_warm with node: the key of the person meant.

    An authoritative id belongs to the name under which it came first; of several ids that came first
    under one name, the earliest has the name's own node and the others one each.
    """
    rows = mentions.withColumn("norm", names.person_key(F.col("surface")))
    home = rows.where("qid is not null").groupBy("qid").agg(earliest("norm", "seq").alias("home"), F.min("seq").alias("since"))
    home = home.withColumn("k", F.row_number().over(W.partitionBy("home").orderBy("since", "qid")))
    home = home.select("qid", F.when(F.col("k") == 1, F.col("home")).otherwise(F.concat_ws("#", "home", "qid")).alias("own"))
    return rows.join(home, "qid", "left").withColumn("node", F.coalesce("own", "norm")).drop("own")


def resolve_people(mentions: DataFrame) -> DataFrame:
    """node, canonical (the longest surface, the first of equals), aliases, qid, is_warm, mentions."""
    rows = assign_people(mentions).withColumn("v", F.explode(names.variants(F.col("surface"))))
    best = F.max_by("v", F.struct(F.length("v"), -F.col("seq"), "v"))
    out = rows.groupBy("node").agg(best.alias("canonical"), F.collect_set("v").alias("all"), F.max("qid").alias("qid"), F.bool_or("is_warm").alias("is_warm"), F.count_distinct("seq").alias("mentions"))
    return out.select("node", "canonical", F.array_sort(F.array_except("all", F.array("canonical"))).alias("aliases"), "qid", "is_warm", "mentions")


def resolve_orgs(mentions: DataFrame) -> DataFrame:
    """seq, name, type, member_count by key: first name, first known type, largest count."""
    rows = mentions.withColumn("key", names.org_key(F.col("name"))).where("key <> ''")
    known = F.min(F.when(F.col("type") != "unknown", F.struct("seq", "type")))["type"]
    return rows.groupBy("key").agg(earliest("name", "seq").alias("name"), F.coalesce(known, F.lit("unknown")).alias("type"), F.max("member_count").alias("member_count"))


def resolve_companies(mentions: DataFrame) -> DataFrame:
    """seq, name, domain by lower-cased domain; without a domain there is no company."""
    rows = mentions.withColumn("domain", F.lower(F.trim("domain"))).where("domain <> ''")
    return rows.groupBy("domain").agg(earliest("name", "seq").alias("name"))


def resolve_sources(mentions: DataFrame) -> DataFrame:
    """seq, url, title, provider by url: the first."""
    rows = mentions.where("trim(url) <> ''")
    return rows.groupBy("url").agg(F.min(F.struct("seq", "title", "provider")).alias("f")).select("url", "f.title", "f.provider")


def first_per_key(rows: DataFrame, keys: list[str], value: str, order: str = "seq") -> DataFrame:
    """The first write of each key (investments, memberships)."""
    return rows.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("at"), F.col(value).alias("value"))).alias("f")).select(*keys, F.col("f.value").alias(value), F.col("f.at").alias(order))


def clean_names(lists: DataFrame) -> DataFrame:
    """list, pos, raw: names that pass the gate, roles stripped, each person once, in order."""
    rows = lists.withColumn("name", names.strip_roles(F.col("raw"))).where(names.is_person(F.col("name"))).withColumn("key", names.person_key(F.col("name")))
    own = W.partitionBy("list", "key").orderBy("pos")
    return rows.withColumn("k", F.row_number().over(own)).where("k = 1").select("list", "pos", "name", "key")


def merged_profiles(rows: DataFrame) -> DataFrame:
    """norm_name, email, seq, arrays companies and titles, linkedin_url: arrays united and sorted, scalars from the first that has one."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c)
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return rows.groupBy("norm_name", F.lower("email").alias("email")).agg(united("companies"), united("titles"), first("linkedin_url"))
