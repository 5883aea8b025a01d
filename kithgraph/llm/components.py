"""Connected components of a DataFrame of links, by alternating large-star and small-star rounds.

Each round is two grouped minima (combined before the shuffle) and two joins on the node. The links of a
hub (two numbers each, no texts) meet in one task of such a join; a round's links are written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.scratch import Scratch


#: Links for which a task is set aside when a round is written.
PER_TASK = 200_000


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """Rows (node, component): the smallest node that each linked node reaches. Nulls and self-links are ignored."""
    scratch = scratch or Scratch(spark, "components")
    tag = f"cc{uuid.uuid4().hex[:6]}"
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    pairs, seen, k = scratch.save(pairs, f"{tag}_0"), None, 0
    held = pairs.count()
    while held:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        k += 1
        pairs = small.unionByName(least.withColumnRenamed("m", "v")).distinct()
        pairs = scratch.save(pairs.coalesce(1 + held // PER_TASK), f"{tag}_{k}")
        scratch.drop(f"{tag}_{k - 1}")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen, held = now, now[0]
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
