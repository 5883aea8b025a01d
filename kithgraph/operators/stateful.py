"""Caches, limiters and breakers over event logs, as windows; their streaming twins are in kithgraph.streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cache_lookups(ops: DataFrame) -> DataFrame:
    """Of each get the value it finds: the key's last set, if that is not older than its time to live.

    seq, ts, key, op ('get' or 'set'), value, ttl_s. Equal times go by seq.
    """
    own = W.partitionBy("key").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op") == "set", F.struct("value", "ts", "ttl_s")), True).over(own)
    rows = ops.withColumn("last", last).where("op = 'get'")
    live = F.col("last").isNotNull() & (F.unix_micros(F.col("last.ts").cast("timestamp")) + F.col("last.ttl_s").cast("long") * 1_000_000 > F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.select("seq", "key", "ts", live.alias("hit"), F.when(live, F.col("last.value")).alias("value"))


def monthly_quota(calls: DataFrame, quota: int) -> DataFrame:
    """provider, month, used, remaining, state."""
    rows = calls.groupBy("provider", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("used"))
    left = F.greatest(F.lit(0), F.lit(quota) - F.col("used"))
    return rows.select("provider", "month", "used", left.alias("remaining"), F.when(left > 0, "ok").otherwise("exhausted").alias("state"))


def quota_states(calls: DataFrame, configured: DataFrame, quota: int) -> DataFrame:
    """provider, month, used, remaining, state: not_configured (the provider has no key), invalid_key (a call was refused), exhausted or ok.

    calls: provider, ts, refused. configured: provider.
    """
    rows = calls.groupBy("provider", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("used"), F.bool_or("refused").alias("refused"))
    rows = rows.join(configured.select("provider").distinct().withColumn("has_key", F.lit(True)), "provider", "left")
    left = F.greatest(F.lit(0), F.lit(quota) - F.col("used"))
    state = F.when(F.col("has_key").isNull(), "not_configured").when(F.coalesce("refused", F.lit(False)), "invalid_key").when(left == 0, "exhausted").otherwise("ok")
    return rows.select("provider", "month", "used", left.alias("remaining"), state.alias("state"))


def recorded_stats(records: DataFrame) -> DataFrame:
    """provider, calls, hits, misses, trips, avg_latency, total_latency. records: provider, kind ('call', 'hit', 'miss', 'trip'), latency of calls."""
    own = lambda k: F.count_if(F.col("kind") == k)
    took = F.when(F.col("kind") == "call", F.col("latency"))
    return records.groupBy("provider").agg(own("call").alias("calls"), own("hit").alias("hits"), own("miss").alias("misses"), own("trip").alias("trips"), F.round(F.avg(took), 3).alias("avg_latency"), F.round(F.coalesce(F.sum(took), F.lit(0.0)), 2).alias("total_latency"))


def spaced(arrivals: DataFrame, least_us: int) -> DataFrame:
    """When each call may start so that a provider's calls are ``least_us`` apart: start_us, waited_us.

    The i-th starts at the largest, over the calls up to it, of arrival plus the spacings since.
    """
    own = W.partitionBy("provider").orderBy("ts", "seq")
    rows = arrivals.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("i", F.row_number().over(own).cast("long"))
    start = F.max(F.col("us") - F.col("i") * least_us).over(own) + F.col("i") * least_us
    return rows.select("provider", "seq", start.alias("start_us"), (start - F.col("us")).alias("waited_us"))


def failure_islands(outcomes: DataFrame, threshold: int) -> DataFrame:
    """Runs of failures of ``threshold`` or more: provider, first seq, last seq, length."""
    own = W.partitionBy("provider").orderBy("ts", "seq")
    rows = outcomes.withColumn("island", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(own)).where("not ok")
    return rows.groupBy("provider", "island").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n")).where(F.col("n") >= threshold).drop("island")


def keepalives(progress: DataFrame, every_s: int = 15) -> DataFrame:
    """After which messages of a job there is a silence, and how many keepalives it gets."""
    own = W.partitionBy("job").orderBy("ts", "seq")
    gap = F.unix_micros(F.lead(F.col("ts").cast("timestamp")).over(own)) - F.unix_micros(F.col("ts").cast("timestamp"))
    rows = progress.withColumn("gap_us", gap).where(F.col("gap_us") > every_s * 1_000_000)
    return rows.select("job", "seq", F.expr(f"gap_us div {every_s * 1_000_000}").alias("keepalives"))


def recent_jobs(jobs: DataFrame, keep: int = 32) -> DataFrame:
    """The last ``keep`` jobs of each owner, newest first."""
    own = W.partitionBy("owner").orderBy(F.desc("ts"), F.desc("seq"))
    return jobs.withColumn("k", F.row_number().over(own)).where(F.col("k") <= keep)


def open_jobs(jobs: DataFrame, consumed: DataFrame, keep: int = 32) -> DataFrame:
    """Of the last ``keep`` jobs of each owner those that nobody has taken; a job is taken once. consumed: owner, seq."""
    return recent_jobs(jobs, keep).join(consumed.select("owner", "seq").distinct(), ["owner", "seq"], "left_anti")


def sessions(spans: DataFrame, gap: int) -> DataFrame:
    """Clusters of spans (group_id, start, end) that lie no more than ``gap`` apart: group_id, cluster, start, end, n."""
    own = W.partitionBy("group_id").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.when(before.isNull() | (F.col("start") - before > gap), 1).otherwise(0)).withColumn("cluster", F.sum("new").over(own))
    return rows.groupBy("group_id", "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def token_bucket(arrivals: DataFrame, rate: float, capacity: float) -> DataFrame:
    """provider, seq, allowed: a bucket of ``capacity`` that refills at ``rate`` a second.

    What is left after each call depends on every call before, so that it is worked out call by call;
    a provider's calls come in order, in portions, and only the bucket's level is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level: dict = {}
        for rows in batches:
            allowed = []
            for provider, us in zip(rows["provider"], rows["us"], strict=True):
                held, last = level.get(provider, (capacity, us))
                held = min(capacity, held + (us - last) / 1e6 * rate)
                allowed.append(held >= 1)
                if provider not in level:
                    level.clear()  # the partition is sorted by provider
                level[provider] = (held - 1 if held >= 1 else held, us)
            yield pd.DataFrame({"provider": rows["provider"], "seq": rows["seq"], "allowed": allowed})

    return _in_order(arrivals).mapInPandas(run, _like(arrivals, "allowed boolean"))


def breaker(outcomes: DataFrame, threshold: int, cooldown_s: float) -> DataFrame:
    """provider, seq, state before the call: closed, open (the call isn't made) or half_open; the same way as token_bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for rows in batches:
            states = []
            for provider, us, ok in zip(rows["provider"], rows["us"], rows["ok"], strict=True):
                fails, opened = kept.get(provider, (0, None))
                if provider not in kept:
                    kept.clear()
                state = "closed" if opened is None else "half_open" if us - opened >= cooldown_s * 1e6 else "open"
                if state != "open":
                    fails = 0 if ok else fails + 1
                    opened = us if not ok and (fails >= threshold or state == "half_open") else None if ok else opened
                kept[provider] = (fails, opened)
                states.append(state)
            yield pd.DataFrame({"provider": rows["provider"], "seq": rows["seq"], "state": states})

    return _in_order(outcomes).mapInPandas(run, _like(outcomes, "state string"))


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).repartition("provider").sortWithinPartitions("provider", "ts", "seq")


def _like(rows: DataFrame, more: str) -> str:
    kinds = dict(rows.dtypes)
    return f"provider {kinds['provider']}, seq {kinds['seq']}, {more}"
