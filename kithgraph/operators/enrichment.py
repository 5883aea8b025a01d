"""Around enrichment: whom to look at next, what is still to do, what was found, and what people have confirmed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kithgraph.functions import taxonomy
from kithgraph.functions.structured import merged
from kithgraph.operators import edges
from kithgraph.params import DEFAULT
from kithgraph.sources.tables import cut

#: Ties through which a show's host is reached (fixed values).
PODCAST_TIES = ("podcast_guest", "cohost")


def raw_degrees(ties: DataFrame, memberships: DataFrame) -> DataFrame:
    """(id, degree): all rows that a person is an end of, memberships and repeated ties included."""
    ends = ties.select(F.col("a").alias("id")).unionByName(ties.select(F.col("b").alias("id"))).unionByName(memberships.select(F.col("person").alias("id")))
    return ends.where("id is not null").groupBy("id").agg(F.count("*").alias("degree"))


def first_edges(ties: DataFrame) -> DataFrame:
    """(src, dst, rtype, cost): each neighbour with the tie that comes first by stored cost. ties: a, b, rtype, cost, seq."""
    both = edges.neighbours(ties.where("a <> b"), "rtype", "cost", "seq")
    first = F.min(F.struct("cost", "seq", "rtype")).alias("f")
    return both.groupBy("src", "dst").agg(first).select("src", "dst", "f.rtype", "f.cost", "f.seq")


def frontier_key(meets: Column, via_podcast: Column, is_warm: Column, notable: Column, degree: Column, prefer_notable: bool = False) -> Column:
    """Order of a frontier; the smallest comes first.

    A meeting point, then a show's host. Then, walking down: people the owner knows, the less notable, leaves.
    Walking up (prefer_notable): the notable, hubs.
    """
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)
    warm, fame, size = (F.lit(1), flag(notable), -degree) if prefer_notable else (flag(is_warm), 1 - flag(notable), degree)
    return F.struct(flag(meets).alias("k1"), flag(via_podcast).alias("k2"), warm.alias("k3"), fame.alias("k4"), size.alias("k5"))


def neighbourhood(roots: DataFrame, ties: DataFrame, people: DataFrame, degrees: DataFrame, hops: int = 2, slice_: int = 40, fanout: int = DEFAULT.fanout, meets: DataFrame | None = None, prefer_notable: bool = False) -> DataFrame:
    """(root, hop, rank, person): who is enriched around each root, hop by hop.

    Of the neighbours that aren't enriched yet, the first ``slice_`` (meeting points and hosts first, then as
    discovered) are ranked, and the first ``fanout`` are next. ties: as of ``first_edges``. people: id, is_warm,
    qid, done. meets: (id) that the other side reaches.
    """
    tag = uuid.uuid4().hex[:8]
    known = people.select(F.col("id").alias("dst"), "is_warm", F.col("qid").isNotNull().alias("notable"), "done").join(degrees.withColumnRenamed("id", "dst"), "dst", "left").na.fill(0, ["degree"])
    if meets is not None:
        known = known.join(meets.select(F.col("id").alias("dst")).distinct().withColumn("meets", F.lit(True)), "dst", "left")
    else:
        known = known.withColumn("meets", F.lit(False))
    steps = cut(ties.join(known.where("not done").drop("done"), "dst"), f"nbh-{tag}-steps")
    front = roots.select(F.col("id").alias("root"), F.lit(0).alias("rank"), F.col("id").alias("person")).distinct()
    taken, out = front.select("root", "person"), None
    for hop in range(1, hops + 1):
        near = front.select("root", "rank", F.col("person").alias("src")).join(steps, "src").join(taken.withColumnRenamed("person", "dst"), ["root", "dst"], "left_anti")
        near = near.withColumn("podcast", F.col("rtype").isin(*PODCAST_TIES))
        found = near.withColumn("k", F.row_number().over(W.partitionBy("root", "dst").orderBy("rank", "cost", "seq"))).where("k = 1")
        cheap = W.partitionBy("root").orderBy((~F.coalesce("meets", F.lit(False))).cast("int"), (~F.col("podcast")).cast("int"), "rank", "cost", "seq", "dst")
        found = found.withColumn("k", F.row_number().over(cheap)).where(F.col("k") <= slice_)
        key = frontier_key(F.col("meets"), F.col("podcast"), F.col("is_warm"), F.col("notable"), F.col("degree"), prefer_notable)
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("root").orderBy(key, "k")))
        front = cut(ranked.where(F.col("rank") <= fanout).select("root", "rank", F.col("dst").alias("person")), f"nbh-{tag}-{hop}")
        rows = front.select("root", F.lit(hop).alias("hop"), "rank", "person")
        out = rows if out is None else out.unionByName(rows)
        taken = taken.unionByName(front.select("root", "person"))
    return out


def to_enrich(people: DataFrame, level: int) -> DataFrame:
    """(id, enriched, after): people below a level; a level never falls."""
    return people.where(F.coalesce("enriched", F.lit(0)) < level).select("id", F.coalesce("enriched", F.lit(0)).alias("enriched"), F.greatest(F.coalesce("enriched", F.lit(0)), F.lit(level)).alias("after"))


def selection_outcome(selected: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: enriched, failed, total of an explicit list (name); outcomes: name, ok. A name without outcome has failed."""
    done = outcomes.groupBy("name").agg(F.bool_or("ok").alias("ok"))
    rows = selected.select("name").join(done, "name", "left")
    good = F.coalesce("ok", F.lit(False))
    return rows.agg(F.count_if(good).alias("enriched"), F.count_if(~good).alias("failed"), F.count("*").alias("total"))


def notices(people: DataFrame) -> DataFrame:
    """(id, notice, needs_context): what an identity check left open. people: id, name, meta (map)."""
    value = lambda k: F.try_element_at("meta", F.lit(k))
    notice = F.when(F.coalesce(value("homonym_rejected"), F.lit("")) != "", F.concat_ws(": ", "name", value("homonym_rejected")))
    rows = people.select("id", notice.alias("notice"), value("homonym_needs_context").alias("needs_context"))
    return rows.where("notice is not null or needs_context is not null")


def background(results: DataFrame, most: int = 4, width: int = 800) -> DataFrame:
    """(subject, text): the first lines of a search about a person; those that share a word with the hint, if any does.

    results: subject, hint, rank, title, snippet; the first eight count.
    """
    rows = results.withColumn("at", F.row_number().over(W.partitionBy("subject").orderBy("rank", "title"))).where("at <= 8")
    line = F.trim(F.concat_ws(" — ", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("snippet"), F.lit(""))))
    hint = F.filter(F.split(F.lower(F.coalesce("hint", F.lit(""))), "\\s+"), lambda w: F.length(w) > 2)
    rows = rows.withColumn("line", line).where("line <> ''").withColumn("on", F.exists(hint, lambda w: F.contains(F.lower("line"), w)))
    rows = rows.withColumn("any", F.max(F.col("on").cast("int")).over(W.partitionBy("subject"))).where("on or any = 0")
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("subject").orderBy("at"))).where(F.col("k") <= most)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), " | ")
    return rows.groupBy("subject").agg(F.substring(text, 1, width).alias("text"))


def verdicts(items: DataFrame, answers: DataFrame, allowed: list[str], key: list[str]) -> DataFrame:
    """Items with label and confidence of the answers; 'unknown' and 0 where there is none, or a label isn't allowed."""
    best = answers.groupBy(*key).agg(F.min(F.struct("label", "confidence")).alias("f"))
    rows = items.join(best, key, "left")
    label = F.when(F.col("f.label").isin(*allowed), F.col("f.label")).otherwise("unknown")
    return rows.withColumn("label", label).withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("f.confidence", F.lit(0.0))))).drop("f")


def weak_ties(hits: DataFrame, nudge: float = 2.0) -> DataFrame:
    """Co-mentions of a target as weak ties: subject, name, rtype, cost; a confident label makes them cheaper, never as cheap as the next tier.

    hits: subject, name, label, confidence.
    """
    known = (F.col("label") != "unknown") & (F.col("confidence") > 0)
    rtype = F.lit("co_mention")
    return hits.where("subject <> name").select("subject", "name", rtype.alias("rtype"), taxonomy.adjusted_cost(rtype, F.when(known, F.col("confidence") * nudge).otherwise(0.0)).alias("cost"))


def merged_meta(assertions: DataFrame) -> DataFrame:
    """(a, b, rtype, meta): the maps of a tie's assertions, in their order; later values hold. assertions: seq, a, b, rtype, meta."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", F.to_json("meta").alias("m")))), lambda x: F.from_json(x["m"], "map<string,string>"))
    return assertions.groupBy("a", "b", "rtype").agg(F.aggregate(ordered, F.create_map().cast("map<string,string>"), merged).alias("meta"))


def confirmed(people: DataFrame, contacts: DataFrame, identities: DataFrame) -> DataFrame:
    """People with what users have confirmed: is_warm for contacts (id), and the id (id, qid) of identities; both may repeat.

    A confirmed identity is enriched anew: its ``enriched`` becomes 0.
    """
    warm = contacts.select("id").distinct().withColumn("told", F.lit(True))
    own = identities.groupBy("id").agg(F.max("qid").alias("new_qid"))
    rows = people.join(warm, "id", "left").join(own, "id", "left")
    return rows.withColumn("is_warm", F.coalesce("told", "is_warm")).withColumn("enriched", F.when(F.col("new_qid").isNotNull(), 0).otherwise(F.col("enriched"))).withColumn("qid", F.coalesce("new_qid", "qid")).select(*people.columns)


def with_columns_added(rows: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns (name -> type, default) that the rows lack; those that they have stay as they are."""
    new = {c: F.lit(default).cast(kind) for c, (kind, default) in columns.items() if c not in rows.columns}
    return rows.withColumns(new) if new else rows


def cacheable(results: DataFrame) -> DataFrame:
    """Search results to remember: those of queries that found something. results: query, items (array)."""
    return results.where(F.size(F.coalesce("items", F.array().cast("array<string>"))) > 0)


def unchecked(wanted: DataFrame, checked: DataFrame, every: int = 25) -> DataFrame:
    """(owner, handle, batch): what is left of a resumable job, in portions after which it notes where it is."""
    left = wanted.select("owner", "handle").distinct().join(checked.select("owner", "handle").distinct(), ["owner", "handle"], "left_anti")
    n = F.row_number().over(W.partitionBy("owner").orderBy("handle"))
    return left.withColumn("batch", F.floor((n - 1) / every).cast("int"))


def report_lines(routes: DataFrame) -> DataFrame:
    """A line of text for each route: src, dst, rank, warmth, path of names."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.array_join("path", " -> "), F.lit(" ("), F.format_number("warmth", 3), F.lit(")"))
    return routes.select("src", "dst", "rank", line.alias("line"))


def progress_sink(rows: DataFrame, path: str, checkpoint: str):
    """Writes a stream of progress rows as JSON, a folder for each batch, so that a reader sees each once."""
    return rows.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").json(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
