"""The graph: adjacency, penalties, distances, cheapest routes and their order.

Frontiers are DataFrames. Each round joins only the labels that changed with the adjacency, keeps the
best label of each (root, node) by a grouped minimum, and is written to the shared folder, which cuts
the lineage. Edge weights are at least 3, so that routes end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kithgraph.functions import taxonomy
from kithgraph.operators.edges import neighbours
from kithgraph.operators.enrichment import frontier_key
from kithgraph.params import DEFAULT, Params
from kithgraph.sources.tables import cut


def adjacency(ties: DataFrame, include_weak: bool = False) -> DataFrame:
    """(a, b, rtype, cost): the cheapest tie of each unordered pair; ties of one cost go by type, then source.

    ties: a, b, rtype and, if there is one, source_url.
    """
    cost = taxonomy.edge_cost(F.col("rtype"), include_weak)
    rows = ties.withColumn("cost", cost).where(F.col("cost") < float("inf"))
    if "source_url" not in ties.columns:
        rows = rows.withColumn("source_url", F.lit(None).cast("string"))
    best = F.min(F.struct("cost", "rtype", F.coalesce("source_url", F.lit("")).alias("source_url"))).alias("m")
    rows = rows.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(best)
    return rows.select("a", "b", "m.rtype", "m.cost", "m.source_url")


def degrees(adj: DataFrame) -> DataFrame:
    """(id, degree): distinct neighbours."""
    return neighbours(adj).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def hub_penalty(degree: Column, p: Params = DEFAULT) -> Column:
    return F.when(degree > p.hub_degree, p.hub_weight * F.log(degree / float(p.hub_degree))).otherwise(0.0)


def fame_penalty(is_warm: Column, qid: Column, sitelinks: Column, p: Params = DEFAULT) -> Column:
    """Zero sitelinks mean 'not measured', and count as famous."""
    return F.when(F.coalesce(is_warm, F.lit(False)) | qid.isNull(), 0.0).when((sitelinks == 0) | (sitelinks >= p.fame_sitelinks), p.fame_cost).otherwise(0.0)


def penalties(people: DataFrame, adj: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(id, degree, hub, fame, penalty) of everyone in the adjacency."""
    rows = degrees(adj).join(people.select("id", "is_warm", "qid", "sitelinks"), "id", "left")
    rows = rows.withColumn("hub", hub_penalty(F.col("degree"), p)).withColumn("fame", fame_penalty(F.col("is_warm"), F.col("qid"), F.col("sitelinks"), p))
    return rows.select("id", "degree", "hub", "fame", (F.col("hub") + F.col("fame")).alias("penalty"))


def steps(adj: DataFrame, nodes: DataFrame | None = None, p: Params = DEFAULT, avoid: str | None = None) -> DataFrame:
    """(src, dst, w, enter, rtype): both directions with the walk's cost, and what entering dst adds."""
    rows = neighbours(adj.where(F.col("rtype") != avoid) if avoid else adj, "rtype", "cost").select("src", "dst", "rtype", (F.col("cost") + p.hop_surcharge).alias("w"))
    if nodes is None:
        return rows.withColumn("enter", F.lit(0.0))
    return rows.join(nodes.select(F.col("id").alias("dst"), F.col("penalty").alias("enter")), "dst", "left").na.fill(0.0, ["enter"])


def hop_distances(roots: DataFrame, walk: DataFrame, most: int = 0) -> DataFrame:
    """(root, node, hops): fewest steps from each root (roots: root); most: steps at most, 0 for no limit."""
    tag = uuid.uuid4().hex[:8]
    seen = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct(), f"bfs-{tag}-0")
    front, k = seen, 0
    pairs = cut(walk.select(F.col("src").alias("node"), "dst").distinct(), f"bfs-{tag}-pairs")
    while not most or k < most:
        k += 1
        new = front.join(pairs, "node").select("root", F.col("dst").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        front = cut(new.withColumn("hops", F.lit(k)), f"bfs-{tag}-{k}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def cheapest(roots: DataFrame, walk: DataFrame, count_end: bool = True, banned: DataFrame | None = None, nearest: int = 0, most_hops: int = 0) -> DataFrame:
    """(root, node, cost, hops, path): the cheapest route from each root; ties go by hops, then path.

    count_end: whether a route's last node's own penalty counts, too. banned: (id) of nodes that routes may end at
    but not pass through. nearest: where only so many nodes of each root are wanted, the cheapest: labels that
    cost more than so many found already are not walked on from, since costs only grow. most_hops: hops at
    most, 0 for no limit. roots: root.

    A round writes only the labels that it has improved.
    """
    tag, k = uuid.uuid4().hex[:8], 0
    walk = cut(walk.select("src", "dst", "w", "enter"), f"sp-{tag}-walk")
    label = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array("root").alias("path")).alias("l")
    front = cut(roots.select("root", F.col("root").alias("node"), label).distinct(), f"sp-{tag}-0")
    kept = front
    while not most_hops or k < most_hops:
        k += 1
        start = front
        if banned is not None and k > 1:
            start = front.join(banned.select(F.col("id").alias("node")), "node", "left_anti")
        if nearest and k > 1:
            best = kept.groupBy("root", "node").agg(F.min("l.cost").alias("c")).where("node <> root")
            bound = best.withColumn("n", F.row_number().over(W.partitionBy("root").orderBy("c"))).where(F.col("n") == nearest).select("root", F.col("c").alias("bound"))
            start = start.join(bound, "root", "left").where("bound is null or l.cost < bound").drop("bound")
        grown = start.join(walk, F.col("node") == F.col("src")).where(~F.array_contains("l.path", F.col("dst")))
        label = F.struct(F.round(F.col("l.cost") + F.col("w") + F.col("enter"), 9).alias("cost"), (F.col("l.hops") + 1).alias("hops"), F.concat("l.path", F.array("dst")).alias("path"))
        new = grown.select("root", F.col("dst").alias("node"), label.alias("l")).groupBy("root", "node").agg(F.min("l").alias("l"))
        both = kept.select("root", "node", "l", F.lit(None).cast("int").alias("new")).unionByName(new.withColumn("new", F.lit(1)))
        merged = both.groupBy("root", "node").agg(F.min("l").alias("l"), F.min(F.when(F.col("new").isNull(), F.col("l"))).alias("before"))
        front = cut(merged.where("before is null or l < before").select("root", "node", "l"), f"sp-{tag}-{k}")
        if front.isEmpty():
            break
        kept = kept.unionByName(front)
    out = kept.groupBy("root", "node").agg(F.min("l").alias("l")).select("root", "node", "l.cost", "l.hops", "l.path")
    if not count_end:
        ends = walk.groupBy(F.col("dst").alias("node")).agg(F.max("enter").alias("own"))
        out = out.join(ends, "node", "left").withColumn("cost", F.when(F.col("hops") > 0, F.round(F.col("cost") - F.coalesce("own", F.lit(0.0)), 9)).otherwise(F.col("cost"))).drop("own")
    return out.select("root", "node", "cost", "hops", "path")


def discover(root: DataFrame, ties: DataFrame, people: DataFrame, limit: int = 20, p: Params = DEFAULT) -> DataFrame:
    """The warmest people around each root: root, rank, node, name, cost, hops, warmth, via (the first tie's label)."""
    adj = cut(adjacency(ties), f"adj-{uuid.uuid4().hex[:8]}")
    walk = cut(steps(adj, penalties(people, adj, p), p), f"walk-{uuid.uuid4().hex[:8]}")
    found = cheapest(root, walk, nearest=limit).where("hops > 0")
    own = W.partitionBy("root").orderBy("cost", "node")
    top = found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= limit)
    first = walk.select(F.col("src").alias("root"), F.col("dst").alias("second"), taxonomy.label(F.col("rtype")).alias("via"))
    top = top.withColumn("second", F.try_element_at("path", F.lit(2))).join(first, ["root", "second"])
    names = people.select(F.col("id").alias("node"), "name")
    return top.join(names, "node", "left").select("root", "rank", "node", F.coalesce("name", F.col("node").cast("string")).alias("name"), F.round("cost", 6).alias("cost"), "hops", taxonomy.warmth_score(F.col("cost"), F.col("hops")).alias("warmth"), "via")


def routes(pairs: DataFrame, walk: DataFrame, banned: DataFrame | None = None, p: Params = DEFAULT, shown: int | None = None, most_hops: int = 0) -> DataFrame:
    """The cheapest loopless routes of each (src, dst) pair: src, dst, rank, cost, hops, path, bridges.

    Partial routes grow from the source and are kept while their cost plus the cheapest rest (from a
    search backward from the target) is within a slack of the best; those beyond it wait, and go on when the
    slack has grown, until there are ``generated_routes`` routes or nothing waits. Then a route goes whose bridges include all of a
    cheaper route's. most_hops: hops at most, 0 for no limit.
    """
    tag = uuid.uuid4().hex[:8]
    pairs = cut(pairs.select("src", "dst").where("src <> dst").distinct(), f"kr-{tag}-pairs")
    back = walk.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    # entering costs: of the node entered when walking forward; the target's own never counts
    enter = walk.groupBy(F.col("dst").alias("id")).agg(F.max("enter").alias("own"))
    back = back.join(enter.withColumnRenamed("id", "src"), "src", "left").select("src", "dst", "w", F.coalesce("own", F.lit(0.0)).alias("enter"))
    rest = cheapest(pairs.select(F.col("dst").alias("root")).distinct(), back, banned=banned, most_hops=most_hops).select(F.col("root").alias("dst"), "node", F.col("cost").alias("h"))
    own = enter.withColumnRenamed("id", "dst")
    rest = cut(rest.join(own, "dst", "left").select("dst", "node", F.when(F.col("node") == F.col("dst"), 0.0).otherwise(F.col("h") - F.coalesce("own", F.lit(0.0))).alias("h")), f"kr-{tag}-rest")
    steps_ = walk.select(F.col("src").alias("node"), F.col("dst").alias("next"), "w", "enter")
    if banned is not None:
        steps_ = steps_.join(banned.select(F.col("id").alias("next"), F.lit(True).alias("ban")), "next", "left")
    else:
        steps_ = steps_.withColumn("ban", F.lit(None).cast("boolean"))
    steps_ = cut(steps_, f"kr-{tag}-steps")
    start = pairs.join(rest.select("dst", F.col("node").alias("src"), "h"), ["src", "dst"])
    waiting = cut(start.select("src", "dst", F.col("h").alias("best"), F.col("src").alias("node"), F.lit(0.0).alias("cost"), F.array("src").alias("path"), "h"), f"kr-{tag}-start")
    done, slack, k = None, p.first_slack, 0
    while True:
        k += 1
        reached = cut(_grown(waiting, slack, steps_, rest, most_hops, f"kr-{tag}-{k}"), f"kr-{tag}-{k}-reached")
        found = reached.where("ends").select("src", "dst", "cost", (F.size("path") - 1).alias("hops"), "path")
        done = found if done is None else done.unionByName(found)
        enough = done.groupBy("src", "dst").agg(F.count("*").alias("n")).where(F.col("n") >= p.generated_routes)
        waiting = cut(reached.where("not ends").drop("ends").join(enough, ["src", "dst"], "left_anti"), f"kr-{tag}-{k}-waiting")
        if waiting.isEmpty():
            break
        slack *= p.more_slack
    ranked = done.withColumn("rank", F.row_number().over(W.partitionBy("src", "dst").orderBy("cost", "hops", "path"))).where(F.col("rank") <= p.generated_routes)
    ranked = cut(ranked.select("src", "dst", "rank", "cost", "hops", "path", bridges(F.col("path")).alias("bridges")), f"kr-{tag}-ranked")
    other = ranked.select("src", "dst", F.col("rank").alias("r"), F.col("bridges").alias("bs"))
    hidden = ranked.join(other, ["src", "dst"]).where("r < rank and size(array_except(bs, bridges)) = 0").select("src", "dst", "rank").distinct()
    kept = ranked.join(hidden, ["src", "dst", "rank"], "left_anti")
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("src", "dst").orderBy("rank")))
    return kept.where(F.col("rank") <= (shown or p.shown_routes))


def _grown(waiting: DataFrame, slack: float, steps_: DataFrame, rest: DataFrame, most_hops: int, tag: str) -> DataFrame:
    """What partial routes grow into: routes within ``slack`` of their pair's best (column ends is true), and those beyond it, which wait for a larger one."""
    ends = rest.select("dst", F.col("node").alias("next"), "h")
    inside = F.col("cost") + F.col("h") <= F.col("best") + slack + 1e-9
    going = inside & (F.col("node") != F.col("dst"))
    held, front, k = waiting.where(~going), waiting.where(going), 0
    while True:
        k += 1
        grown = front.where(F.size("path") <= most_hops) if most_hops else front
        grown = grown.drop("h").join(steps_, "node").where(~F.array_contains("path", F.col("next"))).where("ban is null or next = dst").join(ends, ["dst", "next"])
        cost = F.round(F.col("cost") + F.col("w") + F.when(F.col("next") == F.col("dst"), 0.0).otherwise(F.col("enter")), 9)
        grown = cut(grown.select("src", "dst", "best", F.col("next").alias("node"), cost.alias("cost"), F.concat("path", F.array("next")).alias("path"), "h"), f"{tag}-{k}")
        held, front = held.unionByName(grown.where(~going)), grown.where(going)
        if front.isEmpty():
            break
    return held.withColumn("ends", inside)


def bridges(path: Column) -> Column:
    """The nodes strictly between the ends."""
    return F.slice(path, F.lit(2), F.greatest(F.size(path) - 2, F.lit(0)))


def unroutable(nodes: DataFrame) -> DataFrame:
    return nodes.where("fame > 0").select("id")


def connect(pairs: DataFrame, ties: DataFrame, people: DataFrame, p: Params = DEFAULT, weak_retry: bool = False, most_hops: int = 0) -> DataFrame:
    """Routes of each pair, usable ones first: src, dst, rank, usable, worst_fame, route_cost, tie_cost, warmth, hops, path, blocked.

    First famous people are banned as bridges. Pairs without a route then are searched again without the
    ban; what they give isn't usable. With weak_retry, pairs that still have none may use weak ties.
    """
    adj = cut(adjacency(ties), f"adj-{uuid.uuid4().hex[:8]}")
    nodes = cut(penalties(people, adj, p), f"nodes-{uuid.uuid4().hex[:8]}")
    walk = cut(steps(adj, nodes, p), f"walk-{uuid.uuid4().hex[:8]}")
    famous = unroutable(nodes)
    first = routes(pairs, walk, famous, p, most_hops=most_hops)
    left = pairs.join(first.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    found = first.unionByName(routes(left, walk, None, p, p.unusable_routes, most_hops))
    out = serialized(found, walk, people, nodes)
    if weak_retry:
        missing = pairs.join(out.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
        loose = cut(adjacency(ties, include_weak=True), f"adj-{uuid.uuid4().hex[:8]}")
        near = penalties(people, loose, p)
        walk2 = cut(steps(loose, near, p), f"walk-{uuid.uuid4().hex[:8]}")
        out = out.unionByName(serialized(routes(missing, walk2, None, p, most_hops=most_hops), walk2, people, near))
    return out


def serialized(found: DataFrame, walk: DataFrame, people: DataFrame, nodes: DataFrame) -> DataFrame:
    """Routes with what a reader needs, in the order in which they are shown."""
    hop = found.select("src", "dst", "rank", "cost", "hops", "path", F.posexplode("path").alias("pos", "node"))
    hop = hop.withColumn("next", F.try_element_at("path", F.col("pos") + 2))
    w = walk.select(F.col("src").alias("node"), F.col("dst").alias("next"), "w", "rtype")
    fame = nodes.select(F.col("id").alias("node"), F.col("fame").alias("f")).join(people.select(F.col("id").alias("node"), "sitelinks"), "node", "left")
    hop = hop.join(w, ["node", "next"], "left").join(fame, "node", "left")
    inner = (F.col("pos") > 0) & F.col("next").isNotNull() & (F.coalesce("f", F.lit(0.0)) > 0)
    out = hop.groupBy("src", "dst", "rank", "cost", "hops", "path").agg(F.round(F.sum("w"), 6).alias("tie_cost"), F.array_sort(F.collect_set(F.when(inner, F.col("node")))).alias("blocked"), F.coalesce(F.max(F.when(inner, F.col("sitelinks"))), F.lit(0)).alias("worst_fame"))
    out = out.withColumn("usable", F.size("blocked") == 0).withColumn("warmth", taxonomy.warmth_score(F.col("tie_cost"), F.col("hops")))
    order = W.partitionBy("src", "dst").orderBy(F.desc("usable"), "worst_fame", F.desc("warmth"), "hops", "cost", "path")
    return out.withColumn("rank", F.row_number().over(order)).select("src", "dst", "rank", "usable", "worst_fame", F.col("cost").alias("route_cost"), "tie_cost", "warmth", "hops", "path", "blocked")


def suggestions(pairs: DataFrame, free: DataFrame, plain: DataFrame) -> DataFrame:
    """Where a route through famous people is cheaper than the best without: src, dst, improvement, names' ids.

    free, plain: the best route of each pair without and with the ban (cost, path).
    """
    a = free.select("src", "dst", F.col("cost").alias("free_cost"), bridges(F.col("path")).alias("through"))
    b = plain.select("src", "dst", F.col("cost").alias("plain_cost"))
    return pairs.join(a, ["src", "dst"]).join(b, ["src", "dst"]).where("free_cost < plain_cost").select("src", "dst", F.round(F.col("plain_cost") - F.col("free_cost"), 2).alias("improvement"), "through")


def rank_frontier(candidates: DataFrame, fanout: int = DEFAULT.fanout, prefer_notable: bool = False) -> DataFrame:
    """The people to look at next, of each owner, by ``enrichment.frontier_key``.

    candidates: owner, person, meets, via_podcast, is_warm, notable, degree; a person's best row counts.
    """
    key = frontier_key(F.col("meets"), F.col("via_podcast"), F.col("is_warm"), F.col("notable"), F.col("degree"), prefer_notable)
    rows = candidates.groupBy("owner", "person").agg(F.min(key).alias("key"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("owner").orderBy("key", "person")))
    return ranked.where(F.col("rank") <= fanout).select("owner", "person", "rank")


def dual_distances(roots: DataFrame, adj: DataFrame, without: str = "co_star", most: int = 0) -> DataFrame:
    """(root, node, hops, direct): fewest steps, and the fewest without ties of a type (null where there are none); most: as of ``hop_distances``."""
    pairs = neighbours(adj, "rtype")
    every, some = hop_distances(roots, pairs, most), hop_distances(roots, pairs.where(F.col("rtype") != without), most)
    return every.join(some.withColumnRenamed("hops", "direct"), ["root", "node"], "left")


def route_hops(found: DataFrame, ties: DataFrame) -> DataFrame:
    """The hops of routes: src, dst, rank, pos, a, b, rtype, tier, label, evidence, source_url.

    found: src, dst, rank, path. ties: a, b, rtype, source_url, evidence; of a pair the tie that is walked counts.
    """
    cost = taxonomy.edge_cost(F.col("rtype"), True)
    first = F.min(F.struct(cost.alias("cost"), "rtype", F.coalesce("source_url", F.lit("")).alias("source_url"), "evidence")).alias("f")
    best = ties.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(first).select("x", "y", "f.*")
    hop = found.select("src", "dst", "rank", "path", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("pos", "p"))
    hop = hop.withColumn("q", F.element_at("path", F.col("pos") + 2)).withColumn("x", F.least("p", "q")).withColumn("y", F.greatest("p", "q")).join(best, ["x", "y"])
    return hop.select("src", "dst", "rank", "pos", F.col("p").alias("a"), F.col("q").alias("b"), "rtype", taxonomy.tier(F.col("rtype")).alias("tier"), taxonomy.label(F.col("rtype")).alias("label"), "evidence", "source_url")


def outcomes(pairs: DataFrame, found: DataFrame, adj: DataFrame, most_hops: int = 0) -> DataFrame:
    """(src, dst, state, hops) of each pair: 'found'; 'beyond' (connected, but no route is allowed); 'apart'; 'unknown' (an end has no tie)."""
    pairs = pairs.select("src", "dst").distinct()
    far = hop_distances(pairs.select(F.col("src").alias("root")).distinct(), neighbours(adj)).select(F.col("root").alias("src"), F.col("node").alias("dst"), "hops")
    known = degrees(adj).select("id")
    rows = pairs.join(found.select("src", "dst").distinct().withColumn("hit", F.lit(True)), ["src", "dst"], "left").join(far, ["src", "dst"], "left")
    for end in ("src", "dst"):
        rows = rows.join(known.select(F.col("id").alias(end), F.lit(True).alias(f"k_{end}")), end, "left")
    lost = F.col("k_src").isNull() | F.col("k_dst").isNull()
    return rows.select("src", "dst", F.when(F.col("hit"), "found").when(lost, "unknown").when(F.col("hops").isNotNull(), "beyond").otherwise("apart").alias("state"), "hops")
