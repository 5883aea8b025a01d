import itertools
import math
import random

import pytest

from kithgraph.functions import taxonomy
from kithgraph.plans import graph

PEOPLE = "id string, name string, is_warm boolean, qid string, sitelinks int"


def ties(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, rtype string")


def people(spark, ids, famous=()):
    return spark.createDataFrame([(i, i, False, "Q1" if i in famous else None, 50 if i in famous else 0) for i in ids], PEOPLE)


def pair(spark, a="S", b="T"):
    return spark.createDataFrame([(a, b)], "src string, dst string")


def paths(found):
    return [tuple(r.path) for r in sorted(found.collect(), key=lambda r: r["rank"])]


def test_warm_beats_short_and_direct_beats_relay(spark):
    t = ties(spark, [("S", "X", "board_member"), ("X", "T", "board_member"), ("S", "T", "co_speaker")])
    assert paths(graph.connect(pair(spark), t, people(spark, "SXT")))[0] == ("S", "X", "T")
    t = ties(spark, [("S", "R", "cofounder"), ("R", "T", "cofounder"), ("S", "T", "colleague")])
    assert paths(graph.connect(pair(spark), t, people(spark, "SRT"))) == [("S", "T")]


def test_a_detour_is_hidden(spark):
    t = ties(spark, [("S", "B", "cofounder"), ("B", "T", "cofounder"), ("S", "A", "cofounder"), ("A", "B", "cofounder")])
    assert paths(graph.connect(pair(spark), t, people(spark, "SABT"))) == [("S", "B", "T")]


def test_famous_bridges_are_the_last_resort(spark):
    t = ties(spark, [("S", "C", "cofounder"), ("C", "T", "cofounder")])
    row = graph.connect(pair(spark), t, people(spark, "SCT", "C")).first()
    assert (row.usable, row.blocked, row.worst_fame) == (False, ["C"], 50)
    both = ties(spark, [("S", "C", "cofounder"), ("C", "T", "cofounder"), ("S", "X", "co_speaker"), ("X", "T", "co_speaker")])
    got = graph.connect(pair(spark), both, people(spark, "SCXT", "C")).collect()
    assert [(tuple(r.path), r.usable) for r in got] == [(("S", "X", "T"), True)]


def test_weak_ties_only_on_retry(spark):
    t = ties(spark, [("S", "X", "co_mention"), ("X", "T", "cofounder")])
    assert graph.connect(pair(spark), t, people(spark, "SXT")).count() == 0
    assert paths(graph.connect(pair(spark), t, people(spark, "SXT"), weak_retry=True)) == [("S", "X", "T")]


def test_hop_distances(spark):
    t = ties(spark, [(f"n{i}", f"n{i + 1}", "colleague") for i in range(6)])
    from kithgraph.operators.edges import neighbours

    root = spark.createDataFrame([("n0",)], "root string")
    far = {r.node: r.hops for r in graph.hop_distances(root, neighbours(t)).collect()}
    assert far == {f"n{i}": i for i in range(7)}
    assert graph.hop_distances(root, neighbours(t), most=5).count() == 6


@pytest.mark.parametrize("seed", [1, 2])
def test_routes_against_all_paths(spark, seed):
    r = random.Random(seed)
    kinds = ["cofounder", "board_member", "colleague", "shared_portfolio", "co_speaker"]
    ids = "SABCDT"
    links = {p: r.choice(kinds) for p in itertools.combinations(ids, 2) if r.random() < 0.55 and p != ("S", "T")}
    famous = {"C"}
    cost = {}
    for (a, b), k in links.items():
        cost[a, b] = cost[b, a] = taxonomy.COSTS[taxonomy.TIERS[k]] + 2
    found = []
    for n in range(len(ids) - 1):
        for mid in itertools.permutations([i for i in ids if i not in "ST"], n):
            path = ("S", *mid, "T")
            if famous & set(mid) or any(e not in cost for e in itertools.pairwise(path)):
                continue
            found.append((round(sum(cost[e] for e in itertools.pairwise(path)), 9), len(path) - 1, path))
    found = sorted(found)[:24]
    shown = [x for i, x in enumerate(found) if not any(set(y[2][1:-1]) <= set(x[2][1:-1]) for y in found[:i])][:3]
    adj = graph.adjacency(ties(spark, [(a, b, k) for (a, b), k in links.items()]))
    nodes = graph.penalties(people(spark, ids, famous), adj)
    got = graph.routes(pair(spark), graph.steps(adj, nodes), graph.unroutable(nodes)).orderBy("rank").collect()
    assert [(x.cost, x.hops, tuple(x.path)) for x in got] == shown


def test_scores(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(taxonomy.warmth_score(F.lit(3.0), F.lit(1)).alias("a"), taxonomy.warmth_score(F.lit(6.0), F.lit(2)).alias("b"), taxonomy.warmth_score(F.lit(0.0), F.lit(0)).alias("c"), taxonomy.adjusted_cost(F.lit("co_mention"), F.lit(9.0)).alias("d"), graph.hub_penalty(F.lit(100)).alias("e")).first()
    assert (row.a, row.b, row.c, row.d) == (0.25, 0.143, 1.0, 7.5)
    assert row.e == pytest.approx(0.6 * math.log(2))
