import pytest

from kithgraph.operators import edges

ORGS = "id string, type string"
TIES = "seq int, person_1 string, person_2 string, rtype string, source_url string, evidence string"


def members(spark, n, org="o"):
    return spark.createDataFrame([(org, f"p{i:03d}") for i in range(n)], "org string, person string")


@pytest.mark.parametrize(("n", "pairs"), [(1, 0), (3, 3), (40, 780), (41, 0), (60, 0)])
def test_only_small_groups_are_close(spark, n, pairs):
    orgs = spark.createDataFrame([("o", "firm")], ORGS)
    assert edges.cliques(members(spark, n), orgs).count() == pairs


def test_the_recorded_size_counts(spark):
    orgs = spark.createDataFrame([("o", "company")], ORGS)
    told = spark.createDataFrame([("o", 8), ("o", 900), ("o", 3)], "org string, member_count int")
    assert edges.cliques(members(spark, 5), orgs, recorded=told).count() == 0


def test_one_row_for_both_directions_and_no_loops(spark):
    rows = [(1, "a", "b", "colleague", None, "x"), (2, "b", "a", "colleague", None, "y"), (3, "a", "a", "colleague", None, "z"), (4, "a", None, "colleague", None, "z")]
    got = edges.add_edges(spark.createDataFrame(rows, TIES)).collect()
    assert [(r.a, r.b, r.evidence, r.assertions) for r in got] == [("a", "b", "x", 2)]


@pytest.mark.parametrize("rtype", ["cooccurrence", "made_up"])
def test_what_nobody_asserts_raises(spark, rtype):
    rows = spark.createDataFrame([(1, "a", "b", rtype, None, "x")], TIES)
    with pytest.raises(Exception, match="not a tie"):
        edges.add_edges(rows).collect()


def test_portfolio_and_rounds(spark):
    rosters = spark.createDataFrame([(f, f"{f}{i}") for f, n in (("x", 2), ("y", 3)) for i in range(n)], "firm string, person string")
    inv = spark.createDataFrame([("c", "x"), ("c", "y"), ("d", "x")], "company string, firm string")
    assert edges.portfolio_ties(inv, rosters).count() == 10
    listed = spark.createDataFrame([("r", 1, "x"), ("r", 2, "y"), ("r", 3, "nobody"), ("q", 1, "x")], "round string, firm_pos int, firm string")
    assert edges.round_ties(listed, rosters).count() == 6


def test_a_roster_beyond_the_cap_gives_no_pairs(spark):
    rosters = spark.createDataFrame([("x", f"x{i}") for i in range(50)] + [("y", "y0")], "firm string, person string")
    inv = spark.createDataFrame([("c", "x"), ("c", "y")], "company string, firm string")
    assert edges.portfolio_ties(inv, rosters).count() == 0


def test_mutuals_need_both_ways(spark):
    a = spark.createDataFrame([("o", "h1", " "), ("o", "h2", "Ana Roe"), ("o", "h3", None)], "owner string, handle string, fullname string")
    b = spark.createDataFrame([("o", "h1"), ("o", "h2")], "owner string, handle string")
    assert sorted((r.handle, r.name) for r in edges.mutuals(a, b).collect()) == [("h1", "h1"), ("h2", "Ana Roe")]
