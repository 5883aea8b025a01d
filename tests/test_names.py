import pytest
from pyspark.sql import functions as F

from kithgraph.functions import episodes, funding, names, structured, urls
from kithgraph.operators import resolve


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "key"), [("Tim Poe", "timothy poe"), ("Timothy B. Poe", "timothy poe"), ("  ANA  Roe ", "ana roe"), ("Carl Hale III", "carl hale iii"), (None, "")])
def test_person_keys(spark, raw, key):
    assert one(spark, names.person_key(F.lit(raw).cast("string"))) == key


@pytest.mark.parametrize(("raw", "key"), [("Acme, Inc.", "acme"), ("Acme Holdings LLC", "acme"), ("Inc", "inc"), ("Blue River", "blue river")])
def test_org_keys(spark, raw, key):
    assert one(spark, names.org_key(F.lit(raw))) == key


@pytest.mark.parametrize("raw", ["Ana Roe", "Jean-Luc Smit", "Maria del Roe", "Tim B. Poe"])
def test_people_pass(spark, raw):
    assert one(spark, names.is_noise(F.lit(raw))) is False


@pytest.mark.parametrize("raw", ["", "Home - Acme", "www.acme.com", "Cookie Policy", "Roe, Ana", "ANA ROE", "Managing Partner", "Acme Capital", "Read more", "王伟", None])
def test_noise(spark, raw):
    assert one(spark, names.is_noise(F.lit(raw).cast("string"))) is True


def test_roles_at_the_ends(spark):
    assert one(spark, names.strip_roles(F.lit("Partner Ana Roe"))) == "Ana Roe"
    assert one(spark, names.strip_roles(F.lit("Managing Director"))) == ""


def test_identity_guard(spark):
    ok = lambda s, c, v=None, p=None: one(spark, names.identity_confirmed(F.lit(True), F.lit(s), F.lit(c), F.lit(v).cast("string"), F.lit(p).cast("double")))
    assert ok("venture capital investor", "American footballer") is False
    assert ok("venture capital investor", "") is True
    assert ok("banker", "banker", "different", 0.9) is False
    assert ok("banker", "banker", "different", 0.3) is True


def test_urls(spark):
    assert one(spark, urls.host(F.lit("https://www.Acme.com/team"))) == "acme.com"
    assert one(spark, urls.host(F.lit("not a url"))) == ""
    assert one(spark, urls.is_roster_url(F.lit("https://acme.com/our-team"))) is True
    assert one(spark, urls.is_roster_url(F.lit("https://acme.com/news/team"))) is False
    assert one(spark, urls.firm_name(F.lit("Team | Acme Capital"), F.lit("https://acmecapital.com/team"))) == "Acme Capital"


def test_people_with_authoritative_ids(spark):
    rows = [(1, "Jon Smit", "Q111", False), (2, "Jon Smit", "Q222", True), (3, "Ana Roe", None, False), (4, "Ana Roe", "Q5", False), (5, "Tim Poe", "Q7", False), (6, "Timothy B. Poe", "Q7", False)]
    got = {r.node: (r.qid, r.canonical) for r in resolve.resolve_people(spark.createDataFrame(rows, "seq int, surface string, qid string, is_warm boolean")).collect()}
    assert got == {"jon smit": ("Q111", "Jon Smit"), "jon smit#Q222": ("Q222", "Jon Smit"), "ana roe": ("Q5", "Ana Roe"), "timothy poe": ("Q7", "Timothy B. Poe")}


def test_episodes_and_rounds(spark):
    rows = [("f", "The Roe Show", "Ana Roe", 1, "Growth with Carl Hale", ""), ("f", "The Roe Show", "Ana Roe", 2, "More growth with Carl Hale", ""), ("f", "The Roe Show", "Ana Roe", 3, "Markets", "An agenda"), ("g", "Acme Talks", "Acme Talks", 1, "Talk with Nora Lund", "")]
    got = episodes.episodes(spark.createDataFrame(rows, "feed_id string, show string, author string, pos int, title string, description string")).collect()
    assert [(r.feed_id, r.pos, r.guest) for r in got] == [("f", 1, "Carl Hale")]


def test_rounds(spark):
    one_round = "Blue River raises $11.7M, led by Acme Ventures, with participation from North Fund and Lund Capital. Ana Roe said more."
    rows = [(1, one_round), (2, "Lund Capital led the seed round in Blue River."), (3, "A profile of Acme Ventures."), (4, "; ".join(["led by Acme Ventures" + " and so on" * 80] * 3)), (5, None), (6, "")]
    got = {r.id: r for r in funding.rounds(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert set(got) == {1, 2}
    assert (got[1].company, got[1].amount, got[1].investors) == ("Blue River", "$11.7M", ["Acme Ventures", "North Fund", "Lund Capital"])
    assert got[2].investors == ["Lund Capital"]
    target = spark.createDataFrame([(1, one_round, "north fund"), (2, one_round, "other fund")], "id int, text string, firm string")
    assert [r.id for r in funding.rounds(target, "firm").collect()] == [1]


def test_linked_data_and_nested_objects(spark):
    html = '<script type="application/ld+json">{"@graph": [{"@type": "Person", "name": "Ana Roe"}, {"@type": ["Thing", "Person"], "name": "ana roe"}, {"x": [{"@type": "Person", "name": "Tim Poe"}]}, {"@type": "Org", "name": "Acme"}]}</script><script type="application/ld+json">{broken</script>'
    rows = spark.createDataFrame([(html,), (None,), ("",)], "h string")
    assert [r.x for r in rows.select(structured.jsonld_names(F.col("h")).alias("x")).collect()] == [["Ana Roe", "Tim Poe"], [], []]
    nested = spark.createDataFrame([('{"a": [{"id": 1, "name": "x"}, {"b": {"id": 1, "name": "y"}}, {"id": 2, "name": "z"}, {"id": 3}]}',), ("no json",), (None,)], "t string")
    got = [[dict(m) for m in r.x] for r in nested.select(structured.harvested(F.col("t"), "id", "name").alias("x")).collect()]
    assert got == [[{"id": "1", "name": "x"}, {"id": "2", "name": "z"}], [], []]
    assert [r.x for r in nested.select(structured.field(F.col("t"), "$.a[2].name", "?").alias("x")).collect()] == ["z", "?", "?"]
