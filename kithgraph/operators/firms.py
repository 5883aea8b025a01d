"""Firms from their own pages: rosters, portfolios, whose firm a person is in, and what a roster becomes in the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kithgraph.functions import names, taxonomy, urls
from kithgraph.functions.structured import jsonld_names
from kithgraph.operators import edges, resolve
from kithgraph.params import DEFAULT
from kithgraph.sources.tables import cut


def _rank(by: list[str], *order) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(*order))


def search_results(keyed: DataFrame, free: DataFrame) -> DataFrame:
    """The keyed search's rows of a query where it has any, else the free search's. Both: query and any columns."""
    return keyed.unionByName(free.join(keyed.select("query").distinct(), "query", "left_anti"))


def firm_pages(candidates: DataFrame, portfolio: bool = False) -> DataFrame:
    """(firm, page_id, url) of each firm's roster (or portfolio) page: of its own pages the shallowest; null where it has none.

    candidates: firm, pos, page_id, url, title.
    """
    fits = urls.is_portfolio_url(F.col("url")) if portfolio else urls.is_roster_url(F.col("url"))
    rows = candidates.where(fits).withColumn("declared", urls.firm_name(F.col("title"), F.col("url")))
    rows = rows.where(urls.is_page_of(F.col("firm"), F.col("url"), F.col("declared")))
    rows = rows.withColumn("k", _rank(["firm"], urls.path_depth(F.col("url")), "pos", "page_id")).where("k = 1").select("firm", "page_id", "url")
    return candidates.select("firm").distinct().join(rows, "firm", "left")


def roster_members(pages: DataFrame, most: int = 40, cap: int = DEFAULT.clique_cap) -> DataFrame:
    """page_id, n, name, key, overflow: people that a page lists, those of its linked data first, each once whatever the case.

    overflow: the page lists more than ``cap``, so that sharing it says little. pages: page_id, html.
    """
    list_of = lambda src, column: pages.select(F.struct("page_id", F.lit(src).alias("src")).alias("list"), F.posexplode(column).alias("pos", "raw"))
    rows = list_of(0, jsonld_names(F.col("html"))).unionByName(list_of(1, urls.blocks(F.col("html"))))
    rows = resolve.clean_names(rows).select("list.page_id", "list.src", "pos", "name", "key")
    rows = rows.withColumn("k", _rank(["page_id", F.lower("name")], "src", "pos")).where("k = 1")
    rows = rows.withColumn("n", _rank(["page_id"], "src", "pos")).withColumn("overflow", F.count(F.lit(1)).over(W.partitionBy("page_id")) > cap)
    return rows.where(F.col("n") <= most).select("page_id", "n", "name", "key", "overflow")


def person_firms(subjects: DataFrame, members: DataFrame, pages: DataFrame, most: int = 3) -> DataFrame:
    """(subject, firm_key, page_id, members): the fullest roster of each firm that names the person, the largest ``most``.

    subjects: name. members: as of ``roster_members``. pages: page_id, firm.
    """
    sizes = members.groupBy("page_id").agg(F.count("*").alias("members"))
    hits = subjects.select(F.col("name").alias("subject"), names.person_key(F.col("name")).alias("key")).distinct().join(members.select("page_id", "key").distinct(), "key")
    rows = hits.join(pages.select("page_id", names.org_key(F.col("firm")).alias("firm_key")).where("firm_key <> ''"), "page_id").join(sizes, "page_id")
    best = rows.withColumn("k", _rank(["subject", "firm_key"], F.desc("members"), "page_id")).where("k = 1")
    return best.withColumn("k", _rank(["subject"], F.desc("members"), "firm_key")).where(F.col("k") <= most).select("subject", "firm_key", "page_id", "members")


def portfolio_companies(pages: DataFrame, most: int = 400) -> DataFrame:
    """page_id, n, name, domain: companies that a page links to, one for each domain. pages: page_id, url, html.

    A link counts if it leads to another site than the page's own (or a part of it), that is no aggregator, and
    bears a usable name.
    """
    rows = pages.select("page_id", urls.host(F.col("url")).alias("own"), F.posexplode(urls.anchor_parts(F.col("html"))).alias("pos", "a")).where(F.startswith("a.href", F.lit("http")))
    rows = rows.select("page_id", "own", "pos", urls.host(F.col("a.href")).alias("domain"), urls.company_name(F.col("a.alt"), F.col("a.text")).alias("name"), urls.is_blocked(F.col("a.href")).alias("blocked"))
    dotted = lambda c: F.concat(F.lit("."), c)
    same = F.endswith(dotted(F.col("domain")), dotted(F.col("own"))) | F.endswith(dotted(F.col("own")), dotted(F.col("domain")))
    rows = rows.where((F.col("domain") != "") & (F.col("name") != "") & ~F.col("blocked") & ~same)
    rows = rows.withColumn("k", _rank(["page_id", "domain"], "pos")).where("k = 1").withColumn("n", _rank(["page_id"], "pos"))
    return rows.where(F.col("n") <= most).select("page_id", "n", "name", "domain")


def absorbed(rosters: DataFrame, cap: int = DEFAULT.clique_cap) -> dict[str, DataFrame]:
    """What rosters become: orgs, memberships and ties.

    rosters: subject, org, org_type, rtype, source_url, told (how many members the source says), overflow, and
    names (array). A roster whose names are all noise gives nothing. One with overflow, or with fewer than two
    names in a firm's page, gives the subject's membership at most. An organisation's size is the larger of what
    is told and the people seen, the subject included; ties need two to ``cap``.
    """
    rows = rosters.withColumn("org_key", names.org_key(F.col("org"))).withColumn("me", names.person_key(F.col("subject"))).where("org_key <> ''")
    own = ["subject", "me", "org_key", "org", "org_type", "rtype", "source_url", "told", "overflow"]
    each = rows.select(*own, F.explode("names").alias("raw")).withColumn("name", names.strip_roles(F.col("raw"))).where(names.is_person(F.col("name"))).withColumn("key", names.person_key(F.col("name")))
    people = each.groupBy(*own).agg(F.collect_set("key").alias("keys"))
    people = people.withColumn("size", F.greatest(F.coalesce("told", F.lit(0)), F.size("keys") + 1)).withColumn("all", F.array_distinct(F.concat(F.array("me"), F.array_sort("keys"))))
    orgs = people.groupBy("org_key").agg(F.min(F.struct("subject", "org"))["org"].alias("name"), F.min("org_type").alias("type"), F.max("size").alias("member_count"))
    who = F.when(F.col("overflow"), F.array("me")).when(F.col("org_type") == "firm", F.col("all")).otherwise(F.array().cast("array<string>"))
    memberships = people.select(F.explode(who).alias("person"), "org_key").distinct()
    small = people.where(~F.col("overflow")).where(F.size("all").between(2, cap) & (F.col("size") <= cap))
    held = small.select("org_key", "rtype", "source_url", F.explode("all").alias("a"), "all")
    ties = held.select("org_key", "rtype", "source_url", "a", F.explode("all").alias("b")).where("a < b").distinct()
    return {"orgs": orgs, "memberships": memberships, "ties": ties}


def firm_ties(ties: DataFrame) -> DataFrame:
    """(person, org): who already has a colleague at a firm. ties: a, b, org, rtype."""
    return edges.neighbours(ties.where("rtype = 'same_firm_partner' and org is not null"), "org").select(F.col("src").alias("person"), "org").distinct()


def orgs_of(memberships: DataFrame, ties: DataFrame) -> DataFrame:
    """(person, org): organisations on any row that a person is an end of."""
    rows = memberships.select("person", "org").unionByName(edges.neighbours(ties, "org").select(F.col("src").alias("person"), "org"))
    return rows.where("org is not null and person is not null").distinct()


def pending_rosters(memberships: DataFrame, ties: DataFrame, orgs: DataFrame, most: int = 3) -> DataFrame:
    """(person, org): firms of each person whose roster has not been absorbed for them, the first ``most``."""
    firms = orgs.where("type = 'firm'").select(F.col("id").alias("org"))
    rows = orgs_of(memberships, ties).join(firms, "org", "left_semi").join(firm_ties(ties), ["person", "org"], "left_anti")
    return rows.withColumn("k", _rank(["person"], "org")).where(F.col("k") <= most).select("person", "org")


def within_budget(listed: DataFrame, peopled: DataFrame, budget: int = 6) -> DataFrame:
    """Co-investors up to the point where an anchor has met ``budget`` firms that nobody is known of.

    listed: anchor, round, pos, firm, in the order (round, pos). peopled: (firm) with people.
    """
    rows = listed.where("firm <> anchor").join(peopled.select("firm").distinct().withColumn("known", F.lit(True)), "firm", "left")
    rows = rows.withColumn("k", _rank(["anchor", "firm"], "round", "pos"))
    new = F.when(F.col("known").isNull() & (F.col("k") == 1), 1).otherwise(0)
    before = F.coalesce(F.sum(new).over(W.partitionBy("anchor").orderBy("round", "pos", "firm").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("spent", before).where(F.col("spent") < budget).select("anchor", "round", "pos", "firm", F.col("known").isNotNull().alias("known"))


def seeds(manifest: DataFrame) -> dict[str, DataFrame]:
    """Ties and memberships of a list of verified rows: kind ('founder', 'star'), owner, name, rtype, org, source_url.

    Stars tie the owner to each name. The founders of an organisation are its members, and co-founders of each
    other where there are two or more.
    """
    key = names.person_key
    stars = manifest.where("kind = 'star'").select(key(F.col("owner")).alias("x"), key(F.col("name")).alias("y"), "rtype", "source_url").where("x <> y")
    stars = stars.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "rtype", "source_url").distinct()
    founders = manifest.where("kind = 'founder'").select(names.org_key(F.col("org")).alias("org"), key(F.col("name")).alias("person"), "source_url").where("org <> '' and person <> ''")
    one = founders.groupBy("org", "person").agg(F.min("source_url").alias("source_url"))
    sizes = one.groupBy("org").agg(F.count("*").alias("member_count"))
    few = one.join(sizes.where(F.col("member_count") <= DEFAULT.clique_cap).select("org"), "org")
    pairs = few.select("org", F.col("person").alias("a"), "source_url").join(few.select("org", F.col("person").alias("b")), "org").where("a < b")
    ties = stars.unionByName(pairs.select("a", "b", F.lit("cofounder").alias("rtype"), "source_url")).distinct()
    return {"ties": ties, "memberships": one, "orgs": sizes}


def precrawl(firms: DataFrame, members: DataFrame, companies: DataFrame, cap: int = DEFAULT.clique_cap) -> dict[str, DataFrame]:
    """Rosters and portfolios of a list of firms as a graph: memberships, partner ties, investments, and portfolio ties.

    firms: firm, roster_page, book_page. members: as of ``roster_members``; pages with overflow are passed over.
    companies: as of ``portfolio_companies``.
    """
    listed = firms.select("firm", F.col("roster_page").alias("page_id")).join(members.where("not overflow"), "page_id")
    memberships = cut(listed.select("firm", F.col("key").alias("person")).distinct(), "precrawl")
    orgs = firms.select(F.col("firm").alias("id"), F.lit("firm").alias("type")).distinct()
    partners = edges.cliques(memberships.select(F.col("firm").alias("org"), "person"), orgs, cap)
    investments = firms.select("firm", F.col("book_page").alias("page_id")).join(companies, "page_id").select(F.lower("domain").alias("company"), "firm").distinct()
    return {"memberships": memberships, "partners": partners, "investments": investments, "shared": edges.portfolio_ties(investments, memberships, cap)}


def labelled_ties(rows: DataFrame) -> DataFrame:
    """Ties with how they read."""
    return rows.withColumn("label", taxonomy.label(F.col("rtype")))
