"""Queries of the operators over names, pages, shows and announcements, with their SQL.

The texts are made from the supplied tables, so that the SQL knows what an operator has to find in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.functions import episodes, funding, names, taxonomy, urls
from kithgraph.operators import audit, edges, filings, resolve, stateful
from kithgraph.plans.projection import table, view
from kithgraph.plans.queries import _ADJ, _CLIQUES, query, roster_adj, roster_ties
from kithgraph.plans.queries_world import _key, _person

# -- names --------------------------------------------------------------------------------------

#: What surrounds a person's name, by customer number modulo 12; whether it passes as a person, and as noise.
_SHAPES = [("{n}", True, False), ("Partner {n}", False, False), ("{n} | Home", False, True), ("{n}, {n}", False, True), ("{n} Ventures", False, True), ("Cookie Policy", False, True), ("{n}!", False, True), ("Managing Director", False, True), ("", False, True), ("www.{n}.com", False, True), ("Xbox Founder {n}", False, True), ("{n} Email", False, True)]
_N = _person("c_custkey")
_BODY = _person("c_custkey * 5 + 1")


def _shape(values) -> str:
    return "case c_custkey % 12 " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


def _text(shape: str) -> str:
    parts = shape.split("{n}")
    out = [f"'{parts[0]}'"]
    for p in parts[1:]:
        out += [_N, f"'{p}'"]
    return f"concat({', '.join(out)})"


_RAW = _shape([_text(t) for t, _, _ in _SHAPES])


@query(f"""with c as (select c_custkey, {_RAW} as raw, {_N} as n from customer) select c_custkey as id, {_shape([str(p).lower() for _, p, _ in _SHAPES])} as person, {_shape([str(x).lower() for _, _, x in _SHAPES])} as noise,
case when c_custkey % 12 in (0, 1) then n when c_custkey % 12 = 7 then '' end as bare, c_custkey % 12 = 4 as org from c""")
def name_gates(s, d):
    t = table(s, d, "customer").selectExpr("c_custkey as id", f"{_RAW} as raw", "c_custkey % 12 as k")
    return t.select("id", names.is_person(F.col("raw")).alias("person"), names.is_noise(F.col("raw")).alias("noise"), F.when(F.col("k").isin(0, 1, 7), names.strip_roles(F.col("raw"))).alias("bare"), names.is_org(F.col("raw")).alias("org"))


_ALTS = {"Tim": ["Timothy"], "Timothy": ["Tim", "Timmy"], "Bob": ["Robert"], "Robert": ["Bob", "Bobby", "Rob"]}


@query("with n as (select c_custkey as id, " + _N + " as n from customer) select id, case string_split(n, ' ')[1] " + " ".join(f"when '{k}' then concat_ws('|', n, {', '.join(chr(39) + a + ' ' + chr(39) + ' || string_split(n, chr(32))[2]' for a in v)})" for k, v in _ALTS.items()) + " else n end as variants from n")
def search_variants(s, d):
    t = table(s, d, "customer").selectExpr("c_custkey as id", f"{_N} as n")
    return t.select("id", F.array_join(names.search_variants(F.col("n")), "|").alias("variants"))


@query(f"""with l as (select c_custkey // 20 as list, c_custkey as pos, case when c_custkey % 12 = 1 then true when c_custkey % 12 = 0 then true else false end as ok, {_N} as name from customer),
k as (select list, pos, name, {_key('name')} as key, row_number() over (partition by list, {_key('name')} order by pos) as k from l where ok) select list, pos, name, key from k where k = 1""")
def clean_name_lists(s, d):
    return resolve.clean_names(table(s, d, "customer").selectExpr("c_custkey div 20 as list", "c_custkey as pos", f"{_RAW} as raw"))


@query(f"""with c as (select c_custkey as id, {_N} as a, {_BODY} as b from customer) select id, {_key('a')} <> {_key('b')} and not exists (select 1 from (select unnest(string_split({_key('a')}, ' ')) as w) x join (select unnest(string_split({_key('b')}, ' ')) as w) y using (w)) as clean,
'saw ' || a || ' twice' as evidence, sha1(a || '||' || b)[1:16] as short_key, case when length(a || ' of ' || b) <= 16 then a || ' of ' || b else left(a || ' of ' || b, 15) || '…' end as short from c""")
def name_details(s, d):
    t = table(s, d, "customer").selectExpr("c_custkey as id", f"{_N} as a", f"{_BODY} as b")
    text = F.concat(F.lit("saw   "), "a", F.lit("\n twice"))
    whole = F.concat("a", F.lit(" of "), "b")
    return t.select("id", names.is_clean_person(F.col("a"), F.col("b")).alias("clean"), names.evidence_window(text, F.col("a")).alias("evidence"), names.short_key(F.col("a"), F.col("b")).alias("short_key"), names.ellipsis(whole, 16).alias("short"))


@query("""with p as (select *, string_split(p_name, ' ') as w from part) select p_partkey as id, list_filter(w, lambda x: length(x) > 3)[1] as word, 'Q' || p_partkey as entity, true as is_entity, p_name || '|' || p_brand as cells,
case when p_size % 3 = 0 then 'board_member' else 'colleague' end as tie, lpad(cast(p_partkey as varchar), 10, '0') as cik from p""")
def cell_details(s, d):
    t = table(s, d, "part")
    uri = F.concat(F.lit("http://x/entity/Q"), "p_partkey")
    cell = F.concat(F.lit(" ; "), "p_name", F.lit("|"), F.col("p_brand"), F.lit(";;"))
    position = F.when(F.col("p_size") % 3 == 0, "Trustee").otherwise("Secretary")
    display = F.concat("p_name", F.lit("  (CIK "), F.lpad(F.col("p_partkey").cast("string"), 10, "0"), F.lit(")"))
    entity = F.substring_index(uri, "/", -1)
    return t.select(F.col("p_partkey").alias("id"), F.try_element_at(names.distinctive_tokens(F.col("p_name")), F.lit(1)).alias("word"), entity.alias("entity"), names.is_qid(entity).alias("is_entity"), F.array_join(names.as_list(cell), "|").alias("cells"), filings.officer_tie(position).alias("tie"), names.filing_cik(display).alias("cik"))


@query(f"select c_custkey as id, {_N} as person, c_custkey % 3 = 0 as company, case when c_custkey % 2 = 0 then 'Jr' else '' end as suffix from customer")
def filing_names(s, d):
    t = table(s, d, "customer").selectExpr("c_custkey as id", f"{_N} as n")
    suffix = F.when(F.col("id") % 2 == 0, " JR.").otherwise("")
    turned = F.concat(F.upper(F.substring_index("n", " ", -1)), F.lit(" "), F.upper(F.substring_index("n", " ", 1)), suffix)
    shown = filings.person_display(F.concat(turned, F.lit("  (CIK 0000000001)")))
    company = filings.is_company(F.concat(turned, F.when(F.col("id") % 3 == 0, F.lit("  (ACM)  (CIK 0000000001)")).otherwise("")))
    return t.select("id", F.trim(F.regexp_replace(shown, " Jr$", "")).alias("person"), company.alias("company"), F.regexp_extract(shown, "(Jr)$", 1).alias("suffix"))


_KIND_ROWS = {"venture": "an angel investor", "law": "a retired judge", "music": "drummer in a band", None: "lives quietly"}


@query("select c_custkey as id, c_custkey % 4 in (0, 1, 2) and (c_custkey // 4) % 4 in (0, 1, 2) and c_custkey % 4 <> (c_custkey // 4) % 4 as conflict, not coalesce(c_custkey % 5 = 0 and c_nationkey >= 15 or (c_custkey % 4 in (0, 1, 2) and (c_custkey // 4) % 4 in (0, 1, 2) and c_custkey % 4 <> (c_custkey // 4) % 4), false) as confirmed from customer")
def identity_checks(s, d):
    kinds = [F.lit(v) for v in _KIND_ROWS.values()]
    pick = lambda e: F.element_at(F.array(*kinds), (F.expr(e) + 1).cast("int"))
    t = table(s, d, "customer").select(F.col("c_custkey").alias("id"), pick("c_custkey % 4").alias("a"), pick("c_custkey div 4 % 4").alias("b"), F.when(F.col("c_custkey") % 5 == 0, "different").otherwise("unknown").alias("verdict"), (F.col("c_nationkey") / 25.0).alias("sure"))
    return t.select("id", names.domain_conflict(F.col("a"), F.col("b")).alias("conflict"), names.identity_confirmed(F.lit(True), F.col("a"), F.col("b"), F.col("verdict"), F.col("sure")).alias("confirmed"))


@query("select t.rtype, cast(n.nudge as double) as nudge, cast(greatest(case when t.rtype = 'co_mention' then 14.0 else cost end - nudge, below + 0.5) as double) as cost from (values ('cofounder', 1.0, 0.0), ('board_member', 2.0, 1.0), ('colleague', 3.0, 2.0), ('shared_portfolio', 4.5, 3.0), ('co_speaker', 7.0, 4.5), ('co_mention', 14.0, 7.0)) t(rtype, cost, below), (values (0.0), (0.4), (2.0), (9.0)) n(nudge)")
def nudged_costs(s, d):
    types = s.createDataFrame([(t,) for t in ("cofounder", "board_member", "colleague", "shared_portfolio", "co_speaker", "co_mention")], "rtype string")
    nudges = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.4, 2.0, 9.0)])).alias("nudge")
    return types.select("rtype", nudges).select("rtype", "nudge", taxonomy.adjusted_cost(F.col("rtype"), F.col("nudge")).alias("cost"))


# -- pages --------------------------------------------------------------------------------------

_PATHS = ["team", "our-team/ana", "portfolio", "portfolio/acme", "blog/team", "", "about", "companies"]


@query("select p_partkey as id, p_size % 5 > 0 and p_partkey % 8 in (0, 1) as roster, p_size % 5 > 0 and p_partkey % 8 in (2, 7) as portfolio, p_size % 5 = 0 as blocked, 'https://t.com/' || p_partkey as target, case p_size % 3 when 0 then 'http://e/' || p_partkey when 1 then 'http://f/' || p_partkey else 'show' end as episode from part")
def page_kinds(s, d):
    step = F.element_at(F.array(*[F.lit(x) for x in _PATHS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    url = F.concat(F.lit("https://www."), F.when(F.col("p_size") % 5 == 0, "linkedin.com").otherwise("acme.org"), F.lit("/"), step)
    wrapped = F.concat(F.lit("https://duck.example/l/?uddg=https%3A%2F%2Ft.com%2F"), "p_partkey", F.lit("&rut=1"))
    link, sound = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("http://e/"), "p_partkey")), F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("http://f/"), "p_partkey", F.lit(".mp3?x=1")))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), urls.is_roster_url(url).alias("roster"), urls.is_portfolio_url(url).alias("portfolio"), urls.is_blocked_news(url).alias("blocked"), urls.unwrapped(wrapped).alias("target"), urls.episode_url(link, sound, F.lit("show")).alias("episode"))


@query("select p_partkey as id, case p_size % 3 when 0 then p_name else 'acme' end as firm, p_size % 3 <> 0 or p_partkey % 2 = 0 as own from part where p_partkey < 2000".replace("where p_partkey < 2000", ""))
def page_firms(s, d):
    stem = F.when(F.col("p_size") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise("acme")
    url = F.concat(F.lit("https://"), stem, F.lit(".com/team"))
    title = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Ana Roe | "), "p_name", F.lit(" - Team"))).otherwise("A team of good humans")
    firm = F.when(F.col("p_size") % 3 == 0, F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(", Inc."))).otherwise(F.concat("p_name", F.lit(" north")))).otherwise("Acme Capital")
    declared = urls.firm_name(title, url)
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.lower(declared).alias("firm"), urls.is_page_of(firm, url, declared).alias("own"))


_TAG = "script|style|noscript|nav|header|footer|form|svg|iframe|template|aside|button"


@query(f"""with b as (select page_id, {"regexp_replace(" * 12}html{"".join(f", '(?is)<{t}[^>]*>.*?</{t}>', ' ', 'g')" for t in _TAG.split('|'))} as t from pages), e as (select page_id, unnest(string_split_regex(t, '<[^>]+>')) as x, generate_subscripts(string_split_regex(t, '<[^>]+>'), 1) as i from b),
n as (select page_id, i, trim(regexp_replace(x, '\\s+', ' ', 'g')) as x from e), f as (select page_id, x, min(i) as i from n where x <> '' and length(x) <= 80 group by 1, 2) select page_id, row_number() over (partition by page_id order by i) - 1 as pos, x as block from f""".replace("\\\\", "\\"))
def page_blocks(s, d):
    return table(s, d, "pages").select("page_id", F.posexplode(urls.blocks(F.col("html"))).alias("pos", "block")).withColumn("pos", F.col("pos").cast("long"))


# -- shows --------------------------------------------------------------------------------------

_G, _H = _person("l_suppkey * 5 + l_linenumber"), _person("l_orderkey % 30")
#: Title and description of an episode by line quantity modulo 6, and what asserts the guest.
_TITLES = ["concat('Growth with ', {g}, ' from Acme (Storm Ventures)')", "concat({g}, ' on Markets')", "concat('Talk | ', {g}, ' | Ep. ', cast(l_linenumber as varchar(9)))", "concat({g}, ' and the Markets')", "concat('#', cast(l_linenumber as varchar(9)), ' - ', {g})", "'Markets'"]
_DESCS = ["''", "concat('<p>', {g}, ' is the CEO of Alpha Labs.</p>')", "''", "concat('An agenda for today. Later ', {g}, ' is discussed')", "concat({g}, ' runs Beta Group and more.')", "concat({g}, ' is new')"]


def _pick(values) -> str:
    return "case cast(l_quantity as bigint) % 6 " + " ".join(f"when {i} then {v.format(g=_G)}" for i, v in enumerate(values)) + " end"


_ITEMS = f"select feed_id, pos, min(title) as title, min(descr) as description, min(guest) as g, min(kind) as kind from (select l_orderkey % 30 as feed_id, l_orderkey * 10 + l_linenumber as pos, {_pick(_TITLES)} as title, {_pick(_DESCS)} as descr, {_G} as guest, cast(l_quantity as bigint) % 6 as kind from lineitem where l_partkey % 8 = 0) x group by feed_id, pos having count(*) = 1"
_HOSTED = f"it as ({_ITEMS}), ep as (select *, {_key('g')} as key, {_key(_person('feed_id'))} as host from it where feed_id % 5 <> 0)"


def _items(s: SparkSession, d: str) -> DataFrame:
    rows = s.sql(_ITEMS.replace("from lineitem", "from {l}"), l=table(s, d, "lineitem"))
    author = F.when(F.col("feed_id") % 5 == 0, "Acme Talks").otherwise(F.expr(_person("feed_id")))
    return rows.select("feed_id", F.when(F.col("feed_id") % 5 == 0, "Acme Talks: daily").otherwise("Markets daily").alias("show"), author.alias("author"), "pos", "title", "description")


_USES = "uses as (select feed_id, count(*) filter (kind = 2) >= 3 and count(*) filter (kind = 2) >= 0.3 * count(*) as slot from it group by feed_id)"


@query(f"""with {_HOSTED}, {_USES}, f as (select ep.* from ep join uses using (feed_id) where kind in (0, 1, 4) or kind = 2 and slot), k as (select *, row_number() over (partition by feed_id, key order by pos) as k from f where key <> host)
select feed_id, pos, g as guest, key, case when kind = 0 then 'Storm Ventures' else '' end as org from k where k = 1""")
def episode_guests(s, d):
    return episodes.episodes(_items(s, d), most=1 << 60)


@query(f"""with {_HOSTED}, sj as (select distinct {_person('c_custkey')} as subject, c_custkey % 3 as w from customer where c_custkey < 42), j as (select subject, ep.*, row_number() over (partition by subject, feed_id, title order by pos) as k from sj join ep on ep.key = {_key('subject')} where ep.key <> host and kind in (0, 1, 4) and (w = 0 or w = 1 and kind = 1 or w = 2 and kind = 0)),
r as (select *, row_number() over (partition by subject order by feed_id, pos) as r from j where k = 1) select subject, feed_id, pos, {_person('feed_id')} as host, case when kind = 0 then 'Storm Ventures' else '' end as org from r where r <= 6""")
def guest_appearances(s, d):
    org = F.expr("case c_custkey % 3 when 1 then array('Alpha Labs') when 2 then array('Storm Capital') else array() end")
    subjects = table(s, d, "customer").where("c_custkey < 42").select(F.expr(_person("c_custkey")).alias("name"), org.cast("array<string>").alias("orgs"))
    return episodes.appearances(subjects, _items(s, d))


@query('''with f as (select s_suppkey % 4 as t, s_suppkey as pos, 'rss' || (s_suppkey % 60) as rss, s_name as "show" from supplier where s_suppkey % 3 <> 0 and s_nationkey % 6 <> 0), k as (select *, row_number() over (partition by rss order by t, pos) as k from f), r as (select rss, "show", row_number() over (order by t, pos, rss) as n from k where k = 1) select n, rss, "show" from r where n <= 30''')
def human_feeds(s, d):
    author = F.when(F.col("s_suppkey") % 3 == 0, "Acme Media").otherwise("Ana Roe & Tim Poe")
    rss = F.when(F.col("s_nationkey") % 6 != 0, F.concat(F.lit("rss"), F.col("s_suppkey") % 60))
    return episodes.human_feeds(table(s, d, "supplier").select((F.col("s_suppkey") % 4).alias("term_pos"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("show"), rss.alias("rss"), author.alias("author")))


@query(f"with h as (select s_suppkey as id, case s_suppkey % 4 when 0 then '' when 1 then 'Ana Roe' when 2 then 'Ana Roe|Tim Poe' else {_person('s_suppkey')} end as hosts from supplier) select * from h")
def show_hosts(s, d):
    author = F.expr(f"case s_suppkey % 4 when 0 then 'Markets Daily' when 1 then 'Ana Roe, CEO' when 2 then 'Ana Roe & Tim Poe and Timothy Poe' else {_person('s_suppkey')} end")
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array_join(episodes.hosts(author, F.lit("Markets Daily: the show")), "|").alias("hosts"))


# -- announcements ------------------------------------------------------------------------------

_NEWS = """concat('Blue', cast(p_partkey as varchar(9)), ' raises $', cast(p_size as varchar(9)), 'M in a round ', case p_size % 4 when 0 then 'led by Acme Ventures, with participation from North Fund and Lund Capital. More.' when 1 then 'that people discuss.'
  when 2 then 'for all. Storm Ventures led the seed round with participation from Ana Roe and North Fund' else concat('led by Acme Ventures. ', repeat('Filler words here. ', 40), 'Others were backed by Lund Capital; ', repeat('Filler words here. ', 40), 'joined by North Fund.') end)"""


@query("""select p_partkey as id, 'Blue' || p_partkey as company, '$' || p_size || 'M' as amount, case p_size % 4 when 0 then 'Acme Ventures|North Fund|Lund Capital' else 'Storm Ventures|North Fund' end as investors from part where p_size % 4 in (0, 2)""")
def announced_rounds(s, d):
    # few bytes make many texts: rows are dealt before they are made, so that more than a task or two reads them
    rows = table(s, d, "part").select("p_partkey", "p_size").repartition("p_partkey")
    found = funding.rounds(rows.selectExpr("p_partkey as id", f"{_NEWS} as text"))
    return found.select("id", "company", "amount", F.array_join("investors", "|").alias("investors"))


@query("""with r as (select p_partkey as id, p_brand as company_key, p_size % 4 as kind from part where p_size % 4 in (0, 2)), k as (select *, row_number() over (partition by id % 2 order by id) as k from r where kind = 0 or id % 2 = 1)
select case id % 2 when 0 then 'lund capital' else 'north fund' end as firm, id from k where k <= 5""")
def rounds_of_firms(s, d):
    texts = table(s, d, "part").selectExpr("p_partkey as id", f"{_NEWS} as text", "case p_partkey % 2 when 0 then 'lund capital' else 'north fund' end as firm")
    found = funding.rounds(texts, "firm").join(texts.select("id", "firm"), "id").select("firm", "id", F.col("id").alias("pos"), F.col("id").cast("string").alias("url"), "keys")
    return funding.rounds_of_firms(found).select("firm", "id")


@query("""with r as (select p_partkey as id, p_brand as company_key, p_size % 4 = 0 as named from part where p_size % 4 in (0, 2)), k as (select *, row_number() over (partition by company_key order by not named, id) as k from r) select company_key, id, named from k where k = 1""")
def round_of_company(s, d):
    texts = table(s, d, "part").selectExpr("p_partkey as id", f"{_NEWS} as text", "p_brand as company_key")
    found = funding.rounds(texts).join(texts.select("id", "company_key"), "id").select("company_key", F.lit("lund capital").alias("firm"), "id", F.col("id").alias("pos"), F.col("id").cast("string").alias("url"), "keys")
    return funding.round_of_company(found).select("company_key", "id", F.array_contains("keys", "lund capital").alias("named"))


_B = _person("c_custkey * 11 + 1")


@query(f"""with c as (select c_custkey % 40 as subject_n, c_custkey as pos, {_person('c_custkey * 5 + 1')} as b from customer where c_custkey < 400), p as (select *, {_person('subject_n')} as subject, row_number() over (partition by {_person('subject_n')} order by pos) as k from c),
f as (select subject, pos, b, k, row_number() over (partition by subject, {_key('b')} order by k) as n from p where k <= 4 and not exists (select 1 from (select unnest(string_split({_key('b')}, ' ')) as w) x join (select unnest(string_split({_key('subject')}, ' ')) as w) y using (w)))
select subject, b as name, pos as page_id, 'met ' || b || ' there.' as evidence from f where n = 1""")
def co_mentioned_people(s, d):
    t = table(s, d, "customer").where("c_custkey < 400").selectExpr(f"{_person('c_custkey % 40')} as subject", "c_custkey as pos", "c_custkey as page_id", f"concat('met ', {_person('c_custkey * 5 + 1')}, ' there.') as text")
    return episodes.co_mentions(t)


# -- audits -------------------------------------------------------------------------------------


@query(f"select c_custkey as id, {_RAW} as name from customer where c_custkey % 5 > 0 and {_shape([str(x).lower() for _, _, x in _SHAPES])}")
def role_nodes(s, d):
    return audit.role_nodes(table(s, d, "customer").selectExpr("c_custkey as id", f"{_RAW} as name", "case when c_custkey % 5 = 0 then 'Q1' end as qid"))


@query(f"with {_ADJ} select c_custkey as id, {_RAW} as name from customer left join dg on dg.id = c_custkey where c_custkey % 12 = 4 or c_custkey % 9 = 0 and coalesce(degree, 0) >= 2")
def org_nodes(s, d):
    p = table(s, d, "customer").selectExpr("c_custkey as id", f"{_RAW} as name")
    from kithgraph.plans import graph

    kinds = p.select("id", F.when(F.col("id") % 9 == 0, "Business").otherwise("Human").alias("kind"))
    return audit.org_nodes(p, graph.degrees(roster_adj(s, d)), kinds)


@query(f"with {_CLIQUES} select * from cl where a % 7 <> 0 and b % 7 <> 0")
def purged_ties(s, d):
    bad = view(s, d, "people").where("id % 7 = 0").select("id")
    return audit.purge(roster_ties(s, d), bad, "a", "b").select("org", "a", "b", "rtype")


@query(f"with {_CLIQUES}, pr as (select id as x, id + 1 as y from people union all select id + 1, id from people) select distinct x, y from pr join cl on cl.a = least(x, y) and cl.b = greatest(x, y)")
def tied_pairs(s, d):
    p = view(s, d, "people")
    pairs = p.select(F.col("id").alias("x"), (F.col("id") + 1).alias("y")).unionByName(p.select((F.col("id") + 1).alias("x"), F.col("id").alias("y")))
    return edges.has_edge(pairs, roster_ties(s, d))


@query("""with e as (select user_id % 40 as g, event_id as seq, event_type, value from events) select 'n' || g as norm_name, lower('E' || g) as email, array_to_string(list_sort(list(distinct event_type)), ',') as companies, array_to_string(list_sort(list(distinct cast(seq % 3 as varchar))), ',') as titles,
'u' || min(case when seq % 4 = 0 then seq end) as linkedin_url from e group by g""")
def merged_profiles(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 40).alias("g"), F.col("event_id").alias("seq"), "event_type")
    rows = e.select(F.concat(F.lit("n"), "g").alias("norm_name"), F.concat(F.lit("E"), "g").alias("email"), "seq", F.array("event_type").alias("companies"), F.array((F.col("seq") % 3).cast("string")).alias("titles"), F.when(F.col("seq") % 4 == 0, F.concat(F.lit("u"), "seq")).alias("linkedin_url"))
    return resolve.merged_profiles(rows).withColumns({c: F.array_join(c, ",") for c in ("companies", "titles")})


# -- limiters -----------------------------------------------------------------------------------

_LOG = "e as (select user_id as provider, event_id as seq, epoch_us(ts) as us, event_type <> 'error' as ok, row_number() over (partition by user_id order by ts, event_id) as i from events)"


@query(f"""with recursive {_LOG}, b as (select provider, seq, us, i, cast(3.0 as double) as held from e where i = 1 union all
select e.provider, e.seq, e.us, e.i, least(cast(3.0 as double), case when b.held >= 1 then b.held - 1 else b.held end + (e.us - b.us) / cast(1000000.0 as double) * (cast(1.0 as double) / 7200)) from b join e on e.provider = b.provider and e.i = b.i + 1) select provider, seq, held >= 1 as allowed from b""")
def token_bucket(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("provider"))
    return stateful.token_bucket(e, 1 / 7200, 3.0)


@query(f"""with recursive {_LOG}, b as (select provider, seq, us, i, 'closed' as state, case when ok then 0 else 1 end as fails, cast(null as bigint) as opened from e where i = 1 union all
select provider, seq, us, i, state, case when state = 'open' then fails when ok then 0 else fails + 1 end, case when state = 'open' then opened when ok then null when fails + 1 >= 2 or state = 'half_open' then us else opened end
from (select e.provider, e.seq, e.us, e.i, e.ok, b.fails, b.opened, case when b.opened is null then 'closed' when e.us - b.opened >= 86400000000 then 'half_open' else 'open' end as state from b join e on e.provider = b.provider and e.i = b.i + 1) x) select provider, seq, state from b""")
def circuit_breaker(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("provider"), (F.col("event_type") != "error").alias("ok"))
    return stateful.breaker(e, 2, 86400.0)


@query("""with m as (select user_id as provider, strftime(ts, '%Y-%m') as month, count(*) as used, bool_or(event_type = 'error' and event_id % 40 = 0) as refused from events group by 1, 2)
select provider, month, used, greatest(0, 20 - used) as remaining, case when provider % 10 = 0 then 'not_configured' when refused then 'invalid_key' when used >= 20 then 'exhausted' else 'ok' end as state from m""")
def quota_states(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("provider"), "ts", ((F.col("event_type") == "error") & (F.col("event_id") % 40 == 0)).alias("refused"))
    keys = e.select("provider").distinct().where("provider % 10 <> 0")
    return stateful.quota_states(e, keys, 20)


@query("""with e as (select user_id % 20 as owner, user_id as job, event_id as seq, ts, event_type from events), k as (select owner, job, seq, row_number() over (partition by owner order by ts desc, seq desc) as k from e where event_type = 'click')
select owner, seq from k where k <= 32 and not exists (select 1 from e p where p.owner = k.owner and p.event_type = 'purchase' and p.seq = k.seq + 1)""")
def open_jobs(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 20).alias("owner"), F.col("event_id").alias("seq"), "ts", "event_type")
    taken = e.where("event_type = 'purchase'").select("owner", (F.col("seq") - 1).alias("seq"))
    return stateful.open_jobs(e.where("event_type = 'click'"), taken).select("owner", "seq")


@query("select user_id as provider, count(*) filter (event_type in ('view', 'error')) as calls, count(*) filter (event_type = 'click') as hits, count(*) filter (event_type = 'signup') as misses, count(*) filter (event_type = 'purchase') as trips, round(avg(value) filter (event_type in ('view', 'error')), 3) as avg_latency, round(coalesce(sum(value) filter (event_type in ('view', 'error')), 0), 2) as total_latency from events group by 1")
def recorded_stats(s, d):
    kind = F.expr("case event_type when 'click' then 'hit' when 'signup' then 'miss' when 'purchase' then 'trip' else 'call' end")
    return stateful.recorded_stats(table(s, d, "events").select(F.col("user_id").alias("provider"), kind.alias("kind"), F.col("value").alias("latency")))
