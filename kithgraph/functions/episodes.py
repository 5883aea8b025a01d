"""Guests of podcast episodes, shows and their hosts, and people named on pages, from titles and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kithgraph.functions import names

_NAME = "\\p{Lu}[\\p{L}'-]+(?: \\p{Lu}[\\p{L}'.-]*){1,3}"
# What introduces a guest, numbers an episode, or opens a biography (fixed values).
_WITH = "(?i)\\b(?:with|feat\\.?|ft\\.?|featuring)\\s+(.+)$"
_NUMBERED = "(?i)\\b(?:ep|eps|episode)\\b\\.?:?\\s*\\d+"
_MARKER = "(?i)^\\s*(?:(?:ep|eps|episode|pt|part|s\\d+e\\d+|season)\\b[\\s.:#-]*\\d*|[\\d\\s.#-]+)\\s*$"
_BIO = "(?:is|was|serves\\s+as|joins|co-?founded|founded|leads|runs)"
_LEAD, _OFFSET = 240, 40
GENERIC_ORG_WORDS = ["ventures", "capital", "partners", "fund", "group", "holdings", "company", "corporation", "incorporated", "limited", "management", "technologies", "labs"]
_EDGES = " .,-–—|"


def _strip(text: Column) -> Column:
    return F.trim(text, F.lit(_EDGES))


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "), "\\s+", " "))


def hosts(author: Column, show: Column) -> Column:
    """People among the author's parts; none if the author is how the show's name begins."""
    parts = F.filter(F.transform(F.split(F.coalesce(author, F.lit("")), "\\s*(?:&|,| and )\\s*"), lambda x: F.trim(x)), names.is_person)
    keyed = F.transform(parts, lambda p: F.struct(names.person_key(p).alias("key"), p.alias("name")))
    once = F.filter(keyed, lambda x, i: F.array_position(F.transform(keyed, lambda y: y["key"]), x["key"]) == i + 1)
    brand = (names.normalize(author) != "") & F.startswith(names.normalize(show), names.normalize(author))
    return F.when(brand, F.array().cast("array<string>")).otherwise(F.transform(once, lambda x: x["name"]))


def title_org(title: Column) -> Column:
    """The last short parenthesis that is neither a person nor a guest clause: the guest's organisation."""
    inner = F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("\\(([^)]*)\\)"), 1), lambda x: F.trim(x))
    good = F.filter(inner, lambda x: (x != "") & ~x.rlike(_WITH) & ~names.is_person(x) & (F.size(F.split(x, "\\s+")) <= 4))
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.lit(""))


def title_without_parentheses(title: Column) -> Column:
    return F.regexp_replace(F.trim(title), "\\([^)]*\\)", " ")


def title_flat(title: Column) -> Column:
    """The title with what is in parentheses, without the parentheses."""
    return F.trim(F.regexp_replace(F.translate(title, "()", "  "), "\\s+", " "))


def guest_by_marker(title: Column) -> Column:
    after = F.regexp_extract(title_flat(F.coalesce(title, F.lit(""))), _WITH, 1)
    name = _strip(F.get(F.split(after, "\\s*(?:,| from | at | of | on )\\s*"), 0))
    return F.when(names.is_person(name), name)


def guest_by_template(title: Column) -> Column:
    """The first part of a numbered title that is a person."""
    parts = F.transform(F.split(title_without_parentheses(F.coalesce(title, F.lit(""))), "[:|]"), _strip)
    found = F.filter(parts, lambda x: (x != "") & ~x.rlike(_MARKER) & names.is_person(x))
    return F.when(title.rlike(_NUMBERED), F.try_element_at(found, F.lit(1)))


def guest_by_bio(title: Column, description: Column) -> Column:
    """A person of the title whom the description introduces at its start, else one who opens it and is in the title."""
    lead = F.substring(plain(description), 1, _LEAD)
    slots = F.transform(F.split(title_without_parentheses(F.coalesce(title, F.lit(""))), "[:|]"), lambda x: _strip(F.get(F.split(F.trim(x), "\\s+on\\s+"), 0)))
    told = lambda x: F.regexp_instr(lead, F.concat(F.lit("(?i)\\b\\Q"), x, F.lit(f"\\E\\b\\s+{_BIO}\\b")))
    named = F.filter(slots, lambda x: (x != "") & names.is_person(x) & told(x).between(1, _OFFSET + 1))
    opening = F.regexp_extract(lead, f"^\\s*(?:\\S+\\s+){{0,3}}?([A-Z][\\w.'-]+(?:\\s+[A-Z][\\w.'-]+){{1,3}})\\s+{_BIO}\\b", 1)
    opens = F.when(names.is_person(opening) & F.contains(names.normalize(title_flat(F.coalesce(title, F.lit("")))), names.normalize(opening)), opening)
    return F.coalesce(F.try_element_at(named, F.lit(1)), opens)


def episodes(items: DataFrame, most: int = 300, least_hits: int = 3, share: float = 0.3) -> DataFrame:
    """feed, pos, guest, key, org of episodes that name a guest: feed_id, show, author, pos, title, description.

    The slot template counts only in feeds that use it often enough; a feed without human hosts has no
    guests; each guest counts once in a feed, where first seen.
    """
    rows = items.where(F.col("pos") <= most).withColumn("hosts", hosts(F.col("author"), F.col("show"))).withColumn("slot", guest_by_template(F.col("title")))
    feed = W.partitionBy("feed_id")
    uses = (F.count("slot").over(feed) >= least_hits) & (F.count("slot").over(feed) >= share * F.count(F.lit(1)).over(feed))
    guest = F.coalesce(guest_by_marker(F.col("title")), guest_by_bio(F.col("title"), F.col("description")), F.when(uses, F.col("slot")))
    found = rows.withColumn("guest", guest).where("guest is not null and size(hosts) > 0")
    found = found.withColumn("key", names.person_key(F.col("guest"))).where(~F.array_contains(F.transform("hosts", names.person_key), F.col("key")))
    first = F.row_number().over(W.partitionBy("feed_id", "key").orderBy("pos"))
    return found.withColumn("k", first).where("k = 1").select("feed_id", "pos", "guest", "key", title_org(F.col("title")).alias("org"))


def appearances(subjects: DataFrame, items: DataFrame, most: int = 6) -> DataFrame:
    """(subject, feed_id, pos, host, org): episodes that a subject is a guest of, one row for each host.

    subjects: name, orgs (array). items: as of ``episodes``. The episode must assert the guest (by a clause or a
    biography, not by a slot); someone who hosts the show is no guest; where organisations of the subject are
    known, a telling word of one must be in the title or the description.
    """
    words = F.array_distinct(F.flatten(F.transform("orgs", lambda o: names.distinctive_tokens(o, GENERIC_ORG_WORDS, 3))))
    mine = subjects.select(F.col("name").alias("subject"), names.person_key(F.col("name")).alias("key"), F.coalesce(words, F.array().cast("array<string>")).alias("words")).where("key <> ''")
    guest = F.coalesce(guest_by_marker(F.col("title")), guest_by_bio(F.col("title"), F.col("description")))
    told = items.withColumn("hosts", hosts(F.col("author"), F.col("show"))).where("size(hosts) > 0").withColumn("guest", guest).where("guest is not null")
    told = told.withColumn("key", names.person_key(F.col("guest"))).withColumn("hay", names.normalize(F.concat_ws(" ", "title", plain(F.col("description")))))
    rows = mine.join(told, "key").where(~F.array_contains(F.transform("hosts", names.person_key), F.col("key")))
    rows = rows.where((F.size("words") == 0) | F.exists("words", lambda w: F.contains(F.col("hay"), w)))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("subject", "feed_id", "title").orderBy("pos"))).where("k = 1")
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("subject").orderBy("feed_id", "pos"))).where(F.col("k") <= most)
    return rows.select("subject", "feed_id", "pos", F.explode("hosts").alias("host"), title_org(F.col("title")).alias("org"))


def human_feeds(found: DataFrame, most: int = 30) -> DataFrame:
    """The first ``most`` feeds with a human host, each once: n, rss, show. found: term_pos, pos, show, rss, author."""
    rows = found.where((F.coalesce("rss", F.lit("")) != "") & (F.size(hosts(F.col("author"), F.col("show"))) > 0))
    one = rows.groupBy("rss").agg(F.min(F.struct("term_pos", "pos", "show")).alias("f"))
    top = one.orderBy("f.term_pos", "f.pos", "rss").limit(most)  # at most ``most`` rows
    return top.select(F.row_number().over(W.orderBy("f.term_pos", "f.pos", "rss")).alias("n"), "rss", F.col("f.show").alias("show"))


def co_mentions(pages: DataFrame, most_pages: int = 4, most_people: int = 25) -> DataFrame:
    """subject, name, page_id, evidence of people named on the subject's first pages: subject, pos, page_id, text."""
    own = W.partitionBy("subject").orderBy("pos", "page_id")
    rows = pages.where("trim(text) <> ''").withColumn("k", F.row_number().over(own)).where(F.col("k") <= most_pages)
    found = rows.select("subject", "page_id", "k", "text", F.posexplode(F.regexp_extract_all("text", F.lit(f"({_NAME})"), 1)).alias("at", "name"))
    found = found.where(names.is_clean_person(F.col("name"), F.col("subject"))).withColumn("key", names.person_key(F.col("name")))
    found = found.withColumn("n", F.row_number().over(W.partitionBy("subject", "key").orderBy("k", "at"))).where("n = 1")
    found = found.withColumn("n", F.row_number().over(W.partitionBy("subject").orderBy("k", "at"))).where(F.col("n") <= most_people)
    return found.select("subject", "name", "page_id", names.evidence_window(F.col("text"), F.col("name")).alias("evidence"))
