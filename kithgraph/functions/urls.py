"""URLs and HTML as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kithgraph.functions import names

# Path hints and hosts (fixed values).
ROSTER_HINTS = ["team", "people", "our-team", "ourteam", "partners", "staff", "leadership", "who-we-are", "whoweare", "members", "our-firm", "ourfirm", "crew", "humans"]
NOT_ROSTER = ["portfolio", "blog", "post", "news", "careers", "jobs", "contact", "privacy", "terms", "press", "insights", "cask", "formula", "wiki", "forum", "comments"]
PORTFOLIO_HINTS = ["portfolio", "companies", "investments"]
BLOCKED_HOSTS = ["linkedin.com", "twitter.com", "x.com", "facebook.com", "crunchbase.com", "pitchbook.com", "dealroom.co", "f6s.com", "reddit.com", "wikipedia.org", "medium.com", "youtube.com", "signal.nfx.com", "app.dealroom.co"]
BLOCKED_NEWS = ["zoominfo.com", "tracxn.com", "linkedin.com", "instagram.com", "x.com", "twitter.com", "facebook.com", "crunchbase.com", "pitchbook.com", "dealroom.co", "cbinsights.com", "owler.com", "youtube.com", "reddit.com", "wikipedia.org", "parsers.vc", "signal.nfx.com", "f6s.com", "golden.com"]
GENERIC_FIRM_WORDS = ["ventures", "capital", "partners", "fund", "funds", "group", "management", "the", "and", "vc", "llc", "lp"]
TLD_WORDS = ["co", "com", "vc", "io", "ai", "net", "org", "fund", "capital"]
DROPPED_TAGS = "script|style|noscript|nav|header|footer|form|svg|iframe|template|aside|button"


def host(url: Column) -> Column:
    """Lower case, without a leading 'www.'."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), "^www\\.", "")


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def _steps(url: Column) -> Column:
    return F.filter(F.split(F.lower(path(url)), "/"), lambda x: x != "")


def path_depth(url: Column) -> Column:
    return F.size(_steps(url))


def _any_of(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(w.replace(".", "\\.") for w in words))


def is_blocked(url: Column) -> Column:
    """Aggregators and social sites: real pages, but never a firm's own."""
    return _any_of(host(url), BLOCKED_HOSTS)


def is_roster_url(url: Column) -> Column:
    low = F.lower(path(url))
    return ~is_blocked(url) & (F.size(_steps(url)) > 0) & ~_any_of(low, NOT_ROSTER) & _any_of(low, ROSTER_HINTS)


def is_portfolio_url(url: Column) -> Column:
    """The list itself: a hint in the last step. One company's page lies below it."""
    return ~is_blocked(url) & F.coalesce(_any_of(F.try_element_at(_steps(url), F.lit(-1)), PORTFOLIO_HINTS), F.lit(False))


def domain_stem(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(host(url), ".", 1), "[^a-z0-9]", "")


def is_blocked_news(url: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit(""))).rlike("|".join(h.replace(".", "\\.") for h in BLOCKED_NEWS))


def unwrapped(url: Column, parameter: str = "uddg") -> Column:
    """The target that a redirect carries in a parameter, else the URL."""
    return F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(parameter))), url)


def episode_url(link: Column, enclosure: Column, fallback: Column) -> Column:
    clean = F.regexp_replace(enclosure, "\\.(mp3|m4a|wav|ogg)(\\?.*)?$", "")
    return F.coalesce(F.nullif(F.trim(link), F.lit("")), F.nullif(F.trim(clean), F.lit("")), fallback)


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def text_of(html: Column, most: int = 20_000) -> Column:
    """Text without markup and without the tags that hold no prose."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), f"(?is)<({DROPPED_TAGS})[^>]*>.*?</\\1>", " ")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), "\\s+", " ")), 1, most)


def blocks(html: Column, most: int = 80) -> Column:
    """The short texts of single elements, each once, in order."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), f"(?is)<({DROPPED_TAGS})[^>]*>.*?</\\1>", " ")
    parts = F.transform(F.split(bare, "<[^>]+>"), lambda x: F.trim(F.regexp_replace(x, "\\s+", " ")))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (F.length(x) <= most)))


def anchors(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?is)<a [^>]*href=\"([^\"]*)\""), 1)


def jsonld_bodies(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>"), 1)


def firm_name(page_title: Column, url: Column) -> Column:
    """The part of the title whose letters match the domain and that is no person, else the domain itself as a title."""
    stem = domain_stem(url)

    def letters(part: Column) -> Column:
        t = names.tokens(names.normalize(part))
        last = F.array_max(F.transform(t, lambda x, i: F.when(~x.isin(*TLD_WORDS), i + 1).otherwise(1)))
        return F.array_join(F.slice(t, F.lit(1), F.greatest(F.lit(1), last)), "")

    parts = F.transform(F.split(F.coalesce(page_title, F.lit("")), "[|\\-–—:·]"), lambda x: F.struct(F.trim(x).alias("part"), letters(x).alias("letters")))
    fits = F.filter(parts, lambda x: (x["letters"] != "") & (stem != "") & (F.contains(x["letters"], stem) | F.contains(stem, x["letters"])))
    first = F.try_element_at(F.filter(F.transform(fits, lambda x: x["part"]), lambda x: ~names.is_person(x)), F.lit(1))
    shown = F.trim(F.regexp_replace(first, "(?i)\\.(co|com|vc|io|ai|net|org)$", ""), F.lit(" ."))
    return F.coalesce(F.nullif(shown, F.lit("")), first, F.initcap(stem))


def firm_words(firm: Column) -> Column:
    """The words that tell a firm from others."""
    return F.array_distinct(F.filter(names.tokens(names.normalize(firm)), lambda x: (F.length(x) > 2) & ~x.isin(*GENERIC_FIRM_WORDS)))


def is_page_of(firm: Column, url: Column, declared: Column) -> Column:
    """Whether a page is the firm's own, by identity: its domain, or the name that it gives itself (``firm_name``).

    The domain decides for firms with one telling word; others must declare their name or its initials.
    """
    words, stem = firm_words(firm), domain_stem(url)
    domain = (stem != "") & F.exists(words, lambda w: F.startswith(stem, w) | F.startswith(w, stem))
    initials = F.array_join(F.transform(names.tokens(names.normalize(firm)), lambda w: F.substring(w, 1, 1)), "")
    same = (declared != "") & ((names.org_key(declared) == names.org_key(firm)) | (F.replace(names.normalize(declared), F.lit(" "), F.lit("")) == initials))
    return (F.size(words) == 0) | (domain & (F.size(words) == 1)) | same


def unescaped(text: Column) -> Column:
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def anchor_parts(html: Column) -> Column:
    """Of each link, in order: href, alt (of its image) and text."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?is)<a\\s[^>]*>.*?</a>"), 0)
    value = lambda x, pattern: unescaped(F.trim(F.regexp_extract(x, pattern, 1)))
    return F.transform(
        tags,
        lambda x: F.struct(
            value(x, "(?is)^<a\\s[^>]*?href\\s*=\\s*[\"']([^\"']*)").alias("href"),
            value(x, "(?is)<img\\s[^>]*?alt\\s*=\\s*[\"']([^\"']*)").alias("alt"),
            unescaped(F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), "\\s+", " "))).alias("text"),
        ),
    )


def company_name(alt: Column, text: Column) -> Column:
    """The image's text, else the link's own: short, without a comma (a place), and no page word. '' if neither."""
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))
    good = F.filter(F.array(tidy(alt), tidy(text)), lambda x: (x != "") & (F.length(x) <= 48) & ~F.contains(x, F.lit(",")) & ~names.is_noise(x))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


def readable(plain: Column, rendered: Column) -> Column:
    """The plainly fetched page if it has text of its own, else the rendered one."""
    return F.when(F.size(blocks(plain)) > 0, plain).otherwise(F.coalesce(rendered, plain))
