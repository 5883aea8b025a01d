"""Names of people and organisations, as Column expressions: normal forms, keys, and gates that keep noise out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kithgraph.functions.vocabulary import DOMAINS, EMBEDDED_TITLES, JOB_WORDS, LEGAL_SUFFIXES, NICKNAMES, NOISE_PHRASES, NOISE_TOKENS, ORG_SUFFIXES, ROLES, STOPWORDS


def array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normalize(s: Column) -> Column:
    """Lower case; runs of what is no letter, digit or underscore become one space. Null gives ''."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(s, F.lit("")))), "[^\\p{L}\\p{N}_\\s]", " ")
    return F.trim(F.regexp_replace(plain, "\\s+", " "))


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, " "), lambda t: t != "")


def strip_middle_initials(s: Column) -> Column:
    """Without interior words of one letter; the first and the last word stay."""
    t = F.split(F.trim(s), "\\s+")
    kept = F.filter(t, lambda x, i: (i == 0) | (i == F.size(t) - 1) | (F.length(F.rtrim(x, F.lit("."))) > 1))
    return F.when(F.size(t) <= 2, F.trim(s)).otherwise(F.array_join(kept, " "))


def person_key(s: Column) -> Column:
    """Normal form without middle initials, the first name in its long form."""
    t = F.split(normalize(strip_middle_initials(s)), " ")
    names = F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv])
    return F.array_join(F.transform(t, lambda x, i: F.when(i == 0, F.coalesce(F.try_element_at(names, x), x)).otherwise(x)), " ")


def org_key(s: Column) -> Column:
    """Normal form without the legal suffixes at its end; one token stays."""
    t = F.split(normalize(s), " ")
    last = F.array_max(F.transform(t, lambda x, i: F.when(~x.isin(*LEGAL_SUFFIXES), i + 1).otherwise(F.lit(1))))
    return F.array_join(F.slice(t, F.lit(1), F.greatest(F.lit(1), last)), " ")


def strip_roles(s: Column) -> Column:
    """Without role words at either end; interior words stay. May leave nothing."""
    t = tokens(F.regexp_replace(F.trim(F.coalesce(s, F.lit(""))), "\\s+", " "))
    own = F.transform(t, lambda x, i: F.when(~F.lower(F.regexp_replace(x, "[^\\p{L}\\p{N}_]", "")).isin(*ROLES), i + 1))
    kept = F.filter(own, lambda i: i.isNotNull())
    first, last = F.array_min(kept), F.array_max(kept)
    return F.when(F.size(kept) == 0, "").otherwise(F.array_join(F.slice(t, first, last - first + 1), " "))


def is_noise(s: Column, org_ok: bool = False) -> Column:
    """What can't be a name: markup, addresses, sentences, navigation, roles alone, titles inside, organisations (unless org_ok)."""
    text, norm = F.trim(F.coalesce(s, F.lit(""))), normalize(s)
    t, bare = tokens(norm), tokens(normalize(strip_roles(s)))
    address = F.lower(text).rlike("http|www\\.|@|\\.(com|org|net|io|ai|co|gov|edu)\\b")
    joined = text.rlike(" [-|–—·•] |•|::") | text.rlike("[,;!?…]|\\.\\.")
    shout = text.rlike("\\S\\s+\\S") & text.rlike("\\p{Lu}") & ~text.rlike("[\\p{L}&&[^\\p{Lu}]]")
    roles = F.forall(t, lambda x: x.isin(*dict.fromkeys([*JOB_WORDS, *STOPWORDS, *ROLES])))
    inside = (F.size(bare) >= 3) & F.exists(bare, lambda x: x.isin(*ROLES, *EMBEDDED_TITLES))
    out = (text == "") | address | joined | shout | ~text.rlike("[a-zA-ZÀ-ɏ]") | (norm == "") | norm.isin(*NOISE_PHRASES) | roles
    out = out | inside | F.exists(t, lambda x: x.isin(*NOISE_TOKENS))
    return out if org_ok else out | F.exists(t, lambda x: x.isin(*[w for w in ORG_SUFFIXES if w != "co"]))


def is_person(s: Column) -> Column:
    """Two to four capitalised words that are no stop or organisation words."""
    t = tokens(F.regexp_replace(F.trim(F.coalesce(s, F.lit(""))), "\\s+", " "))
    good = F.forall(t, lambda x: x.rlike("^\\p{Lu}") & (F.length(normalize(x)) >= 2) & ~normalize(x).isin(*dict.fromkeys([*STOPWORDS, *ORG_SUFFIXES])))
    return ~is_noise(s) & F.size(t).between(2, 4) & good


def org_type(s: Column) -> Column:
    """By the last word that names a kind of organisation."""
    kinds = F.create_map(*[F.lit(x) for kv in ORG_SUFFIXES.items() for x in kv])
    known = F.filter(F.transform(F.reverse(tokens(normalize(s))), lambda x: F.try_element_at(kinds, x)), lambda k: k.isNotNull())
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("unknown"))


def is_org(s: Column) -> Column:
    return F.arrays_overlap(tokens(normalize(s)), array(ORG_SUFFIXES))


def variants(s: Column) -> Column:
    return F.array_distinct(F.array(F.trim(s), strip_middle_initials(F.trim(s))))


def search_variants(s: Column, limit: int = 4) -> Column:
    """The name without middle initials, then with its long and its short first names."""
    bare = strip_middle_initials(F.coalesce(s, F.lit("")))
    t = F.split(bare, "\\s+")
    rest = F.array_join(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), " ")
    longer = F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv])
    shorter: dict[str, list[str]] = {}
    for short, full in NICKNAMES.items():
        shorter.setdefault(full, []).append(short)
    short_of = F.create_map(*[c for k, v in shorter.items() for c in (F.lit(k), array(v))])
    first = normalize(F.try_element_at(t, F.lit(1)))
    none = F.array().cast("array<string>")
    other = F.concat(F.coalesce(F.array_compact(F.array(F.try_element_at(longer, first))), none), F.coalesce(F.try_element_at(short_of, first), none))
    all_ = F.slice(F.array_distinct(F.concat(F.array(bare), F.transform(other, lambda x: F.concat(F.initcap(x), F.lit(" "), rest)))), 1, limit)
    return F.when(bare == "", none).when(F.size(t) < 2, F.array(bare)).otherwise(all_)


def distinctive_tokens(s: Column, generic: Iterable[str] = tuple(ORG_SUFFIXES), longer_than: int = 3) -> Column:
    return F.array_distinct(F.filter(tokens(normalize(s)), lambda x: (F.length(x) > longer_than) & ~x.isin(*generic)))


def evidence_window(text: Column, needle: Column, radius: int = 160) -> Column:
    """The text around the first hit, spaces collapsed; '' if there is none."""
    at = F.instr(text, needle)
    start = F.greatest(F.lit(1), at - radius)
    return F.when(at > 0, F.trim(F.regexp_replace(F.substring(text, start, at - start + F.length(needle) + radius), "\\s+", " "))).otherwise("")


def is_clean_person(s: Column, subject: Column) -> Column:
    """A person other than the subject: plain letters, two or more words, none repeated or shared."""
    t, other = tokens(person_key(s)), tokens(person_key(subject))
    return is_person(s) & s.rlike("^[\\p{L} '.-]+$") & (F.size(t) >= 2) & (F.size(F.array_distinct(t)) == F.size(t)) & ~F.arrays_overlap(t, other)


def queue_noise(s: Column) -> Column:
    n = F.size(tokens(F.trim(F.coalesce(s, F.lit("")))))
    return is_noise(s) | (n < 2) | (n > 6) | F.coalesce(s, F.lit("")).rlike("[#@_\\x{1F300}-\\x{1FAFF}]|(?i)\\b(official|fan|club|shop|studio)\\b")


def filing_cik(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, "\\(CIK (\\d{10})\\)", 1), F.lit(""))


def ellipsis(s: Column, width: int) -> Column:
    return F.when(F.length(s) <= width, s).otherwise(F.concat(F.substring(s, 1, width - 1), F.lit("…")))


def short_key(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("||", *parts).cast("binary")), 1, 16)


def is_qid(s: Column) -> Column:
    return F.coalesce(s, F.lit("")).rlike("^Q\\d+$")


def as_list(cell: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), "[;|]"), lambda x: F.trim(x)), lambda x: x != "")


def domains_of(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(f"\\b({'|'.join(words)})\\b"), F.lit(d)) for d, words in DOMAINS.items()]))


def domain_conflict(signal: Column, candidate: Column) -> Column:
    a, b = domains_of(signal), domains_of(candidate)
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def identity_confirmed(target: Column, signal: Column, candidate: Column, verdict: Column, confidence: Column, reject_at: float = 0.6) -> Column:
    """Open where there is nothing to compare; closed on a confident 'different' or on disjoint subject areas."""
    blank = ~F.coalesce(target, F.lit(False)) | (F.trim(F.coalesce(signal, F.lit(""))) == "") | (F.trim(F.coalesce(candidate, F.lit(""))) == "")
    other = (F.coalesce(verdict, F.lit("")) == "different") & (F.coalesce(confidence, F.lit(0.0)) >= reject_at)
    return blank | ~(other | domain_conflict(signal, candidate))
