"""Personal data replaced by made-up values of the same type.

Mail addresses, phone and card numbers, network addresses and titled names are found by one pattern.
A name is known by gender and name parts, however its title is spelled; within a text, a shorter titled
name and the name or a part of it without title belong to the first full name they fit (a word that the
text has in lower case as well is left alone). Each entity (in canonical form: lower case, digits, a
number's leading plus) gets a surrogate by a keyed hash: digits for
digits, letters of the same script for letters, names of the same gender from lists, card numbers with
the same kind of check digit, phone numbers with the same country code. Domains are entities of their own,
so that all addresses of a domain share the new one; top-level labels stay. A mention is written in its own
format and case. So that different entities stay different, the entity table is checked: of entities with
one surrogate (of persons: one surname), and of surrogates that are entities themselves, all but the first
are derived anew until none is left. One entity has one surrogate in the whole corpus.

That ends: a surname has one more syllable in each attempt, and addresses and domains one more letter from the
fifth on, so that their space outgrows any table. Numbers keep their length; a table that holds nearly all
numbers of a format is an error after ``ATTEMPTS``.

All of it is SQL functions: no Python runs on rows. Texts without an entity pass through without a
shuffle; of the others the mentions are joined with the entity table, and the texts once with the
surrogates found.

Nulls: a null text stays null and has no entities; rows with a null id, and rows that repeat, are treated
like others. Other columns are kept by ``with_surrogates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.scratch import Scratch

KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?<![\d.])\d{4}(?:[ -]?\d{4}){3}(?!\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "person": r"(?<!\p{L})(?:Mrs|Mr|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr)\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?",
}
ANY = "|".join(f"(?:{x})" for x in KINDS.values())
_TITLE = r"^(?:Mrs|Mr|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr)\.? "
#: Country codes of phone numbers; none is the start of another.
_COUNTRY = r"^[+](?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[0578]|9[679])[0-9])"
_FEMALE = r"^(?:mrs|ms|miss|frau|madame|mme|señora|sra)\b"

# Names for surrogates (fixed values).
WOMEN = ["Ada", "Bianca", "Clara", "Dora", "Elena", "Flora", "Greta", "Hanna", "Irene", "Julia", "Klara", "Laura", "Marta", "Nora", "Olga", "Paula"]
MEN = ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jakob", "Karl", "Leo", "Martin", "Nils", "Oskar", "Paul"]
FAMILIES = ["Adler", "Berger", "Conti", "Duval", "Ellis", "Fabre", "Garner", "Hansen", "Ibarra", "Jansen", "Keller", "Lopez", "Moreau", "Novak", "Olsen", "Prieto", "Quinn", "Rossi", "Sander", "Thorne", "Ulrich", "Vidal", "Weber", "Zeller"]
WOMEN_CYRILLIC = ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"]
MEN_CYRILLIC = ["Антон", "Борис", "Виктор", "Глеб", "Иван", "Михаил", "Олег", "Павел"]
FAMILIES_CYRILLIC = ["Белов", "Волков", "Громов", "Зимин", "Крылов", "Лесин", "Орлов", "Соколов"]
SYLLABLES = ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "pe", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve", "vo", "wa", "we", "za", "ze"]
SYLLABLES_CYRILLIC = ["ба", "бе", "бо", "ва", "ве", "во", "га", "го", "да", "де", "до", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "па", "пе", "по", "ра", "ре", "ро", "са", "се", "со", "та", "те", "то", "фа", "ха", "ча", "ша", "за"]
#: Times that a surrogate is derived, at most.
ATTEMPTS = 64
_ACCENTED, _CYRILLIC, _GREEK = "àáâäçèéêëìíîïñòóôöùúûü", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"


def _lit(values) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _draw(seed: str, place: str, n: str) -> str:
    return f"cast(pmod(xxhash64({seed}, {place}), {n}) as int)"


def _spelled(value: str, seed: str) -> str:
    """Each letter and digit replaced by another of its script."""
    pick = lambda pool: f"substring('{pool}', {_draw(seed, 'i', str(len(pool)))} + 1, 1)"
    return f"""array_join(transform(filter(split({value}, ''), c -> c <> ''), (c, i) -> case
      when c rlike '[0-9]' then cast({_draw(seed, 'i', '10')} as string)
      when c rlike '[a-z]' then {pick('abcdefghijklmnopqrstuvwxyz')}
      when c rlike '[\\\\p{{IsCyrillic}}]' then {pick(_CYRILLIC)}
      when c rlike '[\\\\p{{IsGreek}}]' then {pick(_GREEK)}
      when c rlike '[\\\\p{{L}}]' then {pick(_ACCENTED)} else c end), '')"""


def _luhn(digits: str, parity: int) -> str:
    """Sum of the digits of which every second, from the first that has the parity, counts double."""
    return f"""aggregate(transform(sequence(1, length({digits})), i -> case when i % 2 = {parity}
      then 2 * cast(substring({digits}, i, 1) as int) - case when cast(substring({digits}, i, 1) as int) > 4 then 9 else 0 end
      else cast(substring({digits}, i, 1) as int) end), 0, (a, b) -> a + b)"""


_DIGITS = f"array_join(transform(sequence(1, length(canon)), i -> cast({_draw('seed', 'i', '10')} as string)), '')"


def surrogate() -> Column:
    """Of columns kind, canon, seed and attempt. An address has its own domain still."""
    names = lambda latin, cyrillic, place: f"case when canon rlike '[\\\\p{{IsCyrillic}}]' then {_lit(cyrillic)}[{_draw('seed', place, str(len(cyrillic)))}] else {_lit(latin)}[{_draw('seed', place, str(len(latin)))}] end"
    first = f"case when startswith(canon, 'f ') then {names(WOMEN, WOMEN_CYRILLIC, '1')} else {names(MEN, MEN_CYRILLIC, '1')} end"
    ending = f"array_join(transform(sequence(1, 2 + attempt), i -> {names(SYLLABLES, SYLLABLES_CYRILLIC, '10 + i')}), '')"
    more = f"case when attempt < 4 then '' else array_join(transform(sequence(1, attempt - 3), i -> substring('abcdefghijklmnopqrstuvwxyz', {_draw('seed', '1000 + i', '26')} + 1, 1)), '') end"
    # after some attempts a number's country code goes, too, so that there are enough surrogates
    code = f"case when attempt < 8 then regexp_extract(canon, {_sql(_COUNTRY)}, 0) else regexp_extract(canon, '^[+]', 0) end"
    phone = f"element_at(transform(array({code}), c -> concat(c, substring({_DIGITS}, length(c) + 1))), 1)"
    card = f"element_at(transform(array({_DIGITS}), d -> case when {_luhn('canon', 1)} % 10 = 0 then concat(substring(d, 1, 15), cast((10 - {_luhn('substring(d, 1, 15)', 1)} % 10) % 10 as string)) else d end), 1)"
    return F.expr(f"""case kind
      when 'email' then concat({_spelled("element_at(split(canon, '@'), 1)", 'seed')}, {more}, '@', element_at(split(canon, '@'), 2))
      when 'domain' then concat({_spelled("regexp_replace(canon, '[.][a-z]+$', '')", 'seed')}, {more}, regexp_extract(canon, '([.][a-z]+)$', 1))
      when 'ip' then concat_ws('.', transform(sequence(1, 4), i -> cast(1 + {_draw('seed', 'i', '254')} as string)))
      when 'card' then {card}
      when 'phone' then {phone}
      else concat_ws(' ', case when size(split(canon, ' ')) > 2 then {first} end, concat({names(FAMILIES, FAMILIES_CYRILLIC, '2')}, {ending})) end""")


def _canon() -> Column:
    return F.expr("case when kind = 'card' then regexp_replace(value, '[^0-9]', '') when kind = 'phone' then regexp_replace(value, '[^0-9+]', '') when kind = 'person' then who.canon else lower(value) end")


def _named(found: str) -> str:
    """Gender and name without title of each titled name among the values found, in their order."""
    return f"""transform(filter({found}, v -> v rlike {_sql(_TITLE)}), v -> named_struct('g', case when lower(v) rlike {_sql(_FEMALE)} then 'f' else 'm' end, 'n', {_bare('v')}))"""


def _bare(value: str) -> str:
    return f"regexp_replace(regexp_replace({value}, {_sql(_TITLE)}, ''), {_sql("'s$")}, '')"


def _pattern() -> str:
    """Of columns pii_text and named: the pattern of all mentions, a text's own names without a title among them.

    A single word that the text has in lower case, too, is no name there.
    """
    low = "split(pii_text, '[^\\\\p{L}\\'-]+')"
    single = "array_distinct(flatten(transform(named, x -> split(x.n, ' '))))"
    single = f"filter({single}, w -> length(w) > 1 and not array_contains({low}, lower(w)))"
    words = f"concat(transform(filter(named, x -> contains(x.n, ' ')), x -> x.n), {single})"
    return f"case when size(named) = 0 then {_sql(ANY)} else concat({_sql(ANY)}, {_sql(r"|(?<![\p{L}\p{N}])(?:")}, array_join(array_distinct({words}), '|'), {_sql(r")(?![\p{L}\p{N}])")}) end"


def _who(value: str) -> str:
    """Of a name and the text's titled names: canon (gender and name in lower case) and which part of the name is meant.

    A single word is the first full name of the text that it is the last (without title: or first) word of.
    """
    g = f"case when not {value} rlike {_sql(_TITLE)} then '' when lower({value}) rlike {_sql(_FEMALE)} then 'f' else 'm' end"
    last, first = "element_at(split(x.n, ' '), -1)", "split(x.n, ' ')[0]"
    fits = f"filter(named, x -> x.n = q.n and q.g in ('', x.g)), filter(named, x -> not contains(q.n, ' ') and q.g in ('', x.g) and contains(x.n, ' ') and {last} = q.n), filter(named, x -> not contains(q.n, ' ') and q.g = '' and contains(x.n, ' ') and {first} = q.n)"
    full = f"element_at(transform(array(array({fits})), f -> concat(case when contains(q.n, ' ') then f[0] else f[1] end, f[2], f[0])), 1)"
    pick = f"element_at(transform(array({full}), c -> coalesce(try_element_at(c, 1), named_struct('g', q.g, 'n', q.n))), 1)"
    part = f"case when not contains(x.n, ' ') or x.n = q.n then 'all' when {last} = q.n then 'last' else 'first' end"
    return f"element_at(transform(array(named_struct('g', {g}, 'n', {_bare(value)})), q -> element_at(transform(array({pick}), x -> named_struct('canon', lower(concat(x.g, ' ', x.n)), 'part', {part})), 1)), 1)"


def _rendered() -> str:
    """Of m.kind, m.value, m.surr, m.part: the surrogate in the mention's format."""
    upto = "length(regexp_replace(substring(m.value, 1, i + 1), '[^0-9]', ''))"
    poured = f"array_join(transform(filter(split(m.value, ''), c -> c <> ''), (c, i) -> case when c rlike '[0-9]' then substring(regexp_replace(m.surr, '[+]', ''), {upto}, 1) else c end), '')"
    part = "case m.part when 'last' then element_at(split(m.surr, ' '), -1) when 'first' then split(m.surr, ' ')[0] else m.surr end"
    titled = f"concat(regexp_extract(m.value, {_sql(_TITLE)}, 0), {part}, regexp_extract(m.value, {_sql("'s$")}, 0))"
    return f"case when m.kind in ('card', 'phone') then {poured} when m.kind = 'person' then {titled} when m.value = upper(m.value) then upper(m.surr) else m.surr end"


def _kind(value: str) -> Column:
    out = F.when(F.col(value).contains("@"), F.lit("email"))
    for k in ("ip", "card", "phone"):
        out = out.when(F.col(value).rlike(f"^(?:{KINDS[k]})$"), F.lit(k))
    return out.otherwise(F.lit("person"))


def entities(mentions: DataFrame, pepper: str, tmp: Scratch) -> DataFrame:
    """kind, canon, surr of each entity; no two have one surrogate, and no surrogate is an entity."""
    domain = F.element_at(F.split("canon", "@"), -1)
    base = mentions.select("kind", "canon").unionByName(mentions.where("kind = 'email'").select(F.lit("domain").alias("kind"), domain.alias("canon")))
    base = tmp.save(base.distinct(), "entities")
    seed = F.sha2(F.concat_ws("|", F.lit(pepper), "kind", "canon", F.col("attempt").cast("string")), 256)
    mark = lambda c: F.lower(F.when(F.col("kind") == "person", F.element_at(F.split(c, " "), -1)).otherwise(F.col(c)))

    def derived(rows: DataFrame) -> DataFrame:
        return rows.withColumn("seed", seed).withColumn("surr", surrogate()).select("kind", "canon", "attempt", "surr", mark("surr").alias("mark"))

    table = tmp.save(derived(base.withColumn("attempt", F.lit(0))), "surr_0")
    real = base.select("kind", mark("canon").alias("mark")).distinct()
    for k in range(ATTEMPTS):
        first = table.groupBy("kind", "mark").agg(F.min(F.struct("attempt", "canon")).alias("holder"), F.count("*").alias("claims")).where("claims > 1")
        taken = table.join(first, ["kind", "mark"]).where("canon <> holder.canon").select("kind", "canon")
        clash = tmp.save(taken.unionByName(table.join(real, ["kind", "mark"], "left_semi").select("kind", "canon")).distinct().withColumn("again", F.lit(1)), f"clash_{k}")
        if clash.isEmpty():
            break
        if k == ATTEMPTS - 1:
            raise ValueError("the numbers of a format are nearly all taken, so that there are no surrogates left for them")
        old = table.join(clash, ["kind", "canon"], "left")
        new = derived(old.where("again = 1").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))
        table = tmp.save(old.where("again is null").select("kind", "canon", "attempt", "surr", "mark").unionByName(new), f"surr_{k + 1}")
        tmp.drop(f"surr_{k}", f"clash_{k}")
    domains = table.where("kind = 'domain'").select(F.col("canon").alias("domain"), F.col("surr").alias("new_domain"))
    emails = table.where("kind = 'email'").withColumn("domain", domain).join(domains, "domain")
    emails = emails.select("kind", "canon", F.concat(F.substring_index("surr", "@", 1), F.lit("@"), "new_domain").alias("surr"))
    return table.where("kind not in ('email', 'domain')").select("kind", "canon", "surr").unionByName(emails)


def with_surrogates(docs: DataFrame, pepper: str = "a key of the owner", text_col: str = "text", counts: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """The rows with all their columns, the text's entities replaced; with counts, n_<kind> of each kind is added.

    pepper: the secret key; another key gives other surrogates.
    """
    tmp = scratch or Scratch(docs.sparkSession, "surrogates")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("pii_text"))
    rows = rows.withColumn("found", F.expr(f"regexp_extract_all(pii_text, {_sql(ANY)}, 0)"))
    hit = rows.where("size(found) > 0").withColumn("named", F.expr(_named("found"))).withColumn("pattern", F.expr(_pattern()))
    hit = hit.withColumn("found", F.expr("case when size(named) = 0 then found else regexp_extract_all(pii_text, pattern, 0) end"))
    hit = tmp.save(hit.select("row", "pii_text", "pattern", "named", "found", F.xxhash64("pii_text").alias("h1"), F.crc32(F.col("pii_text").cast("binary")).alias("h2")), "hit")
    mentions = hit.select("h1", "h2", "named", "found").dropDuplicates(["h1", "h2"]).select("h1", "h2", "named", F.posexplode("found").alias("pos", "value"))
    mentions = mentions.withColumn("kind", _kind("value")).withColumn("who", F.expr(f"case when kind = 'person' then {_who('value')} end")).withColumn("canon", _canon())
    mentions = mentions.select("h1", "h2", "pos", "value", "kind", "canon", F.col("who.part").alias("part"))
    mentions = tmp.save(mentions, "mentions")
    table = tmp.save(entities(mentions, pepper, tmp), "table")
    written = mentions.join(table.select("kind", "canon", "surr"), ["kind", "canon"]).groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "value", "surr", "part"))).alias("ms"))
    pieces = "split(pii_text, pattern, -1)"
    text = F.expr(f"array_join(zip_with({pieces}, transform(ms, m -> {_rendered()}), (a, b) -> concat(a, coalesce(b, ''))), '')")
    replaced = hit.join(written, ["h1", "h2"]).withColumn("pii_new", text)

    def out(df: DataFrame, new: Column, number) -> DataFrame:
        kept = [(new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
        return df.select(*kept, *[number(k).cast("long").alias(f"n_{k}") for k in KINDS] if counts else [])

    a = out(replaced, F.col("pii_new"), lambda k: F.size(F.filter("ms", lambda m: m["kind"] == k)))
    b = out(rows.where("size(found) = 0"), F.col(f"row.`{text_col}`"), lambda k: F.lit(0))
    return a.unionByName(b)
