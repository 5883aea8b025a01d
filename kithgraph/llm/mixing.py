"""Mixing domains to target weights when each document belongs to several of them in part.

A naive Bayes classifier, learned from a labelled table, gives each document a posterior over domains.
Its features are the shape of the text (in bands) and the presence of words and word starts that are
telling for one domain. Domains may be crossed with a column whose value each row states (a language, a
source). Then nonnegative document rates are fitted by least squares: the sum of rate x
tokens x posterior is to match each domain's target, each domain's error weighted by the inverse of its
share, and a vanishing ridge picks the rates nearest 1 of all that do (targets that the posteriors can't
reach are met as nearly as they allow). At the optimum a rate is 1 - multipliers . posterior, with one
multiplier for each domain, held between 0 and ``repeats`` times the highest rate that undivided documents
would need (so that no few documents are drawn hundreds of times for a target out of reach); these are
found by Newton's steps, whose sums over all documents' posteriors Spark makes, and the driver holds a few
numbers for each step. Tokens are runs of letters, digits, and runs of marks. Rates and posteriors are not rounded.
Posterior mass in a domain whose target is 0 has no rate: a document's rate is reduced by it, and is 0 where
such domains have half of the mass or more. All of it is SQL functions: no Python runs on rows.

The fit uses up to ``max_train`` labelled documents, the first by a hash of their id: a documented bound.

A row's rate is a function of its own text and stratum alone: rows are never joined by their id, and the
whole row goes with its posterior through one table, so that nothing is shuffled but the labelled sample.

Nulls: a null text is empty (no tokens; any rate suits it); a null stratum is like one that no weight names. A null id has no label, and is drawn by its
text alone. Labels with no domain (null) are left out; of several domains of an id the first by name
counts. A domain without labelled documents can't be predicted, so that its target is left out. Without
any label every rate is 1. Rows that repeat get the same rate and the same draw. Other columns are kept
by ``mixed`` and ignored by ``rates``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.scratch import Scratch

#: Of the labels table, by which documents learn their domain.
DOMAIN = "case when toxic = 1 then 'toxic' when quality = 0 then 'junk' when quality = 1 then 'clean' end"
#: Share of a domain's labelled documents that hold a telling word, at least.
SUPPORT = 0.02
#: How much likelier a telling word is in its domain than elsewhere, at least, with 2.5 standard errors taken off.
LIFT = 3
def _band(name: str, value: Column, cuts: tuple[float, ...]) -> Column:
    band = sum((F.when(value >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    return F.concat(F.lit(f"#{name}"), band.cast("string"))


#: What counts as a token: a run of letters, a digit, a run of marks.
TOKEN = "\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+"


def _described(rows: DataFrame) -> DataFrame:
    """Of columns row and text: row, tokens (their number), shape (band names), terms (distinct words), starts (their first five letters)."""
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern))
    split = F.split(F.lower("text"), "[\\x20\\x09-\\x0D.,;:!?\"'()]+")
    rows = rows.select("row", F.char_length("text").alias("chars"), count(TOKEN).cast("long").alias("tokens"), count("[#*$%&|<>]").alias("symbols"), count("!").alias("exclaims"), count("[A-Z]").alias("capitals"), F.array_remove(split, "").alias("split"))
    rows = rows.select("row", "chars", "tokens", "symbols", "exclaims", "capitals", F.size("split").alias("words"), F.array_distinct("split").alias("terms"))
    many = F.greatest(F.col("words"), F.lit(1))
    shape = F.array(
        _band("symbols", F.col("symbols") / many, (0.05, 0.3, 0.8)),
        _band("exclaims", F.col("exclaims") / many, (0.05, 0.3)),
        _band("capitals", F.col("capitals") / F.greatest(F.col("chars"), F.lit(1)), (0.1, 0.3)),
        _band("distinct", F.size("terms") / many, (0.15, 0.3, 0.5)),
    )
    return rows.select("row", "tokens", shape.alias("shape"), "terms", F.transform("terms", lambda w: F.substring(w, 1, 5)).alias("starts"))


def _learn(docs: DataFrame, known: DataFrame, most: int, id_col: str, text_col: str, tmp: Scratch) -> tuple[dict[str, float], dict[str, dict[str, float]], dict[str, list[str]]]:
    """Of each domain the score of a text without features, and what each feature adds."""
    texts = docs.select(F.col(id_col).cast("long").alias("known_id"), F.col(text_col).alias("known_text"))
    texts = texts.join(F.broadcast(known), F.col("known_id") == F.col("doc_id"))  # known has max_train rows at most
    texts = tmp.save(texts.select("doc_id", "known_text", "domain"), "known_texts")
    starts = F.transform(F.array_distinct("starts"), lambda x: F.concat(F.lit("~"), x))
    described = _described(texts.select(F.struct("domain").alias("row"), F.col("known_text").alias("text"))).withColumn("domain", F.col("row.domain"))
    train = described.select("domain", F.explode(F.concat(F.array(F.lit("")), "shape", "terms", starts)).alias("f"))
    counts = train.groupBy("f").pivot("domain", sorted(r["domain"] for r in known.select("domain").distinct().collect())).agg(F.count(F.lit(1))).na.fill(0)
    counts = tmp.save(counts, "counts")
    names = [c for c in counts.columns if c != "f"]
    if not names:
        return {}, {}, {}
    total = counts.where("f = ''").select(*[F.col(f"`{d}`").alias(f"n_{k}") for k, d in enumerate(names)]).first()
    if total is None:
        return {}, {}, {}
    n = {d: total[k] for k, d in enumerate(names)}
    whole = sum(n.values())
    rest = {d: sum((F.col(f"`{e}`") for e in names if e != d), F.lit(0)) + 0.5 for d in names}
    # the logarithm of the lift, less 2.5 standard errors
    lift = [F.log((F.col(f"`{d}`") + 0.5) / (n[d] + 1) / (rest[d] / (whole - n[d] + 1))) - 2.5 * F.sqrt(1 / (F.col(f"`{d}`") + 0.5) + 1 / rest[d]) for d in names]
    worth = F.greatest(*[F.when((F.col(f"`{d}`") >= max(4.0, SUPPORT * n[d])) & (x > math.log(LIFT)), F.col(f"`{d}`") * x).otherwise(0.0) for d, x in zip(names, lift, strict=True)], F.lit(0.0))
    told = counts.where("f <> '' and not startswith(f, '#')").withColumn("worth", worth).where("worth > 0").orderBy(F.desc("worth"), "f").limit(most).drop("worth")
    bands = counts.where("startswith(f, '#')")
    base = {d: math.log(max(n[d], 0.5) / whole) for d in names}
    adds: dict[str, dict[str, float]] = {}
    whose: dict[str, list[str]] = {d: [] for d in names}
    for r in told.unionByName(bands).collect():  # at most ``most`` and a few bands
        chance = {d: (r[d] + 0.5) / (n[d] + 1) for d in names}
        if r["f"].startswith("#"):
            whole_share = (sum(r[d] for d in names) + 0.5) / (whole + 1)  # a rare band says little
            adds[r["f"]] = {d: math.log((r[d] + 10 * whole_share) / (n[d] + 10)) for d in names}
        else:
            mean = sum(chance[d] * n[d] for d in names) / whole
            adds[r["f"]] = {d: math.log(chance[d] / mean) for d in names}
            whose[max(names, key=lambda d: (chance[d], d))].append(r["f"])  # noqa: B023
    # that none of a domain's telling words is there is evidence, too (one of them being absent is not)
    rows = described.withColumn("all", F.concat("terms", starts))
    lacking = {d: ~F.arrays_overlap("all", _texts(whose[d])) for d in names if whose[d]}
    if lacking:
        found = {r["domain"]: r for r in rows.groupBy("domain").agg(F.count("*").alias("n"), *[F.count_if(x).alias(f"none_{k}") for k, x in enumerate(lacking.values())]).collect()}
        for k, d in enumerate(lacking):
            adds[f"!{d}"] = {c: math.log((found[c][f"none_{k}"] + 0.5) / (found[c]["n"] + 1)) if c in found else 0.0 for c in names}
    return base, adds, whose


def _texts(keys: list[str]) -> Column:
    return F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")


def _posteriors(rows: DataFrame, base: dict[str, float], adds: dict[str, dict[str, float]], whose: dict[str, list[str]]) -> DataFrame:
    names = sorted(base)
    terms, starts = sorted(k for k in adds if k[0] not in "#~!"), sorted(k[1:] for k in adds if k[0] == "~")
    # of words and of word starts the telling ones alone remain
    found = F.concat("shape", F.array_intersect("terms", _texts(terms)), F.transform(F.array_intersect("starts", _texts(starts)), lambda x: F.concat(F.lit("~"), x)))
    rows = rows.select("row", "tokens", found.alias("found"))
    lacking = [F.when(~F.arrays_overlap("found", _texts(whose[d])), F.lit(f"!{d}")) for d in names if whose.get(d)]
    if lacking:
        rows = rows.select("row", "tokens", F.concat("found", F.array_compact(F.array(*lacking))).alias("found"))
    values = F.create_map(*[x for k, v in sorted(adds.items()) for x in (F.lit(k), F.array(*[F.lit(v[d]) for d in names]))])
    zero = F.array(*[F.lit(0.0)] * len(names))

    def plus(k: int):
        return lambda s, x: s + x[k]

    def scores(adds: Column) -> Column:
        return _let(F.array(*[F.aggregate(adds, F.lit(base[d]), plus(k)) for k, d in enumerate(names)]), chances)

    def chances(s: Column) -> Column:
        e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
        return _let(e, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))

    adds = F.transform("found", lambda f: F.coalesce(F.try_element_at(values, f), zero))
    return rows.select("row", "tokens", _let(adds, scores).alias("p"))


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _only(where: Column):
    return lambda x: F.when(where, x).otherwise(0.0)


def _allowed(names: list[str], wanted: dict[str, float]) -> Column:
    """The share of a document that may stay: its posterior mass in domains with a target, or none if that is half of it or less."""
    mass = sum((F.col("p")[k] for k, d in enumerate(names) if wanted[d] > 0), F.lit(0.0))
    return F.when(mass > 0.5, F.least(mass, F.lit(1.0))).otherwise(0.0)


def _plain(shifts: list[float]) -> Column:
    """1 - multipliers . posterior; the multipliers are one array, so that all steps share their compiled code."""
    x = F.array(*[F.lit(float(v)) for v in shifts])
    return F.lit(1.0) - F.aggregate(F.zip_with(x, F.col("p"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def _rate(shifts: list[float], most: float) -> Column:
    """The rate at the multipliers, from a document's posterior p and its share that may stay."""
    return F.col("may") * F.greatest(F.lit(0.0), F.least(F.lit(most), _plain(shifts)))


def _fitted(rows: DataFrame, names: list[str], own: dict[str, float], goal: dict[str, float], most: float, rounds: int, close: float, ridge: float) -> list[float]:
    """The multipliers, by Newton's steps on the dual of the ridged least squares, damped until they descend."""
    live = [k for k, d in enumerate(names) if goal[d] > 0 and own[d] > 0]
    if not live:
        return [0.0] * len(names)
    size, aim = np.array([own[names[k]] for k in live]), np.array([goal[names[k]] for k in live])

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, gradient and second derivatives: one pass over the documents."""
        used = rows.withColumn("z", _plain(_spread(x, live, len(names)))).where("may > 0 and z > 0")
        used = used.select("z", F.least(F.col("z"), F.lit(most)).alias("rate"), (F.col("tokens") * F.col("may")).alias("held"), *[F.col("p")[k].alias(f"p{k}") for k in live])
        drawn, free = F.col("held") * F.col("rate"), F.when(F.col("z") < most, F.col("held")).otherwise(0.0)
        sums = [F.sum(drawn * (2 * F.col("z") - F.col("rate"))), *[F.sum(drawn * F.col(f"p{k}")) for k in live], *[F.sum(free * F.col(f"p{k}") * F.col(f"p{j}")) for k in live for j in live]]
        v = np.array([float(y or 0.0) for y in used.agg(*sums).first()])
        bend = v[1 + len(live) :].reshape(len(live), -1) + np.diag(ridge * size)
        return v[0] / 2 + x @ aim + ridge / 2 * (size * x * x).sum(), aim - v[1 : 1 + len(live)] + ridge * size * x, bend

    x, damp = np.zeros(len(live)), 0.01
    value, slope, bend = at(x)
    for _ in range(rounds):
        if np.abs(slope / aim).max() < close:
            break
        step = -np.linalg.solve(bend + np.diag(damp * size), slope)
        new = at(x + step)
        if new[0] <= value + 1e-4 * (slope @ step):
            x, (value, slope, bend), damp = x + step, new, damp / 10
        elif damp > 1e3:
            break  # the sums tell no more
        else:
            damp *= 8
    return _spread(x, live, len(names))


def _spread(x: np.ndarray, live: list[int], n: int) -> list[float]:
    """Of all domains, those not live with 0; rounded, so that the order of sums doesn't show."""
    out = [0.0] * n
    for k, v in zip(live, x, strict=True):
        out[k] = round(float(v), 12)
    return out


def _rated(docs: DataFrame, labels: DataFrame, weights: dict[str, float], domain: str, total: float | None, cover: float | None, stratum: str | None, rounds: int, close: float, ridge: float, repeats: float, max_train: int, most_features: int, id_col: str, text_col: str, scratch: Scratch | None) -> DataFrame:
    """row (a struct of all columns of the input), tokens, domains, p, rate of each row; each row's rate comes from its own text."""
    spark = docs.sparkSession
    tmp = scratch or Scratch(spark, "mixing")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(domain).alias("domain")).where("doc_id is not null and domain is not null")
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    known = tmp.save(known, "known")
    base, adds, whose = _learn(docs, known, most_features, id_col, text_col, tmp)
    names = sorted(base)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    if not names:
        rows = _described(packed)
        return rows.select("row", "tokens", F.array().cast("array<string>").alias("domains"), F.array().cast("array<double>").alias("p"), F.lit(1.0).alias("rate"))
    rows = _posteriors(_described(packed), base, adds, whose)
    if stratum:
        values = sorted({k.split(":", 1)[1] for k in weights if ":" in k})
        value = F.coalesce(F.col(f"row.`{stratum}`").cast("string"), F.lit(""))
        mine = [value == v for v in values] + [~value.isin(*values) if values else F.lit(True)]
        rows = rows.withColumn("p", F.concat(*[F.transform("p", _only(m)) for m in mine]))
        names = [f"{d}:{v}" for v in values for d in names] + names
    rows = tmp.save(rows, "posteriors")
    wanted = {d: max(0.0, weights.get(d, 0.0)) for d in names}
    share = sum(wanted.values()) or 1.0
    wanted = {d: v / share for d, v in wanted.items()}
    rows = rows.withColumn("may", _allowed(names, wanted))
    held = rows.agg(*[F.sum(F.col("tokens") * F.col("may") * F.col("p")[k]).alias(f"w{k}") for k in range(len(names))]).first()
    own = {d: float(held[f"w{k}"] or 0.0) for k, d in enumerate(names)}
    needs = [own[d] / v for d, v in wanted.items() if v > 0 and own[d] > 0]
    if total is None and cover:
        total = min(max(needs, default=0.0), cover * sum(own[d] for d in names if wanted[d] > 0))
    total = total or min(needs, default=0.0)
    goal = {d: v * total for d, v in wanted.items()}
    top = repeats if cover else repeats * max([1.0, *(goal[d] / own[d] for d in names if own[d] > 0)])
    fit = _rate(_fitted(rows, names, own, goal, top, rounds, close, ridge), top)
    return rows.select("row", "tokens", F.array(*[F.lit(d) for d in names]).alias("domains"), "p", fit.alias("rate"))


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], domain: str = DOMAIN, total: float | None = None, cover: float | None = None, stratum: str | None = None, rounds: int = 60, close: float = 1e-7, ridge: float = 1e-4, repeats: float = 4.0, max_train: int = 10_000, most_features: int = 300, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, tokens, domain (the likeliest), domains, p (of each of the domains), rate of each row.

    weights: of the domains' expected tokens in the mixture. total: tokens of the mixture; if none is
    given, the most for which no domain needs more tokens than it has. cover: instead, the fewest for which
    no domain has to lose any, but at most ``cover`` times what the domains with a weight have. stratum: a
    column that crosses the domains: "clean:en" is the clean part of the rows that have "en" there, "clean"
    that of rows whose value no weight names. repeats: no fitted rate is more than that many times the
    highest that undivided documents would need, which is 1 or more; with ``cover`` no rate is more than it.
    """
    used = [id_col, text_col] + [stratum] * bool(stratum)
    rows = _rated(docs.select(*dict.fromkeys(used)), labels, weights, domain, total, cover, stratum, rounds, close, ridge, repeats, max_train, most_features, id_col, text_col, scratch)
    likeliest = F.try_element_at("domains", F.nullif(F.array_position("p", F.array_max("p")), F.lit(0)).cast("int"))
    return rows.select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), "tokens", likeliest.alias("domain"), "domains", "p", "rate")


def copies(rate: Column, *key: Column) -> Column:
    """How often a document is in the mixture: its rate, rounded up with the chance of its fraction by a keyed hash."""
    chance = F.pmod(F.xxhash64(*key, F.lit("mixture")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + chance).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], domain: str = DOMAIN, total: float | None = None, cover: float | None = None, stratum: str | None = None, rounds: int = 60, close: float = 1e-7, ridge: float = 1e-4, repeats: float = 4.0, max_train: int = 10_000, most_features: int = 300, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The documents of the mixture, with their columns; one that is drawn n times is in it n times. Options as of ``rates``."""
    rows = _rated(docs, labels, weights, domain, total, cover, stratum, rounds, close, ridge, repeats, max_train, most_features, id_col, text_col, scratch)
    n = copies(F.col("rate"), F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.col(f"row.`{text_col}`")))
    rows = rows.select("row", F.explode(F.array_repeat(F.lit(0), n)))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
