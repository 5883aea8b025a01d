"""Cases of the first review."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kithgraph.llm import licenses, mixing, quality_gam, quality_rules
from kithgraph.llm import secrets_automaton as secrets
from kithgraph.llm.surrogates import with_surrogates

DOMAINS = {"clean": ("river", 1, 0), "junk": ("jackpot", 0, 0), "toxic": ("vile", 0, 1)}


def corpus(spark, **sizes):
    """Documents whose domain one word tells, and labels of the first 500 of each domain."""
    docs, labels = [], []
    for k, (d, n) in enumerate(sizes.items()):
        word, quality, toxic = DOMAINS[d]
        for i in range(n):
            docs.append((k * 100_000 + i, f"{word}s {word} {word}ish and so on with w{i % 7} " + "some more words here " * 5))
            if i < 500:
                labels.append((docs[-1][0], quality, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("toxic", [60, 400])
def test_no_clearly_toxic_document_leaves_the_pipeline_stage(spark, toxic):
    docs, labels = corpus(spark, clean=4000, junk=60, toxic=toxic)
    docs = docs.withColumn("lang", F.element_at(F.array(*map(F.lit, ("en", "en", "de", "fr", "es", "es"))), (1 + F.col("doc_id") % 6).cast("int")))
    options = {"stratum": "lang", "cover": corpus_pipeline.COVER}
    got = mixing.rates(docs, labels, corpus_pipeline.WEIGHTS, **options).collect()
    assert {r.domain.split(":")[0] for r in got} == set(DOMAINS)
    assert {r.rate for r in got if not r.domain.startswith("clean")} == {0.0}
    left = mixing.mixed(docs, labels, corpus_pipeline.WEIGHTS, **options)
    assert left.columns == docs.columns
    left = left.collect()
    assert not any("vile" in r.text or "jackpot" in r.text for r in left)
    held = Counter(r.lang for r in left)
    wanted = {k.split(":")[1]: v for k, v in corpus_pipeline.WEIGHTS.items() if ":" in k}
    for k, v in wanted.items():
        assert held[k] / len(left) == pytest.approx(v / sum(wanted.values()), abs=0.01)


def test_clean_documents_stay_where_shares_are_near_the_targets(spark):
    docs, labels = corpus(spark, clean=4000, junk=60, toxic=60)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 100 < 56, "en").when(F.col("doc_id") % 100 < 72, "de").when(F.col("doc_id") % 100 < 88, "fr").otherwise("es"))
    got = mixing.rates(docs, labels, corpus_pipeline.WEIGHTS, stratum="lang", cover=corpus_pipeline.COVER).collect()
    assert all(0.97 < r.rate < 1.15 for r in got if r.domain.startswith("clean"))


@pytest.mark.parametrize("sizes", [{"clean": 4000, "junk": 206, "toxic": 60}, {"clean": 4000, "junk": 260, "toxic": 80}])
def test_expected_words_meet_the_targets_at_rare_shares(spark, sizes):
    docs, labels = corpus(spark, **sizes)
    weights = {"clean": 0.9, "junk": 0.06, "toxic": 0.04}
    got = mixing.rates(docs, labels, weights).collect()
    drawn = np.array([np.array(r.p) * r.tokens * r.rate for r in got]).sum(axis=0)
    assert drawn / drawn.sum() == pytest.approx([weights[d] for d in got[0].domains], rel=1e-2)
    assert max(r.rate for r in got) < 1.1


def test_keys_of_letters_alone_are_scored(spark):
    key, word = "ASIA" + "QZXKWVJTBGMPLRND", "Donaudampfschifffahrtsgesellschaft"
    rows = [(1, f"id {key} end"), (2, f"{word} {word.upper()} {word.lower()}"), (3, "=" * 40)]
    got = {r.doc_id: r.spans for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "format:3:23", 2: "", 3: ""}
    assert [x for _, x in secrets.pieces(f"{word.lower()}={key}")] == [word.lower(), key]


def test_phone_numbers_without_separators_are_replaced(spark):
    values = ["+13775550271", "+4915112345678", "+1377 555 0271", "+35312345678"]
    got = with_surrogates(spark.createDataFrame([(i, f"call {v} now") for i, v in enumerate(values)], "doc_id long, text string")).collect()
    new = [r.text.split("call ")[1].split(" now")[0] for r in sorted(got, key=lambda r: r.doc_id)]
    for old, now, code in zip(values, new, ["+1", "+49", "+1", "+353"], strict=True):
        assert len(now) == len(old) and now.startswith(code) and now[len(code) :] != old[len(code) :] and old[4:] not in now
    assert new[0] == new[2].replace(" ", "")  # one entity


def test_a_person_keeps_one_surrogate_in_all_forms(spark):
    rows = [(1, "Mr. Carl Hale came. Mr Hale left; Carl Hale's dog stayed. Hale and Mr Carl Hale's car. Carl!"), (2, "Mr Carl Hale"), (3, "Herr Hale"), (4, "Mrs Hale, Mr Mark Will. He will mark it, Will.")]
    got = {r.doc_id: r for r in with_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first, last = got[2].text.split()[1:]
    assert got[1].text == f"Mr. {first} {last} came. Mr {last} left; {first} {last}'s dog stayed. {last} and Mr {first} {last}'s car. {first}!"
    assert got[1].n_person == 6 and "Hale" not in got[3].text + got[4].text and got[3].text.split()[1] != last
    assert got[4].text.endswith(" He will mark it, Will.")


def test_a_common_licence_is_not_lost(spark):
    notices = [(i, f"Copyright {1990 + i % 30} Jane{i} Roe{i}. Released under the MIT License.") for i in range(300)]
    docs = spark.createDataFrame(notices + [(1000 + i, f"plain line w{i} about rivers and v{i % 50} boats") for i in range(600)], "doc_id long, text string")
    got = licenses.licences(docs).collect()
    assert {r.doc_id for r in got if r.family == "MIT" and r.confirmed} == set(range(300))
    assert not [r for r in got if r.doc_id >= 1000]


def test_wrapped_and_short_notices(spark):
    grant = "# Permission is hereby granted, free of charge, to any\n# person obtaining a copy of this software and associated\n# documentation files (the X), to deal in it"
    rows = [(1, f"code\n\n{grant}\n\nmore code"), (2, "a line\nAll rights reserved.\nanother"), (None, grant), (3, "Released under the MIT License.\nLicensed under CC BY 4.0."), (4, "rivers and boats " * 30 + "\nmore of them"), (5, None), (5, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows] + [(100 + i, f"plain line w{i} about rivers and v{i % 50} boats", "x") for i in range(300)], "doc_id long, text string, words string")
    got = sorted((r.doc_id or 0, r.pos, r.n_lines, r.family) for r in licenses.licences(docs).collect() if r.confirmed)
    assert got == [(0, 0, 3, "MIT"), (1, 2, 3, "MIT"), (2, 1, 1, "Proprietary"), (3, 0, 1, "MIT"), (3, 1, 1, "CC-BY-4.0")]


def test_surrogates_of_many_entities_end_and_stay_apart(spark):
    low = "abcdefghijklmnopqrstuvwxyz"
    surname = lambda i: "Z" + "".join(low[i // 26**k % 26] for k in range(3)) + "q"
    rows = [(i, f"Mr {surname(i)} wrote") for i in range(6000)] + [(10_000 + i, f"to {c}@x.com, {c}@mail{i}.org and 10.0.0.{i}") for i, c in enumerate(low)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in with_surrogates(docs).collect()}
    people = [got[i].split()[1] for i in range(6000)]
    assert len(set(people)) == 6000 and all(x.isalpha() and x[0].isupper() for x in people) and not set(people) & {surname(i) for i in range(6000)}
    mails = [got[10_000 + i].split()[1].rstrip(",") for i in range(26)]
    assert len(set(mails)) == 26 and len({m.split("@")[1] for m in mails}) == 1  # one domain
    others = [got[10_000 + i].split()[2] for i in range(26)]
    assert len({m.split("@")[1] for m in others}) == 26


def test_base_spans_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kinds = [(secrets.ASSIGN, lambda m: len(m[2]) >= 8), (secrets.ACCESS, lambda m: m.end() - m.start() >= 16), (secrets.HEX, lambda m: True)]
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in secrets.secret_spans(docs).collect():
        found = sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(kinds) for m in p.finditer(texts[r.doc_id]) if good(m))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in found) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()


def test_a_score_is_the_sum_of_its_table_entries():
    r = np.random.default_rng(3)
    x = r.random((800, 4))
    model = quality_gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float))
    bins = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(model.cuts)]
    wide = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(model.pair_cuts)]
    total = np.full(len(x), model.base) + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
    for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
        total = total + t[wide[i], wide[j]]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-total)), atol=1e-9)


def test_each_adaptive_rule_can_reject(spark):
    r = np.random.default_rng(5)
    word = lambda k: "".join(map(chr, r.integers(97, 123, k)))
    text = lambda n: " ".join(word(6) for _ in range(n))
    rows = [(i, "\n".join(text(20) for _ in range(10))) for i in range(60)]
    phrase = text(40)
    odd = {
        "symbols": text(200) + " $$$$" * 60,
        "exclaims": text(200) + "!!!!" * 60,
        "capitals": " ".join(word(6).upper() if i % 2 else word(6) for i in range(200)),
        "dup_lines": "\n".join(["a b", "c d", "e f"] * 4 + [text(60)]),
        "repeats": " ".join([phrase, text(60), phrase, text(60)]),
    }
    rows += [(100 + k, t) for k, t in enumerate(odd.values())]
    docs = spark.createDataFrame([(*x, "en", "s") for x in rows], "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x.broken for x in quality_rules.quality_rules(docs).collect()}
    assert [got[100 + k] for k in range(len(odd))] == list(odd) and {got[i] for i in range(60)} == {""}
