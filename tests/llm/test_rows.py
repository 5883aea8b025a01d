"""Operators that judge or rewrite documents one by one."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from kithgraph.llm import licenses, mixing, quality_rules
from kithgraph.llm import secrets_automaton as secrets
from kithgraph.llm.line_dedup import without_repeated_lines
from kithgraph.llm.quality_gam import FEATURES, features, fit, quality_scores
from kithgraph.llm.surrogates import with_surrogates
from kithgraph.llm.token_files import _Encoder, pack, read_tokens, unpack, write_tokens

FOLDER = "/root/testdata/sf0.001"
ROWS = [(1, "One two three. " * 30, "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "no id " * 60, "en", None), (1, "One two three. " * 30, "en", "s"), (4, "\n \n\t\n", "fr", "t"), (5, "long" * 5000 + " text", "fr", "t")]
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, score string, kind string, part int, found string, row string"


def odd(spark):
    return spark.createDataFrame([(*r, "a", "b", "c", 1, "d", "e") for r in ROWS], SCHEMA)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=70))
@settings(max_examples=60, deadline=None)
def test_codes(values):
    v = np.array(values, np.uint32)
    assert (unpack(*pack(v), len(v)) == v).all()


def test_token_files(spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    docs = odd(spark).select("doc_id", "text", "part").unionByName(spark.read.parquet(f"{FOLDER}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit(1).alias("part")))
    got = read_tokens(spark, write_tokens(docs, f"file://{tmp_path}/ids", path, block_tokens=2000)).collect()
    t = Tokenizer.from_file(path)
    expect, at = [], 0
    rows = sorted(((r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    for d, ids in rows:
        expect.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expect
    assert read_tokens(spark, write_tokens(docs.limit(0), f"file://{tmp_path}/none", path)).count() == 0


def test_words_encode_as_whole_texts_do():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        s = f.read()
    e, t = _Encoder(s), Tokenizer.from_str(s)
    texts = ["It's WE'LL don't naïve ÀÉÎ ΣΑΣ İ <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "x́ ß ẞ ﬁ A--B,.c 3.14 #$%&*-", "", "日本語 a b a\xa0c 'tis can't..."]
    ids, size = e.encode([x.encode() for x in texts], 1)
    at = np.concatenate([[0], np.cumsum(size)])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]


def test_quality_rules_as_sql(spark):
    docs = odd(spark)
    got = quality_rules.quality_rules(docs)
    c = duckdb.connect()
    c.register("held", pa.table({n: pa.array([r[n] for r in docs.collect()], pa.int64() if n == "doc_id" else pa.string()) for n in ("doc_id", "text", "lang", "source")}))
    c.sql("create view documents as select * from held")
    other = c.sql(quality_rules.SQL)
    at = [other.columns.index(x) for x in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in other.fetchall())
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_secret_spans(spark):
    token = secrets.credentials(1, 5)[2]
    rows = [(1, f'é password = "abcdefgh1" AKIA{"B" * 16} {"0f" * 20} {token}'), (2, "secret: token: abcdefghijkl"), (3, None), (4, "Donaudampfschifffahrtsgesellschaft 2669109448945250"), (None, "apikey=12345678")]
    got = {r.doc_id: r for r in secret_rows(spark, rows)}
    assert [x.split(":")[0] for x in got[1].spans.split(",")] == ["assign", "access", "hex", "format"]
    _, a, b = got[1].spans.split(",")[3].split(":")
    assert rows[0][1][int(a) : int(b)] == token
    base = ",".join(x for x in got[1].spans.split(",") if not x.startswith("format"))
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert (got[2].n_assign, got[3].spans, got[4].spans, got[None].n_assign) == (0, "", "", 1)


def secret_rows(spark, rows):
    return secrets.secret_spans(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")).collect()


def test_automata_tell_formats():
    secret, plain, least = secrets.trained()
    score = lambda xs: [secret.loglik(x) - plain.loglik(x) >= least for x in xs]
    assert np.mean(score(secrets.credentials(60, 99))) > 0.9
    assert np.mean(score(secrets.ordinary(200, 98))) < 0.01
    assert secret.states < 120


def test_quality_scores(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.9
    none = quality_scores(odd(spark), labels.limit(0)).collect()
    assert len(none) == len(ROWS) and {r.score for r in none} == {0.5}
    assert all(0 <= r.score <= 1 for r in quality_scores(odd(spark), labels).collect())


def test_features_are_the_same_in_any_batch():
    texts = ["The cat. The cat sat!", "", None, "A\nB\nA\nB c", "ÀÉ xx xx xx 12 $$$"]
    whole = features(pa.array(texts))
    assert whole.shape == (5, len(FEATURES)) and np.isfinite(whole).all()
    assert np.allclose(whole, np.concatenate([features(pa.array([t], pa.string())) for t in texts]))


def test_the_model_learns_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((fit(x, y).score(x) > 0.5) == y).mean() > 0.9


def test_surrogates(spark):
    rows = [(1, "Write to tim.poe@mail1.example.com or TIM.POE@MAIL1.EXAMPLE.COM, +1 (377) 555-0271."), (2, "Again tim.poe@mail1.example.com; 97.51.17.173, 4111 1111 1111 1111 and Frau Anna Roe, Mr. Carl Hale."), (3, None), (4, ""), (None, "und.34@mail7.example.com"), (2, "4111111111111111")]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kind string")
    got = with_surrogates(frame, "pepper").collect()
    assert len(got) == len(rows) and {r.kind for r in got} == {"k"}
    by = {(r.doc_id, r.n_card): r for r in got}
    one, two = by[1, 0].text, by[2, 1].text if "Again" in by[2, 1].text else next(r.text for r in got if r.text and r.text.startswith("Again"))
    mail = re.search(r"Again (\S+@\S+\.com);", two)[1]
    assert mail in one and mail.upper() in one and "poe" not in (one + two).lower()
    phone = re.search(r"(\+1 \(\d{3}\) \d{3}-\d{4})\.", one)[1]
    assert phone != "+1 (377) 555-0271"
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", two)[0].replace(" ", "")
    assert any(r.text == card for r in got)  # one card, two formats
    digits = [int(c) for c in card]
    assert sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"Frau \w+ \w+, Mr\. \w+ \w+\.", two) and "Anna Roe" not in two
    assert sorted(r.text or "" for r in with_surrogates(frame, "pepper").collect()) == sorted(r.text or "" for r in got)
    assert with_surrogates(frame.limit(0)).count() == 0


def test_licences(spark):
    rows = [(1, "text here\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, "mit der version und der work"), (4, None), (None, "This work is licensed under the GNU General Public License, version 3.")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, family string")
    model = licenses.trained(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    got = {(r.doc_id, r.pos): (r.family, r.confirmed) for r in licenses.licences(frame, model).collect()}
    assert got == {(1, 1): ("MIT", True), (2, 0): ("Apache-2.0", True), (None, 0): ("GPL-3.0", True)}
    assert licenses.licences(frame.limit(0)).count() == 0


def test_mixing_meets_its_targets(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    weights = {"clean": 0.9, "junk": 0.06, "toxic": 0.04}
    got = mixing.rates(docs, labels, weights).collect()
    p, w, r = (np.array(x, float) for x in ([x.p for x in got], [x.tokens for x in got], [x.rate for x in got]))
    drawn = (p * (w * r)[:, None]).sum(axis=0)
    assert drawn / drawn.sum() == pytest.approx([weights[d] for d in got[0].domains], abs=0.01)
    assert (r >= 0).all() and np.allclose(p.sum(axis=1), 1)
    texts = {x.doc_id: x.text or "" for x in docs.collect()}
    assert all(x.tokens == len(regex.findall(mixing.TOKEN, texts[x.doc_id])) for x in got)
    assert {x.rate for x in mixing.rates(odd(spark), labels.limit(0), weights).collect()} == {1.0}
    kept = mixing.mixed(odd(spark), labels.limit(0), weights)
    assert kept.columns == odd(spark).columns and kept.count() == len(ROWS)
    assert mixing.mixed(odd(spark).limit(0), labels, weights).count() == 0


def clash():
    return {c: F.lit("mine") for c in ("gone_at", "gone_id", "mix_rate", "mix_n", "mix_k", "mix_id", "row", "at", "held", "gone", "id", "tokens", "p", "rate", "first", "lines")}


def test_no_row_is_judged_by_another_of_its_id(spark):
    """Null ids, and ids that repeat with other texts."""
    for i in (None, 7):
        frame = spark.createDataFrame([(i, "A of the day\nB of the day"), (i, "C of the day\nA of the day"), (1, "B of the day")], "doc_id long, text string").withColumns(clash())
        got = without_repeated_lines(frame)
        assert got.columns == frame.columns and {r.gone_at for r in got.collect()} == {"mine"}
        lines = sorted(x for r in got.collect() for x in r.text.split("\n") if x)
        assert lines == ["A of the day", "B of the day", "C of the day"]


def test_mixing_keeps_rows_without_an_id(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    nameless = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id"))).withColumns(clash())
    weights, options = corpus_pipeline.WEIGHTS, {"stratum": "lang", "cover": corpus_pipeline.COVER}
    got = mixing.mixed(nameless, labels, weights, **options)
    assert got.columns == nameless.columns and {r.mix_n for r in got.collect()} == {"mine"}
    rate = lambda df: {r.tokens: r.rate for r in mixing.rates(df, labels.where("doc_id % 3 > 0"), weights, **options).collect()}
    assert rate(nameless) == rate(docs)  # by tokens


def test_stages_of_the_pipeline_on_odd_tables(spark):
    docs = odd(spark).select("doc_id", "text", "lang", "source", F.lit(1).alias("n_chars")).withColumns(clash())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, FOLDER)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert {r.gone_id for r in rows} <= {"mine"} and len(rows) <= 4 * len(ROWS)
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    kept = corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()
    assert len(kept) == len(ROWS) and any(r.doc_id is None for r in kept)
    assert corpus_pipeline.tokens(spark, docs, FOLDER).count() == len(ROWS)
    assert corpus_pipeline.tokens(spark, docs.limit(0), FOLDER).count() == 0


def test_the_stage_accepts_what_the_scores_accept(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scores = quality_scores(docs, labels).collect()
    assert sorted(r.doc_id for r in corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.01").collect()) == sorted(r.doc_id for r in scores if r.predicted)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scores)
