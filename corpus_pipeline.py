"""A corpus pipeline: stages over documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; the last returns the token files' digest of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.minhash import near_duplicates
from kithgraph.llm.mixing import mixed
from kithgraph.llm.quality_gam import accepted
from kithgraph.llm.scratch import Scratch
from kithgraph.llm.simhash import without_leaks
from kithgraph.llm.token_files import read_tokens, write_tokens

#: Of the expected tokens of the mixture: the clean part of each language; toxic text, and junk that the first stage has left, get none.
WEIGHTS = {"clean:en": 0.56, "clean:de": 0.155, "clean:fr": 0.155, "clean:es": 0.12, "clean": 0.01}
#: The mixture is no larger than this many times its input's share with a weight.
COVER = 1.25


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among ``ids``; those with a null id stay. One plan at every size: the texts are dealt by id."""
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = rows.where("id is not null").hint("merge").join(ids.select(F.col("doc_id").alias("id")), "id", "left_anti").unionByName(rows.where("id is null"))
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; each is judged by its text in the pass that reads it."""
    return accepted(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return _without(docs, near_duplicates(docs.select("doc_id", "text"), size=5, percent=80).where("not kept").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at rates that give each language's clean tokens their target weight.

    The languages are met by repeating the scarcer ones, so that a clean document's rate is 1 or more; a document that is toxic or junk has none.
    """
    return mixed(docs, _table(spark, sf_dir, "labels"), WEIGHTS, stratum="lang", cover=COVER)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the token files."""
    import public_tokenizers

    tmp = Scratch(spark, "tokens")
    folder = write_tokens(docs, tmp.path("ids"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    tmp.drop("ids/temp")
    return read_tokens(spark, folder)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]
#: The stages fit models and search by sketches, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tmp = _table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = tmp.save(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            tmp.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
