"""The queries of this subpackage, opN_<name>, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithgraph.llm.minhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), size=3, percent=85)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kithgraph.llm.scratch import Scratch
    from kithgraph.llm.token_files import read_tokens, write_tokens

    tmp = Scratch(spark, "tokens")
    folder = write_tokens(_docs(spark, sf_dir), tmp.path("ids"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    tmp.drop("ids/temp")
    return read_tokens(spark, folder)


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithgraph.llm.licenses import licences

    return licences(_docs(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithgraph.llm.quality_rules import quality_rules

    return quality_rules(_docs(spark, sf_dir))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithgraph.llm.surrogates import with_surrogates

    return with_surrogates(_docs(spark, sf_dir).select("doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithgraph.llm.line_dedup import line_report

    return line_report(_docs(spark, sf_dir))


def op7_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithgraph.llm.secrets_automaton import secret_spans

    return secret_spans(_docs(spark, sf_dir))


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithgraph.llm.quality_gam import quality_scores

    return quality_scores(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from kithgraph.llm.mixing import copies, rates

    found = rates(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), {"clean": 0.9, "junk": 0.06, "toxic": 0.04})
    p = [F.try_element_at("p", F.nullif(F.array_position("domains", F.lit(d)), F.lit(0)).cast("int")).alias(f"p_{d}") for d in ("clean", "junk", "toxic")]
    return found.select("doc_id", "tokens", "domain", *p, "rate", copies(F.col("rate"), F.col("doc_id").cast("string")).alias("copies"))


def op10_simhash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithgraph.llm.simhash import leaks

    return leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    from kithgraph.llm import quality_rules

    return {"op4_quality_rules": quality_rules.SQL}
