"""Files of the kinds that the graph is fed from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Column names that exports use, by their meaning (fixed values).
HEADERS = {"first_name": ["first name", "firstname"], "last_name": ["last name", "lastname"], "url": ["url", "profile url"], "email": ["email address", "email"], "company": ["company", "organization"], "position": ["position", "title"], "connected_on": ["connected on"]}


def contacts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of contact exports: seq, first_name, last_name, url, email, company, position.

    A byte-order mark and the notes above the header line are passed over; header names vary.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿", "").alias("text"))
    rows = lines.select("file", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")).where("trim(line) <> ''")
    known = {a: k for k, v in HEADERS.items() for a in v}
    head = F.lower("line").rlike("first ?name") & F.lower("line").rlike("last ?name")
    first = F.min(F.when(head, F.col("pos"))).over(W.partitionBy("file"))
    rows = rows.withColumn("head_at", first).where("pos >= head_at")
    header = F.max(F.when(F.col("pos") == F.col("head_at"), F.col("line"))).over(W.partitionBy("file"))
    cells = lambda c: F.transform(F.split(c, ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^\"|\"$", "")))
    names = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    rows = rows.withColumn("keys", F.transform(cells(header), lambda x: F.coalesce(F.try_element_at(names, F.lower(x)), F.lower(x)))).where("pos > head_at").withColumn("cells", cells(F.col("line")))
    at = lambda k: F.try_element_at("cells", F.nullif(F.array_position("keys", F.lit(k)), F.lit(0)).cast("int"))
    return rows.select("file", F.col("pos").alias("seq"), *[F.nullif(at(k), F.lit("")).alias(k) for k in HEADERS])


def feeds(spark: SparkSession, path: str) -> DataFrame:
    """Episodes of RSS files: file, title, description, link, pubDate."""
    fields = "title string, description string, link string, pubDate string, enclosure struct<_url: string>"
    return spark.read.format("xml").option("rowTag", "item").schema(fields).load(path).select(F.input_file_name().alias("file"), "title", "description", "link", "pubDate", F.col("enclosure._url").alias("enclosure"))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def write_queue(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
