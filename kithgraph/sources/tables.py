"""Intermediate tables in the folder that the session's executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_state: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it names none, a temporary one on one machine (tests), an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _state.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="kith_"))
    return base.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table and read again: what comes after doesn't repeat what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kith-{name}-{uuid.uuid4().hex[:10]}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        except Exception:  # the session may have ended
            return
