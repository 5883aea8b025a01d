"""Tables that cut lineage: Parquet in the folder which driver and executors share.

The folder is the one named by ``spark.checkpoint.dir``. Where a session names none, a temporary folder
is used if it runs on one machine (tests); on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if "dir" not in _local:
            _local["dir"] = "file://" + tempfile.mkdtemp(prefix="kith_")
        base = _local["dir"]
    return base.rstrip("/")


class Scratch:
    """A folder of intermediate tables; ``save`` writes one and reads it again, ``drop`` deletes it."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/kith-{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._gone)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def release(self) -> None:
        """Lets Spark delete the shuffle files of steps whose tables have been saved."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        target.getFileSystem(conf).delete(target, True)

    def _gone(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # the session may have ended before the interpreter does
            pass
