"""Tables that a query writes on its way, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[Scratch] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. A folder of our own only in local mode, where driver and tasks share one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tracklens-"))
        atexit.register(shutil.rmtree, _own[0].removeprefix("file://"), True)
    return _own[0]


class Scratch:
    """A folder of one call. Results read it lazily, so it stays until drop() or the end of the Python process."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        _made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _drop_all() -> None:
    for s in _made:
        try:
            if s.spark.sparkContext._jsc is not None and not s.spark.sparkContext._jsc.sc().isStopped():
                s.drop()
        except Exception:  # the session may be gone already
            return
