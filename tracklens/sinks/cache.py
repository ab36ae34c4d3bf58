"""Stored results by content key: what is there is not computed again.

rows:   the results, a partition a key; a key that is computed anew overwrites its own partition only. With many=True a
        partition a run: for many small results, as a partition a key costs files, renames and listings for each of them.
        A key's rows are then those of its last ledger entry's run; rows of earlier runs stay, but are not given.
ledger: key, run, n, digest of what a run stored, appended after the rows are there. A run that dies in between
        leaves rows that no ledger entry vouches for, so its keys count as missing; the next run takes its number and place.

Keys are null-free strings; equal keys among the asked ones count once. An empty set of keys computes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = "key string, run int, n long, digest long"


class Cache:
    def __init__(self, spark: SparkSession, root: str, ddl: str, many: bool = False):
        """root: a folder that the driver and all executors share; ddl: the columns of a result besides key and run; many: a partition a run."""
        self.spark, self.root, self.many = spark, root.rstrip("/"), many
        self.schema = T.StructType([*T.StructType.fromDDL(ddl), T.StructField("key", T.StringType())])
        self.stored = T.StructType([*self.schema, T.StructField("run", T.IntegerType())]) if many else self.schema
        spark.createDataFrame([], self.stored).write.mode("append").partitionBy("run" if many else "key").parquet(f"{self.root}/rows")
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(f"{self.root}/ledger")

    def rows(self) -> DataFrame:
        stored = self.spark.read.schema(self.stored).parquet(f"{self.root}/rows")
        return stored.join(self.latest(), ["key", "run"], "left_semi").select(self.schema.names) if self.many else stored

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger")

    def latest(self) -> DataFrame:
        """The last ledger entry of each key."""
        return self.ledger().groupBy("key").agg(F.max_by(F.struct("run", "n", "digest"), "run").alias("l")).select("key", "l.*")

    def measured(self, keys: DataFrame) -> DataFrame:
        """key, n, digest of the stored rows of these keys, summed before the shuffle; order of rows and files does not matter."""
        return self._sums(self.rows().join(keys.select("key").distinct(), "key", "left_semi"))

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*self.schema.names)).alias("digest"))

    def valid(self, keys: DataFrame, content: bool = True) -> DataFrame:
        """key: which of these are stored. content: whether rows are read and held against the ledger, or its entry is enough."""
        known = self.latest().join(keys.select("key").distinct(), "key", "left_semi")
        if not content:
            return known.select("key")
        return known.join(self.measured(keys), ["key", "n", "digest"], "left_semi").select("key")

    def fill(self, keys: DataFrame, compute: Callable[[DataFrame], DataFrame], content: bool = True) -> int:
        """Computes what is missing of keys (key and any other columns) and returns the number of this run.

        compute gets the rows of missing keys and returns rows of the result with key. A key without result rows
        stays missing.
        """
        run = (self.ledger().agg(F.max("run")).first()[0] or 0) + 1
        asked = keys.join(self.valid(keys, content), "key", "left_anti")
        # the missing keys are stored, since what is valid changes while rows are written
        asked.write.mode("overwrite").parquet(f"{self.root}/asked-{run}")
        missing = self.spark.read.schema(asked.schema).parquet(f"{self.root}/asked-{run}")
        if not missing.limit(1).count():
            return run
        made = compute(missing).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))
        if self.many:
            made.write.mode("overwrite").parquet(f"{self.root}/rows/run={run}")
            sums = self._sums(self.spark.read.schema(self.schema).parquet(f"{self.root}/rows/run={run}"))
        else:
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(f"{self.root}/rows")
            sums = self.measured(missing)
        sums.select("key", F.lit(run).alias("run"), "n", "digest").write.mode("append").parquet(f"{self.root}/ledger")
        return run

    def read(self, keys: DataFrame) -> DataFrame:
        """Each asked row with the stored rows of its key."""
        return keys.join(self.rows(), "key")
