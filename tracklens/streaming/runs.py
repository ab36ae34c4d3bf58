"""Running streams: files in, files out, with the state and checkpoints in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..scratch import Scratch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """A store that holds list, map and timer states, for streams started inside; the session's setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def follow(stream: DataFrame, path: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Writes what a stream gives to files at path, a micro-batch every so often, until stopped."""
    with state_store(stream.sparkSession):
        return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same for all that is there now; a later run with the same checkpoint goes on from there."""
    with state_store(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def replayed(rows: DataFrame, operator, n_files: int = 12, files_a_batch: int = 4, name: str = "stream") -> DataFrame:
    """operator(stream) of rows that arrive in files, mixed by hash, a few files a micro-batch."""
    scratch = Scratch(rows.sparkSession, name)
    rows.repartition(n_files).write.parquet(scratch.path("in"))
    stream = rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_a_batch).parquet(scratch.path("in"))
    made = operator(stream)
    available(made, scratch.path("out"), scratch.path("checkpoint"))
    return rows.sparkSession.read.schema(made.schema).parquet(scratch.path("out"))
