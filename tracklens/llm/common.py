"""Shared plumbing of the text operators: Arrow batches, shared folders, words."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one call of a batch function gets at most (a longer text comes alone).
CHUNK_BYTES = 2 << 20
#: Bytes by which the driver's heap may grow between two tables before it is freed.
HEAP_GROWTH = 96 << 20
#: Entries of a worker's word cache before it starts anew.
CACHE_WORDS = 300_000

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. A folder of our own only in local mode, where driver and tasks share one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="tracklens-")
        import shutil

        atexit.register(shutil.rmtree, _own["dir"].removeprefix("file://"), True)
    return _own["dir"]


def drop(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch:
    """Tables of one operator call in the shared folder: written once, read often, found again after lost executors.

    Results are lazy and read them, so they stay until the workspace() around the call ends, or else until the
    Python process does.
    """

    #: The driver's heap when it was last freed.
    _held = 0

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _scratches.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if self._heap() - Scratch._held > HEAP_GROWTH:
            self.free()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        drop(self.spark, f"{self.root}/{name}" if name else self.root)

    def free(self) -> None:
        """Lets the driver clean shuffle files of jobs that are over and give back what their plans took of its memory."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()
        Scratch._held = self._heap()

    def _heap(self) -> int:
        return self.spark._jvm.Runtime.getRuntime().totalMemory()


_scratches: list[Scratch] = []


@contextmanager
def workspace() -> Iterator[None]:
    """Drops at its end the intermediate tables of all operators called inside. Write or collect their results before."""
    before = len(_scratches)
    try:
        yield
    finally:
        for s in _scratches[before:]:
            s.drop()
        del _scratches[before:]


@atexit.register
def _drop_all() -> None:
    for s in _scratches:
        try:
            if s.spark.sparkContext._jsc is not None and not s.spark.sparkContext._jsc.sc().isStopped():
                s.drop()
        except Exception:  # the session may be gone already
            return


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string, nothing else: other columns may clash with ours."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def chunks(batch: pa.RecordBatch, at: int | None = 0, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `most` bytes of text in column `at`, whatever the session's batch size."""
    n, start = batch.num_rows, 0
    sizes = None if at is None else pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    while start < n:
        end, held = start + 1, 0 if sizes is None else sizes[start]
        while end < n and (sizes is None or held + sizes[end] <= most):
            held += 0 if sizes is None else sizes[end]
            end += 1
        yield batch.slice(start, end - start)
        start = end


def map_batches(
    df: DataFrame,
    func: Callable[..., dict[str, list]],
    schema: str | T.StructType,
    text: str = "text",
    init: Callable | None = None,
    most: int = CHUNK_BYTES,
    arrow_text: bool = False,
) -> DataFrame:
    """func gets the columns of df as lists, a bounded number of text bytes a call, and returns columns by name.

    init, if given, runs once a task; its result is func's first argument. most: text bytes a call. arrow_text: the text comes as
    an Arrow array.
    """
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = arrow_schema(schema)
    names, at = df.columns, df.columns.index(text) if text in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = (init(),) if init else ()
        for batch in batches:
            for part in chunks(batch, at, most):
                out = func(*head, *(c if arrow_text and i == at else c.to_pylist() for i, c in enumerate(part.columns)))
                if out is not None:
                    made = pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
                    if made.num_rows:
                        yield made

    return df.select(*names).mapInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def split_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """(text of each word, its number among the distinct words, the distinct words) by white space as str.split() has it; "" may be among them."""
    split = pc.utf8_split_whitespace(text)
    words = split.flatten().dictionary_encode()
    size = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(size)), size), words.indices.to_numpy(), words.dictionary


def spread(size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of the given sizes stand one after the other: (how many entries each wanted list has, their places)."""
    n = size[which]
    first = np.cumsum(size) - size
    return n, np.repeat(first[which] - np.cumsum(n) + n, n) + np.arange(n.sum())


class WordHash(dict):
    """64-bit hash of each word (bytes), kept while the table is small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


#: One a worker process.
WORD_HASH = WordHash()

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: A-Z to a-z, and every ASCII character that is neither letter nor digit to a space.
FOLD = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Runs of [^\\x20\\x09-\\x0D], unchanged."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
