"""Token ids of whole texts by a public tokenizer, and a file format for them.

encode_texts() gives the ids that the tokenizers library gives. The library is asked once for each distinct
word and worker, and a word is looked up once a batch of texts: the vocabulary's pre-tokenizer never joins characters across white space, and its normalizer
works on single characters below U+0300, so a text's ids are its words' ids in a row. Every word for which
that does not hold (other scripts, special tokens) and every text with U+001C-U+001F goes to the library whole.

write_ids() stores ids at a path as records of concatenated ids; document boundaries and doc_ids of a record are
Elias-Fano sequences. open_ids() finds a store again. read_ids() reads all documents and ids_of() single ones, both
through select: no 64-bit table of offsets is written or unpacked.

Defined cases: a null or empty text has no ids but the end id; null doc_ids come first, rows with equal doc_id in
the order of their texts; negative doc_ids are stored as any others; a text of any length is one document of one
record; other columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_batches, split_words, spread, texts

#: Ids and documents of one record of the store at most (a longer document has a record of its own).
RECORD_IDS, RECORD_DOCS = 1 << 20, 4096
#: Text bytes that are encoded at a time: the more, the more often a word is met again.
ENCODE_BYTES = 12 << 20
#: Words that a worker keeps with their ids before it starts anew.
CACHE = 400_000

_ODD = re.compile("[\x1c-\x1f]")
_LATIN = re.compile("[\x00-ɏ]*")
_ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The usual letters of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """What make() gives for a key, kept in two halves: when one is full the other one goes, but for what was asked for meanwhile."""

    def __init__(self):
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE // 2:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class _Parts(_Cache):
    def __init__(self, model, dtype):
        super().__init__()
        self.model, self.kind, self.letters = model, "H" if dtype.itemsize == 2 else "I", _byte_letters()

    def make(self, part: str) -> bytes:
        letters = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(self.letters)
        return array(self.kind, [t.id for t in self.model.tokenize(letters)]).tobytes()


class Encoder(_Cache):
    """word -> its ids as bytes. One a worker and vocabulary file."""

    def __init__(self, path: str):
        import os

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.parts = _Parts(self.tokenizer.model, self.dtype)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)").search
        #: The short way is written for vocabularies with this normalizer and these word ends; others go to the library whole.
        import json

        spec = json.loads(self.tokenizer.to_str())
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.short = kinds == ["NFC", "Replace", "Lowercase"] and spec["pre_tokenizer"].get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex") == _PARTS.pattern and spec["model"].get("end_of_word_suffix") == "</w>"

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def make(self, word: str) -> bytes:
        if self.special(word) or not _LATIN.fullmatch(word):
            return self.library(word)
        low = word.lower()
        if low.isalpha():  # one part
            return self.parts[low]
        return b"".join(map(self.parts.__getitem__, (_ASCII_PARTS if low.isascii() else _PARTS).findall(low)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.short or _ODD.search(text):
            return self.library(text)
        return b"".join(map(self.__getitem__, text.split()))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """encode() of each text; a word is looked up once, however often the texts have it."""
        if not self.short or pc.any(pc.match_substring_regex(texts, _ODD.pattern)).as_py():
            return [self.encode(t) for t in texts.to_pylist()]
        text, which, words = split_words(texts)
        found = list(map(self.__getitem__, words.to_pylist()))
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        n, places = spread(size, which)
        ids = np.frombuffer(b"".join(found), self.dtype)[places]
        ends = np.cumsum(np.bincount(text, n, len(texts)).astype(np.int64)).tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits an entry, read by select.

    Layout: n, universe (two u64), low bits packed, upper parts in unary as a bit vector, and the position of
    every SAMPLE-th one bit (u64), from which select(i) scans at most SAMPLE ones.
    """

    SAMPLE = 256

    def __init__(self, n: int, universe: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.universe, self.low, self.high, self.samples = n, universe, low, high, samples
        self.bits = self.low_bits(n, universe)

    @staticmethod
    def low_bits(n: int, universe: int) -> int:
        return max(0, (universe // n).bit_length() - 1) if n else 0

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, universe = len(v), int(v[-1]) + 1 if len(v) else 0
        bits = cls.low_bits(n, universe)
        low = b""
        if bits:
            low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = ((v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        bitmap = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bitmap[ones] = 1
        return cls(n, universe, low, np.packbits(bitmap, bitorder="little").tobytes(), ones[:: cls.SAMPLE].astype("<u8"))

    def select(self, i: int) -> int:
        """Entry i."""
        at = int(self.samples[i // self.SAMPLE])
        left, byte = i % self.SAMPLE, at >> 3
        word = self.high[byte] & (0xFF << (at & 7))
        while (c := word.bit_count()) <= left:
            left, byte = left - c, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        upper = byte * 8 + (word & -word).bit_length() - 1 - i
        low = 0
        for b in range(self.bits):
            p = i * self.bits + b
            low |= (self.low[p >> 3] >> (p & 7) & 1) << b
        return upper << self.bits | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n].astype(np.uint64)
        v = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.bits)
        if self.bits:
            b = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits)
            v |= (b.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1).astype(np.uint64)
        return v.astype(np.int64)

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQ", self.n, self.universe, len(self.low), len(self.high)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> EliasFano:
        n, universe, a, c = struct.unpack_from("<QQQQ", b)
        return cls(n, universe, b[32 : 32 + a], b[32 + a : 32 + a + c], np.frombuffer(b, "<u8", offset=32 + a + c))


#: A record: its place (range partition, number, ids before it there), its documents (the first `n_null` have no
#: doc_id; the others' doc_ids less `first_id`), their boundaries, and the ids.
STORE = "part int, record long, before long, n_docs long, n_ids long, n_null long, first_id long, doc_ids binary, bounds binary, width int, ids binary"


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None) -> DataFrame:
    """Writes the store of all documents in ascending doc_id order to `path` and opens it; end_id closes each document.

    One range exchange of the texts; each task then encodes its range in order and writes records of bounded size.
    """
    ordered = texts(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    tail = b"" if end_id is None else None

    def start():
        return {"part": TaskContext.get().partitionId(), "record": 0, "before": 0}

    def encode(state: dict, doc_id: list, text: pa.Array) -> dict[str, list]:
        enc = encoder(vocabulary)
        end = tail if tail is not None else np.array([end_id], enc.dtype).tobytes()
        width, out = enc.dtype.itemsize, {k: [] for k in ("part", "record", "before", "n_docs", "n_ids", "n_null", "first_id", "doc_ids", "bounds", "width", "ids")}

        def flush(ids: list[int | None], parts: list[bytes]) -> None:
            lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // width
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            real = [i for i in ids if i is not None]  # nulls are first
            first = real[0] if real else 0
            own = EliasFano.build(np.array([i - first for i in real], np.uint64)).to_bytes()
            for k, v in (("part", state["part"]), ("record", state["record"]), ("before", state["before"]), ("n_docs", len(ids)), ("n_ids", int(bounds[-1])), ("n_null", len(ids) - len(real)), ("first_id", first), ("doc_ids", own), ("bounds", EliasFano.build(bounds).to_bytes()), ("width", width), ("ids", b"".join(parts))):
                out[k].append(v)
            state["record"] += 1
            state["before"] += int(bounds[-1])

        ids, parts, held = [], [], 0
        for i, b in zip(doc_id, enc.encode_all(text), strict=True):
            b += end
            if ids and (held + len(b) > RECORD_IDS * width or len(ids) >= RECORD_DOCS):
                flush(ids, parts)
                ids, parts, held = [], [], 0
            ids.append(i)
            parts.append(b)
            held += len(b)
        if ids:
            flush(ids, parts)
        return out

    map_batches(ordered, encode, STORE, init=start, most=ENCODE_BYTES, arrow_text=True).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return open_ids(docs.sparkSession, path)


def open_ids(spark: SparkSession, path: str) -> DataFrame:
    """The store at a path that write_ids() wrote."""
    return spark.read.schema(STORE).parquet(path)


class Record:
    """The documents of one stored record, found by select."""

    def __init__(self, n_null: int, first_id: int, doc_ids: bytes, bounds: bytes, width: int, ids: bytes):
        self.n_null, self.first_id, self.names, self.bounds = n_null, first_id, EliasFano.from_bytes(doc_ids), EliasFano.from_bytes(bounds)
        self.flat = np.frombuffer(ids, f"<u{width}")

    def __len__(self) -> int:
        return self.bounds.n - 1

    def doc_id(self, k: int) -> int | None:
        return None if k < self.n_null else self.first_id + self.names.select(k - self.n_null)

    def span(self, k: int) -> tuple[int, int]:
        return self.bounds.select(k), self.bounds.select(k + 1)

    def find(self, doc_id: int) -> range:
        """Numbers of the documents with this doc_id, by bisection over select."""
        at = lambda x: bisect.bisect_left(range(self.names.n), x, key=self.names.select)
        wanted = doc_id - self.first_id
        return range(self.n_null + at(wanted), self.n_null + at(wanted + 1)) if wanted >= 0 else range(0)


_FIELDS = ["n_null", "first_id", "doc_ids", "bounds", "width", "ids"]


def read_ids(store: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the records alone."""
    spark: SparkSession = store.sparkSession
    per_part = store.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row a range partition
    base, total = {}, 0
    for r in per_part:
        base[r.part], total = total, total + r.n
    shared = spark.sparkContext.broadcast(base)

    def decode(part: list, before: list, *fields: list) -> dict[str, list]:
        out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
        for p, skip, *own in zip(part, before, *fields, strict=True):
            record = Record(*own)
            for k in range(len(record)):
                at, end = record.span(k)
                out["doc_id"].append(record.doc_id(k))
                out["start"].append(shared.value[p] + skip + at)
                out["n_tokens"].append(end - at)
                out["ids_crc32"].append(crc(record.flat[at:end]))
        return out

    return map_batches(store.select("part", "before", *_FIELDS), decode, "doc_id long, start long, n_tokens long, ids_crc32 long", text="ids")


def ids_of(store: DataFrame, wanted: list[int]) -> DataFrame:
    """doc_id, ids of the wanted documents (a row each copy); no other boundaries are looked at."""
    look = sorted(set(wanted))

    def decode(*fields: list) -> dict[str, list]:
        out = {"doc_id": [], "ids": []}
        for own in zip(*fields, strict=True):
            record = Record(*own)
            for doc in look:
                for k in record.find(doc):
                    at, end = record.span(k)
                    out["doc_id"].append(doc)
                    out["ids"].append(record.flat[at:end].tolist())
        return out

    from_ = F.lit(look[-1] if look else 0) >= F.col("first_id")  # records are in ascending order
    return map_batches(store.where(from_).select(*_FIELDS), decode, "doc_id long, ids array<long>", text="ids")


def op8(spark, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'token-ids').root}/ids"
    return read_ids(write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_vocabulary(), end_id=2))
