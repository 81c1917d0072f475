"""Token-id shards with Elias-Fano document boundaries.

A shard file is

    magic "RLTOK1\\0\\0", then eight little-endian u64: documents, null ids,
    tokens, bytes an id, first doc_id + 2**63, and the byte lengths of the
    three sections that follow;
    section 1: Elias-Fano code of the documents' end offsets;
    section 2: Elias-Fano code of doc_id - first doc_id;
    section 3: the concatenated ids.

Elias-Fano keeps n increasing numbers below u in about n * (2 + log2(u / n))
bits: the low bits are packed one after another, and the high parts are set in
unary in a bit array.  Every 64th set bit's place is kept as a sample, so
``select`` reads the offset of one document from a few words and no table of
64-bit offsets exists.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path, small_batches
from .tokens import Encoder, crc_of

MAGIC = b"RLTOK1\0\0"
SAMPLE = 64
ROWS_AT_ONCE = 8192
_COLUMNS = ["doc_id", "start", "n_tokens", "ids_crc32"]
MANIFEST = "shard long, path string, n_docs long, n_tokens long, file_bytes long"


class EliasFano:
    """A non-decreasing sequence of numbers below ``universe``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.empty(0, np.uint8)
        if bits and n:
            parts = v & np.uint64((1 << bits) - 1)
            low = np.packbits((parts[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1) > 0, bitorder="little")
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        parts = self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()
        return struct.pack("<QQQQQ", self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, a, b, c = struct.unpack_from("<QQQQQ", data)
        raw = np.frombuffer(data, np.uint8, a + b + c, 40)
        return cls(n, bits, raw[:a], raw[a : a + b], np.frombuffer(data, "<u4", c // 4, 40 + a + b))

    def select(self, k: int) -> int:
        """The k-th number, from the nearest sample on."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        place, left = int(self.samples[k // SAMPLE]), k % SAMPLE
        byte = place >> 3
        word = int(self.high[byte]) >> (place & 7) << (place & 7)
        left += 1
        while True:
            ones = word.bit_count()
            if left <= ones:
                break
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left - 1):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        return ((place - k) << self.low_bits) | self._low(k)

    def _low(self, k: int) -> int:
        a = k * self.low_bits
        b = a + self.low_bits
        chunk = int.from_bytes(self.low[a >> 3 : (b + 7) >> 3].tobytes(), "little")
        return (chunk >> (a & 7)) & ((1 << self.low_bits) - 1)


def shard_bytes(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """Encodes documents sorted by id, nulls first."""
    dtype = docs[0].dtype if docs else np.dtype("<u2")
    known = np.array([d for d in doc_ids if d is not None], object)
    first = int(known[0]) if len(known) else 0
    ends = EliasFano.build(np.cumsum([len(d) for d in docs])).to_bytes()
    ids = EliasFano.build(np.array([int(d) - first for d in known], np.uint64)).to_bytes()
    body = np.concatenate(docs).tobytes() if docs else b""
    head = struct.pack(
        "<8Q", len(docs), len(docs) - len(known), len(body) // dtype.itemsize, dtype.itemsize, first + 2**63, len(ends), len(ids), len(body)
    )
    return MAGIC + head + ends + ids + body


class Shard:
    """Random access to one shard's documents."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        n, self.nulls, self.tokens, width, first, a, b, c = struct.unpack_from("<8Q", data, 8)
        if len(data) != 72 + a + b + c:
            raise ValueError("the shard is cut short")
        self.n, self.first = n, first - 2**63
        self.ends = EliasFano.from_bytes(data[72 : 72 + a])
        self.ids = EliasFano.from_bytes(data[72 + a : 72 + a + b])
        self.body = np.frombuffer(data, f"<u{width}", offset=72 + a + b)

    def doc_id(self, k: int) -> int | None:
        return None if k < self.nulls else self.ids.select(k - self.nulls) + self.first

    def span(self, k: int) -> tuple[int, int]:
        return (self.ends.select(k - 1) if k else 0), self.ends.select(k)

    def rows(self, first: int, last: int, base: int) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start, tokens, crc32) of documents ``first`` to ``last``, exclusive, after ``base`` ids of other shards."""
        a = self.span(first)[0]
        for k in range(first, last):
            b = self.ends.select(k)
            yield self.doc_id(k), base + a, b - a, crc_of(self.body[a:b])
            a = b

    def tokens_of(self, k: int) -> np.ndarray:
        a, b = self.span(k)
        return self.body[a:b]


def _store(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _writer(folder: str, tokenizer: str, end_id: int, shard_tokens: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder = Encoder.of(tokenizer, False)
        store, root = _store(folder)
        ids: list[int | None] = []
        docs: list[np.ndarray] = []
        size, made = 0, 0

        def flush() -> pd.DataFrame:
            nonlocal made
            data = shard_bytes(ids, docs)
            shard = (task.partitionId() << 24) + made
            made += 1
            name = f"{shard:016d}.tok"
            # An attempt writes under its own name; the move puts a whole file in place, also when a task runs again.
            own = f"{root}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(own) as out:
                out.write(data)
            store.move(own, f"{root}/{name}")
            return pd.DataFrame([(shard, f"{folder}/{name}", len(docs), size, len(data))], columns=[c.split()[0] for c in MANIFEST.split(", ")])

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                ids.append(None if doc_id is pd.NA else int(doc_id))
                docs.append(encoder.encode(text, end_id))
                size += len(docs[-1])
                if size >= shard_tokens:
                    yield flush()
                    ids, docs, size = [], [], 0
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, shard_tokens: int = 1 << 24) -> DataFrame:
    """Writes every text's ids to shard files in ascending order of doc_id; returns the manifest, one row per shard.

    A null or empty text is the end id alone.  Null doc_ids come first, and rows
    of one doc_id are ordered by a hash of their text.  An empty table writes no
    shard.  Range partitions deal texts by id, so only one partition's current
    shard is in memory.
    """
    spark = docs.sparkSession
    small_batches(spark)
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = dealt.mapInPandas(_writer(folder, tokenizer, end_id, shard_tokens), MANIFEST).toPandas()
    found = found.sort_values("shard", ignore_index=True)
    return spark.createDataFrame(found, MANIFEST) if len(found) else spark.createDataFrame([], MANIFEST)


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, base in zip(pdf["path"], pdf["start"]):
            store, at = _store(path)
            with store.open_input_stream(at) as f:
                shard = Shard(f.read())
            # Offsets come one by one from the select structures; a table of them is never made.
            for k in range(0, shard.n, ROWS_AT_ONCE):
                yield pd.DataFrame(list(shard.rows(k, min(shard.n, k + ROWS_AT_ONCE), int(base))), columns=_COLUMNS).astype({"doc_id": "Int64"})


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Reads the shards back: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document."""
    spark: SparkSession = manifest.sparkSession
    shards = manifest.toPandas().sort_values("shard", ignore_index=True)  # one row per shard file
    shards["start"] = shards["n_tokens"].cumsum() - shards["n_tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not len(shards):
        return spark.createDataFrame([], schema)
    dealt = spark.createDataFrame(shards[["path", "start"]]).repartition(len(shards))
    return dealt.mapInPandas(_reader, schema)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the shards to the shared folder and returns what they hold."""
    return read_tokens(write_tokens(docs, new_path(docs.sparkSession, "tokens"), tokenizer, end_id))
