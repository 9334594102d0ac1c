"""Token-id files whose document boundaries are Elias-Fano encoded.

A folder holds ``part-NNNNN.tok`` files in ascending key order.  A file is: the ids of its documents
one after another in the narrowest of two or four bytes, then the keys, then the boundaries, then a
JSON footer, its length and a magic word.  Boundaries take about ``2 + log2(ids / documents)`` bits
each: low bits packed, high bits in unary, and a select sample every 256 documents from which any
offset is found without a table of 64-bit offsets.

Null text is empty text: such a document holds the end id alone.  Texts of any length are written
whole.  Repeated keys (ties) are kept in the order of the first 32 characters of their texts, then of
the input, and may lie in several files; null keys come first.  An empty table gives a folder of one empty file.  Extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import json
import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.tokens import encoder, slices

MAGIC = b"TOKEF001"
SAMPLE = 256
#: A file holds about so much text, and so many documents, so its keys and boundaries are bounded.
FILE_BYTES, FILE_DOCS = 64 << 20, 1 << 19
#: Characters of the texts by which rows with one key are ordered, before their places in the input.
TIE_CHARS = 32


class EliasFano:
    """A non-decreasing sequence of ``n`` integers below ``top + 1``."""

    def __init__(self, n: int, low: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lower, self.upper, self.samples = n, low, lower, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        high[at] = 1
        return cls(n, low, np.packbits(bits.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Place of the ``i``-th set bit of the upper part, from the sample before it."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        word = int(self.upper[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = int(self.upper[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        high, value = self.select(i) - i, 0
        for k in range(self.low):
            p = i * self.low + k
            value |= (int(self.lower[p >> 3]) >> (p & 7) & 1) << k
        return high << self.low | value

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.lower, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        return (high.astype(np.int64) << self.low) | (bits.astype(np.int64) << np.arange(self.low)).sum(axis=1, dtype=np.int64)

    def parts(self) -> tuple[dict, list[bytes]]:
        return {"n": self.n, "low": self.low}, [self.lower.tobytes(), self.upper.tobytes(), self.samples.tobytes()]

    @classmethod
    def read(cls, head: dict, parts: list[bytes]) -> EliasFano:
        return cls(head["n"], head["low"], np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], "<u4"))


class TokenFile:
    """Random access to one file."""

    def __init__(self, folder: str, name: str):
        store, root = fs.FileSystem.from_uri(folder)
        self.file = store.open_input_file(posixpath.join(root, name))
        size = self.file.size()
        tail = self.file.read_at(min(size, 16), max(0, size - 16))
        if tail[8:] != MAGIC:
            raise ValueError(f"{name} is no token file")
        n = int.from_bytes(tail[:8], "little")
        self.head = json.loads(self.file.read_at(n, size - 16 - n))
        at, parts = self.head["ids_bytes"], []
        for length in self.head["parts"]:
            parts.append(self.file.read_at(length, at))
            at += length
        self.keys = json.loads(zlib.decompress(parts[0]))
        self.bounds = EliasFano.read(self.head["bounds"], parts[1:])
        self.kind = np.dtype(self.head["dtype"])

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, i: int, j: int | None = None) -> np.ndarray:
        """Ids of documents ``i`` to ``j`` (excluded)."""
        a, b = self.bounds[i], self.bounds[i + 1 if j is None else j]
        return np.frombuffer(self.file.read_at((b - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind)


def write_files(df: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write token files in ascending key order and return the manifest, one row a file.

    Files go to ``folder`` (any URI that pyarrow opens) under a task's own name and are renamed when
    whole, so a lost or repeated task leaves one complete file.
    """
    spark = df.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        code = "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        name = f"part-{task.partitionId():05d}.tok"
        temporary = posixpath.join(root, f".{name}.{task.taskAttemptId()}")
        keys, bounds, total = [], [np.zeros(1, np.int64)], 0
        with store.open_output_stream(temporary) as out:
            for b in batches:
                keys += b.column(0).to_pylist()
                for i, j in slices(b.column(1)):
                    ids, size = encoder(path, code).encode(b.column(1).slice(i, j - i))
                    out.write(np.insert(ids, np.cumsum(size), end_id).astype(code).tobytes())
                    bounds.append(total + np.cumsum(size + 1))
                    total = int(bounds[-1][-1])
            head, parts = EliasFano.of(np.concatenate(bounds)).parts()
            parts.insert(0, zlib.compress(json.dumps(keys).encode()))
            for p in parts:
                out.write(p)
            footer = json.dumps({"dtype": code, "ids_bytes": total * np.dtype(code).itemsize, "parts": [len(p) for p in parts], "bounds": head}).encode()
            out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        store.move(temporary, posixpath.join(root, name))
        yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "file": name, "docs": len(keys), "ids": total}], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    texts = df.select(df[key].alias("k"), df[text].alias("t"))
    size = texts.agg(F.sum(F.octet_length("t")).alias("b"), F.count("*").alias("n")).first()
    spread = min(2 * spark.sparkContext.defaultParallelism, (size.b or 0) >> 20)  # small tables still use all cores
    files = max(1, spread, -(-(size.b or 0) // FILE_BYTES), -(-size.n // FILE_DOCS))  # a file's keys and boundaries fit a task
    order = ["k", "p", "u"]  # a key of many rows is dealt into many files too
    dealt = texts.withColumns({"p": F.substring("t", 1, TIE_CHARS), "u": F.monotonically_increasing_id()}).repartitionByRange(files, *order).sortWithinPartitions(*order).select("k", "t")
    made = dealt.mapInArrow(run, "shard int, file string, docs long, ids long").collect()  # a row a file, as a commit protocol keeps
    rows, start = [], 0
    for r in sorted(made, key=lambda r: r.shard):
        rows.append((r.shard, r.file, r.docs, r.ids, start))
        start += r.ids
    with store.open_output_stream(posixpath.join(root, "manifest.json")) as out:
        out.write(json.dumps([dict(zip(("shard", "file", "docs", "ids", "start"), r)) for r in rows]).encode())
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, file, docs, ids, start) of a folder's files; ``start`` counts the ids of all files before."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(posixpath.join(root, "manifest.json")) as f:
        rows = json.loads(f.read())
    data = [tuple(r[c] for c in ("shard", "file", "docs", "ids", "start")) for r in rows]
    return spark.createDataFrame(data, "shard int, file string, docs long, ids long, start long").repartition(max(1, len(data)), "shard") if data else spark.createDataFrame([], "shard int, file string, docs long, ids long, start long")


def read_files(spark: SparkSession, folder: str, key: str = "doc_id", kind: str = "long", digest: bool = False) -> DataFrame:
    """Documents of a folder: (key, start, n_tokens, ids array<int>), or with ``digest`` ids_crc32 for the ids."""
    value = "ids_crc32 long" if digest else "ids array<int>"

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                f = TokenFile(folder, row["file"])
                at = f.bounds.all()
                for i in range(0, len(f), 1024):
                    j = min(len(f), i + 1024)
                    own = at[i : j + 1]
                    ids = f.ids(i, j).astype("<u4")
                    each = [ids[a:b] for a, b in zip(own - own[0], own[1:] - own[0])]
                    last = pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(f.keys[i:j], pa.int64() if kind == "long" else pa.string()), pa.array(own[:-1] + row["start"], pa.int64()), pa.array(np.diff(own), pa.int64()), last], ["k", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return manifest(spark, folder).mapInArrow(run, f"k {kind}, start long, n_tokens long, {value}").withColumnRenamed("k", key)
