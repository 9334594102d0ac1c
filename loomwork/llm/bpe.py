"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a token resolves
with one probe and one comparison.  Tier two takes the misses: a heap of adjacent pairs over a
linked list of byte runs, lowest rank first and leftmost on a tie, as rank-file tokenizers merge.

Null text encodes as empty text (no ids).  Texts of any length are encoded whole.  Repeated rows get equal
results, null keys are kept, columns of any other name are left out, and an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from loomwork.llm.tokens import slices


class PerfectHash:
    """Minimal perfect hash of byte strings by hash-and-displace; ``slot`` of a stranger is some slot."""

    def __init__(self, keys: list[bytes], load: int = 4):
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // load)
        self.shift = [0] * self.buckets
        groups: dict[int, list[bytes]] = {}
        for k in keys:
            groups.setdefault(xxhash.xxh3_64_intdigest(k) % self.buckets, []).append(k)
        taken, free = bytearray(n), 0
        for b, own in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:
                while taken[free]:
                    free += 1
                taken[free] = 1
                self.shift[b] = -free - 1
                continue
            d = 0
            while True:
                at = {self._place(xxhash.xxh3_64_intdigest(k), d) for k in own}
                if len(at) == len(own) and not any(taken[i] for i in at):
                    break
                d += 1
            for i in at:
                taken[i] = 1
            self.shift[b] = d

    def _place(self, h: int, d: int) -> int:
        return ((h >> 24) ^ ((d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFF)) % self.n

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -d - 1 if d < 0 else self._place(h, d)


class RankBPE:
    """Encoder and decoder of a rank file; ``cache`` bounds the pre-tokens remembered by a worker."""

    def __init__(self, path: str, pattern: str, cache: int = 500_000):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = PerfectHash(list(self.ranks))
        self.slots: list[tuple[bytes, int]] = [(b"", -1)] * self.whole.n
        for k, r in self.ranks.items():
            self.slots[self.whole.slot(k)] = (k, r)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for k, r in self.ranks.items():
            self.bytes_of[r] = k
        self.split = regex.compile(pattern).findall
        self.limit, self.known = cache, {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token itself."""
        n, get = len(piece), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, e = heappop(heap)
            m = end[i]
            if not m or m >= n or end[m] != e:
                continue  # one of the two runs has been merged since
            end[i], end[m] = e, 0
            if e < n:
                before[e] = i
                if (r := get(piece[i : end[e]])) is not None:
                    heappush(heap, (r, i, end[e]))
            p = before[i]
            if p >= 0 and (r := get(piece[p:e])) is not None:
                heappush(heap, (r, p, e))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def piece(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        key, rank = self.slots[self.whole.slot(raw)]
        return np.array([rank] if key == raw else self.merge(raw), dtype="<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        known, pieces = self.known, self.split(text)
        if len(known) > self.limit:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = self.piece(p)
        return np.frombuffer(b"".join(map(known.__getitem__, pieces)), dtype="<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> RankBPE:
    """One coder a worker process."""
    return RankBPE(path, pattern)


def encode_ids(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row; extra columns are left out, repeated rows stay."""

    def run(batches):
        bpe = coder(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                ids = [pa.array(bpe.encode(t or "").astype(np.int32)) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array([x.to_numpy() for x in ids], type=pa.list_(pa.int32()))], ["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode_ids(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, raw binary) of every row; null ids give empty bytes."""

    def run(batches):
        bpe = coder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or ()) for x in b.column(1).to_pylist()], type=pa.binary())], ["k", "raw"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("k"), df[ids].alias("t")).mapInArrow(run, f"k {kind}, raw binary").withColumnRenamed("k", key)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every row in one pass: (key, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches):
        bpe = coder(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            n, sha_ids, sha_raw = [], [], []
            for t in texts:
                ids = bpe.encode(t or "").tolist()
                n.append(len(ids))
                sha_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                sha_raw.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_raw, pa.string())], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("k", key)
