"""Lexical retrieval packing.

Documents are tokenised once into the shared folder, then dealt into shards by a min-hash of their
id pairs (related texts meet; the key is completed by doc_id, so a hot key splits).  Each shard has
a BM25 inverted index over its ids, with document frequencies and mean length of the whole corpus.  A
seed opens a window; the index returns its unused neighbours, best first by all ids of the seed, which
fill the window greedily; the document that overflows is cut and its rest opens the next window.  What
is left at the end of a shard is cut into powers of two, so no id is padded.

Shards hold about SHARD_IDS ids, so a task's memory is bounded; a text of any length is cut into as
many windows as it needs and its shard grows by it.  Neighbours in other shards are not returned.
Null text is empty text (the end id alone).  Every row is packed, repeated rows and null keys too; of
equally good neighbours the earlier in the shard's order (min-hash, key, length) comes first.  An
empty table gives an empty result.  Extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import written
from loomwork.llm.tokens import encoder, slices

#: Ids of a shard; bounds a task's memory.  Rows of a shard: keys of (id, row) fit 32 bits.
SHARD_IDS, SHARD_ROWS = 4_000_000, 60_000
K1, B = 1.2, 0.75
#: Cells of the table in which a shard holds the weights of its commonest ids for all documents (in single precision, as scores are), and neighbours sorted at a time.
DENSE_CELLS, FIRST = 8 << 20, 32


def _width(path: str, end_id: int) -> str:
    """The narrowest of two unsigned types that holds all ids."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def tokenised(df: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, near long, n int, ids binary of unsigned 16- or 32-bit integers), the end id included."""

    def run(batches):
        code = _width(path, end_id)
        kind = np.dtype(code)
        for b in batches:
            for i, j in slices(b.column(1)):
                ids, size = encoder(path, code).encode(b.column(1).slice(i, j - i))
                ends = np.cumsum(size)
                ids = np.insert(ids, ends, end_id)
                size = size + 1
                start, last = np.cumsum(size) - size, np.cumsum(size) - 1
                h = ids.astype(np.uint32)
                h[:-1] = (h[:-1] * np.uint32(0x9E3779B1) ^ h[1:]) * np.uint32(0x85EBCA6B)
                h[last] = np.where(size > 1, np.uint32(0xFFFFFFFF), ids[last].astype(np.uint32))  # no pair reaches into the next text
                near = np.minimum.reduceat(h, start).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(size) * kind.itemsize]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(code).tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(near), pa.array(size.astype(np.int32)), raw, pa.array(np.full(j - i, kind.itemsize, np.int32))], ["k", "near", "n", "ids", "width"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind}, near long, n int, ids binary, width int")


def document_frequencies(ids: DataFrame) -> dict[int, int]:
    """How many of all documents hold each id; the vocabulary bounds what reaches the driver."""

    def run(batches):
        total, last = np.zeros(0, np.int64), np.zeros(1 << 16, np.int32)

        def distinct(own: np.ndarray) -> np.ndarray:
            nonlocal last
            if (most := own.max(initial=0)) >= len(last):
                last = np.zeros(2 * int(most), np.int32)
            place = np.arange(len(own), dtype=np.int32)
            last[own] = place  # one place of each id stays
            return own[last[own] == place]

        for b in batches:
            each = [distinct(np.frombuffer(raw.as_buffer(), "<u2" if width == 2 else "<u4")) for raw, width in zip(b.column(0), b.column(1).to_pylist())]
            own = np.bincount(np.concatenate(each), minlength=len(total)) if each else total[:0]
            own[: len(total)] += total[: len(own)]
            total = own if len(own) else total
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "c"])

    return {r.id: r.c for r in ids.select("ids", "width").mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()}


class Shard:
    """BM25 over the ids of some documents; ``idf`` by id and the ``mean`` length are those of the corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.docs = docs
        n = self.n = len(docs)
        size = np.array([len(d) for d in docs], dtype=np.int64)
        pair = np.concatenate(docs).astype(np.int64) * n + np.repeat(np.arange(n), size)
        if pair.max(initial=0) < 1 << 32:
            pair = pair.astype(np.uint32)
        pair, tf = np.unique(pair, return_counts=True)
        term, self.doc = np.divmod(pair.astype(np.int64), n)
        df = np.bincount(term)
        self.starts = np.concatenate([[0], np.cumsum(df)])
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc] / mean))).astype(np.float64)
        order = np.argsort(self.doc, kind="stable")
        self.of_doc = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=n))])
        self.terms = term[order]
        common = np.flatnonzero(df > n // 8)  # rows of these are added whole, which is faster than their lists
        common = common[np.argsort(-df[common], kind="stable")][: DENSE_CELLS // n]
        self.row, self.dense = np.full(len(df), -1), np.zeros((len(common), n), np.float32)
        self.row[common] = np.arange(len(common))
        for r, t in enumerate(common):
            own = slice(self.starts[t], self.starts[t + 1])
            self.dense[r, self.doc[own]] = self.weight[own]

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share an id with the seed, best first; all ids of the seed are asked."""
        terms = self.terms[self.of_doc[seed] : self.of_doc[seed + 1]]
        row = self.row[terms]
        spans = [slice(a, z) for a, z in zip(self.starts[terms[row < 0]], self.starts[terms[row < 0] + 1])]
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n).astype(np.float32) if spans else np.zeros(self.n, np.float32)
        for r in row[row >= 0]:
            score += self.dense[r]
        score *= unused
        left, take = np.flatnonzero(score), FIRST
        while len(left):  # a window takes few of them, so not all are sorted
            own = score[left]
            least = np.partition(own, len(own) - take)[len(own) - take] if len(own) > take else 0.0
            first = left[own >= least]
            yield from first[np.argsort(-score[first], kind="stable")].tolist()
            left, take = left[own < least], 8 * take


def pack_shard(docs: list[np.ndarray], window: int, idf: np.ndarray, mean: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every sequence is full but the last."""
    if not docs:
        return []
    index, unused = Shard(docs, idf, mean), np.ones(len(docs), dtype=bool)
    out, sequence, fill, after = [], 0, 0, 0
    carry: tuple[int, int] | None = None

    def place(doc: int, start: int) -> None:
        nonlocal sequence, fill, carry
        take = min(window - fill, len(docs[doc]) - start)
        out.append((doc, start, take, sequence, fill))
        fill += take
        carry = (doc, start + take) if start + take < len(docs[doc]) else None
        if fill == window:
            sequence, fill = sequence + 1, 0

    while True:
        if carry is None:
            while after < len(docs) and not unused[after]:
                after += 1
            if after == len(docs):
                return out
            unused[after] = False
            carry = (after, 0)
        seed = carry[0]
        while carry is not None:
            place(*carry)
        if fill:
            for d in index.neighbours(seed, unused):
                unused[d] = False
                place(d, 0)
                if not fill or carry is not None:
                    break


def cut_tail(pieces: list[tuple[int, int, int, int, int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """Cut the last sequence, if it isn't full, into sequences whose lengths are powers of two."""
    if not pieces or (total := pieces[-1][4] + pieces[-1][2]) == window:
        return pieces
    last = pieces[-1][3]
    out, tail = [p for p in pieces if p[3] < last], [p for p in pieces if p[3] == last]
    room, sequence, offset = 1 << total.bit_length() - 1, last, 0
    for doc, start, length, _, _ in tail:
        while length:
            take = min(length, room - offset)
            out.append((doc, start, take, sequence, offset))
            start, length, offset, total = start + take, length - take, offset + take, total - take
            if offset == room:
                sequence, offset, room = sequence + 1, 0, 1 << max(0, total.bit_length() - 1)
    return out


def pack(df: DataFrame, path: str, end_id: int = 1, window: int = 2048, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece."""
    ids = written(tokenised(df, path, end_id, key, text), "packing")
    size = ids.agg(F.sum("n").alias("ids"), F.count("*").alias("docs")).first()
    total = size.ids or 0
    parts = max(1, -(-total // SHARD_IDS))
    found = document_frequencies(ids)
    seen = np.zeros(max(found, default=0) + 1)
    seen[list(found)] = list(found.values())
    idf, mean = np.log1p((size.docs - seen + 0.5) / (seen + 0.5)), total / max(1, size.docs)
    kind = df.schema[key].dataType.simpleString()

    def block(rows: list[tuple], base: int) -> tuple[pa.RecordBatch, int]:
        docs = [np.frombuffer(r[1], "<u2" if r[2] == 2 else "<u4") for r in rows]
        pieces = cut_tail(pack_shard(docs, window, idf, mean), window)
        cols = list(zip(*pieces))
        own = [docs[d][s : s + n].astype("<u4") for d, s, n, _, _ in pieces]
        arrays = [pa.array([rows[d][0] for d in cols[0]], type=pa.int64() if kind == "bigint" else None), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()), pa.array([len(docs[d]) for d in cols[0]], pa.int64()), pa.array([base + s for s in cols[3]], pa.int64()), pa.array(cols[4], pa.int64())]
        names = ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            arrays, names = [*arrays, pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names), base + pieces[-1][3] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rows, held = TaskContext.get().partitionId() << 40, [], 0
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                rows.append(row)
                held += len(row[1]) // row[2]
                if held >= 2 * SHARD_IDS or len(rows) >= SHARD_ROWS:
                    made, base = block(rows, base)
                    yield made
                    rows, held = [], 0
        if rows:
            yield block(rows, base)[0]

    dealt = ids.repartitionByRange(parts, "near", "k").sortWithinPartitions("near", "k", "n").select("k", "ids", "width")
    schema = f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return dealt.mapInArrow(run, schema).withColumnRenamed("k", key)
