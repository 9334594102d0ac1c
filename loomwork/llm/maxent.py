"""Language-model scores from exact counts and a hashed maximum-entropy model.

Counts: all training words are counted by Spark.  A bounded list of the most frequent words goes to
every task; other words of a document meet their counts in a shuffled join, so no table of words is
broadcast.

Model: the next token's class, then the token in its class, each by a softmax over 32 outcomes whose
logits sum rows of a hashed table: a bias, the word before, the pair before, and the word two back
(skip).  Words outside the head share one outcome, times their share of the words outside it.
Weights start from the counts and learn by distributed gradient updates: in each round every task
runs AdaGrad over its documents and the weighted mean of their tables is the next start.  Counts and
gradient rounds use all training documents.  Arrow splits and numbers the words of whole columns, and
equal contexts of a batch are evaluated once.

The rows of the hashed tables and the codes of words outside the head grow with the square root of
the training tokens (``table_rows``), up to what a task can hold; the head's size is fixed.  The number
of tasks over which weights are averaged follows from the training tokens, not from the cores.

Null text is empty text: one token, the end.  Texts of any length are scored whole.  Of words with
equal counts the smaller bytes enter the head.  Repeated rows get equal results; null keys are kept
and never learned from.  With no training rows all counts are 0 and the scores those of the smoothing;
an empty table gives an empty result.  Extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import written
from loomwork.llm.tokens import slices, strings

#: Outcomes of either softmax; the head holds CLASSES * CLASSES tokens: outside, end, then words.
CLASSES = 32
HEAD = CLASSES * CLASSES
OTHER, END = 0, 1
#: Powers of two between which the rows of the two hashed tables, above their bias rows, grow.
LEAST_ROWS, MOST_ROWS = 1 << 14, 1 << 18
#: Tokens of a gradient step, and its rate in the first round.
STEP, RATE = 8192, 0.3
#: Tokens scored at a time: their logits stay in the processor's cache.
SCORED = 1 << 15
#: Logits below this in size are neither too large nor too small for sums of their exponentials in single precision.
SAFE = 80
#: Groups of tasks whose weights are summed before the last sum.
GROUPS = 64
#: Most words in the list that every task gets.
FREQUENT = 1 << 16
BLOCKS = 16
#: Training tokens of a task for each row of a table: its weights, which are sent once, stay small beside its texts.
TASK_TOKENS = 128


def table_rows(tokens: int) -> int:
    """Rows of a hashed table: about twice the square root of the training tokens, as a power of two."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << (2 * int(tokens**0.5)).bit_length()))


def words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The numbered words of all texts one after another (A-Z lower-cased, cut at ASCII white space), and how many each has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, at = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at either end leaves an empty word
    size = np.diff(np.concatenate([[0], np.cumsum(full)])[at])
    return flat.filter(pa.array(full)).dictionary_encode(), size


def count_words(df: DataFrame, text: str = "text") -> DataFrame:
    """(w string, c long) of all rows."""

    def run(batches):
        for b in batches:
            for i, j in slices(b.column(0), 4_000_000):
                coded, _ = words(b.column(0).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))], ["w", "c"])

    return df.select(df[text].alias("t")).mapInArrow(run, "w string, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Codes:
    """Word → token in the head or OTHER, code as context, and count (-1 if only the join knows it)."""

    def __init__(self, head: list[str], frequent: dict[str, int], rows: int):
        self.rows, self.buckets = rows, rows // 4
        self.width = HEAD + self.buckets  # codes of contexts
        self.known = {w: (OTHER, self.bucket(w), c) for w, c in frequent.items()} | {w: (i, i, frequent[w]) for i, w in enumerate(head, 2)}
        self.places = dict(zip(self.known, range(len(self.known))))  # word → row of the table
        self.table = np.array(list(self.known.values()), np.int64).reshape(-1, 3)

    def bucket(self, w: str) -> int:
        return HEAD + zlib.crc32(w.encode("utf-8", "surrogatepass")) % self.buckets

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray, np.ndarray]:
        """Tokens, context codes and counts of all texts with an end after each, the places of the ends, the words, and the unknown ones among these."""
        coded, size = words(texts)
        names = strings(coded.dictionary)
        at = np.fromiter(map(self.places.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        found = np.empty((len(names), 3), np.int64)
        found[:] = OTHER, 0, -1
        found[at >= 0] = self.table[at[at >= 0]]
        raw = coded.dictionary.take(pa.array(new)).cast(pa.binary())
        found[new, 1] = HEAD + np.fromiter(map(zlib.crc32, raw.to_numpy(zero_copy_only=False)), np.int64, len(new)) % self.buckets
        own = found[coded.indices.to_numpy()]
        ends = np.cumsum(size + 1) - 1
        all_ = np.empty((len(own) + len(size), 3), np.int64)
        inner = np.ones(len(all_), bool)
        inner[ends] = False
        all_[inner], all_[ends] = own, (END, END, 0)
        return all_[:, 0].copy(), all_[:, 1].copy(), all_[:, 2].copy(), ends, coded, own[:, 2] < 0


def contexts(code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes one and two tokens back; 1 (an end) before a text's start. ``ends``: places of the ends."""
    one = np.concatenate([[END], code[:-1]])
    two = np.concatenate([[END, END], code[:-2]]) if len(code) > 1 else np.array([END] * len(code))
    start = np.concatenate([[0], ends[:-1] + 1])
    two[start] = END
    after = start + 1
    two[after[after < len(code)]] = END
    return one, two


def features(one: np.ndarray, two: np.ndarray, branch: np.ndarray | int, bias: int, rows: int) -> np.ndarray:
    """Rows of a table for each context: bias, word before, pair before, skip."""
    h = lambda x, k: (((x * 0x9E3779B1 + branch * 0x85EBCA6B + k * 0xC2B2AE35) & 0xFFFFFFFF) * 0x27D4EB2F >> 13) % rows + bias
    return np.stack([branch + np.zeros_like(one), h(one, 1), h(one * 4099 + two, 2), h(two, 3)])


def row_sums(p: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``p`` with equal ``r``, and these numbers in order."""
    packed = np.sort(r.astype(np.int64) << 32 | np.arange(len(r)))  # much quicker than a stable argsort
    order, sorted_ = packed & 0xFFFFFFFF, packed >> 32
    first = np.flatnonzero(np.diff(sorted_, prepend=-1))
    if 2 * len(first) < len(r):
        return np.add.reduceat(p.take(order, axis=0), first, axis=0), sorted_[first]
    g = p.take(order[first], axis=0)  # most numbers occur once: only the others are added
    size = np.diff(first, append=len(r))
    if (many := np.flatnonzero(size > 1)).size:
        ends = np.cumsum(size[many])
        g[many] = np.add.reduceat(p.take(order[np.repeat(size > 1, size)], axis=0), ends - size[many], axis=0)
    return g, sorted_[first]


class Model:
    """Two tables of weights: classes, and tokens within a class."""

    def __init__(self, outer: np.ndarray, inner: np.ndarray):
        self.tables, self.rows = [outer, inner], len(outer) - 1

    @classmethod
    def start(cls, counts: np.ndarray, rows: int = LEAST_ROWS) -> Model:
        """From head counts: the biases are log shares, all else 0."""
        c = counts.reshape(CLASSES, CLASSES) + 0.5
        outer = np.zeros((1 + rows, CLASSES), np.float32)
        inner = np.zeros((CLASSES + rows, CLASSES), np.float32)
        outer[0] = np.log(c.sum(axis=1) / c.sum())
        inner[:CLASSES] = np.log(c / c.sum(axis=1, keepdims=True))
        return cls(outer, inner)

    def steps(self, token: np.ndarray, one: np.ndarray, two: np.ndarray):
        """For both softmaxes: table, feature rows of the distinct contexts (in order of branch, word before, word two back), each token's context, and outcome."""
        cls, own = np.divmod(token, CLASSES)
        pair = one << 24 | two
        for k, (branch, key, outcome) in enumerate(((None, pair, cls), (cls, cls << 48 | pair, own))):
            distinct, at = np.unique(key, return_inverse=True)
            a, b = distinct >> 24 & 0xFFFFFF, distinct & 0xFFFFFF
            yield k, features(a, b, 0 if branch is None else distinct >> 48, 1 if branch is None else CLASSES, self.rows), at, outcome

    def logits(self, k: int, rows: np.ndarray) -> np.ndarray:
        w = self.tables[k]
        z = w.take(rows[0], axis=0)
        other = np.empty_like(z)
        for r in rows[1:]:
            z += w.take(r, axis=0, out=other, mode="clip")  # the mode that writes straight to ``out``
        if z.size and not -SAFE < z.min() <= z.max() < SAFE:
            z -= z.max(axis=1, keepdims=True)
        return z

    def log10(self, token: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        total = np.zeros(len(token))
        for a in range(0, len(token), SCORED):
            part = slice(a, a + SCORED)
            for k, rows, at, outcome in self.steps(token[part], one[part], two[part]):
                z = self.logits(k, rows)
                own = z[at, outcome]
                total[part] += own - np.log(np.einsum("ij->i", np.exp(z, out=z)))[at]
        return total / np.log(10)

    def learn(self, token: np.ndarray, one: np.ndarray, two: np.ndarray, square: list[np.ndarray], rate: float = RATE, batch: int = STEP) -> None:
        """AdaGrad in batches; ``square`` holds a running sum for each row."""
        for a in range(0, len(token), batch):
            for k, rows, at, outcome in self.steps(token[a : a + batch], one[a : a + batch], two[a : a + batch]):
                w, z = self.tables[k], self.logits(k, rows)
                np.exp(z, out=z)
                z *= (np.bincount(at, minlength=len(z)) / np.einsum("ij->i", z)).astype(np.float32)[:, None]  # expected, less observed
                np.subtract.at(z.ravel(), at * CLASSES + outcome, np.float32(1))
                first = np.flatnonzero(np.diff(rows[0], prepend=-1) | np.diff(rows[1], prepend=-1))  # contexts are sorted by branch and word before
                p = np.add.reduceat(z, first, axis=0)
                for p, r in ((p, rows[0][first]), (p, rows[1][first]), (z, rows[2]), (z, rows[3])):
                    g, own = row_sums(p, r)
                    square[k][own] += np.einsum("ij,ij->i", g, g) / CLASSES
                    g *= (rate / np.sqrt(square[k][own] + 1.0))[:, None]
                    w[own] = np.subtract(w.take(own, axis=0), g, out=g)


def _train(df: DataFrame, codes: Codes, model: Model, text: str, rounds: int) -> Model:
    """Rounds of local gradient steps and a mean over tasks, summed by Spark in blocks of rows."""
    shapes = [t.shape for t in model.tables]
    for round_ in range(rounds):

        def run(batches, model=model, rate=RATE / (1 + round_)):
            own, square, seen = Model(*[t.copy() for t in model.tables]), [np.zeros(s[0], np.float32) for s in shapes], 0
            for b in batches:
                for i, j in slices(b.column(0), 4_000_000):
                    token, code, _, ends, _, _ = codes.arrays(b.column(0).slice(i, j - i))
                    one, two = contexts(code, ends)
                    own.learn(token, one, two, square, rate)
                    seen += len(token)
            if seen:
                flat = np.concatenate([(a - b).ravel() for a, b in zip(own.tables, model.tables)]) * np.float32(seen)
                for i, x in enumerate(np.array_split(flat, BLOCKS)):
                    yield batch(i, TaskContext.get().partitionId() % GROUPS, seen, x)

        def batch(block, group, n, x):
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([group], pa.int32()), pa.array([n], pa.int64()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["block", "group", "n", "x"])

        def add(batches):
            """Sum the rows of each block in the partition; it holds a few blocks."""
            rows: dict[int, list] = {}
            for b in batches:
                for i, _, n, x in zip(*(c.to_pylist() for c in b.columns)):
                    own = rows.setdefault(i, [0, 0])
                    own[0] += n
                    own[1] = own[1] + np.frombuffer(x, np.float32)
            for i, (n, x) in rows.items():
                yield batch(i, 0, n, x)

        schema = "block int, group int, n long, x binary"
        sums = df.select(df[text].alias("t")).mapInArrow(run, schema).repartition(BLOCKS * GROUPS // 4, "block", "group").mapInArrow(add, schema)
        parts = sums.repartition(BLOCKS, "block").mapInArrow(add, schema)
        total: dict[int, list] = {}
        for r in parts.toLocalIterator():  # tables of fixed size
            own = total.setdefault(r.block, [0, 0])
            own[0] += r.n
            own[1] = own[1] + np.frombuffer(r.x, np.float32)
        if not total:
            return model
        flat = np.concatenate([total[i][1] / total[i][0] for i in range(BLOCKS)])
        cut = model.tables[0].size
        model = Model(model.tables[0] + flat[:cut].reshape(shapes[0]), model.tables[1] + flat[cut:].reshape(shapes[1]))
    return model


def score(df: DataFrame, training: Column, rounds: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    rows = df.where(training)
    counts = written(count_words(rows, text), "counts")
    docs = rows.count()
    size = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    v, n = size.v + bool(docs), (size.n or 0) + docs
    head = [(r.w, r.c) for r in counts.orderBy(F.desc("c"), "w").limit(HEAD - 2).collect()]
    held, least = 0, 1 << 62
    for r in counts.groupBy(F.floor(F.log2("c")).alias("b")).count().orderBy(F.desc("b")).collect():
        if (held := held + r["count"]) > FREQUENT:
            break
        least = 1 << r.b
    frequent = {r.w: r.c for r in counts.where(F.col("c") >= least).collect()} | dict(head)
    codes = Codes([w for w, _ in head], frequent, table_rows(n))
    inside = sum(c for _, c in head)
    start = np.zeros(HEAD)
    start[OTHER], start[END] = n - docs - inside, docs
    start[2 : 2 + len(head)] = [c for _, c in head]
    tasks = max(1, n // (TASK_TOKENS * codes.rows))  # from the tokens alone: the mean over tasks is part of the result
    model = _train(rows.coalesce(tasks), codes, Model.start(start, codes.rows), text, rounds)

    def run(batches):
        serial = TaskContext.get().partitionId() << 40
        for b in batches:
            for i, j in slices(b.column(1), 2_000_000):
                token, code, count, ends, coded, unknown = codes.arrays(b.column(1).slice(i, j - i))
                length = np.diff(ends, prepend=-1)
                one, two = contexts(code, ends)
                first = ends - length + 1
                count[ends] = docs
                known = count >= 0
                logs = np.where(known, np.log10(np.maximum(count, 0) + 0.5), 0.0)
                base = np.add.reduceat(logs, first)
                outside = np.add.reduceat(np.where(token == OTHER, logs, 0.0), first)
                others = np.add.reduceat((token == OTHER).astype(np.int64), first)
                sure = np.add.reduceat((known & (count > 0)).astype(np.int64), first)
                lm = np.add.reduceat(model.log10(token, one, two), first)
                row = np.arange(serial, serial + j - i)
                serial += j - i
                none = pa.nulls(j - i, pa.string())
                kinds = ["row", "k", "w", "n", "n_tokens", "n_known", "base", "outside", "others", "lm"]
                keys = b.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([pa.array(row), keys, none, pa.array(np.zeros(j - i, np.int64)), pa.array(length), pa.array(sure), pa.array(base), pa.array(outside), pa.array(others), pa.array(lm)], kinds)
                if unknown.any():
                    word = coded.indices.to_numpy()[unknown].astype(np.int64)
                    pairs, c = np.unique(np.repeat(np.arange(j - i), length - 1)[unknown] * len(coded.dictionary) + word, return_counts=True)
                    own, word = np.divmod(pairs, len(coded.dictionary))
                    empty = [pa.nulls(len(c), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(row[own]), pa.nulls(len(c), keys.type), coded.dictionary.take(pa.array(word)), pa.array(c), *empty], kinds)

    kind = df.schema[key].dataType.simpleString()
    schema = f"row long, k {kind}, w string, n long, n_tokens long, n_known long, base double, outside double, others long, lm double"
    made = written(df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, schema), "scored")
    rare = made.where("w is not null").select("w", "row", "n").join(counts, "w", "left")
    joined = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("r_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("r_known"))
    out = made.where("w is null").join(joined, "row", "left")
    r_log = F.coalesce("r_log", F.lit(0.0))
    v_out, n_out = v - bool(docs) - len(head), n - docs - inside
    return out.select(
        F.col("k").alias(key),
        "n_tokens",
        (F.col("n_known") + F.coalesce("r_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + r_log - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"),
        (F.col("lm") + F.col("outside") + r_log - F.col("others") * float(np.log10(n_out + 0.5 * (v_out + 1)))).alias("score"),
    )
