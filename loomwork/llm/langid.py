"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary.  The probability of a
word is the sum over all its segmentations into pieces, by a forward pass; a text's is the product
over its words.  Piece probabilities are learned by expectation-maximisation (forward-backward over
word counts), each round one Spark job that returns expected counts, whose size is bounded by
vocabulary times languages.  Training uses a documented, bounded sample of rows per language
(``per_language``, chosen by a hash of the key); prediction covers every row and whole texts.

Null text, or text without a letter, is ``und`` with score 0.  Words, which end at Unicode blanks, are
learned and scored over all their segmentations, whatever their length.  Of equally likely languages the first by name is predicted.  Repeated rows get equal results; null keys
are kept and never learned from; extra columns, whatever their names, are left out; without any
training row every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import hash_share
from loomwork.llm.tokens import slices

#: Characters up to which a word needs no scaling, and the share of a character outside the vocabulary.
RUN, FLOOR = 24, 1e-9
#: Characters of words that are walked at a time.
CELLS = 1 << 17
#: Slots of the piece table, and the most slots that a lookup probes.
SLOTS, PROBES = 1 << 18, 5
_SHIFT = np.uint64(64 - SLOTS.bit_length() + 1)
#: What ends a word, as Python's ``str.split`` has it.
_BLANKS = r"[\x1c-\x1f\p{IsWhite_Space}]+"
_LETTER = re.compile(r"[^\W\d_]")


def _finish(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Lattice:
    """All pieces of a vocabulary that match inside words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.id = {p: i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for p in [model.id_to_piece(i)]}
        self.size, self.other = n + 1, n  # the last stands for a character outside the vocabulary
        self.longest = max(map(len, self.id))
        # pieces by a 64-bit hash in an open table, so that whole columns of substrings are looked up at once
        self.keys, self.values = np.zeros(SLOTS + PROBES, np.uint64), np.full(SLOTS + PROBES, -1, np.int32)
        pieces = list(self.id)
        for n, at in _by_length(pieces):
            own = [pieces[i] for i in at]
            h = self._hash(np.array(own, dtype=f"<U{n}").view(np.uint32).reshape(len(own), n).astype(np.uint64))
            for p, k, slot in zip(own, h, (h >> _SHIFT).tolist()):
                first = slot
                while self.values[slot] >= 0:
                    slot += 1
                if slot - first >= PROBES:
                    raise ValueError("the piece table is too dense")
                self.keys[slot], self.values[slot] = k, self.id[p]

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1]):
            h = (h + codes[:, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return _finish(h)

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = (h >> _SHIFT).astype(np.int64)
        out = np.full(h.shape, -1, np.int32)
        for k in range(PROBES):
            out = np.where(self.keys[at + k] == h, self.values[at + k], out)
        return out

    def edges(self, words: list[str], n: int) -> np.ndarray:
        """ids[word, start, length - 1] of words of ``n`` characters; -1 where no piece matches."""
        most = min(n, self.longest)
        codes = np.array(words, dtype=f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
        out = np.full((len(words), n, most), -1, np.int32)
        h = np.zeros_like(codes)
        for k in range(most):
            h = (h[:, : n - k] + codes[:, k:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            out[:, : n - k, k] = self._find(_finish(h))
        out[:, :, 0] = np.where(out[:, :, 0] < 0, self.other, out[:, :, 0])
        return out

    def forward(self, ids: np.ndarray, prob: np.ndarray) -> list[np.ndarray]:
        """alpha[end][word, language]; ``prob`` has a row of zeros at -1."""
        n = ids.shape[1]
        alpha = [np.ones((len(ids), prob.shape[1]))]
        for j in range(1, n + 1):
            alpha.append(sum((alpha[i] * prob[ids[:, i, j - i - 1]] for i in range(max(0, j - ids.shape[2]), j)), np.zeros_like(alpha[0])))
        return alpha

    def log_forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """log probability [word, language] of words of one length, over all segmentations.

        A long word's values are scaled as it is walked; only those of the last ``longest`` places are held.
        """
        n = len(words[0])
        ids = self.edges(words, n)
        if n <= RUN:
            return np.log(np.maximum(self.forward(ids, prob)[n], 1e-300))
        most = ids.shape[2]
        window = np.zeros((most, len(words), prob.shape[1]))  # alpha at j is in row j % most
        window[0], log = 1.0, np.zeros(window.shape[1:])
        for j in range(1, n + 1):
            window[j % most] = sum(window[i % most] * prob[ids[:, i, j - i - 1]] for i in range(max(0, j - most), j))
            if j % 8 == 0 or j == n:
                top = np.maximum(window.max(axis=0), 1e-300)
                window /= top
                log += np.log(top)
        return log + np.log(np.maximum(window[n % most], 1e-300))

    def expected_long(self, ids: np.ndarray, prob: np.ndarray, count: np.ndarray) -> np.ndarray:
        """As ``expected``, for words of any length: both passes hold logarithms."""
        n, most = ids.shape[1:]
        step = lambda i, j: prob[ids[:, i, j - i - 1]]
        ahead = [np.zeros((len(ids), prob.shape[1]))]
        for j in range(1, n + 1):
            seen = sum(np.exp(ahead[i] - ahead[j - 1]) * step(i, j) for i in range(max(0, j - most), j))
            ahead.append(ahead[j - 1] + np.log(np.maximum(seen, 1e-300)))
        out, behind = np.zeros((self.size + 1, prob.shape[1])), {n: np.zeros_like(ahead[0])}
        for i in range(n - 1, -1, -1):
            seen = np.zeros_like(ahead[0])
            for j in range(i + 1, min(n, i + most) + 1):
                seen += np.exp(behind[j] - behind[i + 1]) * step(i, j)
                share = np.exp(ahead[i] + behind[j] - ahead[n]) * step(i, j) * count
                for g in range(prob.shape[1]):
                    out[:, g] += np.bincount(ids[:, i, j - i - 1] + 1, share[:, g], self.size + 1)
            behind[i] = behind[i + 1] + np.log(np.maximum(seen, 1e-300))
            behind.pop(i + most, None)
        return out[1:]

    def expected(self, ids: np.ndarray, prob: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected piece counts [piece, language] of words seen ``count[word, language]`` times."""
        if ids.shape[1] > RUN:
            return self.expected_long(ids, prob, count)
        n, alpha = ids.shape[1], self.forward(ids, prob)
        beta = [np.zeros_like(alpha[0]) for _ in range(n)] + [np.ones_like(alpha[0])]
        out = np.zeros((self.size + 1, prob.shape[1]))
        scale = count / np.maximum(alpha[n], 1e-300)
        for i in range(n - 1, -1, -1):
            for j in range(i + 1, min(n, i + ids.shape[2]) + 1):
                step = prob[ids[:, i, j - i - 1]] * beta[j]
                beta[i] += step
                for g in range(prob.shape[1]):
                    out[:, g] += np.bincount(ids[:, i, j - i - 1] + 1, alpha[i][:, g] * step[:, g] * scale[:, g], self.size + 1)
        return out[1:]


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def _by_length(words: list[str], block: int = 4096):
    order: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        order.setdefault(len(w), []).append(i)
    for n, at in order.items():
        for k in range(0, len(at), block):
            yield n, at[k : k + block]


class Scorer:
    """Word log-probabilities for all languages, remembered in bounded space."""

    def __init__(self, path: str, prob: np.ndarray, cache: int = 300_000):
        self.lattice, self.limit = lattice(path), cache
        self.prob = np.vstack([prob, np.zeros((1, prob.shape[1]))])  # row -1
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.value = np.zeros((1 << 12, self.prob.shape[1]), np.float32)

    def learn(self, words: list[str]) -> None:
        flat = ["\u2581" + w for w in words]
        log = np.empty((len(flat), self.prob.shape[1]))
        for n, at in _by_length(flat):
            for i in range(0, len(at), max(1, CELLS // n)):
                own = at[i : i + max(1, CELLS // n)]
                log[own] = self.lattice.log_forward([flat[k] for k in own], self.prob)
        base = len(self.at)
        while base + len(words) > len(self.value):
            self.value = np.vstack([self.value, np.zeros_like(self.value)])
        self.value[base : base + len(words)] = log
        self.at.update(zip(words, range(base, base + len(words))))

    def score(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.at) > self.limit:
            self.clear()
        get = self.at.get
        flat: list = []
        for t in texts:
            flat += map(get, t)
        if None in flat:
            words = [w for t in texts for w in t]
            self.learn(list({w for w, i in zip(words, flat) if i is None}))
            flat = list(map(self.at.__getitem__, words))
        out, size = np.zeros((len(texts), self.prob.shape[1])), np.array([len(t) for t in texts])
        full = np.flatnonzero(size)
        if len(full):
            out[full] = np.add.reduceat(self.value[np.array(flat, np.int64)], (np.cumsum(size) - size)[full], axis=0, dtype=np.float64)
        return out


def fit(df: DataFrame, path: str, training: Column, per_language: int = 1500, rounds: int = 3, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log prior and piece probabilities [piece, language].

    Of each language about ``per_language`` training rows are used, those with the lowest hash of
    their key; their word counts are summed by Spark and their expected piece counts come back.
    """
    rows = df.where(training & df[lang].isNotNull() & df[text].isNotNull())
    seen = {r[0]: r[1] for r in rows.groupBy(lang).count().orderBy(lang).collect()}
    names = list(seen)
    if not names:
        return [], np.zeros(0), np.zeros((0, 0))
    within = F.lit(False)
    for n in names:
        within = within | ((F.col(lang) == n) & hash_share(F.xxhash64(key, F.lit("langid")), per_language / seen[n]))
    picked = rows.where(within)
    words = picked.select(F.col(lang).alias("l"), F.explode(F.split(text, _BLANKS)).alias("w")).where("w <> ''").groupBy("w", "l").count()
    counts = words.groupBy("w").pivot("l", names).agg(F.first("count")).na.fill(0).persist()
    size = lattice(path).size
    prob = np.full((size, len(names)), 1.0 / size)
    try:
        for _ in range(rounds):

            def run(batches, prob=prob):
                own, full = lattice(path), np.vstack([prob, np.zeros((1, prob.shape[1]))])
                total = np.zeros_like(prob)
                flat: list[str] = []
                count: list = []

                def add():
                    counts_ = np.array(count, np.float64)
                    for n, at in _by_length(flat):
                        for i in range(0, len(at), max(1, CELLS // n)):
                            held = at[i : i + max(1, CELLS // n)]
                            total[:] += own.expected(own.edges([flat[k] for k in held], n), full, counts_[held])
                    flat.clear()
                    count.clear()

                for b in batches:
                    for w, c in zip(b.column(0).to_pylist(), np.stack([x.to_numpy(zero_copy_only=False) for x in b.columns[1:]], axis=1)):
                        flat.append("\u2581" + w)
                        count.append(c)
                    if len(flat) > 100_000:
                        add()
                add()
                piece, g = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(total[piece, g])], ["piece", "g", "x"])

            found = counts.mapInArrow(run, "piece int, g int, x double").groupBy("piece", "g").agg(F.sum("x").alias("x")).collect()  # vocabulary times languages at most
            prob = np.full((size, len(names)), 0.01)
            for r in found:
                prob[r.piece, r.g] += r.x
            prob[-1] = FLOOR
            prob /= prob.sum(axis=0)
    finally:
        counts.unpersist()
    total = np.array([seen[n] for n in names], np.float64)
    return names, np.log(total / total.sum()), prob


def predict(df: DataFrame, path: str, model: tuple[list[str], np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row; the score is the posterior of the predicted language."""
    names, prior, prob = model
    prob = prob.astype(np.float32)

    def run(batches):
        scorer = Scorer(path, prob) if names else None
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                own = [t or "" for t in texts[i:j]]
                if scorer is None:
                    lang, score = ["und"] * len(own), [0.0] * len(own)
                else:
                    log = scorer.score([t.split() for t in own]) + prior
                    p = np.exp(log - log.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best, letter = p.argmax(axis=1), [bool(_LETTER.search(t)) for t in own]
                    lang = [names[k] if ok else "und" for k, ok in zip(best, letter)]
                    score = [float(x) if ok else 0.0 for x, ok in zip(p.max(axis=1), letter)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["k", "lang_pred", "score"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)
