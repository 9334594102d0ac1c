"""Toxicity from a learned lexicon, matched with misspellings and weighed by context.

The lexicon (whole terms, and stems that start many terms) is learned from labelled rows.  It is a
trie; a Levenshtein automaton runs along it, so a word is compared with all terms at once, and the
product is made deterministic as words ask for it.  A hit counts as abuse or, if its window of words
holds quotation marks or a verb of reporting, as quotation.  A logistic model over the counts gives
the score.  Learning uses a documented, bounded sample of labelled rows (``sample`` of each label, by
a hash of the key); scoring covers every row and whole texts.

Candidate terms are words of any length without their outer punctuation.  An empty table gives an empty
result.  Null or empty text has no hits and gets the model's score for that.  Repeated rows get equal
results; extra columns are left out; without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import hash_share
from loomwork.llm.tokens import slices

#: Quotation marks, and verbs of reporting in the four languages of the data.
QUOTES = "\"“”„«»‘’"
REPORTING = frozenset("said says wrote called quoted quote word term dit écrit appelé cite mot sagte schrieb nannte zitiert wort dijo escribió llamó cita palabra".split())
_EDGE = ".,;:!?()[]{}<>*_-…'`" + QUOTES
FEATURES = 6


class Automaton:
    """Words within ``edits`` of a lexicon term (or that start with one of its stems).

    A state is a set of (trie node, edits spent); ``step`` results are remembered up to a bound.
    Stems, and terms of fewer than ``least`` characters, must match exactly.
    """

    def __init__(self, terms: list[str], stems: list[str], edits: int = 1, least: int = 5, bound: int = 200_000):
        self.edits, self.bound = edits, bound
        self.child: list[dict[str, int]] = [{}]
        self.final: list[int] = [0]  # 1 a term, 2 a stem
        self.depth: list[int] = [0]
        self.room: list[int] = [0]  # edits that some term below allows
        for kind, words in ((1, terms), (2, stems)):
            for w in words:
                at, room = 0, edits if kind == 1 and len(w) >= least else 0
                self.room[0] = max(self.room[0], room)
                for c in w:
                    if c not in self.child[at]:
                        self.child[at][c] = len(self.child)
                        self.child.append({})
                        self.final.append(0)
                        self.depth.append(self.depth[at] + 1)
                        self.room.append(0)
                    at = self.child[at][c]
                    self.room[at] = max(self.room[at], room)
                self.final[at] |= kind
        self.start = self._close({(0, 0)})
        self.clear()

    def clear(self) -> None:
        self.ids = {self.start: 0}
        self.states, self.next = [self.start], [{}]

    def _close(self, state: set[tuple[int, int]]) -> frozenset:
        """Add what is reached by leaving out characters of a term."""
        todo, best = list(state), {}
        while todo:
            node, e = todo.pop()
            if best.get(node, 9) <= e or e > self.room[node]:
                continue
            best[node] = e
            todo += [(n, e + 1) for n in self.child[node].values()]
        return frozenset(best.items())

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, e in state:
            if node < 0 or self.final[node] & 2:
                out.add((-1 - (e if node >= 0 else -1 - node), e))  # past a stem: any ending
                if node < 0:
                    continue
            for x, n in self.child[node].items():
                out.add((n, e + (x != c)))
            out.add((node, e + 1))
        past = {(n, e) for n, e in out if n < 0}
        return self._close({(n, e) for n, e in out if n >= 0 and e <= self.edits}) | past

    def match(self, word: str) -> int:
        """0 no match, 1 exact, 2 misspelled."""
        at = 0
        for c in word:
            to = self.next[at].get(c)
            if to is None:
                if len(self.states) > self.bound:
                    found = self.states[at]
                    self.clear()
                    at = self.ids.setdefault(found, len(self.states))
                    if at:
                        self.states.append(found)
                        self.next.append({})
                state = self._step(self.states[at], c)
                to = self.ids.setdefault(state, len(self.states))
                if to == len(self.states):
                    self.states.append(state)
                    self.next.append({})
                self.next[at][c] = to
            at = to
            if not self.states[at]:
                return 0
        ends = [e for n, e in self.states[at] if n < 0 or self.final[n]]
        return 0 if not ends else 1 if min(ends) == 0 else 2


@dataclass
class Lexicon:
    terms: list[str]
    stems: list[str]
    window: int = 6
    known: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.automaton = Automaton(self.terms, self.stems)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "stems": self.stems, "window": self.window, "known": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def words(self, text: str) -> list[str]:
        return text.lower().split()

    def hits(self, words: list[str]) -> list[tuple[int, int, bool]]:
        """(word number, 1 exact or 2 misspelled, quoted) of each hit."""
        known = self.known
        if len(known) > 300_000:
            known.clear()
        codes = list(map(known.get, words))
        if None in codes:
            for w in {w for w, c in zip(words, codes) if c is None}:
                known[w] = self.automaton.match(w.strip(_EDGE))
            codes = list(map(known.__getitem__, words))
        out = []
        if any(codes):
            for i, c in enumerate(codes):
                if c:
                    near = words[max(0, i - self.window) : i + self.window + 1]
                    quoted = sum(q in w for w in near for q in QUOTES if q != "’") >= 2 or any(w.strip(_EDGE) in REPORTING for w in near)
                    out.append((i, c, quoted))
        return out

    def features(self, text: str | None) -> list[float]:
        """log counts of exact and misspelled abuse and quotation, share of abuse, and one."""
        words = self.words(text or "")
        n = [0, 0, 0, 0]
        for _, c, quoted in self.hits(words):
            n[(c - 1) + 2 * quoted] += 1
        return [*np.log1p(n), 10.0 * (n[0] + n[1]) / max(10, len(words)), 1.0]


def _sample(labels: DataFrame, training: Column, sample: int, key: str, label: str) -> DataFrame:
    """The ``sample`` labelled keys of each label with the least hash: at most twice that many rows are ever broadcast."""
    rows = labels.where(training & labels[label].isin(0, 1) & labels[key].isNotNull()).select(labels[key].alias("k"), labels[label].cast("int").alias("y"))
    seen = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    place = F.xxhash64("k", F.lit("toxicity"))
    likely = [rows.where((F.col("y") == y) & hash_share(place, 2 * sample / max(1, seen.get(y, 0)))).distinct().orderBy(place, "k").limit(sample) for y in (0, 1)]  # sorted among twice the sample
    return likely[0].unionByName(likely[1]).groupBy("k").agg(F.max("y").alias("y"))


def learn_lexicon(rows: DataFrame, least: int = 3, ratio: float = 10.0, stems: tuple[int, int] = (4, 6)) -> Lexicon:
    """Terms and stems that are far commoner in toxic rows (t, y) than in others.

    Occurrences count once for each word before them, so copies of a text count once.  The evidence is a likelihood ratio that chance would not reach among as many candidates.  A stem
    never starts a word of the other rows and has at least four endings.
    """
    plain = F.transform(F.split(F.lower("t"), r"\s+"), lambda w: F.regexp_replace(w, r"^\W+|\W+$", ""))
    before = F.concat(F.array(F.lit("")), F.slice("ws", F.lit(1), F.greatest(F.size("ws") - 1, F.lit(0))))
    words = rows.select("y", plain.alias("ws")).select("y", F.explode(F.arrays_zip("ws", before.alias("before"))).alias("p")).select("y", F.col("p.ws").alias("w"), F.col("p.before").alias("before")).where("w <> ''").distinct()
    totals = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if not (totals.get(0) and totals.get(1)):
        return Lexicon([], [])
    share = totals[1] / (totals[0] + totals[1])
    starts = F.explode(F.concat(F.array(F.struct(F.lit(0).alias("n"), F.col("w").alias("s"))), F.transform(F.sequence(F.lit(stems[0]), F.lit(stems[1])), lambda n: F.struct(n.alias("n"), F.substring("w", F.lit(1), n).alias("s")))))
    counted = words.select("y", "w", starts.alias("p")).where("p.n = 0 or length(w) > p.n").groupBy("p.n", "p.s").agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("f"), F.approx_count_distinct("w").alias("kinds")).where(f"t + f > {least}").persist()
    try:
        tried = {r.n: r["count"] for r in counted.groupBy("n").count().collect()}
        both = F.col("t") + F.col("f")
        g = F.col("t") * F.log(F.col("t") / (share * both)) + F.when(F.col("f") > 0, F.col("f") * F.log(F.col("f") / ((1 - share) * both))).otherwise(0.0)
        need = F.create_map(*[F.lit(x) for n, c in tried.items() for x in (n, float(np.log(c) + 2))]) if tried else F.create_map(F.lit(0), F.lit(1.0))
        found = counted.where((F.col("t") >= least) & (g >= need[F.col("n")]) & (F.col("t") * (1 - share) >= ratio * share * F.col("f"))).orderBy(F.desc("t"), "n", "s").collect()  # the labelled sample bounds them
    finally:
        counted.unpersist()
    at = [{r.s: r.t for r in found if r.n == n and (n == 0 or (r.f == 0 and r.kinds >= 4))} for n in (0, *range(stems[0], stems[1] + 1))]
    strong: set[str] = set()
    for n, own in enumerate(at[1:], 1):  # the longest start that keeps nearly all rows
        longer = at[n + 1] if n + 1 < len(at) else {}
        strong |= {x for x, t in own.items() if not any(y.startswith(x) and t2 >= 0.9 * t for y, t2 in longer.items())}
    strong = {x for x in strong if not any(x != y and x.startswith(y) for y in strong)}
    return Lexicon(sorted(w for w in at[0] if not any(w.startswith(x) for x in strong)), sorted(strong))


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(df: DataFrame, labels: DataFrame, training: Column, sample: int = 3000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[Lexicon, np.ndarray | None]:
    """Lexicon and weights from at most ``sample`` keys of each label among ``training`` labels."""
    picked = _sample(labels, training, sample, key, label)
    rows = df.select(df[key].alias("k"), F.coalesce(df[text], F.lit("")).alias("t")).join(F.broadcast(picked), "k").select("y", "t").persist()
    try:
        lexicon = learn_lexicon(rows)

        def run(batches):
            for b in batches:
                x = [lexicon.features(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

        found = rows.mapInArrow(run, "y int, x array<double>").groupBy("y", "x").count().collect()  # bounded by the sample
    finally:
        rows.unpersist()
    if len({r.y for r in found}) < 2:
        return lexicon, None
    x, y = np.repeat([r.x for r in found], [r["count"] for r in found], axis=0), np.repeat([float(r.y) for r in found], [r["count"] for r in found])
    return lexicon, _fit(x, y)


def score(df: DataFrame, model: tuple[Lexicon, np.ndarray | None], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted, n_abuse, n_quoted, spans) of every row; spans are the first word numbers of all hits."""
    lexicon, weight = model

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                own = [lexicon.hits(lexicon.words(t or "")) for t in texts[i:j]]
                x = np.array([lexicon.features(t) if h else [0.0] * (FEATURES - 1) + [1.0] for t, h in zip(texts[i:j], own)]).reshape(-1, FEATURES)
                p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30))) if weight is not None else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([sum(not h[2] for h in o) for o in own], pa.int64()), pa.array([sum(h[2] for h in o) for o in own], pa.int64()), pa.array([[h[0] for h in o] for o in own], pa.list_(pa.int64()))],
                    ["k", "score", "predicted", "n_abuse", "n_quoted", "spans"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind}, score double, predicted int, n_abuse long, n_quoted long, spans array<long>").withColumnRenamed("k", key)
