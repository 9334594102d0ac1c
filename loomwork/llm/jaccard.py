"""N-gram Jaccard join: size-aware, heavy lists apart from light ones.

* Equal shingle sets are one class.
* Small sets (every partner differs by one element at most) enumerate fixed-size subsets: the set
  itself and the set without each one element.  Partners share a key.
* Larger sets post the elements that no partner can all miss, in one global order (elements found
  often come last, then by hash), and inverted lists are scanned.
* The boundary between the two is the size with the least estimated rows: subset keys of the sets
  below it plus list scans of the sets above it.
* Two sets pair in a list only if the element can be the first that they share: what follows it in
  the shorter rest must still suffice.  A linking pair passes that at its first shared element.
* A light list yields its pairs.  A heavy list first links its members to its pivot, the member with
  the fewest elements of its own before it; then only members of different components are still
  paired, so a group of copies isn't squared.
* Candidates pass an exact bitmap bound, inside the join where lists are heavy, and are verified on
  whole sets.

The order comes from counts over all rows and affects speed only.  Null text and text without words
have an empty set and link with nothing; a text with fewer than ``k`` words is one shingle.  Texts of
any length give whole sets.  Repeated rows and repeated keys each come back, equal texts in one
component; null keys are kept and never name a component.  There are no ties: every pair that reaches
the bound links.  Extra columns, whatever their names, are left out.  An empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import release, written
from loomwork.llm.components import components
from loomwork.llm.tokens import slices

#: Most elements that are known as frequent; the list is sent to every task (8 bytes each).
FREQUENT = 1 << 17
#: A list of more members than this is heavy.
HEAVY = 16
#: Pivots of a heavy list, one after another, before members of different components are paired.
PIVOTS = 2
#: Words of a bitmap, and of its fold that is compared first where lists are heavy.
SKETCH, BRIEF = 32, 8

_u = np.uint64
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _u(2) + _u(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` of each at least."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(32))) * _u(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _u(32))) * _u(0xD6E8FEB86659FD93)
    return x ^ (x >> _u(32))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct ``k``-word shingles; A-Z are lower-cased, words end at ASCII white space."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends_of = np.cumsum([len(r) + 1 for r in raw])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
    words = _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, np.concatenate([[0], ends_of]))
    whole = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        whole = _mix(whole * _u(0xC2B2AE3D27D4EB4F) + words[i : i + len(whole)] + _u(i + 1))
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            own = np.zeros(1, np.uint64)
            for i, w in enumerate(words[a:b]):
                own = _mix(own * _u(0xC2B2AE3D27D4EB4F) + w + _u(1000 + i))
            out.append(own)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(df: DataFrame, k: int, make, schema: str, key: str, text: str) -> DataFrame:
    """Run ``make(keys, sets)`` → record batch over the shingle sets of all rows."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts, 1_000_000):
                yield make(b.column(0)[i:j], shingle_sets(texts[i:j], k))

    return df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, schema)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)))


def _class_of(s: np.ndarray) -> tuple[np.ndarray, np.uint64, np.uint64]:
    """Mixed elements, and the two 64-bit sums that name a set."""
    a = _mix(s)
    return a, a.sum(dtype=np.uint64), _mix(s ^ _u(0x5851F42D4C957F2D)).sum(dtype=np.uint64)


def _frequent(df: DataFrame, k: int, num: int, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Elements that many sets would post, to a bound, and the powers of two of their counts."""

    def make(keys, sets):
        return pa.RecordBatch.from_arrays([_lists([s[: 2 * (len(s) - -(-num * len(s) // 100) + 1)] for s in sets])], ["p"])

    counts = written(_sets(df, k, make, "p array<long>", key, text).select(F.explode("p").alias("e")).groupBy("e").count().where(f"count > {HEAVY}").select("e", F.floor(F.log2("count")).cast("int").alias("b")), "frequent")
    sizes = counts.groupBy("b").count().orderBy(F.desc("b")).collect()
    held, least = 0, 1 << 30
    for b, n in sizes:
        if (held := held + n) > FREQUENT:
            break
        least = b
    found = counts.where(F.col("b") >= least).collect()  # FREQUENT rows at most
    release(counts)
    e, b = np.array([r.e for r in found], dtype=np.int64).view(np.uint64), np.array([r.b for r in found], dtype=np.uint8)
    order = np.argsort(e)
    return e[order], b[order]


def _described(df: DataFrame, k: int, num: int, frequent: tuple[np.ndarray, np.ndarray], key: str, text: str) -> DataFrame:
    """A row for each document: its class, size, bitmap, posted elements, and subset keys where it is small."""
    small = 200 // (100 - num) if num < 100 else 1 << 30  # unions below this differ by one element at most
    small -= 200 % (100 - num) == 0 if num < 100 else 0
    known, level = frequent

    def in_order(s: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` elements: rare ones by hash, then frequent ones from the rarest on."""
        if not len(known):
            return s[:most]
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        late = known[at] == s
        first = s[~late]
        if len(first) >= most:
            return first[:most]
        own = s[late]
        return np.concatenate([first, own[np.argsort(level[at[late]], kind="stable")]])[:most]

    def make(keys, sets):
        c1, c2, posted, subsets, sketch = [], [], [], [], []
        for s in sets:
            n = len(s)
            a, x, y = _class_of(s)
            c1.append(x)
            c2.append(y)
            bits = np.bincount((a >> _u(53)).astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1
            sketch.append(np.packbits(bits).view(np.uint64))
            posted.append(in_order(s, n - -(-num * n // 100) + 1) if n else s)
            minus = num * n <= 100 * (n - 1)  # may a partner lack one?
            subsets.append(_mix(np.concatenate([x[None], x - a]) if minus else x[None]) if 0 < n <= small else s[:0])
        longs = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([keys, pa.array([len(s) for s in sets], pa.int32()), longs(c1), longs(c2), _lists(sketch), _lists(posted), _lists(subsets)], ["k", "n", "c1", "c2", "sketch", "posted", "subsets"])

    kind = df.schema[key].dataType.simpleString()
    return _sets(df, k, make, f"k {kind}, n int, c1 long, c2 long, sketch array<long>, posted array<long>, subsets array<long>", key, text)


def _boundary(classes: DataFrame, lists: DataFrame, small: int) -> int:
    """Largest size that enumerates subsets: the least sum of subset keys below it and rows scanned above it."""
    keys = {r.n: r.rows for r in classes.where(F.col("n").between(1, small)).groupBy("n").agg(F.sum(F.size("subsets")).alias("rows")).collect()}
    scans = {r.n: r.rows for r in lists.where(F.col("n") <= small).groupBy("n").agg(F.sum("c").alias("rows")).collect()}
    cost = {x: sum(v for n, v in keys.items() if n <= x) + sum(v for n, v in scans.items() if n > x) for x in range(small + 1)}
    return min(cost, key=lambda x: (cost[x], x))


def _may_link(a: str, b: str, num: int) -> Column:
    """Can this be the first shared element of two sets that link? It holds the size bound too."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 + num) * F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at")) >= num * (n + m)


def _near(num: int, words: list[tuple[Column, Column]]) -> Column:
    """Bits that differ are elements that differ: an exact bound."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in words), F.lit(0))
    return (100 + num) * differ <= (100 - num) * (F.col("x.n") + F.col("y.n"))


def _near_sketch(num: int) -> Column:
    return _near(num, [(F.col("x.sketch")[i], F.col("y.sketch")[i]) for i in range(SKETCH)])


def _near_brief(num: int) -> Column:
    return _near(num, [(F.col(f"x.b{i}"), F.col(f"y.b{i}")) for i in range(BRIEF)])


def _brief() -> list[Column]:
    """The fold of ``sketch``: plain columns, which a join compares faster than an array's entries."""
    return [reduce(Column.bitwiseXOR, [F.col("sketch")[j] for j in range(i, SKETCH, BRIEF)]).alias(f"b{i}") for i in range(BRIEF)]


def _verified(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link; an Arrow batch is bounded in bytes."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = sets.select(F.col("id").alias("a"), F.col("whole").alias("wa")), sets.select(F.col("id").alias("b"), F.col("whole").alias("wb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def near_components(df: DataFrame, k: int = 5, num: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): the smallest key reachable over links of Jaccard ``num / 100`` or more."""
    frequent = _frequent(df, k, num, key, text)
    info = written(_described(df, k, num, frequent, key, text), "sets")
    classes = written(info.where("n > 0").dropDuplicates(["c1", "c2"]).withColumn("id", F.monotonically_increasing_id()), "classes")
    member = written(info.select("k", "n", "c1", "c2").join(classes.select("c1", "c2", "id"), ["c1", "c2"], "left").select("k", "n", "id"), "members")
    release(info)
    scanned = classes.select("id", "n", F.posexplode("posted").alias("at", "e"))
    count = lambda d: d.groupBy("e").agg(F.count("*").alias("c")).where("c > 1")
    lists = written(scanned.join(count(scanned), "e"), "lists")
    small = (200 - 1) // (100 - num) if num < 100 else 0
    edge = _boundary(classes, lists, small)
    # lists serve every pair with a set above the boundary; such a partner has num percent of its size at least
    least = -(-num * (edge + 1) // 100)
    enumerated = classes.where(F.col("n").between(1, edge)).select("id", "n", F.lit(0).alias("at"), F.explode("subsets").alias("e"))
    enumerated = enumerated.join(count(enumerated), "e")
    every = lists.where(F.col("n") >= least).select("e", "id", "n", "at", "c").union(enumerated.select("e", "id", "n", "at", "c"))

    light = every.where(f"c <= {HEAVY}").drop("c")
    ab = F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
    meet = (F.col("x.e") == F.col("y.e")) & (F.col("x.id") < F.col("y.id")) & _may_link("x", "y", num)
    pairs = light.alias("x").join(light.alias("y"), meet).select(*ab)
    heavy = written(every.where(f"c > {HEAVY}").drop("c"), "heavy")

    def starred(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The members but each list's pivot, and the pairs with the pivot."""
        centre = members.groupBy("e").agg(F.min(F.struct("at", "n", "id")).alias("p")).select("e", F.col("p.id").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.at").alias("pat"))
        rest = members.join(centre, "e").where("id <> pivot")
        may = (100 + num) * F.least(F.col("n") - F.col("at"), F.col("pn") - F.col("pat")) >= num * (F.col("n") + F.col("pn"))
        return rest.select(*members.columns), rest.where(may).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))

    bits = classes.select("id", "n", "sketch")

    def likely(found: DataFrame) -> DataFrame:
        x, y = bits.select(F.col("id").alias("a"), F.struct("n", "sketch").alias("x")), bits.select(F.col("id").alias("b"), F.struct("n", "sketch").alias("y"))
        return written(found.distinct().join(x, "a").join(y, "b").where(_near_sketch(num)).select("a", "b"), "pairs")

    def verified(found: DataFrame) -> DataFrame:
        involved = found.select(F.col("a").alias("id")).union(found.select(F.col("b").alias("id"))).distinct()
        named = classes.select("id", "k", "c1", "c2").join(involved, "id")
        wanted = named.select("k").distinct()

        def make(keys, sets):
            names = np.array([_class_of(s)[1:] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())], ["c1", "c2", "whole"])

        found_sets = _sets(df.join(wanted, df[key].eqNullSafe(wanted["k"]), "left_semi"), k, make, "c1 long, c2 long, whole binary", key, text)
        whole = written(found_sets.join(named.select("c1", "c2", "id"), ["c1", "c2"]).select("id", "whole").dropDuplicates(["id"]), "whole")
        links = written(_verified(found, whole, num), "links")
        release(whole, found)
        return links

    def mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
        """The members of lists in which different components are left, where a partner is possible."""
        named = members.select("e", "id", "n", "at").join(labels, F.col("id") == F.col("node"), "left").select("e", "id", "n", "at", F.coalesce("component", "id").alias("component"))
        lists = named.groupBy("e").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least")).where("lo <> hi").select("e", "least")
        partner = F.greatest("least", F.ceil(F.col("n") * num / 100).cast("int"))  # the smallest that the list and the size bound allow
        return named.join(lists, "e").where((100 + num) * (F.col("n") - F.col("at")) >= num * (F.col("n") + partner)).select("e", "id", "n", "at", "component")

    def merged(labels: DataFrame, found: DataFrame) -> DataFrame:
        """Links between components join these, once for each two, however many of their members link."""
        name = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
        between = verified(found).join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")).distinct()
        joined = written(components(between), "joined")
        moved = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        return written(moved.union(joined.join(labels, "node", "left_anti").select("node", "component")), "labels")

    members, stars = starred(heavy)
    labels = written(components(verified(likely(pairs.union(stars)))), "labels")
    release(lists)
    for _ in range(PIVOTS - 1):
        left = written(mixed(members, labels), "rest")
        members, stars = starred(left)
        labels = merged(labels, likely(stars))
    rest = written(mixed(members, labels).join(bits.select("id", *_brief()), "id"), "rest")
    crossed = rest.alias("x").join(rest.alias("y"), meet & (F.col("x.component") != F.col("y.component")) & _near_brief(num)).select(*ab)
    more = likely(crossed)
    if not more.isEmpty():
        labels = merged(labels, more)
    release(rest, heavy)
    placed = member.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select("k", "n", F.coalesce("component", "id").alias("component"))
    named = written(placed, "placed")
    least_key = named.where("component is not null").groupBy("component").agg(F.min("k").alias("least"))
    out = named.join(least_key, "component", "left")
    return out.select(F.col("k").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "k").alias("component_id"))
