"""Document fingerprints by consistent weighted sampling, with DataFrame operations only.

A text is its words (lower case, cut at white space) weighted by their counts.  For each of ``m``
samples a term draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from hashes of itself; with weight w it
offers t = floor(ln w / r + b) at height c exp(-r (t - b) - r), and the lowest offer (term, t) is the
sample.  Two texts agree in a sample with a probability equal to the generalised Jaccard similarity
of their weights; the share of agreeing samples estimates it.

Null text is empty text.  Empty texts share one fingerprint, of likeness 1 among themselves and
about 0 to others.  Texts of any length are taken whole.  Repeated rows get equal fingerprints; rows with
one key follow each other in the order of their texts, in one range; null keys come first.  Columns of any
other name are left out.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 48
#: Ranges of keys are of about RANGE_BYTES of text; beyond RANGES of them (their bounds are part of the plan) they grow instead.
RANGE_BYTES, RANGES = 32 << 20, 20_000


def terms(text: Column) -> Column:
    """array<bigint>: hashes of the words, all even."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"\s+"), ""), lambda w: F.xxhash64(w).bitwiseAND(-2))


def _runs(sorted_: Column) -> Column:
    """Count equal neighbours of a sorted array."""
    n = F.size(sorted_)
    last = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(sorted_, i - 1) != F.get(sorted_, i)))
    return F.when(n > 0, last)


def offer(term: Column, lw: Column, i: int) -> Column:
    """Height and identity of a term's offer to sample ``i`` in one orderable integer."""
    a, b = F.xxhash64(term, F.lit(2 * i)), F.xxhash64(term, F.lit(2 * i + 1))
    part = lambda h, shift, bits: (F.shiftrightunsigned(h, shift).bitwiseAND((1 << bits) - 1).cast("double") + 0.5) / float(1 << bits)
    r = -F.log(part(a, 0, 20) * part(a, 20, 20))
    beta = part(a, 40, 24)
    t = F.floor(lw / r + beta)
    height = F.log(-F.log(part(b, 0, 32) * part(b, 32, 31))) - r * (t.cast("double") - beta) - r
    name = F.shiftrightunsigned(a, 33).bitwiseXOR(t.bitwiseAND(0x7FFFFFFF))
    return F.shiftleft(((height + 128.0) * float(1 << 24)).cast("long"), 31).bitwiseOR(name)


def _lowest(d: DataFrame, keys: list[str], m: int) -> DataFrame:
    """``keys`` with ``s0``, ``s1``, ...: the lowest offers over the rows (term, lw) of each key."""
    return d.groupBy(*keys).agg(*[F.min(offer(F.col("term"), F.col("lw"), i)).alias(f"s{i}") for i in range(m)])


def _signature(lows: list[Column]) -> Column:
    return F.array(*[F.coalesce(x.bitwiseAND(0xFFFF), F.lit(0)).cast("int") for x in lows])


def _exploded(d: DataFrame, keep: list[str], words: Column) -> DataFrame:
    """``keep`` with (term, lw, side) of each distinct word: its hash and the logarithm of its count.

    ``words`` holds even hashes, those of a second text with 1 added. A word with one count in both
    texts gives one row of side 2; all others are of side 0 or 1.
    """
    runs = d.select(*keep, F.sort_array(words).alias("ws")).select(*keep, "ws", _runs(F.col("ws")).alias("ends"))
    word = lambda j: F.get("ws", F.get("ends", j) - 1)
    count = lambda j: F.get("ends", j) - F.coalesce(F.get("ends", j - 1), F.lit(0))

    def row(_, j):
        first = word(j).bitwiseAND(1) == 0
        twin = lambda k: (word(k).bitwiseXOR(word(j)) == 1) & (count(k) == count(j))
        side = F.when(first, F.when(twin(j + 1), 2).otherwise(0)).otherwise(F.when(twin(j - 1), -1).otherwise(1))
        return F.struct(word(j).bitwiseAND(-2).alias("term"), F.log(count(j).cast("double")).alias("lw"), side.alias("side"))

    return runs.select(*keep, F.explode_outer(F.transform("ends", row)).alias("p")).select(*keep, "p.*").where("side IS NULL OR side >= 0")


def text_of(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 4, "0")), "")


def likeness(a: Column, b: Column, m: int) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / float(m)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", m: int = SAMPLES) -> DataFrame:
    """(key, fingerprint, sig) of every row."""
    row = df.select(F.monotonically_increasing_id().alias("row"), df[key].alias("k"), F.coalesce(df[text], F.lit("")).alias("t"))
    signed = _lowest(_exploded(row, ["row", "k"], terms(F.col("t"))), ["row", "k"], m).select("k", _signature([F.col(f"s{i}") for i in range(m)]).alias("sig"))
    return signed.select(F.col("k").alias(key), text_of(F.col("sig")).alias("fingerprint"), "sig")


def _buckets(d: DataFrame, parts: int) -> list[int]:
    """First key of each of about ``parts`` runs of keys; their number is all that reaches the driver."""
    cut = d.agg(F.percentile_approx("o", [i / parts for i in range(parts)], 10 * parts).alias("q"), F.min("o").alias("lo")).first()
    if cut.lo is None:
        return []
    bounds = sorted({cut.lo, *cut.q})
    return sorted(r.o for r in d.groupBy(_bucket(F.col("o"), bounds)).agg(F.min("o").alias("o")).collect())


def _bucket(o: Column, bounds: list[int]) -> Column:
    """Number of bounds up to ``o``, less one; two levels keep it at twice the square root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    first = F.size(F.filter(longs([g[0] for g in groups]), lambda x: x <= o))
    inner = F.element_at(F.array(*[longs(g) for g in groups]), first)
    return (first - 1) * step + F.size(F.filter(inner, lambda x: x <= o)) - 1


def edited_likeness(df: DataFrame, key: str = "doc_id", text: str = "text", m: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, and that to the next text.

    The edited text ends in the beginning of the next document in ascending key order.  Keys are
    dealt into ranges of even size; the first document of a range is copied to the range before, so
    texts are shuffled once and all else stays within a range.  Words with one count in a text and its
    edited text make their offers once for both.
    """
    spark = df.sparkSession
    rows = df.select(df[key].alias("k"), F.coalesce(df[key].cast("long"), F.lit(-(1 << 63))).alias("o"), F.coalesce(df[text], F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t")).alias("b")).first().b or 0
    bounds = _buckets(rows.select("o"), min(RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)))
    if not bounds:
        bounds = [0]
    last = len(bounds) - 1
    bucket = _bucket(F.col("o"), bounds).alias("b")
    before = F.when(F.col("b") == 0, last).otherwise(F.col("b") - 1)
    opens = F.element_at(F.array(*[F.lit(x).cast("long") for x in bounds]), F.col("b") + 1) == F.col("o")
    dealt = rows.select("*", bucket).select("k", "o", "t", F.explode(F.when(opens, F.array(F.struct("b", F.lit(0).alias("x")), F.struct(before.alias("b"), F.lit(1).alias("x")))).otherwise(F.array(F.struct("b", F.lit(0).alias("x"))))).alias("p")).select("k", "o", "t", "p.b", "p.x")
    w = Window.partitionBy("b").orderBy("x", "o", "t")
    half = F.floor(F.length("t") / 2).cast("int")
    placed = dealt.withColumns({"rn": F.row_number().over(w), "next": F.lead("t").over(w)})
    edited = F.concat(F.substring(F.col("t"), F.lit(1), F.length("t") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    texts = placed.select("b", "rn", "k", "x", "t", edited.alias("e"))
    keep = ["b", "rn", "k", "x", "n_chars", "sha"]
    sides = texts.select("b", "rn", "k", "x", F.length("t").cast("long").alias("n_chars"), F.sha2(F.col("e"), 256).alias("sha"), "t", "e")
    added = F.when(F.col("x") == 0, F.transform(terms(F.col("e")), lambda w: w.bitwiseOR(1))).otherwise(F.array().cast("array<bigint>"))
    lows = _lowest(_exploded(sides, keep, F.concat(terms(F.col("t")), added)), [*keep, "side"], m)
    of = lambda other, i: F.min(F.when(F.col("side") != other, F.col(f"s{i}")))
    signed = lows.groupBy(*keep).agg(*[of(1, i).alias(f"own{i}") for i in range(m)], *[of(0, i).alias(f"edit{i}") for i in range(m)])
    both = signed.select(*keep, _signature([F.col(f"own{i}") for i in range(m)]).alias("own"), _signature([F.col(f"edit{i}") for i in range(m)]).alias("edit"))
    ahead = both.withColumn("after", F.lead("own").over(Window.partitionBy("b").orderBy("rn"))).where("x = 0")
    return ahead.select(F.col("k").alias(key), "n_chars", F.col("sha").alias("edited_sha256"), text_of(F.col("own")).alias("fingerprint"), text_of(F.col("edit")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edit"), m).alias("near_edited"), likeness(F.col("own"), F.col("after"), m).alias("near_next"))
