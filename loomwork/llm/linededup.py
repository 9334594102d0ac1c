"""Line dedup by winnowing over line hashes, with DataFrame operations only.

A document is its sequence of non-blank, trimmed lines.  A line is deleted if and only if it lies in a
run of ``window + 1`` lines that also occurs at an earlier place (least key, then line; the places may
overlap), or has at least ``long_words`` words and occurs earlier.  So every deleted line has an equal
line before it, the first of equal lines always stays, and a longer repeated run goes whole even where
its parts were first seen in different documents.

Pairs of neighbouring lines are hashed and each run keeps the least pair hash in it: equal runs keep
equal fingerprints.  Only runs whose fingerprint stands at two places go on; there the match is extended
over the lines on both sides of the fingerprint by joining 128-bit hashes of whole runs.  First places
are plain minima, so a run in a third of all documents is combined before the shuffle.

Null text stays null.  Texts of any length are taken whole.  Rows with the same key and text are one
document and get the same result; of two texts with one key the one with the smaller hash comes first.
Blank lines stay, but a document that loses all its other lines becomes empty.  Documents of fewer than
``window + 1`` lines lose long lines only.  Null keys come first.  Columns of any other name are kept as
they are.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _trimmed(text: Column | str) -> Column:
    """The lines without outer blanks; ``trim`` itself takes a second parameter, so it needs the lambda."""
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def _hold(df: DataFrame, **made: Column) -> DataFrame:
    """Add columns through a generator of one row, so that later lambdas read them instead of computing them again for each element."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("_held")).select(*df.columns, *[F.col(f"_held.{n}").alias(n) for n in made])


def _runs(docs: DataFrame, window: int, long_words: int) -> DataFrame:
    """(o, th, fp, at, s, n, k1, k2): every run of ``n`` lines from line ``s`` on, with its fingerprint and where that stands; long lines are runs of one."""
    lines = _hold(docs.where("text is not null"), lines=F.filter(_trimmed("text"), lambda x: x != "")).drop("text")
    hashed = lines.select("o", "th", F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("h1"), F.transform("lines", lambda x: F.xxhash64(F.lit(2), x)).alias("h2"), F.transform("lines", lambda x: _words(x) >= long_words).alias("long"))
    lines = _hold(hashed, m=F.size("long"))
    pairs = F.zip_with(F.slice("h1", F.lit(1), F.greatest(F.col("m") - 1, F.lit(0))), F.slice("h1", F.lit(2), F.greatest(F.col("m") - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    lines = _hold(lines, pair=F.transform(pairs, lambda g, i: F.struct(g.alias("g"), (-i).alias("i"))))
    key = lambda c, s, n: F.xxhash64(F.slice(c, s, F.lit(n)))
    run = lambda least, s, n: F.struct(least["g"].alias("fp"), (1 - least["i"]).alias("at"), s.alias("s"), F.lit(n).alias("n"), key("h1", s, n).alias("k1"), key("h2", s, n).alias("k2"))
    starts = F.when(F.col("m") > window, F.sequence(F.lit(1), F.col("m") - window)).otherwise(F.array().cast("array<int>"))
    minima = F.transform(starts, lambda s: F.struct(s.alias("s"), F.array_min(F.slice("pair", s, F.lit(window))).alias("p")))
    wide = F.transform(minima, lambda x: run(x["p"], x["s"], window + 1))
    single = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.col("m"), F.lit(1))), lambda s: F.coalesce(F.get("long", s - 1), F.lit(False))), lambda s: run(F.struct(F.get("h2", s - 1).alias("g"), (1 - s).alias("i")), s, 1))
    return lines.select("o", "th", F.explode(F.concat(wide, single)).alias("r")).select("o", "th", "r.*")


def _later(runs: DataFrame) -> DataFrame:
    """The runs that also occur at an earlier place."""
    place = F.struct("o", "th", "at")
    shared = runs.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fp")
    met = runs.join(shared, "fp").select("o", "th", "s", "n", "k1", "k2")
    first = met.groupBy("k1", "k2", "n").agg(F.min(F.struct("o", "th", "s")).alias("a"), F.max(F.struct("o", "th", "s")).alias("b")).where("a <> b").select("k1", "k2", "n", F.col("a.o").alias("fo"), F.col("a.th").alias("fth"), F.col("a.s").alias("fs"))
    return met.join(first, ["k1", "k2", "n"]).where("not (o = fo and th = fth and s = fs)").select("o", "th", "s", "n")


def dedup_lines(df: DataFrame, window: int = 2, long_words: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with later repeated runs deleted from ``text``, and n_lines, n_removed, removed (line numbers among the non-blank ones), which replace columns of those names."""
    names = [c for c in df.columns if c not in ("n_lines", "n_removed", "removed")]
    inner = {c: f"c{i}" for i, c in enumerate(names)}  # own names, so that none of the caller's can clash
    text_ = inner[text]
    held = df.select(*[df[c].alias(inner[c]) for c in names])
    named = held.withColumn("o", F.coalesce(F.col(inner[key]).cast("long"), F.lit(-(1 << 63)))).withColumn("th", F.xxhash64(text_))
    later = _later(_runs(named.select("o", "th", F.col(text_).alias("text")), window, long_words))
    spans = later.select("o", "th", F.sequence(F.col("s"), F.col("s") + F.col("n") - 1).alias("r"))
    gone = spans.groupBy("o", "th").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("r")))).alias("gone"))
    out = named.join(gone, ["o", "th"], "left")
    full = F.size(F.filter(F.coalesce(F.split(text_, "\n"), F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    some = F.col("gone").isNotNull() & (F.size("gone") < F.col("m"))
    out = _hold(out, m=full)
    out = _hold(out, lines=F.when(some, F.split(text_, "\n")))
    out = _hold(out, order=F.filter(F.transform("lines", lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull()))
    out = _hold(out, dead=F.transform("gone", lambda g: F.get("order", g - 1)))
    out = _hold(out, live=F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dead"))
    kept = F.when(F.col("gone").isNull(), F.col(text_)).when(some, F.array_join(F.transform("live", lambda i: F.get("lines", i)), "\n")).otherwise("")
    kept_columns = [kept.alias(c) if c == text else F.col(inner[c]).alias(c) for c in names]
    return out.select(*kept_columns, F.col("m").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("gone", F.array().cast("array<int>")).alias("removed"))


#: The same over the table ``documents``, whose keys are unique.
ORACLE = """
WITH l AS (
  SELECT doc_id, t.pos, t.raw, trim(t.raw, ' ') AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM documents WHERE text IS NOT NULL) t),
n AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ln FROM l WHERE line <> ''),
x AS (SELECT doc_id, ln, line, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY ln)),
r AS (
  SELECT doc_id, ln, 3 AS len, line || chr(10) || b || chr(10) || c AS run FROM x WHERE c IS NOT NULL
  UNION ALL
  SELECT doc_id, ln, 1, line FROM x WHERE length(line) - length(replace(line, ' ', '')) + 1 >= 20),
m AS (SELECT doc_id, ln AS lo, ln + len - 1 AS hi FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, ln) > 1),
d AS (SELECT DISTINCT n.doc_id, n.pos FROM n JOIN m ON n.doc_id = m.doc_id AND n.ln BETWEEN m.lo AND m.hi),
c AS (SELECT l.doc_id, count(*) FILTER (WHERE l.line <> '') AS n_lines, count(d.pos) AS n_removed, string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE d.pos IS NULL) AS kept
      FROM l LEFT JOIN d USING (doc_id, pos) GROUP BY l.doc_id)
SELECT t.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed,
       CASE WHEN t.text IS NULL THEN NULL WHEN c.n_removed > 0 AND c.n_removed = c.n_lines THEN md5('') ELSE md5(c.kept) END AS text_md5
FROM documents t LEFT JOIN c USING (doc_id)
"""
