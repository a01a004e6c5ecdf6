"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

A document is a sequence of line ids. Level 0 ranks the ids that occur more than
once; level k+1 ranks the pairs of level-k ranks that lie 2**k lines apart, so
the rank of level k is the place of a suffix among all suffixes sorted by their
first 2**k lines. Suffixes whose prefix is unique leave, as nothing longer
repeats there. Suffixes that agree on their first m lines form an interval of
the suffix array whose longest common prefix is m or more; the interval of any m is
named by two ranks of level floor(log2 m) that overlap. The doubling stops at
the level that the longest needed prefix asks for.

A run of lines is a repeat if it has ``min_words`` words or more, and a later copy
if an equal run begins earlier, in order of id, text hash and line. All
lines of later copies go. A line lies in a later copy exactly if it lies in a
later copy that is minimal in words from its first or from its last line, so only
those runs are looked up: at most two for each line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, free_name, sorted_ids

MIN_WORDS = 50
_DOC = ["doc_id", "tkey"]


def _same(left: list[Column], right: list[Column]) -> Column:
    out = left[0].eqNullSafe(right[0])
    for a, b in zip(left[1:], right[1:], strict=True):
        out = out & a.eqNullSafe(b)
    return out


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tkey, pos, h, g, w): the lines with their two hashes and words."""
    text = F.col(text_col)
    line = lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), F.regexp_count(x, F.lit("[^\\x20\\x09-\\x0D]+")).alias("w"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tkey"), F.posexplode(F.transform(F.split(text, "\n", -1), line)).alias("pos", "line"))
    return rows.select("doc_id", "tkey", "pos", "line.*")


def _ranked(rows: DataFrame, keys: list[str], work: Work, tag: str) -> DataFrame:
    """``rows`` whose ``keys`` occur more than once, with the rank ``r`` of the keys in their order."""
    often = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys])
    ranks = sorted_ids(often, [F.col(f"_{k}") for k in keys], work, f"{tag}-ranks", "r")
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    return rows.join(ranks, cond).drop(*keys, *[f"_{k}" for k in keys])


def _islands(rows: DataFrame, min_words: int) -> DataFrame:
    """Runs of neighbouring repeated lines that have enough words, with the words before (c0) and through (c1) each line."""
    doc = Window.partitionBy(*_DOC).orderBy("pos")
    rows = rows.withColumn("island", F.col("pos") - F.row_number().over(doc))
    island = Window.partitionBy(*_DOC, "island")
    rows = rows.withColumn("c1", F.sum("w").over(island.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("all", F.sum("w").over(island)).filter(F.col("all") >= min_words).withColumn("c0", F.col("c1") - F.col("w"))


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, tkey, s, m): the shortest run of ``min_words`` from each line on, and the one up to each line."""
    key = [*_DOC, "island"]
    mark = lambda x, kind: F.struct(x.alias("x"), F.lit(kind).alias("kind"))
    two = lambda a, b: rows.select(*key, "pos", F.explode(F.array(a, b)).alias("e")).select(*key, "pos", "e.*")
    # from a line on: the first line whose running words reach those before it plus min_words
    on = two(mark(F.col("c0") + min_words, 1), mark(F.col("c1"), 0))
    w = Window.partitionBy(*key).orderBy(F.desc("x"), "kind", F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    end = F.last(F.when(F.col("kind") == 0, F.col("pos")), ignorenulls=True).over(w)
    on = on.withColumn("end", end).filter("kind = 1 and end is not null").select(*_DOC, F.col("pos").alias("s"), (F.col("end") - F.col("pos") + 1).alias("m"))
    # up to a line: the last line before which the running words are less by min_words
    to = two(mark(F.col("c1") - min_words, 1), mark(F.col("c0"), 0))
    w = Window.partitionBy(*key).orderBy("x", "kind", "pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("kind") == 0, F.col("pos")), ignorenulls=True).over(w)
    to = to.withColumn("start", start).filter("kind = 1 and start is not null").select(*_DOC, F.col("start").alias("s"), (F.col("pos") - F.col("start") + 1).alias("m"))
    return on.unionByName(to).filter("m > 0").distinct()


def later_copies(docs: DataFrame, work: Work, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tkey, s, m): runs of m lines from line s that are later copies of equal runs."""
    lines = work.cut(line_table(docs, id_col, text_col), "lines")  # read twice
    level = _ranked(lines, ["h", "g"], work, "level0")
    level = work.cut(_islands(level, min_words), "level0")
    work.drop(lines)
    runs = _windows(level, min_words)
    # floor(log2 m), from the bits of m
    runs = work.cut(runs.withColumn("k", F.length(F.bin("m")) - 1), "runs")
    depth = runs.agg(F.max("k")).first()[0]
    levels = [level.select(*_DOC, "pos", "r")]
    for k in range(depth or 0):
        doc = Window.partitionBy(*_DOC).orderBy("pos")
        # all lines between have a rank if the run of 2**(k+1) lines repeats, so it is that many rows ahead
        ahead = lambda c: F.lead(c, 1 << k).over(doc)  # noqa: B023, E731
        pairs = levels[-1].withColumn("at", ahead("pos")).withColumn("r2", ahead("r")).filter(F.col("at") == F.col("pos") + (1 << k))
        pairs = pairs.select(*_DOC, "pos", F.col("r").alias("r1"), "r2")
        levels.append(work.cut(_ranked(pairs, ["r1", "r2"], work, f"level{k + 1}"), f"level{k + 1}"))
    ranks = None
    for k, one in enumerate(levels):
        one = one.select(F.lit(k).alias("k_"), *[F.col(c).alias(f"{c}_") for c in (*_DOC, "pos", "r")])
        ranks = one if ranks is None else ranks.unionByName(one)

    def at(df: DataFrame, place: Column, name: str) -> DataFrame:
        cond = (F.col("k") == F.col("k_")) & _same([F.col(c) for c in _DOC], [F.col(f"{c}_") for c in _DOC]) & (place == F.col("pos_"))
        return df.join(ranks, cond).withColumn(name, F.col("r_")).drop("k_", "doc_id_", "tkey_", "pos_", "r_")

    named = at(runs, F.col("s"), "a")
    named = at(named, F.expr("s + m - shiftleft(1, k)"), "b")
    named = work.cut(named.select(*_DOC, "s", "m", "a", "b"), "named")
    place = F.struct(*_DOC, "s")
    heads = named.groupBy("m", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    heads = heads.select(F.col("m").alias("m_"), F.col("a").alias("a_"), F.col("b").alias("b_"), "first")
    heads = work.cut(heads, "heads")  # a plain table, so that a large interval is split in the join
    later = named.join(heads, (F.col("m") == F.col("m_")) & (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")))
    return later.filter(~place.eqNullSafe(F.col("first"))).select(*_DOC, "s", "m")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines of later copies taken out of the text, and ``lines_removed``.

    Every row stays; a text of which all lines go is empty. Null texts stay null
    and empty ones empty. Rows equal in id and text are one document and get one result;
    rows equal in id only are documents of their own. A null id is the first. Other
    columns are kept; one called lines_removed is replaced. An empty table gives no rows.
    """
    work = Work(docs.sparkSession, "line-dedup")
    docs = docs.drop("lines_removed")
    gone = later_copies(docs, work, id_col, text_col, min_words)
    gone = gone.select(*_DOC, F.explode(F.expr("sequence(s, s + m - 1)")).alias("pos")).groupBy(*_DOC).agg(F.collect_set("pos").alias("gone"))
    gone = work.cut(gone, "gone")
    tkey, d, t, g = (free_name(docs, x) for x in ("tkey", "doc_id_", "tkey_", "gone"))
    gone = gone.select(F.col("doc_id").alias(d), F.col("tkey").alias(t), F.col("gone").alias(g))
    rows = docs.withColumn(tkey, F.xxhash64(F.col(text_col)))
    # a merge join at any size: the list of lines grows with the corpus, so it is never broadcast
    rows = rows.join(gone.hint("merge"), _same([F.col(id_col), F.col(tkey)], [F.col(d), F.col(t)]), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(g))
    text = F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")
    return rows.withColumns({text_col: F.when(F.col(g).isNull(), F.col(text_col)).otherwise(text), "lines_removed": F.coalesce(F.size(g), F.lit(0)).cast("long")}).drop(tkey, d, t, g)
