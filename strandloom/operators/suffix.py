"""Suffix arrays by prefix doubling, and searches in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import bound_counts, cut, number_rows


def suffix_array(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, rank): all suffixes of all texts, the empty ones included, in their common order; equal suffixes share a rank.

    A round ranks pairs of ranks ``width`` apart; it ends when no ranks are shared but by equal whole
    suffixes, so after log2 of the longest repeat. Ranks come from counts of the distinct pairs, not of all suffixes.
    """
    n = F.length(text)
    rows = texts.select(key, F.explode(F.sequence(F.lit(0), n)).alias("pos"), F.col(text).alias("t"), n.alias("n"))
    # 0 is the end of a text; a character's rank is its code
    rows = rows.select(key, "pos", "n", F.when(F.col("pos") < F.col("n"), F.ascii(F.substring(F.col("t"), F.col("pos") + 1, F.lit(1))) + 1).otherwise(0).cast("long").alias("rank"))
    longest = texts.agg(F.max(n)).first()[0] or 0
    width, last = 1, -1
    while True:
        w = Window.partitionBy(key).orderBy("pos")
        pairs = rows.withColumn("next", F.coalesce(F.lead("rank", width).over(w), F.lit(-1)))
        distinct = number_rows(pairs.groupBy("rank", "next").agg(F.count("*").alias("c")), ["rank", "next"], "new").select(F.col("rank").alias("r"), F.col("next").alias("x"), "new")
        rows = cut(pairs.join(distinct, (F.col("rank") == F.col("r")) & (F.col("next") == F.col("x"))).select(key, "pos", "n", F.col("new").alias("rank")))
        count = rows.agg(F.max("rank")).first()[0]
        if count == last or width > longest:
            return rows.select(key, "pos", "rank")
        last, width = count, width * 2


def suffix_order(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, place): the place of each suffix, equal ones by key and position."""
    return number_rows(suffix_array(texts, key, text), ["rank", key, "pos"], "place").select(key, "pos", "place")


def suffixes(texts: DataFrame, key: str, text: str = "text", width: int | None = None) -> DataFrame:
    """(key, pos, suffix), each cut to ``width`` characters."""
    part = F.substring(F.col("t"), F.col("pos") + 1, F.lit(width) if width else F.length("t"))
    rows = texts.select(key, F.col(text).alias("t"), F.explode(F.sequence(F.lit(0), F.length(text))).alias("pos"))
    return rows.select(key, "pos", part.alias("suffix"))


def prefix_bounds(texts: DataFrame, queries: DataFrame, key: str, query: str, text: str = "text") -> DataFrame:
    """(query, lower, upper): the range of the suffix array whose suffixes start with each query.

    Suffixes are cut to the length of the longest query and counted by value before they are sorted.
    """
    longest = queries.agg(F.max(F.length(query))).first()[0] or 0
    cut = suffixes(texts, key, text, longest + 1).groupBy("suffix").agg(F.count("*").alias("n"))
    asked = queries.select(F.col(query).alias("q")).distinct()
    starts = asked.join(cut.withColumn("len", F.explode(F.array(*[F.lit(k) for k in _lengths(queries, query)]))), (F.length("q") == F.col("len")) & (F.col("q") == F.substring(F.col("suffix"), F.lit(1), F.col("len"))))
    within = starts.groupBy("q").agg(F.sum("n").alias("within"))
    below = bound_counts(cut, asked, "suffix", "q", weight="n").select("q", "lower")
    return below.join(within, "q", "left").select(F.col("q").alias(query), "lower", (F.col("lower") + F.coalesce("within", F.lit(0))).cast("long").alias("upper"))


def _lengths(queries: DataFrame, query: str) -> list[int]:
    """The lengths of queries that occur."""
    return sorted(r[0] for r in queries.select(F.length(query).alias("n")).distinct().collect())
