"""URL filter by Bloom filter cascades.

The corpus' complete key universe is known: every host suffix and path prefix
of a URL that a rule could name. The first Bloom filter encodes the listed keys,
the second the keys of the universe that falsely pass the first, the third the listed keys
that falsely pass the second, and so on until nothing passes falsely. Walking the
levels then tells listed keys from all others exactly, over the whole universe,
without a join. One cascade holds the blocked rules and one the allowed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, free_name

#: false positive rate of the first level; later levels have one half
FIRST_RATE = 0.01
#: filters of a cascade together may have so many bytes (they go to every task); larger lists are joined
MAX_FILTER_BYTES = 1 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, block: list[str], allow: list[str]) -> DataFrame:
    """(rule, action) of rules like ``example.net/en/``: the host ends at the first slash."""
    rules = [(r, "block") for r in block] + [(r, "allow") for r in allow]
    if not rules:
        return spark.sql("select '' as rule, '' as action where false")
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(a).alias("action")) for r, a in rules])).alias("x")
    return spark.range(1).select(each).select("x.*")


def _shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """(host labels, path length) that occur: as many as distinct shapes of rules, not as rules."""
    host = F.substring_index("rule", "/", 1)
    shape = rules.select(F.size(F.split(host, "\\.")).alias("labels"), (F.length("rule") - F.length(host)).alias("chars"))
    return sorted((r["labels"], r["chars"]) for r in shape.distinct().collect())


def _keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of a URL that a rule could have: host suffixes of whole labels, and path prefixes."""
    labels = F.size(F.split(host, "\\."))
    one = lambda n, c: F.when((labels >= n) & (F.length(path) >= c), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, c)))
    return F.array_distinct(F.array_compact(F.array(*[one(n, c) for n, c in shapes]).cast("array<string>")))


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("long")) for i in range(hashes)]


class Cascade:
    """Levels of Bloom filters: (bits, hashes, words), the words being 64 bits each."""

    def __init__(self, levels: list[tuple[int, int, list[int]]]):
        self.levels = levels

    def passes(self, key: Column, n: int) -> Column:
        bits, hashes, words = self.levels[n]
        held = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one literal
        out = F.lit(True)
        for p in _positions(key, n, bits, hashes):
            out = out & (F.getbit(F.element_at(held, (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
        return out

    def contains(self, key: Column) -> Column:
        """Exact for the keys of the universe it was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for n in reversed(range(len(self.levels))):
            out = F.when(~self.passes(key, n), F.lit(n % 2 == 1)).otherwise(out)
        return out


def _size(n: int, rate: float) -> tuple[int, int]:
    bits = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2) / 64) * 64)
    return bits, max(1, min(16, round(bits / n * math.log(2))))


def build_cascade(universe: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> Cascade | None:
    """A cascade over (key, listed); None if it would be larger than ``max_bytes``."""
    levels: list[tuple[int, int, list[int]]] = []
    encoded, other = universe.filter("listed"), universe.filter("not listed")
    total = 0
    while n := encoded.count():
        bits, hashes = _size(n, FIRST_RATE if not levels else 0.5)
        total += bits // 8
        if total > max_bytes:
            return None
        at = encoded.select(F.explode(F.array(*_positions(F.col("key"), len(levels), bits, hashes))).alias("p"))
        word = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b"))
        held = {r["w"]: r["b"] for r in word.collect()}  # bits / 64 words at most
        levels.append((bits, hashes, [held.get(i, 0) for i in range(bits // 64)]))
        encoded, other = other.filter(Cascade(levels).passes(F.col("key"), len(levels) - 1)), encoded
    return Cascade(levels)


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules`` has (rule, action), a rule being a host and what its URLs' paths
    start with; it fits the host and all subdomains. The longest fitting rule
    decides; a rule that is both blocked and allowed blocks; without a fitting rule the
    verdict is allow and the rule null. A null URL or one without ``://`` has an
    empty host and path and so no rule. Repeated rows each get their result; existing columns
    called host, path, rule or verdict are replaced; empty tables are fine.
    """
    spark = pages.sparkSession
    work = Work(spark, "url-filter")
    rules = work.cut(rules.filter("rule is not null and substring_index(rule, '/', 1) <> ''").select("rule", "action").distinct().coalesce(1), "rules")
    shapes = _shapes(rules)
    out = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if not shapes:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    keys = _keys(F.col("host"), F.col("path"), shapes)
    # the universe: every key of the corpus, and the listed ones; one aggregation, no join
    corpus = out.select(F.explode(keys).alias("key")).select("key", F.lit(False).alias("block"), F.lit(False).alias("allow"))
    listed = rules.select(F.col("rule").alias("key"), (F.col("action") == "block").alias("block"), (F.col("action") == "allow").alias("allow"))
    universe = work.cut(corpus.unionByName(listed).groupBy("key").agg(F.max("block").alias("block"), F.max("allow").alias("allow")), "universe")
    built = {a: build_cascade(universe.select("key", F.col(a).alias("listed")), max_bytes) for a in ("block", "allow")}
    if any(c is None for c in built.values()):
        return _joined(out, rules, shapes, work)
    hit = lambda a: F.filter(keys, built[a].contains)
    mark = lambda a: F.transform(hit(a), lambda k: F.struct(F.length(k).alias("n"), (F.lit(a) == "block").alias("blocks"), k.alias("rule")))
    best = free_name(out, "best")
    out = out.withColumn(best, F.array_max(F.concat(mark("block"), mark("allow"))))
    return _judged(out, best)


def _judged(out: DataFrame, best: str) -> DataFrame:
    verdict = F.when(F.coalesce(F.col(best)["blocks"], F.lit(False)), "block").otherwise("allow")
    return out.withColumns({"rule": F.col(best)["rule"], "verdict": verdict}).drop(best)


def _joined(out: DataFrame, rules: DataFrame, shapes: list[tuple[int, int]], work: Work) -> DataFrame:
    """For lists whose cascade is too large for every task: a join on the key for each distinct host and path."""
    sites = out.select("host", "path").distinct()
    cand = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.explode(_keys(F.col("host"), F.col("path"), shapes)).alias("rule"))
    best = free_name(out, "best")
    got = cand.join(rules, "rule").groupBy("_h", "_p").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "block").alias("blocks"), "rule")).alias(best))
    got = work.cut(got, "sites")  # a plain table, so that the join splits a site with many pages
    out = out.join(got, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").drop("_h", "_p")
    return _judged(out, best)
