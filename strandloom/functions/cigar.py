"""Columns over CIGAR strings, without user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: a match of one base or more
_MATCH = "\\+?0*[1-9][0-9]*[M=X]"
#: clips outside, alignment operations inside; padding is allowed anywhere
VALID = "^(?:\\+?[0-9]+[HP])*(?:\\+?[0-9]+[SP])*(?:\\+?[0-9]+[MIDNP=X])*(?:\\+?[0-9]+[SP])*(?:\\+?[0-9]+[HP])*$"


def is_valid(cigar: Column) -> Column:
    """Counts and known operations, and nothing but clips after an end clip."""
    return cigar.rlike(VALID)


def operations(cigar: Column) -> Column:
    """array<struct<n, op>> of the operations."""
    return _parted(_taken(cigar, "MIDNSHP=X", 0))


def _parted(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("long").alias("n"), F.right(x, F.lit(1)).alias("op")))


def _taken(cigar: Column, kinds: str, group: int) -> Column:
    """The operations of these kinds as texts, or with ``group`` 1 their counts: one search of the text, as nothing is shared between the steps of arrays."""
    return F.regexp_extract_all(cigar, F.lit(f"(\\+?[0-9]+)[{kinds}]"), F.lit(group))


def _total(cigar: Column, kinds: str) -> Column:
    return F.aggregate(_taken(cigar, kinds, 1), F.lit(0).cast("long"), lambda t, x: t + x.cast("long"))


def start_clip(cigar: Column) -> Column:
    """Bases clipped softly before the first alignment operation."""
    return _total(F.regexp_extract(cigar, "^((?:\\+?[0-9]+[SHP])*)", 1), "S")


def end_clip(cigar: Column) -> Column:
    """Bases clipped softly after the first alignment operation."""
    return _total(cigar, "S") - start_clip(cigar)


def read_length(cigar: Column) -> Column:
    """Read bases that the operations take, without clips."""
    return _total(cigar, "M=XI")


def reference_length(cigar: Column) -> Column:
    return _total(cigar, "M=XDN")


def bounds(cigar: Column, pos: Column) -> Column:
    """struct<low, high>: the first and last reference base that a read base matches; -1 and -1 without one."""
    met = cigar.rlike(_MATCH)
    # reference bases skipped before the first match and after the last
    low = pos + _total(F.regexp_extract(cigar, f"(?s)^(.*?){_MATCH}", 1), "DN")
    high = pos + reference_length(cigar) - 1 - _total(F.regexp_extract(cigar, f"(?s)^.*{_MATCH}(.*)$", 1), "DN")
    none = F.lit(-1).cast("long")
    return F.struct(F.coalesce(F.when(met, low), none).alias("low"), F.coalesce(F.when(met, high), none).alias("high"))


def positions(cigar: Column, pos: Column) -> Column:
    """array<long>: for each read base that is not clipped its reference position, -1 in insertions."""
    def add(s: Column, x: Column) -> Column:
        some = x["n"] > 0
        run = F.when(some & F.contains(F.lit("M=X"), x["op"]), F.sequence(s["at"], s["at"] + x["n"] - 1)).when(some & (x["op"] == "I"), F.array_repeat(F.lit(-1).cast("long"), x["n"].cast("int"))).otherwise(F.array().cast("array<bigint>"))
        return F.struct((s["at"] + F.when(x["op"] == "I", 0).otherwise(x["n"])).alias("at"), F.array_append(s["all"], run).alias("all"))

    start = F.struct(pos.cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("all"))
    return F.aggregate(_parted(_taken(cigar, "MIDN=X", 0)), start, add, lambda s: F.flatten(s["all"]))
