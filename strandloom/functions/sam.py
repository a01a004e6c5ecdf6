"""Columns over alignment records: flags, tags, the record rewritten as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def has(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def is_primary(flag: Column) -> Column:
    """Neither secondary nor supplementary."""
    return ~has(flag, S.SECONDARY | S.SUPPLEMENTARY)


def needs_pair(flag: Column) -> Column:
    return has(flag, S.MULTI_SEGMENT)


def is_aligned(flag: Column, pos: Column, cigar: Column) -> Column:
    """Mapped, not both first and last, placed, and with a matching operation."""
    both = flag.bitwiseAND(F.lit(S.FIRST | S.LAST)) == (S.FIRST | S.LAST)
    return ~has(flag, S.UNMAPPED) & ~both & (pos >= 0) & cigar.rlike("[M=X]")


def kept_flags(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(S.KEPT_FLAGS))


def kept_tags(extra: Column, prefixes: list[str]) -> Column:
    """The tab-separated tags that start with one of ``prefixes``, in their order."""
    if not prefixes:
        return F.lit("")
    starts = lambda t: F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(t, p))
    return F.array_join(F.filter(F.split(extra, "\t"), starts), "\t")
