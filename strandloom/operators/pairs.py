"""Mates: pairing by read name and the fields that depend on the mate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import sam


def with_mates(df: DataFrame, mate: Column, name: str = "qname", order: str = "ord", needs: str = "needs_pair", out: str = "mate") -> DataFrame:
    """``df`` with the struct ``mate`` of each row's mate, null for single rows.

    Of the rows that need a pair, the first and second of a name are mates, the third and
    fourth, and so on; a last odd one stays single. One shuffle by name.
    """
    w = Window.partitionBy(F.col(name), F.col(needs)).orderBy(order)
    turn = F.row_number().over(w)
    other = F.when(turn % 2 == 1, F.lead(mate).over(w)).otherwise(F.lag(mate).over(w))
    return df.withColumn(out, F.when(F.col(needs), other))


def pair_rows(df: DataFrame, name: str = "qname", order: str = "ord") -> DataFrame:
    """(first, second, name) of each pair: the orders of the two mates."""
    w = Window.partitionBy(name).orderBy(order)
    rows = df.select(F.col(name), F.col(order).alias("first"), F.lead(order).over(w).alias("second"), F.row_number().over(w).alias("n"))
    return rows.filter((F.col("n") % 2 == 1) & F.col("second").isNotNull()).select("first", "second", name)


def template_length(lo: Column, hi: Column, mate_lo: Column, mate_hi: Column) -> Column:
    """The span of both mates, negative unless (lo, hi) comes first."""
    span = F.greatest(hi, mate_hi) - F.least(lo, mate_lo)
    return F.when((lo < mate_lo) | ((lo == mate_lo) & (hi < mate_hi)), span).otherwise(-span)


def mate_fields(flag: Column, lo: Column, hi: Column, mate: Column) -> dict[str, Column]:
    """flag, rnext, pnext and tlen of a record whose mate is the struct (rname, flag, have, low, high); a null mate changes nothing but is for the caller to see."""
    here = ~sam.has(flag, S.UNMAPPED)
    bits = F.lit(S.MULTI_SEGMENT)
    bits = bits + F.when(mate["have"], F.when(here, S.ALL_ALIGNED).otherwise(0)).otherwise(S.NEXT_UNMAPPED)
    bits = bits.bitwiseOR(F.when(sam.has(mate["flag"], S.REVERSED), S.NEXT_REVERSED).otherwise(0))
    return {
        "flag": flag.bitwiseOR(bits),
        "rnext": F.when(mate["have"], mate["rname"]).otherwise(""),
        "pnext": F.when(mate["have"], mate["low"]).otherwise(-1).cast("long"),
        "tlen": F.when(mate["have"] & here, template_length(lo, hi, mate["low"], mate["high"])).otherwise(0).cast("long"),
    }
