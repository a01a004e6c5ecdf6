"""Interval joins and the windows that grow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: widths of the bins, as powers of two; an interval is stored in the smallest bin that holds it
SHIFTS = (12, 15, 18, 21, 24, 27, 30, 33, 62)


def _level(start: Column, end: Column) -> Column:
    """The number of the smallest bin width with start and end-1 in one bin."""
    last = F.greatest(start, end - 1)
    out = F.lit(len(SHIFTS) - 1)
    for k in reversed(range(len(SHIFTS) - 1)):
        out = F.when(F.shiftright(start, SHIFTS[k]) == F.shiftright(last, SHIFTS[k]), k).otherwise(out)
    return out


def _shift(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SHIFTS]), level + 1)


def _bins(k: int, lo: Column, hi: Column) -> Column:
    """The bins of the level ``k`` from ``lo`` to ``hi``; the widest level is one bin, so that it also holds what lies across 0."""
    if k == len(SHIFTS) - 1:
        return F.when(lo.isNotNull() & hi.isNotNull(), F.array(F.lit(0).cast("long")))
    return F.sequence(F.shiftright(lo, SHIFTS[k]), F.shiftright(hi, SHIFTS[k]))


def overlap_join(probes: DataFrame, regions: DataFrame, chrom: str = "chrom", lo: str = "lo", hi: str = "hi", how: str = "inner") -> DataFrame:
    """Each probe [lo, hi) with each region (chrom, start, end) that it overlaps; columns chrom_r, start and end are added.

    Both are half-open; an empty region at ``hi`` or inside counts as touched.
    The keys are chromosome and bin, of bins of several widths: a region is in one bin, a probe asks the bins of
    each width that occurs. So a chromosome with most of the rows is spread over its bins, wide regions are not copied,
    a pair meets once, and the plan is an equi-join, which Spark broadcasts if one side is small at run time.
    """
    r = regions.select(F.col("chrom").alias("chrom_r"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *[c for c in regions.columns if c not in ("chrom", "start", "end")])
    r = r.withColumn("level_r", _level(F.col("start"), F.col("end"))).withColumn("bin_r", F.when(F.col("level_r") < len(SHIFTS) - 1, F.call_function("shiftright", F.col("start"), _shift(F.col("level_r")))).otherwise(0))
    levels = sorted(x[0] for x in r.select("level_r").distinct().collect())  # len(SHIFTS) at most
    first, last = F.col(lo).cast("long"), F.greatest(F.col(hi), F.col(lo)).cast("long")
    asked = F.flatten(F.array(*[F.transform(_bins(k, first, last), lambda b: F.struct(F.lit(k).alias("level"), b.alias("bin"))) for k in levels] or [F.array().cast("array<struct<level:int,bin:bigint>>")]))  # noqa: B023
    inside = ((F.col("start") < F.col(hi)) | ((F.col("start") == F.col(hi)) & (F.col("end") <= F.col(hi)))) & (F.col("end") > F.col(lo))
    p = probes.withColumn("_b", F.explode_outer(asked) if how == "left" else F.explode(asked))
    out = p.join(r, (F.col(chrom) == F.col("chrom_r")) & (F.col("_b.level") == F.col("level_r")) & (F.col("_b.bin") == F.col("bin_r")) & inside, how)
    return out.drop("_b", "level_r", "bin_r")


def overlap_extent(probes: DataFrame, regions: DataFrame, key: str, chrom: str = "chrom", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(key, hits, min_start, max_end) of the regions that each probe overlaps; probes without one do not occur. Partial sums go before the shuffle."""
    return overlap_join(probes.select(key, chrom, lo, hi), regions.select("chrom", "start", "end"), chrom, lo, hi).groupBy(key).agg(F.count("*").alias("hits"), F.min("start").alias("min_start"), F.max("end").alias("max_end"))


def footprint_window(low: Column, high: Column, clip_start: Column, clip_end: Column, ref_length: Column, overrun: int, reclaim: int) -> tuple[Column, Column]:
    """[lo, hi) around the first and last matched base: ``overrun`` more on each side, ``reclaim`` more for each clipped base, within the reference."""
    lo = F.greatest(low - (F.lit(overrun) + clip_start * reclaim), F.lit(0))
    hi = F.least(high + F.lit(overrun) + clip_end * reclaim, ref_length - 1) + 1
    return lo.cast("long"), hi.cast("long")


def grow_window(lo: Column, hi: Column, low: Column, high: Column, min_start: Column, max_end: Column, ref_length: Column, max_expand: int) -> tuple[Column, Column]:
    """The window with the regions it overlaps taken in, at most ``max_expand`` beyond the matched bases on each side (-1: no limit), within the reference."""
    lo, hi = F.least(lo, F.coalesce(min_start, lo)), F.greatest(hi, F.coalesce(max_end, hi))
    if max_expand >= 0:
        lo, hi = F.greatest(lo, low - max_expand), F.least(hi, high + 1 + max_expand)
    return F.greatest(lo, F.lit(0)).cast("long"), F.least(hi, ref_length).cast("long")
