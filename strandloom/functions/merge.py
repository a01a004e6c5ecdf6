"""Merging two aligned reads and the probability of an alignment, as columns.

An alignment is a path: arrays ``a`` and ``b`` of places in the two sequences,
one step each. Expanded, it is an array of pairs of bases ('' is a gap) with log10 errors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pow10(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


def merged_quality(same: Column, win: Column, lose: Column) -> Column:
    """log10 error of the merged base, from the errors of the base that wins and the one that loses."""
    w, x = _pow10(win), _pow10(lose)
    agree = F.log10((w * x / 3) / (1 - w - x + 4 * w * x / 3))
    differ = F.log10(w * (1 - x / 3) / (w + x - 4 * w * x / 3))
    return F.when(same, agree).otherwise(differ)


def merge_overlap(pairs: Column) -> Column:
    """array<struct<base, qual>> from array<struct<a, qa, b, qb>>: the base of the lower error wins, b on a tie; a winning gap drops the base."""
    def one(p: Column) -> Column:
        first = p["qa"] < p["qb"]
        same = p["a"] == p["b"]
        return F.struct(F.when(first, p["a"]).otherwise(p["b"]).alias("base"), F.when(first, merged_quality(same, p["qa"], p["qb"])).otherwise(merged_quality(same, p["qb"], p["qa"])).alias("qual"))

    return F.transform(F.filter(pairs, lambda p: F.when(p["qa"] < p["qb"], p["a"]).otherwise(p["b"]) != ""), one)


def fill_gap_quality(bases: Column, quals: Column) -> Column:
    """Errors with those of gaps ('' in ``bases``) replaced: the log10 mean of the errors beside the gap, the
    one there is at an end, minus infinity if all are gaps."""
    n = F.size(bases)
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    real = F.filter(index, lambda i: F.get(bases, i) != "")

    def at(i: Column) -> Column:
        left, right = F.array_max(F.filter(real, lambda j: j < i)), F.array_min(F.filter(real, lambda j: j > i))
        l, r = F.get(quals, left), F.get(quals, right)  # noqa: E741
        gap = F.when(left.isNotNull() & right.isNotNull(), F.log10((_pow10(l) + _pow10(r)) / 2)).otherwise(F.coalesce(l, r, F.lit(float("-inf"))))
        return F.when(F.get(bases, i) != "", F.get(quals, i)).otherwise(gap)

    return F.transform(index, at)


def expand_path(a: Column, b: Column, seq_a: Column, qual_a: Column, seq_b: Column, qual_b: Column) -> Column:
    """array<struct<a, qa, b, qb>> of the steps of a path, gap errors filled in."""
    steps = F.when(F.size(a) > 1, F.sequence(F.lit(1), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
    moved = lambda x, i: F.get(x, i) != F.get(x, i - 1)
    base = lambda s, x, i: F.when(moved(x, i), F.substring(s, F.get(x, i - 1) + 1, F.lit(1))).otherwise("")
    qual = lambda q, x, i: F.when(moved(x, i), F.get(q, F.get(x, i - 1))).otherwise(0.0)
    base_a, base_b = F.transform(steps, lambda i: base(seq_a, a, i)), F.transform(steps, lambda i: base(seq_b, b, i))
    fill_a = fill_gap_quality(base_a, F.transform(steps, lambda i: qual(qual_a, a, i)))
    fill_b = fill_gap_quality(base_b, F.transform(steps, lambda i: qual(qual_b, b, i)))
    return F.transform(steps, lambda i: F.struct(F.get(base_a, i - 1).alias("a"), F.get(fill_a, i - 1).alias("qa"), F.get(base_b, i - 1).alias("b"), F.get(fill_b, i - 1).alias("qb")))


def overhang(a: Column, b: Column, seq_a: Column, seq_b: Column, end: bool) -> Column:
    """The part of the one sequence that reaches beyond the alignment at its start or end; null if both do."""
    if end:
        last_a, last_b = F.element_at(a, -1), F.element_at(b, -1)
        rest_a, rest_b = F.substring(seq_a, last_a + 1, F.length(seq_a)), F.substring(seq_b, last_b + 1, F.length(seq_b))
    else:
        rest_a, rest_b = F.substring(seq_a, F.lit(1), F.get(a, 0)), F.substring(seq_b, F.lit(1), F.get(b, 0))
    return F.when((rest_a != "") & (rest_b != ""), None).when(rest_a != "", rest_a).otherwise(rest_b)


def alignment_log10(a: Column, b: Column, seq_a: Column, seq_b: Column, qual_b: Column, gap_open: float, gap_extend: float) -> Column:
    """log10 probability of read b given the path: matches, mismatches and affine gaps; overhangs of the read are gaps."""
    n = F.size(a)
    length = F.length(seq_b)
    over = lambda k: F.when(k > 0, F.lit(gap_open) + k * F.lit(gap_extend)).otherwise(0.0)
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))

    def step(s: Column, i: Column) -> Column:
        ma, mb = F.get(a, i) != F.get(a, i - 1), F.get(b, i) != F.get(b, i - 1)
        kind = F.when(ma & mb, "M").when(ma, "D").otherwise("I")
        q = F.get(qual_b, F.get(b, i - 1))
        same = F.substring(seq_a, F.get(a, i - 1) + 1, F.lit(1)) == F.substring(seq_b, F.get(b, i - 1) + 1, F.lit(1))
        match = F.when(same, F.log10(1 - _pow10(q))).otherwise(q + F.log10(F.lit(1 / 3)))
        gap = F.when(s["kind"] == kind, 0.0).otherwise(F.lit(gap_open)) + F.lit(gap_extend)
        return F.struct((s["p"] + F.when(kind == "M", match).otherwise(gap)).alias("p"), kind.alias("kind"))

    path = F.aggregate(steps, F.struct(F.lit(0.0).alias("p"), F.lit("M").alias("kind")), step, lambda s: s["p"])
    whole = path + over(F.get(b, 0)) + over(length - F.element_at(b, -1))
    return F.when(n <= 1, F.lit(gap_open) + length * F.lit(gap_extend)).otherwise(whole)
