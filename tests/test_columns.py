"""Scalar columns on the edge rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar as C
from strandloom.functions import mangle, merge, numeric, quality, sam
from strandloom.functions import text as X


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def slow_cigar(cigar, pos):
    import re

    out, at, clip, seen = [], pos, [0, 0], False
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op in "M=X":
            out += range(at, at + n)
            at += n
        elif op == "I":
            out += [-1] * n
        elif op in "DN":
            at += n
        elif op == "S":
            clip[seen] += n
        seen = seen or op in "M=XIDN"
    real = [x for x in out if x >= 0]
    return out, *clip, (real[0], real[-1]) if real else (-1, -1)


def test_cigar_columns(spark):
    r = random.Random(1)
    cigars = ["", "6M", "5S", "3S4M", "4M3S", "2H3S1D4M2I3N5X1D2S1H", "3I", "2S3I2S", "0M4S", "1P2M"]
    for _ in range(60):
        mid = "".join(f"{r.randint(1, 4)}{r.choice('MIDN=X')}" for _ in range(r.randint(0, 6)))
        cigars.append(r.choice(["", "2S", "1H3S"]) + mid + (r.choice(["", "2S"]) if mid else ""))
    c = F.col("c")
    got = values(spark, [(x, 7) for x in cigars], "c string, p int", "c", C.positions(c, F.col("p")), C.start_clip(c), C.end_clip(c), C.bounds(c, F.col("p").cast("long")), C.is_valid(c))
    for cig, at, s, e, b, ok in got:
        assert ok
        assert (list(at), s, e, tuple(b)) == slow_cigar(cig, 7), cig


def test_cigar_text_is_searched_a_few_times(spark):
    c, p = F.col("c"), F.col("p")
    df = spark.createDataFrame([("3S+4M0M2D05M1I4N3S", 7), ("x5y+3M2D", 7), (None, 7), ("0M3I", 7)], "c string, p long")
    b = C.bounds(c, p)
    plan = df.select(b["low"].alias("x"), b["high"].alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 3
    plan = df.select(C.positions(c, p).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert [tuple(x) for x in df.select(b["low"], b["high"]).collect()] == [(7, 17), (7, 9), (-1, -1), (-1, -1)]
    assert [x[0] for x in df.select(C.positions(c, p)).collect()] == [[7, 8, 9, 10, 13, 14, 15, 16, 17, -1], [7, 8, 9], None, [-1, -1, -1]]


def test_bad_cigars(spark):
    assert [x[0] for x in values(spark, [("M",), ("3",), ("3Z",), ("2S3M2S1M",), ("2M2H3S",)], "c string", C.is_valid(F.col("c")))] == [False] * 5


def test_flags_and_tags(spark):
    rows = [(0, 3, "4M"), (4, 3, "4M"), (192, 3, "4M"), (64, -1, "4M"), (0, 3, "4S"), (0, 3, ""), (2048, 0, "1="), (256, 0, "1X")]
    got = values(spark, rows, "f int, p long, c string", sam.is_aligned(F.col("f"), F.col("p"), F.col("c")), sam.is_primary(F.col("f")))
    assert got == [(True, True), (False, True), (False, True), (False, True), (False, True), (False, True), (True, False), (True, False)]
    tags = "NM:i:1\tXA:Z:a\tNMx"
    assert values(spark, [(tags,), ("",)], "x string", sam.kept_tags(F.col("x"), ["NM"]), sam.kept_tags(F.col("x"), [])) == [("NM:i:1\tNMx", ""), ("", "")]


def test_qualities(spark):
    got = values(spark, [("ACGTNacgt", "!5~")], "s string, q string", quality.reverse_complement(quality.reverse_complement(F.col("s"))), quality.reverse_complement(F.col("s")), quality.log10s_to_phred(F.transform(quality.phreds_to_log10(F.col("q")), lambda x: x - 1e-9)), quality.log10_to_phred(F.lit(5.0)), quality.log10_to_phred(F.lit(-99.0)))
    assert got == [("ACGTNacgt", "tgcaNACGT", "!5~", "!", "~")]


def test_quality_arrays_go_in_batches(spark):
    p = quality.phreds_to_log10(F.col("q"))
    df = spark.createDataFrame([("!5~",), ("",), (None,), ("Ié+",)], "q string")
    assert [x[0] for x in df.select(p).collect()] == [[(ord(c) - 33) / -10.0 for c in q or ""] for q in ("!5~", "", None, "Ié+")]
    assert "lambdafunction" not in df.select(quality.log10s_to_phred(p).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    ps = spark.createDataFrame([([0.0, -9.9, float("nan"), float("-inf"), float("inf")],), ([],), (None,), ([None, -2.04],)], "p array<double>")
    want = ps.select(F.array_join(F.transform("p", quality.log10_to_phred), "")).collect()
    assert ps.select(quality.log10s_to_phred(F.col("p"))).collect() == want


def test_text(spark):
    got = values(spark, [(" 12x",), ("-7",), ("x",), ("",), ("+3.5",), ("99999999999999999999",)], "t string", X.atol(F.col("t")))
    assert [g[0] for g in got] == [12, -7, 0, 0, 3, 0]
    got = values(spark, [("chr1:5-9",), ("chr1:5",), ("chr1",), ("c:5-x",), ("c:",)], "t string", X.ucsc(F.col("t")))
    assert [tuple(g[0]) for g in got] == [("chr1", 5, 9, ""), ("chr1", 5, 6, ""), ("", -1, -1, "no colon"), ("", -1, -1, "illegal character"), ("", -1, -1, "illegal character")]
    got = values(spark, [("a\\tb\\\\n",), ("a\\x",), ("end\\",), ("",)], "t string", X.unescape(F.col("t")))
    assert [g[0] for g in got] == ["a\tb\\n", None, None, ""]
    assert values(spark, [("abcabd", "abcxbd")], "a string, b string", X.differ_at(F.col("a"), F.col("b")), X.differ_at(F.col("a"), F.col("a")), X.hex_byte(F.lit("fF")), X.find(F.col("a"), F.lit("zz"))) == [(3, 6, 255, 6)]


def test_mangles(spark):
    ops = [("+", 3), ("*", -2), ("/", 3), ("-", 1)]
    got = values(spark, [(v, ops) for v in (-9, 0, 7)], "v long, o array<struct<op:string,arg:long>>", mangle.apply_script(F.col("v"), F.col("o")))
    assert [g[0] for g in got] == [mangle.run_script(v, ops) for v in (-9, 0, 7)] == [3, -3, -7]


def test_log_sums(spark):
    rows = [("a", -1.0), ("a", -2.0), ("a", float("-inf")), ("b", -400.0), ("b", -400.0), ("c", float("-inf"))]
    got = dict(tuple(r) for r in numeric.log10_sum_by(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", "s").collect())
    assert got["a"] == pytest.approx(math.log10(0.11)) and got["b"] == pytest.approx(-400 + math.log10(2)) and got["c"] == float("-inf")
    got = values(spark, [([],), ([-1.0, -1.0],)], "a array<double>", numeric.log10_sum(F.col("a")))
    assert math.isnan(got[0][0]) and got[1][0] == pytest.approx(math.log10(0.2))
    got = values(spark, [(0.5,), (0.0,), (None,)], "x double", numeric.log_gamma(F.col("x")))
    assert got[0][0] == pytest.approx(math.lgamma(0.5)) and got[1][0] == math.inf and got[2][0] is None


def test_random_stream_is_the_known_generator():
    s = numeric.RandomStream([0x123, 0x234, 0x345, 0x456])
    assert [s.word() for _ in range(3)] == [1067595299, 955945823, 477289528]  # the published first outputs for this seed
    assert 0 <= s.uniform() < 1 and len(s.bytes(5)) == 5 and len(s.normal_pair()) == 2


def test_merge(spark):
    # a: AC-G, b: ATTG, path with one gap
    path_a, path_b = [0, 1, 2, 2, 3], [0, 1, 2, 3, 4]
    rows = [(path_a, path_b, "ACG", [-1.0, -3.0, -2.0], "ATTG", [-1.0, -1.0, -2.0, -2.0])]
    e = merge.expand_path(*[F.col(c) for c in ("x", "y", "a", "p", "b", "q")])
    schema = "x array<int>, y array<int>, a string, p array<double>, b string, q array<double>"
    pairs, merged = values(spark, rows, schema, e, merge.merge_overlap(e))[0]
    assert [p["a"] for p in pairs] == ["A", "C", "", "G"]
    assert pairs[2]["qa"] == pytest.approx(math.log10((1e-3 + 1e-2) / 2))
    assert [m["base"] for m in merged] == ["A", "C", "G"]  # the gap has the lower error and wins
    over = values(spark, [([2, 3], [0, 1], "AAC", "CG")], "x array<int>, y array<int>, a string, b string", merge.overhang(F.col("x"), F.col("y"), F.col("a"), F.col("b"), False), merge.overhang(F.col("x"), F.col("y"), F.col("a"), F.col("b"), True))
    assert over == [("AA", "G")]


def test_alignment_probability(spark):
    rows = [([1, 2, 3, 3], [0, 1, 1, 2], "XAB", "AC", [-1.0, -2.0]), ([0], [0], "A", "CC", [-1.0, -1.0])]
    got = values(spark, rows, "x array<int>, y array<int>, a string, b string, q array<double>", merge.alignment_log10(*[F.col(c) for c in ("x", "y", "a", "b", "q")], -4.0, -1.0))
    assert got[0][0] == pytest.approx(math.log10(0.9) - 5 - 5) and got[1][0] == pytest.approx(-6)
