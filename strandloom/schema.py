"""Record types of the engine. Empty text fields are '' and unmapped positions -1, never null."""

from __future__ import annotations

from pyspark.sql import types as T


_SIMPLE = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType()}


def _type(text: str) -> T.DataType:
    """The type that a short text names, without a session."""
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(n, _type(t)) for n, t in (x.split(":") for x in text[7:-1].split(","))])
    return _SIMPLE[text]


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _type(t)) for n, t in (x.split(" ", 1) for x in text.split(", "))])


SAM = _struct("ord long, file_idx int, qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, extra string")
SAM_HEADER = _struct("ord long, file_idx int, text string")
BED = _struct("chrom string, start long, end long")
SEQUENCE = _struct("ord long, name string, short_name string, seq string, qual array<double>")
COST_REGION = _struct("rname string, idx int, start_a long, end_a long, start_b long, end_b long, priority int, open int, extend int, close int, chars array<int>, mm array<array<int>>")
MANGLE = _struct("rname string, pos_lo long, pos_hi long, set_idx int, q_lo int, q_hi int, target string, from_c int, to_c int, ops array<struct<op:string,arg:long>>")
GRAPH_EDGE = _struct("graph string, src long, dst long")

# SAM flag bits
MULTI_SEGMENT, ALL_ALIGNED, UNMAPPED, NEXT_UNMAPPED = 1, 2, 4, 8
REVERSED, NEXT_REVERSED, FIRST, LAST = 16, 32, 64, 128
SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = 256, 512, 1024, 2048
#: bits that a record keeps when it is written anew
KEPT_FLAGS = REVERSED | FIRST | LAST | FAILED | DUPLICATE
