"""Genomics-shaped tables derived from the driver's tables; the SQL of the queries derives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import cut

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(text: Column) -> Column:
    """The ASCII letters of a text as bases."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, BASES)


DNA_SQL = "translate(upper(regexp_replace({}, '[^A-Za-z]', '', 'g')), '" + LETTERS + "', '" + BASES + "')"


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, chrom, lo, hi) from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    lo = F.col("l_partkey") * 10 + F.col("l_linenumber")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), (F.col("l_linenumber") % 5).cast("long").alias("chrom"), lo.alias("lo"), (lo + F.col("l_quantity").cast("long")).alias("hi"))


FOOTPRINTS_SQL = "SELECT l_orderkey * 10 + l_linenumber AS k, CAST(l_linenumber % 5 AS BIGINT) AS chrom, l_partkey * 10 + l_linenumber AS lo, l_partkey * 10 + l_linenumber + CAST(l_quantity AS BIGINT) AS hi FROM lineitem"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, start, end, rid) from part; every fiftieth is wide."""
    p = table(spark, sf_dir, "part")
    start = F.col("p_partkey") * 10
    width = 5 + F.col("p_size") + F.when(F.col("p_partkey") % 50 == 0, 5000).otherwise(0)
    return p.select((F.col("p_size") % 5).cast("long").alias("chrom"), start.alias("start"), (start + width).alias("end"), F.col("p_partkey").alias("rid"))


REGIONS_SQL = 'SELECT CAST(p_size % 5 AS BIGINT) AS chrom, p_partkey * 10 AS start, p_partkey * 10 + 5 + p_size + CASE WHEN p_partkey % 50 = 0 THEN 5000 ELSE 0 END AS "end", p_partkey AS rid FROM part'


def cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, pos, cigar) from lineitem; an odd part key begins with a deletion."""
    li = table(spark, sf_dir, "lineitem")
    # a CIGAR tells its numbers and part, so rows are told apart by these, before any text is made
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    li = li.select((F.col("l_orderkey") * 10 + n).alias("k"), F.col("l_partkey").alias("pos"), F.when(q.isNotNull(), n).alias("n"), F.when(n.isNotNull(), q).alias("q")).distinct()
    n, q = F.col("n").cast("string"), F.col("q").cast("string")
    lead = F.when(F.col("pos") % 2 == 1, "3D").otherwise("")
    cig = F.concat(F.lit("2H"), n, F.lit("S"), lead, q, F.lit("M"), n, F.lit("I2D"), q, F.lit("="), F.lit("4N"), n, F.lit("S"))
    return li.select("k", "pos", cig.alias("cigar"))


CIGARS_SQL = "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS k, l_partkey AS pos, '2H' || l_linenumber || 'S' || CASE WHEN l_partkey % 2 = 1 THEN '3D' ELSE '' END || CAST(l_quantity AS INT) || 'M' || l_linenumber || 'I2D' || CAST(l_quantity AS INT) || '=4N' || l_linenumber || 'S' AS cigar FROM lineitem"


def records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(records, sequences): documents as references; from each, two reads of 60 bases or what a short one has, one with an error, as mates."""
    # lengths, regions, reads and tiles all come from the bases, which cost far more to make than to read again
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", F.coalesce(dna(F.col("text")), F.lit("")).alias("seq")))
    seqs = docs.select(F.col("doc_id").alias("ord"), F.concat(F.lit("d"), "doc_id").alias("name"), F.concat(F.lit("d"), "doc_id").alias("short_name"), "seq", F.lit(None).cast("array<double>").alias("qual"))
    room = F.greatest(F.length("seq") - 65, F.lit(1))
    pos = lambda mate: ((F.col("doc_id") * 7 + mate * 61) % room).cast("int")
    # bases are single bytes, from which a piece is cut at a cost of its own length
    at = lambda mate: F.substring(F.col("seq").cast("binary"), pos(mate) + 1, F.lit(65)).cast("string")
    each = docs.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("mate"), pos(k).alias("pos"), at(k).alias("piece")) for k in (0, 1)])))
    piece = F.col("piece")
    # the first mate has a changed base, the second a deletion of two
    first = F.concat(F.substring(piece, 1, 30), F.translate(F.substring(piece, 31, 1), "ACGT", "TGCA"), F.substring(piece, 32, 29))
    second = F.concat(F.substring(piece, 1, 25), F.substring(piece, 28, 35))
    read = F.when(F.col("mate") == 0, first).otherwise(second)
    flag = 1 + F.when(F.col("mate") == 0, 64).otherwise(128 + 16)
    return each.select(
        (F.col("doc_id") * 2 + F.col("mate")).alias("ord"), F.lit(0).alias("file_idx"), F.concat(F.lit("r"), "doc_id").alias("qname"), flag.cast("int").alias("flag"), F.concat(F.lit("d"), "doc_id").alias("rname"), F.col("pos").cast("long").alias("pos"), F.lit(60).alias("mapq"), F.when(read != "", F.concat(F.length(read).cast("string"), F.lit("M"))).otherwise("").alias("cigar"), F.lit("").alias("rnext"), F.lit(-1).cast("long").alias("pnext"), F.lit(0).cast("long").alias("tlen"), read.alias("seq"), F.repeat(F.lit("5"), F.length(read)).alias("qual"), F.lit("NM:i:1\tXA:Z:x").alias("extra")
    ), seqs
