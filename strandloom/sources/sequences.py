"""Sequences: FASTA and FASTQ text, sequence graphs, and an indexed Parquet form."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q
from .lines import read_lines


def _named(name):
    return F.regexp_extract(name, "^(\\S*)", 1)


def parse_fasta(records: DataFrame) -> DataFrame:
    """(ord, name, short_name, seq, qual) of text cut at ``>`` (ord, value); white space in sequences goes, case stays."""
    rows = records.select("ord", F.replace("value", F.lit("\r"), F.lit("")).alias("v")).filter(F.trim("v") != "")
    name = F.substring_index("v", "\n", 1)
    seq = F.regexp_replace(F.substring(F.col("v"), F.length(name) + 2, F.length("v")), "\\s", "")
    return rows.select("ord", name.alias("name"), _named(name).alias("short_name"), seq.alias("seq"), F.lit(None).cast("array<double>").alias("qual"))


def read_fasta(spark: SparkSession, paths) -> DataFrame:
    """Records are separated by ``>``, so a split file needs no grouping of lines. A ``>`` within a name cuts it."""
    return parse_fasta(read_lines(spark, paths, line_sep=">").select("ord", "value"))


def parse_fastq(lines: DataFrame) -> DataFrame:
    """Four lines a record, of lines (ord, value) with gapless ``line_no`` in each file: one shuffle by record."""
    rows = lines.select("file_idx", (F.floor(F.col("line_no") / 4)).alias("rec"), (F.col("line_no") % 4).cast("int").alias("k"), "ord", F.replace("value", F.lit("\r"), F.lit("")).alias("v"))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    rec = rows.groupBy("file_idx", "rec").agg(F.min("ord").alias("ord"), at(0).alias("n"), at(1).alias("seq"), at(2).alias("p"), at(3).alias("q"))
    wrong = ~F.startswith("n", F.lit("@")) | ~F.startswith("p", F.lit("+")) | (F.length("seq") != F.length("q"))
    name = F.substring(F.col("n"), F.lit(2), F.length("n"))
    qual = F.when(wrong, F.raise_error(F.lit("a FASTQ record is malformed")).cast("array<double>")).otherwise(Q.phreds_to_log10(F.col("q")))
    return rec.select("ord", name.alias("name"), _named(name).alias("short_name"), "seq", qual.alias("qual"))


def read_fastq(spark: SparkSession, paths) -> DataFrame:
    from ..operators.order import number_rows

    lines = read_lines(spark, paths)
    return parse_fastq(number_rows(lines.filter(F.trim("value") != ""), ["ord"], "line_no", within="file_idx"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: FASTQ, Parquet (the indexed form), else FASTA; ``.gz`` is unpacked."""
    plain = re.sub("\\.(gz|gzip)$", "", path)
    if plain.endswith((".fq", ".fastq")):
        return read_fastq(spark, path)
    if plain.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_fasta(spark, path)


def write_fasta(df: DataFrame, path: str) -> None:
    df.orderBy("ord").select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    qual = Q.log10s_to_phred(F.col("qual"))
    df.orderBy("ord").select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), qual).alias("value")).write.text(path)


def write_indexed(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet sorted by ``ord``: row-group statistics find a sequence, pages give a part of it."""
    df.sortWithinPartitions("ord").write.mode(mode).parquet(path)


def read_indexed(spark: SparkSession, path: str, ord: int | None = None, start: int = 0, length: int | None = None) -> DataFrame:
    """All sequences, or ``length`` bases from ``start`` of the one with this ``ord``."""
    df = spark.read.parquet(path)
    if ord is None:
        return df
    part = F.substring(F.col("seq"), F.lit(start + 1), F.lit(length) if length is not None else F.length("seq"))
    return df.filter(F.col("ord") == ord).withColumn("seq", part)


def parse_graph(name: str, text: str) -> tuple[str, list[tuple[int, int]]]:
    """The characters and the jumps (from, to) of a graph sequence.

    ``&name;`` names the next character. ``[a b /]`` before a character lists the
    named places from which it is reached; ``/`` says that it is not reached from
    the character before it. An empty list or an unknown name is an error.
    """
    chars: list[str] = []
    names: dict[str, int] = {}
    asked: list[tuple[int, str]] = []
    no_fall: set[int] = set()
    for token in re.findall(r"&[^;\s]*;|\[[^\[\]]*\]|\s+|.", text, re.S):
        if token.isspace():
            continue
        if token[0] == "&" and token[-1] == ";":
            names[token[1:-1]] = len(chars)
        elif token[0] == "[" and len(token) > 1:
            items = token[1:-1].split()
            if not items:
                raise ValueError(f"empty jump set in {name}")
            for item in items:
                if item == "/":
                    no_fall.add(len(chars))
                else:
                    asked.append((len(chars), item))
        elif token in "[]":
            raise ValueError(f"bracket without its match in {name}")
        else:
            chars.append(token)
    edges = [(i, i + 1) for i in range(len(chars) - 1) if i + 1 not in no_fall]
    for at, item in asked:
        if item not in names:
            raise ValueError(f"unknown place {item} in {name}")
        edges.append((names[item], at))
    return "".join(chars), sorted(set(edges))


def read_graphs(spark: SparkSession, paths) -> DataFrame:
    """(graph, seq, edges) of sequence graphs in FASTA form."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [parse_graph(n, t) for n, t in zip(batch["short_name"], batch["body"], strict=True)]
            yield pd.DataFrame({"graph": batch["short_name"], "seq": [p[0] for p in parsed], "edges": [[{"src": a, "dst": b} for a, b in p[1]] for p in parsed]})

    rows = read_lines(spark, paths, line_sep=">").select("ord", F.replace("value", F.lit("\r"), F.lit("")).alias("v")).filter(F.trim("v") != "")
    name = F.substring_index("v", "\n", 1)
    rows = rows.select(_named(name).alias("short_name"), F.substring(F.col("v"), F.length(name) + 2, F.length("v")).alias("body"))
    return rows.mapInPandas(run, "graph string, seq string, edges array<struct<src:long,dst:long>>")
