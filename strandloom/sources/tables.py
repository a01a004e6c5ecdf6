"""Tables of text: tab-separated cells, regions, settings; and the same written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .lines import read_lines


def cells(value: Column, escapes: bool = False) -> Column:
    """The cells of a line: carriage returns go, tabs separate; a blank line is one empty cell."""
    out = F.split(F.replace(value, F.lit("\r"), F.lit("")), "\t", -1)
    return F.transform(out, X.unescape) if escapes else out


def read_tsv(spark: SparkSession, paths, escapes: bool = False) -> DataFrame:
    """(ord, file_idx, cells)"""
    return read_lines(spark, paths).select("ord", "file_idx", cells(F.col("value"), escapes).alias("cells"))


def write_tsv(df: DataFrame, path: str, column: str = "cells", escapes: bool = False) -> None:
    """One line of tab-separated cells a row, in the order of ``ord`` if there is one."""
    out = F.transform(F.col(column), X.escape) if escapes else F.col(column)
    df = df.orderBy("ord") if "ord" in df.columns else df
    df.select(F.array_join(out, "\t").alias("value")).write.text(path)


def parse_bed(rows: DataFrame, column: str = "cells") -> DataFrame:
    """(chrom, start, end) of rows with three cells that are no comment; numbers as ``atol`` reads them."""
    c = F.col(column)
    keep = (F.size(c) >= 3) & ~F.startswith(F.get(c, 0), F.lit("#"))
    return rows.filter(keep).select(F.get(c, 0).alias("chrom"), X.atol(F.get(c, 1)).alias("start"), X.atol(F.get(c, 2)).alias("end"))


def read_bed(spark: SparkSession, paths) -> DataFrame:
    return parse_bed(read_tsv(spark, paths))


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """name=value lines; ``;`` and ``#`` begin comments, blank lines and section heads are skipped; a line without ``=`` is an error."""
    out = {}
    for row in read_lines(spark, path).orderBy("ord").collect():  # a settings file
        line = row["value"].strip()
        if not line or line[0] in ";#[":
            continue
        name, eq, value = line.partition("=")
        if not eq:
            raise ValueError(f"no value in {line!r}")
        out[name.strip()] = value.strip()
    return out
