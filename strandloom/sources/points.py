"""Data points: tables of integer, floating and categorical columns for trees and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.trees import level_dictionary
from .tables import read_tsv

INT, FLT, CAT = "int", "flt", "cat"


def typed(rows: DataFrame, names: list[str], types: dict[str, str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows (ord, cells) with the header ``names`` as typed columns, and the level dictionary of each category.

    A column is found by its name, in any order; a missing one is an error. Levels are coded in the order in which they first occur.
    """
    missing = [n for n in types if n not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    cell = lambda n: F.get("cells", names.index(n))
    how = {INT: X.atol, FLT: lambda c: c.try_cast("double"), CAT: lambda c: c}
    unknown = [t for t in types.values() if t not in how]
    if unknown:
        raise ValueError(f"unknown type {unknown[0]!r}")
    out = rows.select("ord", *[how[t](cell(n)).alias(n) for n, t in types.items()])
    levels = {}
    for n, t in types.items():
        if t == CAT:
            levels[n] = level_dictionary(out, n, "ord")
            codes = levels[n].select(F.col("level").alias("_level"), F.col("code").alias("_code"))
            out = out.join(codes, F.col(n).eqNullSafe(F.col("_level")), "left").withColumn(n, F.col("_code")).drop("_level", "_code")
    return out, levels


def read_points(spark: SparkSession, path: str, types: dict[str, str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A tab-separated file with a header line."""
    rows = read_tsv(spark, path).filter("size(cells) > 1 or cells[0] <> ''")
    first = rows.orderBy("ord").first()
    if first is None:
        raise ValueError("no header line")
    return typed(rows.filter(F.col("ord") > first["ord"]), list(first["cells"]), types)
