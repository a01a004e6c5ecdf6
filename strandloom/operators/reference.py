"""Reference sequences as overlapping tiles, so that a window is cut out by one equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_TILE = 1 << 14


def lengths(sequences: DataFrame) -> DataFrame:
    """(rname, ref_length); a name that occurs twice is taken once, the last."""
    return sequences.groupBy(F.col("short_name").alias("rname")).agg(F.max_by(F.length("seq"), "ord").cast("long").alias("ref_length"))


def tiles(sequences: DataFrame, size: int) -> DataFrame:
    """(rname, tile, piece): pieces of two tiles' length that begin at each tile; of a name that occurs twice, the last.

    The last of each name is found by names and places alone, so sequences are only moved if the names are too many to be broadcast.
    Pieces are cut from bytes, at a cost of their own length; only a sequence with characters outside ASCII is counted through.
    """
    named = sequences.select(F.col("short_name").alias("rname"), "ord", "seq")
    last = named.groupBy(F.col("rname").alias("_n")).agg(F.max("ord").alias("_last"))
    rows = named.join(last, (F.col("rname") == F.col("_n")) & (F.col("ord") == F.col("_last")))
    single = F.octet_length("seq") == F.length("seq")
    rows = rows.select("rname", F.length("seq").alias("n"), F.when(~single, F.col("seq")).alias("seq"), F.when(single, F.col("seq").cast("binary")).alias("bytes"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / size))).alias("tile"))
    at, length = (F.col("tile") * size + 1).cast("int"), F.lit(2 * size)
    piece = F.coalesce(F.substring("bytes", at, length).cast("string"), F.substring("seq", at, length))
    return rows.select("rname", "tile", piece.alias("piece"))


def cut_windows(windows: DataFrame, sequences: DataFrame, out: str = "window") -> DataFrame:
    """``windows`` (rname, win_lo, win_hi, ...) with the text of the reference between lo and hi.

    A tile is as wide as the widest window, so each window lies in the piece of one tile; no window meets a whole chromosome.
    """
    widest = windows.agg(F.max(F.col("win_hi") - F.col("win_lo"))).first()[0] or 0
    size = MIN_TILE
    while size < widest:
        size *= 2
    t = tiles(sequences, size).withColumnsRenamed({"rname": "_r", "tile": "_t"})
    at = F.floor(F.col("win_lo") / size)
    joined = windows.join(t, (F.col("rname") == F.col("_r")) & (at == F.col("_t")))
    text = F.substring("piece", (F.col("win_lo") - F.col("_t") * size + 1).cast("int"), (F.col("win_hi") - F.col("win_lo")).cast("int"))
    return joined.withColumn(out, text).drop("_r", "_t", "piece")
