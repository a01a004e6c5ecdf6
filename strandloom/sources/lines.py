"""Text lines with their order, without a shuffle."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_BITS = 48


def read_lines(spark: SparkSession, paths: str | list[str], line_sep: str = "\n") -> DataFrame:
    """(ord, file_idx, value): ``ord`` ascends by file, in the order of the paths, and by place in the file.

    A split starts at a multiple of the split size and a task's rows are fewer than its
    bytes, which are less than two splits: so four times the start of the split plus the
    number of the row in its task keeps the order of a file.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    frame = spark.read.text(paths, lineSep=line_sep)
    files = frame.inputFiles()
    rank = {p: i for i, p in enumerate(paths)}
    place = lambda f: (min((i for p, i in rank.items() if f.endswith(p) or f"{p.rstrip('/')}/" in f), default=len(rank)), f)
    listed = F.split(F.lit("\n".join(sorted(files, key=place))), "\n")
    index = (F.array_position(listed, F.col("_metadata.file_path")) - 1).cast("int")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ord_ = F.shiftleft(index.cast("long"), FILE_BITS) + F.col("_metadata.file_block_start") * 4 + row
    return frame.select(ord_.alias("ord"), index.alias("file_idx"), "value")


def read_gzip_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same for gzip files of any suffix; a file is read by one task, as gzip cannot be split."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    frame = spark.read.format("binaryFile").load(paths)
    listed = F.split(F.lit("\n".join(sorted(frame.inputFiles(), key=lambda f: (min((i for i, p in enumerate(paths) if f.endswith(p)), default=len(paths)), f)))), "\n")
    frame = frame.select((F.array_position(listed, F.col("_metadata.file_path")) - 1).cast("int").alias("file_idx"), "content")
    return frame.mapInPandas(_unpack, "ord long, file_idx int, value string")


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file_idx, content in zip(batch["file_idx"], batch["content"], strict=True):
            lines = gzip.decompress(bytes(content)).decode().split("\n")
            lines = lines[:-1] if lines[-1] == "" else lines
            for i in range(0, len(lines), 10_000):
                part = lines[i : i + 10_000]
                yield pd.DataFrame({"ord": [(int(file_idx) << FILE_BITS) + i + k for k in range(len(part))], "file_idx": int(file_idx), "value": part})


def nth(cells: Column, i: int) -> Column:
    return F.coalesce(F.get(cells, i), F.lit(""))
