"""Token ids as Parquet list columns.

A store is a folder of Parquet parts in ascending document order: one row a
document with its ids as a list column and its counts as columns of their own,
so that metadata are read without any ids. Ids are dictionary-encoded, and
delta-encoded where a dictionary grows too large; row groups and pages are
small, and the page indexes let a reader fetch the pages of a few documents. A
manifest beside the parts gives the first document, the counts and the offset of each
part, so that the global offset of a document is a sum of two stored numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .common import Work, shuffle_partitions, small_batches
from .tokens import encoder

END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 512


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        part, total = TaskContext.get().partitionId(), 0
        for batch in tn.each(batches):
            for first, ids, n in enc.encode(batch.column(1)):
                ends = np.cumsum(n + 1)
                out = np.insert(ids, np.cumsum(n), end_id).astype("<i4")
                rows = len(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(np.full(rows, part, np.int32)), pa.array(total + ends - (n + 1)), pa.array(n + 1), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out))],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                total += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append the end id, and write a store in ascending id order.

    A null or empty text is its end id alone; null ids come first; rows that
    repeat an id are ordered by text hash and all kept; other columns are not stored; an
    empty table makes an empty store.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    stored = rows.mapInArrow(_encode(tokenizer, end_id), f"doc_id {kind}, part int, part_start long, n_tokens long, ids array<int>")
    options = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "compression": "zstd"}
    with small_batches(spark):
        stored.write.options(**options).parquet(f"{path}/parts")
    # one row for each part
    parts = spark.read.schema(stored.schema).parquet(f"{path}/parts").groupBy("part").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")).coalesce(1).write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(doc_id, part, start, n_tokens, ids) of a store; columns that are not asked for are not read.

    Null and repeated ids are as they were written; an empty store gives no rows.
    ``where`` may be a condition on doc_id; it reaches the page indexes.
    """
    rows = spark.read.parquet(f"{path}/parts")
    if where is not None:
        rows = rows.filter(where)
    manifest = spark.read.parquet(f"{path}/manifest").select(F.col("part").alias("_part"), F.col("start").alias("_start"))
    # the manifest has a row for each part, of which there are as many as shuffle partitions
    rows = rows.join(F.broadcast(manifest), F.col("part") == F.col("_part"))
    return rows.select("doc_id", "part", (F.col("_start") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tn.each(batches):
        ids = batch.column(3)
        flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<i4")
        ends = np.concatenate([[0], np.cumsum(np.diff(ids.offsets.to_numpy()))])
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows of ``read_tokens``; the crc is of the
    ids as little-endian unsigned 32-bit integers. Each row is digested; no rows give none."""
    rows = tokens.select("doc_id", "start", "n_tokens", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_crc, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a store in the shared folder and give the digests of what is read back from it."""
    spark = docs.sparkSession
    path = Work(spark, "tokens").path("store")
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    return token_digests(read_tokens(spark, path))
