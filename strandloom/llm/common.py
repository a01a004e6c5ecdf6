"""Shared pieces of the corpus operators: work tables, global row numbers and
connected components.

Everything that is written goes to the folder that the session names in
``spark.checkpoint.dir``; a local folder is used only by a local master that
names none (tests).
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for work tables that the driver and all executors see."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="strandloom-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return "file://" + _LOCAL["dir"]


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: rows of whole texts that go to Python at a time while a work table is written, unless the session sets a number
BATCH_ROWS = 512


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound the memory of Arrow batches of texts; afterwards the session is as it was."""
    held = spark.conf.get(ARROW_ROWS, None)
    if held is None:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(ARROW_ROWS)


#: the work folders that this process has begun
_FOLDERS: list[str] = []


def _delete(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_exit:  # only a folder that is there is noted
        files.mkdirs(p)
        files.deleteOnExit(p)
    else:
        files.delete(p, True)


def work_folders() -> int:
    """How many work folders have been begun; ``sweep`` takes it."""
    return len(_FOLDERS)


def sweep(spark: SparkSession, after: int) -> None:
    """Delete the work folders begun since ``work_folders`` gave ``after``; only when nothing reads them any more."""
    for path in _FOLDERS[after:]:
        _delete(spark, path)
    del _FOLDERS[after:]


#: at least so many seconds lie between two calls of ``tidy`` that do something, and so many times what the last one took
TIDY_SECONDS, TIDY_SHARE = 5, 30
_TIDIED = {"next": 0.0}


def tidy(spark: SparkSession) -> None:
    """Let go of what finished jobs have left: shuffle files and broadcasts of frames that nothing holds, and the driver's memory for them.

    Spark frees them when the driver's collector finds the frames gone, which it does late as
    long as the heap can grow. Results do not depend on it.
    """
    began = time.monotonic()
    if began < _TIDIED["next"]:
        return
    gc.collect()  # frames in Python hold those of the JVM
    spark._jvm.System.gc()
    now = time.monotonic()
    _TIDIED["next"] = now + max(TIDY_SECONDS, TIDY_SHARE * (now - began))


class Work:
    """Work tables of one operator call: ``cut`` writes a frame and reads it back. They go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _FOLDERS.append(self.root)
        _delete(spark, self.root, at_exit=True)

    def path(self, tag: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{tag}"

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        with small_batches(self.spark):
            df.write.parquet(path)
        tidy(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete work tables that nothing reads any more."""
        for df in frames:
            path = getattr(df, "_work_path", None)
            if path:
                _delete(self.spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: monotonically_increasing_id() keeps the partition above and the row below this bit.
ROW_BITS = 33


def sorted_ids(df: DataFrame, order: list, work: Work, tag: str, id_col: str = "rid") -> DataFrame:
    """``df`` range-partitioned and sorted by ``order`` with an id that ascends in
    that order; written, so that the ids stay as they are."""
    n = shuffle_partitions(work.spark)
    out = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return work.cut(out.withColumn(id_col, F.monotonically_increasing_id()), tag)


def global_row_numbers(df: DataFrame, order: list, work: Work, tag: str, out_col: str = "row_no", within: str | None = None) -> DataFrame:
    """Gapless numbers from 0 in ``order``; with ``within`` (the leading order
    column) the numbers start again at each of its values.

    One range sort; the offsets come from one row for each partition (and value
    of ``within``), so nothing larger than that is gathered in one place.
    """
    rid, part = free_name(df, "rid"), free_name(df, "part_no")
    rows = sorted_ids(df, order, work, tag, rid).withColumn(part, F.shiftright(F.col(rid), ROW_BITS))
    keys = [part] + ([within] if within else [])
    heads = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(rid).alias("_first"))
    w = Window.partitionBy(within) if within else Window.partitionBy(F.lit(0))
    w = w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # at most one row for each partition and each boundary of `within`
    heads = work.cut(heads.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_first", "_before").coalesce(1), f"{tag}-heads")
    on = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    cond = on[0] if len(on) == 1 else on[0] & on[1]
    out = rows.join(F.broadcast(heads), cond)
    return out.withColumn(out_col, F.col("_before") + F.col(rid) - F.col("_first")).drop(rid, part, "_first", "_before", *[f"_{i}" for i in range(len(keys))])


def bit_words(words: DataFrame, bits: int) -> Column:
    """A column with the array of all 64-bit words of a filter, from the rows (w, b) of those that are not zero; the plan holds it once."""
    held = words.select("w", "b").toArrow()  # bits / 64 rows at most
    out = np.zeros(bits >> 6, np.int64)
    out[held["w"].to_numpy()] = held["b"].to_numpy()
    table = pa.table({"words": pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out))})
    return words.sparkSession.createDataFrame(table).scalar()


#: bits of a key filter (as a power of two), whatever the number of keys, and how many of them a key sets
FILTER_BITS, PROBES = 23, 2


def key_filter(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A condition that holds for all of the long ``keys`` and, if they are not too many, for few others.

    It keeps rows that cannot join from being shuffled. The filter has 1 MiB whatever the keys; with
    very many keys everything passes, and the join that follows is as it would be without it.
    """
    bits = 1 << FILTER_BITS
    places = lambda k: [F.pmod(F.xxhash64(k, F.lit(i)), F.lit(bits)) for i in range(PROBES)]
    at = keys.select(F.explode(F.array(*places(F.col(key)))).alias("p"))
    held = bit_words(at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")), bits)

    def maybe(k: Column) -> Column:
        out = F.lit(True)
        for p in places(k):
            out = out & (F.getbit(F.get(held, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
        return out

    return maybe


def _watched(df: DataFrame, work: Work, tag: str) -> tuple[DataFrame, tuple]:
    """A work table of edges, and its number of rows and sum of hashes, which are taken while it is written."""
    seen = Observation()
    df = work.cut(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), tag)
    return df, (seen.get["n"], seen.get["s"])


def connected_components(edges: DataFrame, work: Work, max_rounds: int = 64) -> DataFrame:
    """(node, component) of the graph with the long columns ``u`` and ``v``;
    component is the smallest node reachable. Nodes without edges do not occur.

    Alternating large-star and small-star steps: every step is two
    aggregations by minimum and joins on the node, so hubs are pre-aggregated
    and no neighbourhood is gathered; the edges never leave the executors.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    e, last = _watched(e, work, "edges")
    for _ in range(max_rounds):
        if last[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima as plain tables, so that the joins split a hub
        low = work.cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "low")
        # large star: each larger neighbour goes to the smallest of the neighbourhood
        large = both.filter("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work.cut(large, "large")
        work.drop(low)
        low = work.cut(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), "low")
        # small star: the smaller neighbours and the node itself go to the smallest
        small = large.join(low, F.col("u") == F.col("k")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, now = _watched(small.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), work, "small")
        work.drop(e, large, low)
        e = new
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("connected components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
