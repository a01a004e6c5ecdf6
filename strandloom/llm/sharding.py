"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 in a total order; a keyed Feistel network permutes the
smallest power of two that holds the numbers, and numbers that leave the range
walk on through the network until they are back in it. The result is a
permutation of the numbers, so ``place % n_shards`` and ``place // n_shards``
are shard and slot: shard sizes differ by one row at most, slots have no gaps,
and both follow from the row number, the row count and the seed alone
(``place_of``), as does the row from its place (``row_at``).
"""

from __future__ import annotations

import struct

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, free_name, global_row_numbers

SHARDS = 16
SEED = 20_240_601
ROUNDS = 6
#: steps of a walk for each bit of the domain, plus a constant: each step ends a walk with a chance
#: of at least one half, so a longer walk does not occur; it would be an error, not a wrong place
WALK_PER_BIT, WALK = 4, 64


def _keys(rows: int, seed: int) -> tuple[int, list[tuple[int, int]]]:
    """Bits of the low half, and a key and mask for each round (the halves swap, so masks alternate)."""
    bits = max(2, (max(rows, 2) - 1).bit_length())
    low = bits // 2
    masks = [(1 << (bits - low)) - 1, (1 << low) - 1]
    return low, [(seed * 1_000 + r, masks[r % 2]) for r in range(ROUNDS)]


def place(row_no: Column, rows: int, seed: int = SEED) -> Column:
    """The permuted place of a row number in 0..rows-1."""
    low, keys = _keys(rows, seed)
    keyed = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(m).cast("long").alias("m")) for k, m in keys])

    def network(x: Column) -> Column:
        start = F.struct(F.shiftright(x, low).alias("l"), x.bitwiseAND(F.lit((1 << low) - 1).cast("long")).alias("r"))
        end = lambda s: F.shiftleft(s["l"], low).bitwiseOR(s["r"])
        turn = lambda s, k: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(F.xxhash64(s["r"], k["k"]).bitwiseAND(k["m"])).alias("r"))
        return F.aggregate(keyed, start, turn, end)

    steps = WALK_PER_BIT * max(2, rows.bit_length()) + WALK
    walk = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda y, _: F.when(y < rows, y).otherwise(network(y)))
    far = walk(network(row_no.cast("long")))
    return F.when(far < rows, far).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))


def _turn(r: int, key: int) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<q", key), xxhash.xxh64_intdigest(struct.pack("<q", r), 42))


def place_of(row_no: int, rows: int, seed: int = SEED) -> int:
    """``place`` for one row number, without Spark."""
    low, keys = _keys(rows, seed)
    x = row_no
    while True:
        left, right = x >> low, x & ((1 << low) - 1)
        for key, mask in keys:
            left, right = right, left ^ (_turn(right, key) & mask)
        x = left << low | right
        if x < rows:
            return x


def row_at(where: int, rows: int, seed: int = SEED) -> int:
    """The row number whose place is ``where``: the inverse of ``place_of``."""
    low, keys = _keys(rows, seed)
    x = where
    while True:
        left, right = x >> low, x & ((1 << low) - 1)
        for key, mask in reversed(keys):
            left, right = right ^ (_turn(left, key) & mask), left
        x = left << low | right
        if x < rows:
            return x


def feistel_shards(df: DataFrame, order: list[str], n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards-1) and ``slot`` (gapless from 0 in each shard).

    Rows are numbered in ``order``; rows equal in all of it are numbered in any
    order, which is then kept (they differ in nothing that orders them). Nulls
    come first. A column that is already called shard or slot is replaced. An
    empty table gives an empty result.
    """
    work = Work(df.sparkSession, "sharding")
    df = df.drop("shard", "slot")
    number = free_name(df, "row_no")
    rows = global_row_numbers(df, [F.col(c) for c in order], work, "rows", number)
    count = rows.count()
    at = free_name(df, "place")
    placed = rows.withColumn(at, place(F.col(number), count, seed))
    return placed.withColumns({"shard": F.pmod(at, F.lit(n_shards)).cast("int"), "slot": F.expr(f"`{at}` div {n_shards}")}).drop(number, at)


def write_shards(df: DataFrame, path: str) -> None:
    """Write rows of ``feistel_shards`` as Parquet, one folder a shard, ascending by slot in each file."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
