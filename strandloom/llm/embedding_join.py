"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine c or more lie within eps = sqrt(2-2c) of each other.
Vectors are rotated to their principal dimensions (a rotation keeps distances),
sorted by their cells of an eps grid on the leading dimensions, and the sequence is cut
into blocks. A tree of intervals over the blocks is joined with itself from the
root down: a pair of intervals whose boxes are further apart than eps is dropped with all
it holds, the others are split. A box bounds the leading coordinates and the norm of the
other coordinates, as the difference of two such norms is a part of the distance, too.

The block pairs that remain are dealt out as tiles, a square of the matrix of block pairs
each: a tile reads each of its blocks once, however many pairs it has of it. Within a
pair the recursion goes on to intervals of ``LEAF`` vectors, and those that are near enough
are compared in double precision.

Equal vectors are one node with a weight. A block pair gives the number of links
of each vector and, of its links, only a label for each vector's component, so a
group of near copies does not become a list of all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Work, connected_components, global_row_numbers

COSINE = 0.9
#: leading dimensions of the grid order
GRID_DIMS = 8
#: vectors of a block
BLOCK = 1024
#: vectors of the smallest intervals
LEAF = 128
#: blocks of a tile's side, at most
SIDE = 32
#: intervals are split into so many
FAN = 4
_SLACK = 1e-9


def _unit(numbers: pa.Array, dim: int) -> np.ndarray:
    """The unit vectors of rows of ``dim`` numbers, in double precision."""
    x = numbers.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            u = _unit(batch.column(0).flatten(), dim)
            u = np.hstack([u, np.ones((len(u), 1))])
            total += u.T @ u
        i, j = np.triu_indices(dim + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    return run


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """The principal axes of the unit vectors as columns, the leading one first; all rows count."""
    sums = vectors.select("embedding").mapInArrow(_moments(dim), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((dim + 1, dim + 1))
    for r in sums:  # (dim+1)(dim+2)/2 numbers
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    n = max(m[dim, dim], 1)
    cov = m[:dim, :dim] / n - np.outer(m[dim, :dim], m[dim, :dim]) / n**2
    return np.linalg.eigh(cov)[1][:, ::-1].copy()


def _places(u: np.ndarray, axes: np.ndarray, lead: int) -> np.ndarray:
    """The leading coordinates of unit vectors, and the norm of the others."""
    at = u @ axes[:, :lead]
    return np.hstack([at, np.sqrt(np.maximum(0, 1 - (at * at).sum(axis=1, keepdims=True)))])


def _cells(axes: np.ndarray, eps: float, lead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(_unit(batch.column(1).flatten(), len(axes)), axes, lead)
            cell = np.floor(at[:, :lead] / eps).astype(np.int32)
            two = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, two(cell), two(at)], ["key", "embedding", "n", "cell", "at"])

    return run


def _labels(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for links rows[i]-cols[i] between nodes 0..n-1."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, rows, label[cols])
        np.minimum.at(new, cols, label[rows])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _boxes(at: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.arange(0, len(at), leaf)
    return np.minimum.reduceat(at, first), np.maximum.reduceat(at, first)


def _close(u: np.ndarray, box_u: tuple, v: np.ndarray, box_v: tuple, cosine: float, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all u[i], v[j] with ``cosine`` or more; intervals whose boxes are further apart are skipped."""
    away = np.maximum(0, np.maximum(box_u[0][:, None] - box_v[1][None], box_v[0][None] - box_u[1][:, None]))
    near = (away * away).sum(axis=2) <= 2 - 2 * cosine + _SLACK
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, js in enumerate(near):
        if js.any():
            on = np.flatnonzero(np.repeat(js, leaf)[: len(v)])
            x, y = np.nonzero(u[i * leaf : (i + 1) * leaf] @ v[on].T >= cosine)
            rows.append(x + i * leaf)
            cols.append(on[y])
    return np.concatenate(rows), np.concatenate(cols)


def _compare(axes: np.ndarray, cosine: float, lead: int, leaf: int):
    dim = len(axes)

    def run(tile: pa.Table) -> pa.Table:
        """The links within a tile: its rows are blocks, with the blocks that each of them is compared with."""
        held = {}
        for r in range(tile.num_rows):
            values = lambda c: tile[c][r].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            u = _unit(tile["vectors"][r].values, dim)
            held[tile["block"][r].as_py()] = values("keys"), values("weights"), u, _boxes(_places(u, axes, lead), leaf)
        out = [(np.zeros(0, np.int64),) * 3]
        for r in range(tile.num_rows):
            a = tile["block"][r].as_py()
            ka, wa, ua, box_a = held[a]
            for b in tile["partners"][r].as_py():
                kb, wb, ub, box_b = held[b]
                rows, cols = _close(ua, box_a, ub, box_b, cosine, leaf)
                if a == b:
                    once = rows < cols
                    rows, cols = rows[once], cols[once]
                    links = np.bincount(rows, wa[cols], len(ka)) + np.bincount(cols, wa[rows], len(ka))
                    node, label = ka, _labels(rows, cols, len(ka))
                else:
                    node = np.concatenate([ka, kb])
                    links = np.concatenate([np.bincount(rows, wb[cols], len(ka)), np.bincount(cols, wa[rows], len(kb))])
                    label = _labels(rows, cols + len(ka), len(node))
                on = np.flatnonzero(links)
                out.append((node[on], node[label[on]], links[on].astype(np.int64)))
        u, v, links = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"u": u, "v": v, "links": links})

    return run


def _block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    at = np.stack(table["at"].combine_chunks().to_numpy(zero_copy_only=False))
    flat = table["embedding"].combine_chunks().flatten()
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.table({"block": [key[0].as_py()], "keys": one(table["node"].combine_chunks()), "weights": one(table["n"].combine_chunks()), "vectors": one(flat), "lo": [at.min(axis=0).tolist()], "hi": [at.max(axis=0).tolist()]})


def _tiles(pairs: DataFrame, blocks: DataFrame, count: int, work: Work) -> DataFrame:
    """(row, col, block, keys, weights, vectors, partners): the blocks of each tile.

    A side is ``SIDE`` blocks at most, which bounds a tile's memory, and smaller where that gives too few tiles for the cores.
    """
    side = max(1, min(SIDE, math.ceil(count / (2 * work.spark.sparkContext.defaultParallelism**0.5))))
    tile = [F.expr(f"a div {side}").alias("row"), F.expr(f"b div {side}").alias("col")]
    none = F.array().cast("array<long>")
    reads = pairs.select(*tile, F.col("a").alias("block"), F.array("b").alias("with")).unionByName(pairs.select(*tile, F.col("b").alias("block"), none.alias("with")))
    # SIDE partners of a block at most
    reads = reads.groupBy("row", "col", "block").agg(F.flatten(F.collect_list("with")).alias("partners"))
    return reads.join(blocks.select("block", "keys", "weights", "vectors"), "block")


def _tree_pairs(boxes: DataFrame, blocks: int, lead: int, eps: float, work: Work) -> DataFrame:
    """(a, b): block pairs, a <= b, whose boxes are within ``eps``; by joining the tree of intervals from the root down."""
    levels = [boxes.select(F.col("block").alias("node"), "lo", "hi")]
    n = blocks
    while n > 1:
        up = levels[-1].groupBy(F.expr(f"node div {FAN}").alias("node")).agg(F.array(*[F.min(F.get("lo", i)) for i in range(lead)]).alias("lo"), F.array(*[F.max(F.get("hi", i)) for i in range(lead)]).alias("hi"))
        levels.append(work.cut(up, "tree"))
        n = -(-n // FAN)
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))  # the root with itself
    for level in reversed(levels[:-1]):
        side = lambda x: level.select(F.col("node").alias(x), F.expr(f"node div {FAN}").alias(f"up_{x}"), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"))  # noqa: B023, E731
        down = pairs.withColumnsRenamed({"a": "up_a", "b": "up_b"}).join(side("a"), "up_a").join(side("b"), "up_b").filter("a <= b")
        # the squared distance of two boxes
        away = [F.greatest(F.get("lo_a", F.lit(i)) - F.get("hi_b", F.lit(i)), F.get("lo_b", F.lit(i)) - F.get("hi_a", F.lit(i)), F.lit(0.0)) for i in range(lead)]
        near = reduce(lambda x, y: x + y, [x * x for x in away]) <= eps * eps + _SLACK
        pairs = work.cut(down.filter(near).select("a", "b").repartition("a", "b"), "pairs")
    return pairs


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Vectors that are null, empty, zero or hold null or non-finite numbers link
    with nothing; vectors of different lengths are not compared (each length that occurs is a join of its own). Equal vectors link
    with each other, repeated rows included. component_id is the smallest vec_id reachable,
    kept says that it is the row's own. Other columns are ignored; an empty table gives no rows.
    """
    work = Work(vectors.sparkSession, "embeddings")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    v = F.col("embedding")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0)
    # floats stay floats until they are compared
    kind = "float" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull) else "double"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    # adding zero makes -0.0 and 0.0 equal
    rows = rows.select("vec_id", "good", F.when(F.col("good"), F.transform(v, lambda x: x + F.lit(0.0).cast(kind))).alias("embedding"))
    rows = work.cut(rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.hash("embedding")}), "rows")
    distinct = rows.filter("good").groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.count("*").alias("n"))
    distinct = work.cut(distinct.select(F.struct("h1", "h2").alias("key"), "embedding", "n", F.size("embedding").alias("dim")), "distinct")

    found, nodes = [], []
    for (dim,) in distinct.select("dim").distinct().orderBy("dim").collect():  # the lengths of vectors: one, as a rule
        own = distinct.filter(F.col("dim") == dim).drop("dim")
        eps, lead = (2 - 2 * cosine) ** 0.5, min(GRID_DIMS, dim)
        axes = principal_axes(own, dim)
        cells = own.mapInArrow(_cells(axes, eps, lead), T.StructType([*own.schema.fields, T.StructField("cell", T.ArrayType(T.IntegerType())), T.StructField("at", T.ArrayType(T.DoubleType()))]))
        order = global_row_numbers(cells, [F.col("cell"), F.col("at"), F.col("key")], work, f"order{dim}", "node")
        base = F.lit(dim << 44).cast("long")  # nodes of other lengths have other numbers
        order = work.cut(order.select("key", "embedding", "n", "at", F.expr(f"node div {block}").alias("block"), (F.col("node") + base).alias("node")), "ordered")
        nodes.append(order.select("key.h1", "key.h2", "node", "n"))
        blocks = work.cut(order.groupBy("block").applyInArrow(_block, f"block long, keys array<long>, weights array<long>, vectors array<{kind}>, lo array<double>, hi array<double>"), "blocks")
        count = blocks.count()
        pairs = _tree_pairs(blocks.select("block", "lo", "hi"), count, lead + 1, eps, work)
        tiles = _tiles(pairs, blocks, count, work).groupBy("row", "col")
        found.append(work.cut(tiles.applyInArrow(_compare(axes, cosine, lead, leaf), "u long, v long, links long"), "links"))
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found:
        links = reduce(DataFrame.unionByName, found)
        node = reduce(DataFrame.unionByName, nodes)
        comp = connected_components(links.select("u", "v"), work)
        count = links.groupBy("u").agg(F.sum("links").alias("links"))
        node = node.join(count, F.col("node") == F.col("u"), "left").drop("u").join(comp.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left")
        node = node.select(F.col("h1").alias("a"), F.col("h2").alias("b"), F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"))
        joined = rows.filter("good").select("vec_id", "h1", "h2").join(node, (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")))
        joined = work.cut(joined.select("vec_id", "n_links", "component"), "joined")
        least = work.cut(joined.groupBy("component").agg(F.min("vec_id").alias("component_id")), "least")
        alone = joined.join(least, "component").select("vec_id", "n_links", "component_id").unionByName(alone)
    return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
