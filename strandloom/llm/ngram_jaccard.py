"""N-gram Jaccard join by parity sketches.

Each document is the set of its distinct word shingles. A set toggles one bit
of a wide sketch for each shingle, so the Hamming distance of two sketches is at
most the symmetric difference of the sets, and sets with Jaccard similarity s or
more differ in at most (1-s)/(1+s) * (|A|+|B|) shingles. Sketches are cut into
blocks for each band of set sizes; by the pigeonhole principle two similar sets
agree on a block among the d+1 fullest blocks of each (d: the largest possible
distance). Sets that agree on such a block meet in a bucket; pairs are screened by the
Hamming distance of the sketches and verified on the exact sets.

In a bucket each set is first compared with the smallest and the largest set id only (two stars), and
then, where components are still apart, with a few sets drawn by hash. Other pairs of a bucket that are then still in different components are compared as
well, so no link that joins two components is missed, and copies are not
expanded into all pairs. Equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import Work, connected_components, key_filter

K = 5
#: similarity in hundredths
SIMILARITY = 80
#: 64-bit words of a sketch
SKETCH_WORDS = 16
#: bits of a sketch block (as a power of two); a block is kept as the XOR of a random word for each set bit
BLOCK_BITS = 20
_I, _U = np.int64, np.uint64


def max_distance(total: int, similarity: int) -> int:
    """The largest symmetric difference of two similar sets of ``total`` elements together."""
    return total * (100 - similarity) // (100 + similarity)


def band_blocks(band: int, similarity: int) -> int:
    """Blocks of the sketches that sets of 2**band to 2**(band+1)-1 elements share with larger partners."""
    top = (2 << band) - 1
    return max(16, (max_distance(top + top * 100 // similarity, similarity) + 1) * 5 // 4)


def _buckets(s: np.ndarray, similarity: int) -> list[np.ndarray]:
    """The bucket keys of one set: its fullest d+1 blocks in each band class it belongs to."""
    n = len(s)
    band = n.bit_length() - 1
    roles = [(band, n * 100 // similarity)]
    if band and -(-n * similarity // 100) < 1 << band:  # a smaller partner may be in the band below
        roles.append((band - 1, (1 << band) - 1))
    out = []
    for b, partner in roles:
        m, p = band_blocks(b, similarity), max_distance(n + partner, similarity) + 1
        at = ((s >> _U(32)) % _U(m) << _U(BLOCK_BITS)) | (s & _U((1 << BLOCK_BITS) - 1))
        at, times = np.unique(at, return_counts=True)
        if times.max() > 1:
            at = at[times % 2 == 1]
        block = (at >> _U(BLOCK_BITS)).astype(_I)
        first = np.flatnonzero(np.diff(block, prepend=-1))
        word, full, block = np.bitwise_xor.reduceat(tn.mix(at), first) if len(at) else np.zeros(0, _U), np.diff(first, append=len(at)), block[first]
        if len(block) < p:  # empty blocks count too
            rest = np.setdiff1d(np.arange(m), block)
            word, full, block = np.append(word, np.zeros(len(rest), _U)), np.append(full, np.zeros(len(rest), _I)), np.append(block, rest)
        key = tn.mix(word ^ tn.mix(block.astype(_U) + _U((b + 1) << 32)))
        out.append(key[np.lexsort((key, -full))[:p]])
    return out


def _signatures(k: int, similarity: int):
    """Set id, size, sketch and buckets of each document; a task gives sketch and buckets of a set once, and empty lists where it occurs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # the sets of this task
        for batch in tn.each(batches):
            data, offsets = tn.text_bytes(batch.column(2))
            for i, j in tn.slices(offsets):
                sets = tn.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                n = np.array([len(s) for s in sets], np.int32)
                sid = tn.mix(np.array([tn.mix(s).sum(dtype=_U) for s in sets], _U) + n.astype(_U)).view(_I)
                bits = np.zeros((len(sets), SKETCH_WORDS * 64), np.uint8)
                keys = []
                again = np.zeros(len(sets), bool)
                for r, (s, own) in enumerate(zip(sets, sid.tolist(), strict=True)):
                    again[r] = own in seen
                    if len(s) and not again[r]:
                        seen.add(own)
                        bits[r] = np.bincount((s >> _U(20)).astype(_I) & (SKETCH_WORDS * 64 - 1), minlength=SKETCH_WORDS * 64) & 1
                        keys.append(np.concatenate(_buckets(s, similarity)).view(_I))
                    else:
                        keys.append(np.zeros(0, _I))
                sketch = pa.array(np.packbits(bits[~again], axis=1).view(_I).ravel())
                lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n), pa.array(sid), lists(np.concatenate([[0], np.cumsum(~again)]) * SKETCH_WORDS, sketch), lists(np.concatenate([[0], np.cumsum([len(x) for x in keys])]), pa.array(np.concatenate(keys)))],
                    ["doc_id", "tkey", "n", "sid", "sketch", "buckets"],
                )

    return run


def _verify(k: int, similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tn.each(batches):
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                a, b = (tn.shingle_sets(*tn.text_bytes(part.column(c)), k) for c in (2, 3))
                same = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)]
                ok = [100 * s >= similarity * (len(x) + len(y) - s) for s, x, y in zip(same, a, b, strict=True)]
                yield part.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


#: further stars of a bucket, around sets drawn by hash
TURNS = 3


def _like(a: Callable[[str], F.Column], b: Callable[[str], F.Column], similarity: int) -> F.Column:
    """Whether sizes and sketches are near enough for two sets to be similar."""
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.get(a("sketch"), F.lit(i)).bitwiseXOR(F.get(b("sketch"), F.lit(i)))) for i in range(SKETCH_WORDS)])
    sizes = F.least(a("n"), b("n")) * 100 >= F.greatest(a("n"), b("n")) * similarity
    return sizes & (apart * (100 + similarity) <= (a("n") + b("n")) * (100 - similarity))


def similar_sets(docs: DataFrame, work: Work, id_col: str = "doc_id", text_col: str = "text", k: int = K, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(documents, links): (doc_id, n, sid) for each row of ``docs``, and verified links
    (u, v) between set ids whose components are those of all similar pairs."""
    spark = work.spark
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    signed = work.cut(base.mapInArrow(_signatures(k, similarity), f"doc_id {kind}, tkey long, n int, sid long, sketch array<long>, buckets array<long>"), "signed")
    slim = work.cut(signed.select("doc_id", "tkey", "n", "sid"), "slim")
    sets = signed.filter("n > 0").groupBy("sid").agg(F.min("n").alias("n"), F.min(F.struct("doc_id", "tkey")).alias("d"), F.max("sketch").alias("sketch"))
    sets = work.cut(sets.select("sid", "n", "d.doc_id", "d.tkey", "sketch"), "sets")

    # buckets with two sets or more, and their ends; then their rows, which a plain table lets the join split
    rows = signed.select(F.explode("buckets").alias("bucket"), "sid")
    ends = work.cut(rows.groupBy("bucket").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo < hi"), "ends")
    met = work.cut(rows.filter(key_filter(ends, "bucket")(F.col("bucket"))).join(ends, "bucket"), "met")
    work.drop(signed, ends)
    pair = F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("sid").alias("b")), F.struct(F.col("sid").alias("a"), F.col("hi").alias("b"))))
    stars = work.cut(met.select(pair.alias("p")).select("p.*").filter("a < b").distinct(), "stars")

    def paired(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """``pairs`` with the columns of both sets from ``of``."""
        side = lambda x: of.withColumnsRenamed({c: x if c == "sid" else f"{c}_{x}" for c in of.columns})
        return pairs.join(side("a"), "a").join(side("b"), "b")

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        """(u, v): the similar ones of ``pairs``, first by sketches and then by the sets."""
        near = paired(pairs, sets).filter(_like(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b"), similarity))
        near = work.cut(near.select("a", "b", "doc_id_a", "doc_id_b", "tkey_a", "tkey_b"), f"{tag}-near")
        need = F.explode(F.array(*[F.struct(F.col(x).alias("sid"), F.col(f"doc_id_{x}").alias("d"), F.col(f"tkey_{x}").alias("t")) for x in "ab"]))
        need = work.cut(near.select(need.alias("x")).select("x.*").distinct(), f"{tag}-need")
        texts = base.filter(key_filter(need, "t")(F.col("tkey"))).join(need, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t")))
        texts = work.cut(texts.select("sid", "text").dropDuplicates(["sid"]), f"{tag}-texts")
        both = paired(near.select("a", "b"), texts).select("a", "b", "text_a", "text_b")
        out = work.cut(both.mapInArrow(_verify(k, similarity), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")), f"{tag}-links")
        work.drop(near, need, texts)
        return out

    links = verified(stars, "star")

    def unfinished(rows: DataFrame, tag: str) -> DataFrame:
        """The rows (bucket, sid, ...) of buckets whose sets are in different components by now, with the component."""
        comp = connected_components(links, work)
        left = rows.join(comp, F.col("sid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "sid")).drop("node", "component")
        left = work.cut(left, f"{tag}-all")
        open_ = left.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
        open_ = work.cut(open_, f"{tag}-open")
        return work.cut(left.join(open_, "bucket"), tag)

    def near(a: Callable[[str], F.Column], b: Callable[[str], F.Column]) -> F.Column:
        return (a("comp") != b("comp")) & _like(a, b, similarity)

    # the two ends of a bucket are done
    left = unfinished(met.filter("sid != lo and sid != hi").select("bucket", "sid").distinct(), "left")
    left, done = work.cut(left.join(sets.select("sid", "n", "sketch"), "sid"), "left-sets"), left
    work.drop(met, done)
    # each set with a few sets of its bucket, other ones in each bucket: no more than so many pairs a row
    drawn = [F.min(F.struct(F.xxhash64("sid", "bucket", F.lit(turn)), "sid", "n", "comp", "sketch")) for turn in range(TURNS)]
    drawn = work.cut(left.groupBy("bucket").agg(F.array_distinct(F.array(*drawn)).alias("drawn")), "drawn")
    pairs = left.join(drawn.select("bucket", F.explode("drawn").alias("one")), "bucket").filter(near(lambda c: F.col(c), lambda c: F.col("one")[c]))
    pairs = pairs.select(F.least("sid", "one.sid").alias("a"), F.greatest("sid", "one.sid").alias("b")).distinct()
    links = work.cut(links.unionByName(verified(work.cut(pairs, "drawn-pairs"), "drawn")), "more-links")
    done, left = left, unfinished(left.drop("comp"), "open")
    work.drop(done, drawn)
    # all pairs that are still open; the distance of the sketches is part of the join, so that pairs too far apart are not made
    side = lambda x: left.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in left.columns if c != "bucket"])
    cross = side("x").join(side("y"), "bucket").filter("sid_x < sid_y").filter(near(lambda c: F.col(f"{c}_x"), lambda c: F.col(f"{c}_y")))
    cross = cross.select(F.col("sid_x").alias("a"), F.col("sid_y").alias("b")).distinct()
    cross = work.cut(cross.join(stars, ["a", "b"], "left_anti"), "cross")
    work.drop(left)
    links = links.unionByName(verified(cross, "cross"))
    return slim, links


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Null and empty texts have no shingles and are their own component; fewer
    than ``k`` words are one shingle; equal sets share a component; rows that
    repeat a doc_id each get a row. component_id is the smallest doc_id
    reachable (a null doc_id alone stays null). Other columns are ignored; an
    empty table gives no rows.
    """
    work = Work(docs.sparkSession, "ngram-jaccard")
    slim, links = similar_sets(docs, work, id_col, text_col, k, similarity)
    comp = work.cut(connected_components(links, work), "components")
    classed = slim.filter("n > 0").join(comp, F.col("sid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "sid"))
    classed = work.cut(classed.select("doc_id", "n", "comp"), "classed")
    # a plain table, so that a large group is split in the join
    least = work.cut(classed.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    linked = classed.join(least, "comp").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = slim.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
