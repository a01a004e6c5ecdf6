"""Benchmark decontamination by greedy string tiling.

Texts are sequences of words (letters and digits, A-Z folded). The runs of ``min_match``
words of the benchmark items are seeds. Distinct documents' seeds are joined with
the items' seeds, and pairs of a document and an item that share enough of them are
candidates. For each, running Karp-Rabin finds the longest common runs of
unmarked words, marks them as tiles, longest first and without overlap, and goes on with
shorter runs down to ``min_match``. The part of the item's words that tiles cover decides, so
passages whose sentences are reordered are found like those in order.

A Bloom filter of the seeds, of a bounded size whatever the benchmark, keeps seeds of
the corpus that no item has from being shuffled; the join alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import Work, free_name

MIN_MATCH = 5
COVERAGE = 0.5
#: bits of the filter for each seed, and at least and at most in all (powers of two)
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 64, 16, 27
PROBES = 4
_U = np.uint64


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """The Karp-Rabin hash of the ``n`` words from each place on."""
    up, down = tn._powers(max(len(words), 1024) + 1)
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return (sums[n:] - sums[:-n]) * down[: len(words) - n + 1]


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[n:] == total[:-n]


def _matches(doc: np.ndarray, item: np.ndarray, doc_marked: np.ndarray, item_marked: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of unmarked words, of ``n`` words or more: (length, place in doc, place in item)."""
    if n > min(len(doc), len(item)):
        return []
    at = np.flatnonzero(_free(item_marked, n))
    h = _runs(item, n)[at]
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    there = np.flatnonzero(_free(doc_marked, n))
    g = _runs(doc, n)[there]
    lo, hi = np.searchsorted(h, g, "left"), np.searchsorted(h, g, "right")
    out = []
    for i in np.flatnonzero(hi > lo).tolist():
        d = int(there[i])
        for p in at[lo[i] : hi[i]].tolist():
            if d and p and not doc_marked[d - 1] and not item_marked[p - 1] and doc[d - 1] == item[p - 1]:
                continue  # found from an earlier place
            k = 0
            while d + k < len(doc) and p + k < len(item) and doc[d + k] == item[p + k] and not doc_marked[d + k] and not item_marked[p + k]:
                k += 1
            if k >= n:
                out.append((k, d, p))
    return out


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length), without overlap in either."""
    doc_marked, item_marked = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out: list[tuple[int, int, int]] = []
    n = max(min_match, min(len(doc), len(item)))
    while True:
        found = sorted(_matches(doc, item, doc_marked, item_marked, n), key=lambda m: (-m[0], m[1], m[2]))
        again = 0
        for k, d, p in found:
            if k < again:
                break
            if doc_marked[d : d + k].any() or item_marked[p : p + k].any():
                again = k  # what is left of it may still be longer than the matches that follow
                continue
            doc_marked[d : d + k] = item_marked[p : p + k] = True
            out.append((d, p, k))
        if again:
            continue
        if n == min_match:
            return out
        n = max(min_match, n // 2)


def _seeds(data: np.ndarray, offsets: np.ndarray, min_match: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed, row) of each run of ``min_match`` words; fewer words make one seed of the whole row."""
    h, row, _, _ = tn.words(data, offsets, tn.NOT_ALNUM)
    s, at = tn.shingles(h, row, min_match)
    ends = np.searchsorted(row, np.arange(len(offsets)))
    n = np.diff(ends)
    few = np.flatnonzero((n > 0) & (n < min_match))
    whole = [tn.mix(np.append(h[ends[r] : ends[r + 1]], _U(n[r])) * tn.mix(np.arange(1, n[r] + 2, dtype=_U))).sum(dtype=_U) for r in few.tolist()]
    return np.concatenate([s, np.array(whole, _U)]), np.concatenate([at, few])


def _probes(seed: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(tn.mix(seed + _U(i)) >> _U(64 - bits)).astype(np.int64) for i in range(PROBES)]


def _item_seeds(min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tn.each(batches):
            data, offsets = tn.text_bytes(batch.column(1))
            for i, j in tn.slices(offsets):
                seed, row = _seeds(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_match)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + i)), pa.array(seed.view(np.int64))], ["no", "seed"])

    return run


def _hits(held: Broadcast, bits: int, min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts that hold a seed which passes the filter, with these seeds."""
        maybe = held.value
        for batch in tn.each(batches):
            data, offsets = tn.text_bytes(batch.column(2))
            for i, j in tn.slices(offsets):
                seed, row = _seeds(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_match)
                for k in range(PROBES):
                    at = (tn.mix(seed + _U(k)) >> _U(64 - bits)).astype(np.int64)
                    on = np.flatnonzero(maybe[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                    seed, row = seed[on], row[on]
                if len(seed):
                    rows = np.unique(row)
                    order = np.argsort(row, kind="stable")
                    ends = np.append(np.searchsorted(row[order], rows), len(row))
                    seeds = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(seed[order].view(np.int64)))
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows + i)).columns, seeds], ["h", "g", "text", "seeds"])

    return run


_TILE = pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())])


def _tile(coverage: float, min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the pairs (h, g, no, text, item), those whose tiles cover enough."""
        for batch in tn.each(batches):
            rows, out = [], []
            for r in range(batch.num_rows):
                doc, item = (tn.words(*tn.text_bytes(batch.column(c).slice(r, 1)), tn.NOT_ALNUM)[0] for c in (3, 4))
                if len(item) >= min_match:
                    found = tiles(doc, item, min_match)
                else:  # too short to be told from common words, so it must be the whole document
                    found = [(0, 0, len(item))] if np.array_equal(doc, item) else []
                matched = sum(k for _, _, k in found)
                if matched >= coverage * len(item):
                    rows.append(r)
                    out.append((len(found), matched, len(item), matched / len(item), [dict(zip(("doc_word", "item_word", "words"), t, strict=True)) for t in found]))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(_TILE)]
            cols = [pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int64())).columns[:3], *cols], ["h", "g", "no", "n_tiles", "matched_words", "item_words", "coverage", "tiles"])

    return run


def _words(text: Column) -> Column:
    """The words of a text, as the tiling sees them, with single spaces."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(folded, "[\\x00-\\x7F&&[^0-9a-z]]+", " "))


def item_classes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id): the item that stands for each item in the results, the smallest of those with the same words."""
    items = benchmark.select(F.col(id_col).alias("item"), _words(F.col(text_col)).alias("words")).filter("words <> ''")
    least = items.groupBy("words").agg(F.min("item").alias("item_id"))
    return items.join(least, "words").select("item", "item_id")


def _filter(seeds: DataFrame, most_bits: int) -> tuple[Broadcast, int]:
    """The Bloom filter of the seeds, and its number of bits as a power of two."""
    n = seeds.count()
    bits = min(most_bits, max(LEAST_BITS, (n * BITS_PER_SEED).bit_length()))

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_probes(batch.column(0).to_numpy().view(_U), bits)))
            byte, first = np.unique(at >> 3, return_index=True)
            held = np.bitwise_or.reduceat(1 << (at & 7), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(byte), pa.array(held.astype(np.int32))], ["byte", "held"])

    held = seeds.select("seed").mapInArrow(bytes_of, "byte long, held int").groupBy("byte").agg(F.bit_or("held").alias("held")).toArrow()  # 2**bits / 8 rows at most
    out = np.zeros(1 << (bits - 3), np.uint8)
    out[held["byte"].to_numpy()] = held["held"].to_numpy().astype(np.uint8)
    return seeds.sparkSession.sparkContext.broadcast(out), bits


def _text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h"), F.hash(text, F.length(text)).alias("g")]


def _found(docs: DataFrame, benchmark: DataFrame, work: Work, text_col: str, item_col: str, item_text_col: str, min_match: int, coverage: float, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """(texts, items): (h, g, no, ...) for each distinct text of ``docs`` and item that match, and (no, item_id, n_items, item) of the items."""
    items = benchmark.select(F.col(item_col).alias("id"), _words(F.col(item_text_col)).alias("item")).filter("item <> ''")
    items = items.groupBy("item").agg(F.min("id").alias("item_id"), F.count("*").alias("n_items"))
    items = work.cut(items.withColumn("no", F.monotonically_increasing_id()), "items")
    seeds = items.select("no", "item").mapInArrow(_item_seeds(min_match), "no long, seed long")
    seeds = work.cut(seeds.groupBy("seed", "no").agg(F.count("*").alias("times")), "seeds")
    held, bits = _filter(seeds, most_bits)

    text = F.col(text_col)
    hits = docs.select(*_text_keys(text), text.alias("text")).filter("text <> ''").mapInArrow(_hits(held, bits, min_match), "h long, g int, text string, seeds array<long>")
    hits = work.cut(hits, "hits")
    # equal texts are one: only their keys are told apart, and one text of each is read
    have = hits.select("h", "g", F.explode("seeds").alias("seed")).distinct()
    shared = have.join(seeds, "seed").groupBy("h", "g", "no").agg(F.sum("times").alias("shared"))
    # tiles of min_match words or more that cover m words of an item hold m / min_match of its seeds or more
    size = items.select(F.col("no"), "item", F.size(F.split("item", " ")).alias("size"))
    pairs = shared.join(size, "no").filter((F.col("shared") * min_match >= F.col("size") * coverage) | (F.col("size") < min_match))
    texts = work.cut(hits.groupBy("h", "g").agg(F.first("text").alias("text")), "texts")
    pairs = pairs.join(texts, ["h", "g"]).select("h", "g", "no", "text", "item")
    kinds = "h long, g int, no long, n_tiles int, matched_words int, item_words int, coverage double, tiles array<struct<doc_word:int,item_word:int,words:int>>"
    return work.cut(pairs.mapInArrow(_tile(coverage, min_match), kinds), "found"), items


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, item_id, n_items, n_tiles, matched_words, item_words, coverage, tiles): the documents in which tiles
    cover ``coverage`` of an item's words or more.

    The ``n_items`` items of equal words are one, the smallest (``item_classes`` lists them). An item of
    fewer than ``min_match`` words matches the documents that have these words and no others. Null
    and empty texts and items match nothing; repeated documents are reported each. Empty tables give no rows.
    """
    work = Work(docs.sparkSession, "decontamination")
    found, items = _found(docs, benchmark, work, text_col, item_col, item_text_col, min_match, coverage, most_bits)
    rows = docs.select(F.col(id_col).alias("doc_id"), *_text_keys(F.col(text_col)))
    return rows.join(found, ["h", "g"]).join(items.drop("item"), "no").select("doc_id", "item_id", "n_items", "n_tiles", "matched_words", "item_words", "coverage", "tiles")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` that ``find_contamination`` does not report, with all their columns; null and empty texts stay."""
    work = Work(docs.sparkSession, "decontamination")
    found, _ = _found(docs, benchmark, work, text_col, item_col, item_text_col, min_match, coverage, most_bits)
    h, g = free_name(docs, "h"), free_name(docs, "g")
    gone = found.select(F.col("h").alias(h), F.col("g").alias(g)).distinct()
    rows = docs.withColumns(dict(zip((h, g), _text_keys(F.col(text_col)), strict=True)))
    return rows.join(gone, [h, g], "left_anti").select(*[f"`{c}`" for c in docs.columns])
