"""Toxicity by a linear classifier on character n-grams with naive Bayes scaling.

A text is the set of its character n-grams (lower-cased, hashed). Each n-gram has
a naive Bayes log-count ratio r: how much oftener toxic texts hold it than
others. The n-grams whose ratio stands out most from chance are the features, scaled by
r, and a logistic regression on them gives the score.

Learning uses at most ``max_rows`` labelled rows (those of the smallest
hashes), so what the driver holds is bounded; scoring covers whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import Work, free_name

SIZES = (3, 4, 5, 6, 7)
BITS = 20
FEATURES = 4_000
MAX_ROWS = 20_000
#: tasks that count n-grams: each may give all buckets, and has its part of the max_rows examples
COUNT_TASKS = 12
#: bytes of text that are taken at a time
SLICE = 400_000
_K = np.uint32(0x9E3779B1)


def _chars(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all lower-cased texts, and the end of each."""
    each = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    return np.concatenate(each) if each else np.zeros(0, np.uint32), np.cumsum([len(x) for x in each], dtype=np.int64)


def _grams(chars: np.ndarray):
    """For each n: the bucket of the n-gram at each place."""
    h = chars * _K
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) + chars[n - 1 :] * _K
        if n in SIZES:
            x = (h ^ (h >> np.uint32(15)) ^ np.uint32(n)) * np.uint32(0x85EBCA6B)
            yield n, ((x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def features(texts: list[str | None], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of the texts; ``slot`` maps buckets to features (-1: none)."""
    chars, ends = _chars(texts)
    found = []
    for n, bucket in _grams(chars) if len(chars) >= max(SIZES) else _short(chars):
        f = slot[bucket]
        at = np.flatnonzero(f >= 0)
        row = np.searchsorted(ends, at, "right")
        whole = at + n <= ends[row]
        found.append(row[whole] * np.int64(1 << BITS) + f[at[whole]])
    code = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return code >> BITS, code & ((1 << BITS) - 1)


def _short(chars: np.ndarray):
    pad = np.concatenate([chars, np.zeros(max(SIZES), np.uint32)])  # the places beyond are dropped by the caller's ends
    for n, bucket in _grams(pad):
        yield n, bucket[: max(0, len(chars) - n + 1)]


def _slices(col: pa.Array):
    _, offsets = tn.text_bytes(col)
    for i, j in tn.slices(offsets, SLICE):
        yield i, j, col.slice(i, j - i).to_pylist()


@dataclass
class ToxicityModel:
    """Feature of each bucket (-1: none), weight of each feature, and the bias."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        row, f = features(texts, self.slot)
        return 1 / (1 + np.exp(-(self.bias + np.bincount(row, self.weight[f], minlength=len(texts)))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label that hold a bucket, as one table a task."""
    total = np.zeros((2, 1 << BITS), np.int64)
    every = np.arange(1 << BITS, dtype=np.int32)
    for batch in tn.each(batches):
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, texts in _slices(batch.column(0)):
            row, f = features(texts, every)
            for y in (0, 1):
                total[y] += np.bincount(f[label[i:j][row] == y], minlength=1 << BITS)
    at = np.flatnonzero(total.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "neg", "pos"])


def _active(slot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tn.each(batches):
            for i, j, texts in _slices(batch.column(0)):
                row, f = features(texts, slot)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f.astype(np.int32))), batch.column(1).slice(i, j - i)], ["f", "toxic"])

    return run


def _fit(idx: np.ndarray, ends: np.ndarray, y: np.ndarray, r: np.ndarray, l2: float, steps: int = 200, block: int = 1 << 18) -> tuple[np.ndarray, float]:
    """Logistic regression on features scaled by ``r``, by Adam; row i has the features idx[ends[i]:ends[i+1]]. Both classes weigh the same.

    Rows are taken in blocks of about ``block`` features, so that scratch arrays stay small.
    """
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + block, block)).clip(0, len(y)))
    parts = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        parts.append((i, j, idx[ends[i] : ends[j]], np.repeat(np.arange(j - i, dtype=np.int32), np.diff(ends[i : j + 1]))))
    n = len(r)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)  # the last is the bias
    for t in range(1, steps + 1):
        scaled, g = w[:n] * r, np.zeros(n + 1)
        g[:n] = l2 * w[:n]
        for i, j, f, row in parts:
            p = 1 / (1 + np.exp(-(w[n] + np.bincount(row, scaled[f], minlength=j - i))))
            e = weight[i:j] * (p - y[i:j])
            g[:n] += np.bincount(f, e[row], minlength=n) * r
            g[n] += e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:n], float(w[n])


def fit_toxicity(docs: DataFrame, labels: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, l2: float = 1e-4) -> ToxicityModel:
    """Learn from the labelled rows for which ``use`` holds (a condition on the id).

    A null id or label is no label; an id labelled twice is toxic if one label
    is. Rows that repeat an id with other texts are examples each, rows that repeat
    id and text are one. At most ``max_rows`` labels are used, and of their rows at most ``max_rows``. Without examples of both labels
    the model gives every text the score 0 (or 1, if all are toxic).
    """
    work = Work(docs.sparkSession, "toxicity")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    if use is not None:
        known = known.withColumnRenamed("id", id_col).filter(use).withColumnRenamed(id_col, "id")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    known = work.cut(known.coalesce(1), "labels")  # max_rows rows at most
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("id"))
    rows = work.cut(rows.select(F.xxhash64("doc_id", "text").alias("key"), "text", "toxic").dropDuplicates(["key"]), "labelled")
    some = work.cut(rows.select("key").orderBy("key").limit(max_rows).coalesce(1), "some")  # max_rows rows at most
    rows = work.cut(rows.join(F.broadcast(some), "key").select("text", "toxic").repartition(COUNT_TASKS), "examples")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return ToxicityModel(np.full(1 << BITS, -1, np.int32), np.zeros(1), 40.0 if n.get(1) else -40.0)
    counts = rows.mapInArrow(_counts, "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    ratio = F.log((F.col("pos") + 1) / (n[1] + 2)) - F.log((F.col("neg") + 1) / (n[0] + 2))
    counts = counts.withColumn("ratio", ratio)
    clear = F.abs("ratio") / F.sqrt(1 / (F.col("pos") + 1) + 1 / (F.col("neg") + 1))
    best = counts.orderBy(F.desc(clear), "bucket").limit(FEATURES).select("bucket", "ratio").collect()
    slot = np.full(1 << BITS, -1, np.int32)
    slot[[x["bucket"] for x in best]] = np.arange(len(best))
    r = np.array([x["ratio"] for x in best])
    active = rows.mapInArrow(_active(slot), "f array<int>, toxic int").toArrow()  # max_rows rows of FEATURES numbers at most
    y, f = active["toxic"].to_numpy().astype(float), active["f"].combine_chunks()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(f).to_numpy(zero_copy_only=False))])
    w, b = _fit(f.flatten().to_numpy(zero_copy_only=False), ends, y, r, l2)
    del active, f
    tn.trim()  # the driver goes on with other work
    return ToxicityModel(slot, w * r, b)


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tn.each(batches):
            at = batch.num_columns - 1
            out = [model.score(texts) for _, _, texts in _slices(batch.column(at))]
            score = pa.array(np.concatenate([*out, np.zeros(0)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], score], [*batch.schema.names[:at], "score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) with ``score``: 0 to 1, higher is likelier toxic.

    Null and empty texts, and texts too short for an n-gram, get the score of
    no features. Rows are scored each; a column called score is replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    schema = docs.select(*names).schema.add("score", "double")
    rows = docs.select(*names, F.col(text_col).alias(free_name(docs, "text_")))
    return rows.mapInArrow(_score(model), schema)
