"""Best-fit packing by linear grouping.

Documents are encoded and cut into pieces of at most ``length`` ids. The counts
of the pieces by length (``length`` numbers, whatever the corpus) are all that the plan needs:
large lengths are rounded up within groups of equal counts, the few sizes that
remain are packed by the best mix of configurations (column generation on the
configuration programme), the real lengths then take the places of their group
(what rounding leaves free in a sequence goes to its next place, so that a longer piece
fits there, and a piece more if one fits), and what is left goes best-fit into the gaps,
and then into new sequences. As real lengths do not use up the groups evenly, lengths
are grouped anew for each round of configurations. A few plans are made, and the one with the
fewest sequences is taken. The
plan is a list of runs: a run gives the pieces of one length with
neighbouring ranks the same offset in neighbouring sequences. Pieces find their
run by length and rank, so that the corpus is packed by one sort and one join
with the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import Work, global_row_numbers
from .tokens import encoder

LENGTH = 1024
END_ID = 2
#: plans that are made: groups of large lengths, and hundredths of a mix of configurations that are
#: used before the rest is grouped anew; no groups is best-fit decreasing
TRIALS = ((40, 100), (40, 75), (0, 100))
#: lengths over this part of a sequence are large
LARGE = 1 / 8
#: the mix of configurations is improved until no more than this part of it can be saved
ENOUGH = 1e-3


def _pieces(path: str, length: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in tn.each(batches):
            for first, ids, n in enc.encode(batch.column(1)):
                rows, piece, start, size, crc, parts = [], [], [], [], [], []
                at = 0
                for r, k in enumerate(n.tolist()):
                    doc = np.append(ids[at : at + k], np.uint32(end_id)).astype("<u4")
                    at += k
                    cut = [0, *range(len(doc) % length or length, len(doc), length), len(doc)]
                    for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                        rows.append(first + r), piece.append(p), start.append(a), size.append(b - a)
                        crc.append(zlib.crc32(doc[a:b].tobytes()))
                        if with_ids:
                            parts.append(doc[a:b])
                out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(size)])
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def _best_configuration(value: np.ndarray, sizes: list[int], length: int) -> tuple[float, list[int]]:
    """The counts of sizes that fit a sequence with the largest sum of values (a knapsack)."""
    order = np.argsort(sizes)
    up, worth = np.array(sizes)[order], value[order]
    fit = np.searchsorted(up, np.arange(length + 1), "right")
    best = np.zeros(length + 1)
    took = np.full(length + 1, -1, np.int64)
    for c in range(1, length + 1):
        best[c] = best[c - 1]
        if n := fit[c]:
            sums = best[c - up[:n]] + worth[:n]
            i = int(sums.argmax())
            if sums[i] > best[c] + 1e-12:
                best[c], took[c] = sums[i], order[i]
    out, c = [0] * len(sizes), length
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            out[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[length]), out


def configurations(sizes: list[int], need: list[int], length: int, most: int = 4000) -> list[tuple[list[int], int]]:
    """Configurations (a count for each size) and how often to use each, so that together they have
    at least ``need`` pieces of each size; the fewest but for rounding."""
    k = len(sizes)
    if not k:
        return []
    columns = [[length // s if i == j else 0 for j in range(k)] for i, s in enumerate(sizes)]
    basis = np.array(columns, float).T
    demand = np.array(need, float)
    x = np.linalg.solve(basis, demand)
    for _ in range(most):
        value = np.linalg.solve(basis.T, np.ones(k))
        gain, new = _best_configuration(value, sizes, length)
        if gain <= 1 + ENOUGH:
            break
        step = np.linalg.solve(basis, np.array(new, float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[out] = new
        basis[:, out] = new
        x = np.maximum(np.linalg.solve(basis, demand), 0)
    return [(c, int(n + 1e-6)) for c, n in zip(columns, x, strict=True) if n >= 1 - 1e-6]


@dataclass
class _Bins:
    """``count`` sequences, from number ``first`` on, all holding pieces of ``sizes`` in this order."""

    first: int
    count: int
    used: int


class Plan:
    """Runs (length, first rank, count, first sequence, offset), from counts by length."""

    def __init__(self, counts: dict[int, int], length: int = LENGTH, groups: int = TRIALS[0][0], part: int = 100):
        self.part = part
        self.length, self.runs, self.sequences = length, [], 0
        self.rank = dict.fromkeys(counts, 0)
        self.left = dict(counts)
        self.open: dict[int, list[_Bins]] = {}  # by gap
        for n in (length,):  # full pieces need no plan
            if self.left.get(n):
                self._put(n, self._new(self.left[n]))
        self.large = sorted(s for s in counts if length * LARGE < s < length and self.left[s])
        while groups and sum(self.left[s] for s in self.large) > groups and self._round(groups):
            pass
        for s in sorted((s for s in self.left if self.left[s]), reverse=True):
            self._best_fit(s)

    def _new(self, count: int) -> _Bins:
        b = _Bins(self.sequences, count, 0)
        self.sequences += count
        return b

    def _put(self, size: int, b: _Bins) -> None:
        """The next pieces of this size go into the sequences of ``b``, one each."""
        self.runs.append((size, self.rank[size], b.count, b.first, b.used))
        self.rank[size] += b.count
        self.left[size] -= b.count
        b.used += size

    def _round(self, groups: int) -> int:
        """Use a part of the best mix of configurations for the large lengths that are left; the number of sequences begun.

        The rest is grouped anew, as the real lengths do not use up the groups evenly.
        """
        sizes = [s for s in reversed(self.large) if self.left[s]]
        total = sum(self.left[s] for s in sizes)
        # groups of (nearly) equal counts, by descending length; each is rounded up to its largest
        grouped: list[list[int]] = []
        seen = 0
        for s in sizes:
            if len(grouped) <= seen * groups // total:
                grouped.append([])
            grouped[-1].append(s)
            seen += self.left[s]
        tops = [g[0] for g in grouped]
        need = [sum(self.left[s] for s in g) for g in grouped]
        before = self.sequences
        for config, times in sorted(configurations(tops, need, self.length), key=lambda c: -c[1]):
            self._fill(-(-times * self.part // 100), [tops[g] for g, n in enumerate(config) for _ in range(n)])
        return self.sequences - before

    def _fit(self, most: int) -> int | None:
        """The longest large length of at most ``most`` that is left."""
        i = bisect_right(self.large, most) - 1
        while i >= 0 and not self.left[self.large[i]]:
            del self.large[i]
            i -= 1
        return self.large[i] if i >= 0 else None

    def _fill(self, count: int, slots: list[int]) -> None:
        """``count`` sequences: real lengths take the places of their group, the longest first; sequences are split where the length changes.

        A place also has what the places before it left free, and the last ones have all that is left.
        """
        while count and (size := self._fit(slots[0] if slots[1:] else self.length)):
            todo = [(self._new(min(count, self.left[size])), 0, slots[0])]
            count -= todo[0][0].count
            while todo:
                b, at, room = todo.pop()
                if at >= len(slots) - 1:
                    room = self.length - b.used
                size = self._fit(room)
                if size is not None:
                    if b.count > self.left[size]:
                        todo.append((_Bins(b.first + self.left[size], b.count - self.left[size], b.used), at, room))
                        b.count = self.left[size]
                    self._put(size, b)
                if at < len(slots) - 1:
                    todo.append((b, at + 1, room - (size or 0) + slots[at + 1]))
                elif size is not None:
                    todo.append((b, at + 1, 0))
                else:
                    self._keep(b)

    def _keep(self, b: _Bins) -> None:
        if b.count and b.used < self.length:
            self.open.setdefault(self.length - b.used, []).append(b)

    def _best_fit(self, size: int) -> None:
        while self.left[size]:
            gap = min((g for g in self.open if g >= size), default=None)
            if gap is None:
                each = self.length // size  # so many in a new sequence
                b = self._new(max(1, self.left[size] // each))
            else:
                b = self.open[gap].pop()
                if not self.open[gap]:
                    del self.open[gap]
            fits = (self.length - b.used) // size
            full = min(b.count, max(1, self.left[size] // fits))
            if full < b.count:
                self._keep(_Bins(b.first + full, b.count - full, b.used))
                b.count = full
            for _ in range(fits):
                if self.left[size] < b.count:
                    if not self.left[size]:
                        break
                    self._keep(_Bins(b.first + self.left[size], b.count - self.left[size], b.used))
                    b.count = self.left[size]
                self._put(size, b)
            self._keep(b)


def best_plan(counts: dict[int, int], length: int = LENGTH, trials: tuple = TRIALS) -> Plan:
    """The plan of ``trials`` with the fewest sequences, the first of equals."""
    return min((Plan(counts, length, *t) for t in trials), key=lambda p: p.sequences)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", trials: tuple = TRIALS, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset) for each piece.

    A null or empty text is its end id alone. Only documents longer than
    ``length`` are cut, so that all but the first piece are full. Offsets are
    gapless from 0 in each sequence. Repeated rows are packed each; a null id
    stays null; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Work(spark, "packing")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    pieces = rows.mapInArrow(_pieces(tokenizer, length, end_id, with_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{ids}")
    pieces = work.cut(pieces, "pieces")
    ranked = global_row_numbers(pieces, [F.col("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], work, "ranked", "rank", within="length")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # ``length`` rows at most
    plan = best_plan(counts, length, trials)
    runs = spark.createDataFrame(plan.runs or [(0, 0, 0, 0, 0)], "size long, rank0 long, n long, seq0 long, offset long")
    # the plan has a run for each change of length or configuration: it depends on `length` and the groups, not on the corpus
    found = ranked.join(F.broadcast(runs), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank0") + F.col("n")))
    return found.withColumn("sequence_id", F.col("seq0") + F.col("rank") - F.col("rank0")).drop("size", "rank0", "n", "seq0", "rank")
