import bisect
import collections
import random
import zlib

import numpy as np
import pytest

from strandloom.llm import packing as p
from strandloom.llm.queries import tokenizer_path

from .test_tokens import library


def check_plan(counts, length=1024):
    plan = p.best_plan(dict(counts), length)
    ranks, bins = collections.defaultdict(list), collections.defaultdict(list)
    for size, first, n, seq, offset in plan.runs:
        for i in range(n):
            ranks[size].append(first + i)
            bins[seq + i].append((offset, size))
    assert all(sorted(ranks[s]) == list(range(n)) for s, n in counts.items())
    assert len(bins) == plan.sequences
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= length
    return plan.sequences


def best_fit_decreasing(counts, length=1024):
    gaps = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            i = bisect.bisect_left(gaps, size)
            gap = gaps.pop(i) if i < len(gaps) else length
            bisect.insort(gaps, gap - size)
    return len(gaps)


@pytest.mark.parametrize("low,high", [(1, 1024), (300, 700), (100, 600), (130, 400)])
def test_plans_need_no_more_than_best_fit_decreasing(low, high):
    r = random.Random(high)
    counts = collections.Counter(r.randint(low, high) for _ in range(20_000))
    grouped = min(p.Plan(dict(counts), 1024, *t).sequences for t in p.TRIALS if t[0])
    best_fit = best_fit_decreasing(counts)
    assert check_plan(counts) <= best_fit
    assert grouped <= 1.001 * best_fit


@pytest.mark.parametrize("low,high", [(1, 1024), (300, 700), (1, 60), (513, 1024)])
def test_plans(low, high):
    r = random.Random(low)
    counts = collections.Counter(r.randint(low, high) for _ in range(3000))
    least = -(-sum(s * n for s, n in counts.items()) // 1024)
    big = sum(n for s, n in counts.items() if s > 512)
    assert check_plan(counts) <= 1.04 * max(least, big) + 2


def test_small_plans():
    assert check_plan({1024: 5}) == 5
    assert check_plan({1: 1}) == 1
    assert check_plan({}) == 0
    assert check_plan({400: 7, 624: 7, 2: 10}) == 8


def test_pieces_and_places(frame):
    texts = {1: None, 2: "", 3: "a few words", 4: "word " * 3000, 5: "same text", 6: "same text", 7: "é中\x1c <|endoftext|>", 8: "end <|endoftext|> more"}
    rows = [(k, v, 9) for k, v in texts.items()] + [(5, "same text", 9), (None, "same text", 9)]
    got = p.pack_documents(frame(rows, "doc_id long, text string, piece int"), tokenizer_path(), length=64).collect()
    want = collections.Counter()
    for k, v, _ in rows:
        ids = [*library([v or ""])[0], 2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[(k, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
    assert p.pack_documents(frame([], "doc_id long, text string"), tokenizer_path()).count() == 0
