import random

import numpy as np

from strandloom.llm import decontamination as d

from .conftest import words

ITEM = words(30, 500)


def slow_tiles(doc, item, least):
    """Greedy tiling by comparing all places."""
    dm, im, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = []
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not dm[i + k] and not im[j + k]:
                    k += 1
                if k >= least:
                    best.append((-k, i, j))
        if not best:
            return out
        k, i, j = min(best)
        for x in range(-k):
            dm[i + x] = im[j + x] = True
        out.append((i, j, -k))


def test_tiles_like_the_slow_way():
    r = random.Random(2)
    for _ in range(200):
        doc, item = (np.array([r.randint(1, 3) for _ in range(r.randint(0, 16))], np.uint64) for _ in range(2))
        assert sorted(d.tiles(doc, item, 2)) == sorted(slow_tiles(doc.tolist(), item.tolist(), 2))


def test_documents(spark, frame):
    w = ITEM.split()
    turned = " ".join(w[20:] + w[10:20] + w[:10])
    half = " ".join(w[:10])
    docs = frame(
        [(1, "x " + ITEM.upper() + ". y", "k"), (2, turned, "k"), (3, half, "k"), (4, None, "k"), (5, "", "k"), (6, words(3000, 40_000) + "\n" + ITEM + "\n" + words(3000, 9000), "k"), (1, ITEM, "k"), (None, ITEM, "k"), (7, words(3000, 40_000), "k"), (8, "it is too short!", "k"), (9, "Too, short", "k")],
        "doc_id long, text string, h string",
    )
    bench = frame([(9, ITEM), (8, ITEM.upper() + "."), (10, "too short"), (11, None), (12, "")], "item_id long, text string")
    for bits in (d.MOST_BITS, 4):  # a filter that lets nearly everything pass changes nothing
        got = d.find_contamination(docs, bench, most_bits=bits).collect()
        assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 8), (1, 8), (1, 8), (2, 8), (6, 8), (9, 10)]
        assert all(r["n_items"] == (2 if r["item_id"] == 8 else 1) and r["coverage"] == 1 for r in got)
        assert {r["n_tiles"] for r in got if r["doc_id"] == 2} == {3}
        rest = d.remove_contaminated(docs, bench, most_bits=bits)
        assert rest.columns == docs.columns and sorted(r["doc_id"] for r in rest.collect()) == [3, 4, 5, 7, 8]
    assert sorted(tuple(r) for r in d.item_classes(bench).collect()) == [(8, 8), (9, 8), (10, 10)]
    assert d.find_contamination(docs, frame([], "item_id long, text string")).count() == 0
    assert d.find_contamination(frame([], "doc_id long, text string"), bench).count() == 0
    assert d.remove_contaminated(docs, frame([], "item_id long, text string")).count() == 11


def test_against_all_pairs(frame):
    """Every pair of a document and an item is tiled plainly, without seeds."""
    r = random.Random(9)
    common = words(8, 60_000).split()
    items = [[*words(r.randint(5, 25), 1000 * i).split(), *(common if i % 2 else [])] for i in range(30)]
    docs = []
    for _ in range(120):
        parts = [words(r.randint(0, 30), r.randrange(100_000)).split()]
        for item in r.sample(items, r.randint(0, 3)):
            a = r.randrange(len(item))
            parts += [item[a:], ["gap"], item[:a]] if r.random() < 0.6 else [item[: r.randint(1, len(item))]]
        docs.append([w for p in parts for w in p])
    got = d.find_contamination(frame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string"), frame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()
    want = set()
    for i, x in enumerate(docs):
        for k, y in enumerate(items):
            matched = sum(n for _, _, n in slow_tiles(x, y, d.MIN_MATCH))
            if matched >= d.COVERAGE * len(y):
                want.add((i, k, matched))
    assert want and {(x["doc_id"], x["item_id"], x["matched_words"]) for x in got} == want
