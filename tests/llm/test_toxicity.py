import random

import numpy as np

from strandloom.llm import toxicity as t

LABELS = "doc_id long, toxic int"


def corpus(n, seed=1):
    r = random.Random(seed)
    syllables = ["an", "er", "th", "on", "re", "st", "in", "ou", "ble", "ti"]
    out = []
    for i in range(n):
        text = " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(r.randint(20, 60)))
        toxic = i % 3 == 0
        if toxic:
            w = text.split()
            for bad in r.sample(["gribble", "snarfog", "zaptwit"], 2):
                w.insert(r.randrange(len(w)), bad)
            text = " ".join(w)
        out.append((i, text, int(toxic)))
    return out


def test_held_out_accuracy_and_edge_cases(frame):
    rows = corpus(400)
    docs = frame([(i, x, "s") for i, x, _ in rows] + [(1000, None, "s"), (1001, "", "s"), (1002, "ab", "s"), (None, "gribble snarfog", "s"), (5, rows[5][1], "s")], "doc_id long, text string, score string")
    labels = frame([(i, y) for i, _, y in rows[:300]] + [(None, 1), (7, None), (3, 0)], LABELS)
    model = t.fit_toxicity(docs, labels)
    got = t.score_toxicity(docs, model).collect()
    assert len(got) == 405
    score = {r["doc_id"]: r["score"] for r in got}
    assert all(0 <= s <= 1 for s in score.values())
    wrong = [(i, y, score[i]) for i, _, y in rows if (score[i] >= 0.5) != bool(y)]
    assert len(wrong) <= 2
    assert score[1000] == score[1001]
    assert score[None] >= 0.5


def test_without_both_labels(frame):
    docs = frame([(1, "some text"), (2, None)], "doc_id long, text string")
    assert {r["score"] >= 0.5 for r in t.score_toxicity(docs, t.fit_toxicity(docs, frame([], LABELS))).collect()} == {False}
    assert {r["score"] >= 0.5 for r in t.score_toxicity(docs, t.fit_toxicity(docs, frame([(1, 1)], LABELS))).collect()} == {True}


def test_features_are_the_distinct_ngrams(monkeypatch):
    every = np.arange(1 << t.BITS)
    texts = ["abcabcabc", "", None, "ab", "Größe und Maß " * 3, "x" * 200]
    row, f = t.features(texts, every)
    for i, x in enumerate(texts):
        want = {(x or "").lower()[j : j + n] for n in t.SIZES for j in range(len(x or "") - n + 1)}
        assert abs(len(set(f[row == i].tolist())) - len(want)) <= 1  # but for a rare collision


def bucket(gram):
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c) * int(t._K)) % (1 << 32)
    x = (h ^ (h >> 15) ^ len(gram)) * 0x85EBCA6B % (1 << 32)
    return (x ^ (x >> 13)) * 0xC2B2AE35 % (1 << 32) >> (32 - t.BITS)


def buckets(text):
    text = (text or "").lower()
    return {bucket(text[j : j + n]) for n in t.SIZES for j in range(len(text) - n + 1)}


def test_ratios_selection_and_score_like_the_slow_way(frame, monkeypatch):
    monkeypatch.setattr(t, "FEATURES", 60)
    rows = corpus(90, seed=4)
    more = [(5, "another text of five"), (5, "another text of five"), (500, None), (501, "never labelled zaptwit")]
    labels = [(i, y) for i, _, y in rows if i % 7] + [(5, 1), (500, 0), (None, 1), (502, None), (999, 1)]
    model = t.fit_toxicity(frame([r[:2] for r in rows] + more, "doc_id long, text string"), frame(labels, LABELS))
    marks = {}
    for i, y in labels:
        if i is not None and y is not None:
            marks[i] = max(y, marks.get(i, 0))
    examples = [(x, marks[i]) for i, x in {*(r[:2] for r in rows), *more} if i in marks]
    n = [sum(y == k for _, y in examples) for k in (0, 1)]
    held = [{}, {}]
    for x, y in examples:
        for b in buckets(x):
            held[y][b] = held[y].get(b, 0) + 1

    def ratio(b):
        return np.log((held[1].get(b, 0) + 1) / (n[1] + 2)) - np.log((held[0].get(b, 0) + 1) / (n[0] + 2))

    clear = {b: abs(ratio(b)) / np.sqrt(1 / (held[1].get(b, 0) + 1) + 1 / (held[0].get(b, 0) + 1)) for b in {*held[0], *held[1]}}
    chosen = set(np.flatnonzero(model.slot >= 0).tolist())
    assert len(chosen) == 60 and sorted(model.slot[sorted(chosen)].tolist()) == list(range(60))
    assert min(clear[b] for b in chosen) >= max(v for b, v in clear.items() if b not in chosen) - 1e-9
    # a toxic n-gram never speaks against toxicity by more than noise: weight and ratio have one sign where it matters
    strong = max(chosen, key=lambda b: clear[b])
    assert ratio(strong) * model.weight[model.slot[strong]] > 0
    # the score is the logistic sum over the distinct n-grams of the whole text, however long
    texts = [(i, x) for i, x, _ in rows] + [(700, ""), (701, None), (702, "x" * 5), (703, "plain words " * 60_000 + "gribble snarfog zaptwit")]
    got = {r["doc_id"]: r["score"] for r in t.score_toxicity(frame(texts, "doc_id long, text string"), model).collect()}
    for i, x in texts:
        own = [b for b in buckets(x if i != 703 else "plain words " * 3 + "gribble snarfog zaptwit") if b in chosen]
        want = 1 / (1 + np.exp(-(model.bias + sum(model.weight[model.slot[b]] for b in own))))
        assert abs(got[i] - want) < 1e-9


def test_empty_tables(frame):
    docs = frame([], "doc_id long, text string")
    model = t.fit_toxicity(docs, frame([(1, 1), (2, 0)], LABELS))
    assert t.score_toxicity(docs, model).collect() == []
