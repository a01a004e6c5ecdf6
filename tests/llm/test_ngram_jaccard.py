import collections
import random
import re

from strandloom.llm import ngram_jaccard as j

from .conftest import even_and_odd, words


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return collections.Counter((k, len(sets[i]), least.get(root(i))) for i, (k, _) in enumerate(rows))


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def test_against_all_pairs(frame):
    r = random.Random(8)
    rows = []
    shared = words(60, 77_000)
    for g in range(25):
        text = words(r.choice([1, 3, 5, 8, 12, 40, 90, 300]), g * 1000)
        if g % 3 == 0:
            text += "\n" + shared
        for _ in range(r.randint(1, 6)):
            rows.append(edited(r, text, r.choice([0, 0, 1, 1, 2, 4])))
    rows += [None, "", " \t\n", "One two", "one TWO", words(20_000, 5), edited(r, words(20_000, 5), 300)]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    rows += [rows[0], (None, "lonely text without an id at all"), (rows[1][0], "another text of the same id as one before")]
    docs = frame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, component_id string, n int")
    got = collections.Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in j.ngram_jaccard_components(docs).collect())
    assert got == plain(rows)


def test_many_near_copies_are_one_group(frame):
    r = random.Random(6)
    text = words(80)
    rows = [(i, edited(r, text, 1)) for i in range(120)] + [(500 + i, text) for i in range(40)]
    got = j.ngram_jaccard_components(frame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == plain(rows)


def test_no_rows(frame):
    assert j.ngram_jaccard_components(frame([], "doc_id long, text string")).count() == 0
    assert j.ngram_jaccard_components(frame([(1, None)], "doc_id long, text string")).collect() == [(1, 0, 1)]


def test_words_of_one_polynomial_hash_are_not_linked(frame):
    rows = list(enumerate(even_and_odd()))
    got = j.ngram_jaccard_components(frame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(x) for x in got) == [(0, 1, 0), (1, 1, 1)]


def test_blocks_hold_the_pigeonhole_bound():
    """Similar sets share a bucket, for all sizes of small sets."""
    import numpy as np

    rng = np.random.default_rng(0)
    for n in [*range(1, 40), 100, 257, 1000]:
        for _ in range(10):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            change = j.max_distance(2 * len(a), 80) // 2
            b = np.unique(np.concatenate([a[change:], rng.integers(0, 1 << 63, change, dtype=np.uint64)]))
            keys = [set(np.concatenate(j._buckets(x, 80)).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]
