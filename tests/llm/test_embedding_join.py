import numpy as np
import pytest

from strandloom.llm import embedding_join as e

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def plain(rows):
    ok = [x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(v != 0 for v in x) for _, x in rows]
    unit = [np.array(x, np.float32).astype(float) if g else None for (_, x), g in zip(rows, ok, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    n = len(rows)
    links = [[b for b in range(n) if b != a and ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9] for a in range(n)]
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min(rows[b][0] for b in seen)
        out.append((rows[a][0], len(links[a]), least, rows[a][0] == least))
    return sorted(out)


@pytest.mark.parametrize("block,leaf", [(4, 2), (16, 5), (1024, 128)])
def test_against_all_pairs(frame, block, leaf):
    r = np.random.default_rng(1)
    base = r.normal(size=(12, 6))
    rows = [(i, (base[i % 12] + r.normal(size=6) * 0.25).tolist()) for i in range(90)]
    rows += [(100, None), (101, []), (102, [0.0] * 6), (103, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (104, [float("nan")] + [1.0] * 5), (105, [float("inf")] + [1.0] * 5), (106, [1.0, 2.0]), (107, [2.0, 4.0]), (108, [1e-30] * 6), (109, [1.0] * 6), (110, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (111, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [rows[7]]
    got = e.embedding_components(frame([(k, x, "c") for k, x in rows], SCHEMA), block=block, leaf=leaf).collect()
    assert sorted(tuple(x) for x in got) == plain(rows)


def test_no_rows(frame):
    assert e.embedding_components(frame([], SCHEMA)).count() == 0
    assert [tuple(x) for x in e.embedding_components(frame([(1, None, "")], SCHEMA)).collect()] == [(1, 0, 1, True)]


def test_intervals_that_are_skipped_hold_no_link():
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 8))
    x, y = (base[r.integers(0, 40, n)] + r.normal(size=(n, 8)) * 0.2 for n in (300, 170))
    x, y = (np.array(sorted((v / np.linalg.norm(v, axis=1, keepdims=True)).tolist())) for v in (x, y))
    axes = np.linalg.qr(r.normal(size=(8, 8)))[0]
    for leaf in (3, 32, 400):
        boxes = [e._boxes(e._places(v, axes, 3), leaf) for v in (x, y)]
        rows, cols = e._close(x, boxes[0], y, boxes[1], 0.9, leaf)
        want = np.argwhere(x @ y.T >= 0.9)
        assert sorted(zip(rows.tolist(), cols.tolist(), strict=True)) == sorted(map(tuple, want.tolist())) and len(want)
