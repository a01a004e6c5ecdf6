"""Relational operators on edge rows, against plain loops."""

import collections
import random

from pyspark.sql import functions as F

from strandloom.operators import graphs, intervals, optimise, order, pairs, reference, regions, suffix, trees


def test_overlaps(spark):
    r = random.Random(2)
    probes = [(i, r.choice("ab"), lo, lo + r.choice([0, 1, 40, 5000])) for i, lo in enumerate(r.randint(0, 60_000) for _ in range(200))]
    spots = [(r.choice("abc"), s, s + r.choice([0, 1, 30, 3000, 50_000])) for s in (r.randint(0, 60_000) for _ in range(200))]
    spots += [("a", probes[0][3], probes[0][3] + 5), ("a", 10, 20), ("a", 12, 15)]  # at the edge; nested
    p = spark.createDataFrame(probes, "k int, chrom string, lo long, hi long")
    s = spark.createDataFrame(spots, "chrom string, start long, end long")
    got = collections.Counter((x["k"], x["start"], x["end"]) for x in intervals.overlap_join(p, s).collect())
    want = collections.Counter((k, a, b) for k, c, lo, hi in probes for d, a, b in spots if c == d and (a < hi or (a == hi and b <= hi)) and b > lo)
    assert got == want
    assert intervals.overlap_join(p, s.limit(0)).count() == 0
    left = intervals.overlap_join(p, s, how="left").select("k").distinct().count()
    assert left == 200


def test_windows(spark):
    rows = [(10, 20, 2, 3, 100), (0, 99, 0, 0, 100), (-1, -1, 0, 0, 100)]
    df = spark.createDataFrame(rows, "low long, high long, c0 long, c1 long, n long")
    lo, hi = intervals.footprint_window(*[F.col(c) for c in ("low", "high", "c0", "c1", "n")], 5, 1)
    assert [tuple(x) for x in df.select(lo, hi).collect()] == [(3, 29), (0, 100), (0, 5)]
    df = spark.createDataFrame([(3, 29, 10, 20, 1, 90, 50), (3, 29, 10, 20, None, None, 50)], "lo long, hi long, low long, high long, s long, e long, n long")
    lo, hi = intervals.grow_window(*[F.col(c) for c in ("lo", "hi", "low", "high", "s", "e", "n")], 8)
    assert [tuple(x) for x in df.select(lo, hi).collect()] == [(2, 29), (3, 29)]
    lo, hi = intervals.grow_window(*[F.col(c) for c in ("lo", "hi", "low", "high", "s", "e", "n")], -1)
    assert [tuple(x) for x in df.select(lo, hi).collect()] == [(1, 50), (3, 29)]


def test_pairs(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "a"), (5, "c"), (6, "c"), (7, "c"), (8, "c")]
    got = pairs.pair_rows(spark.createDataFrame(rows, "ord long, qname string")).collect()
    assert sorted((x["first"], x["second"]) for x in got) == [(1, 3), (5, 6), (7, 8)]
    df = spark.createDataFrame([(o, q, q != "b") for o, q in rows], "ord long, qname string, needs_pair boolean")
    got = pairs.with_mates(df, F.col("ord")).collect()
    assert {x["ord"]: x["mate"] for x in got} == {1: 3, 2: None, 3: 1, 4: None, 5: 6, 6: 5, 7: 8, 8: 7}


def test_numbers_and_bounds(spark):
    r = random.Random(0)
    rows = [(i, r.randint(0, 9), r.choice("ab")) for i in range(100)]
    df = spark.createDataFrame(rows, "i int, v int, g string").repartition(5)
    got = {x["i"]: x["row_no"] for x in order.number_rows(df, ["v", "i"]).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted((v, i) for i, v, _ in rows))}
    got = {x["i"]: x["row_no"] for x in order.number_rows(df, ["i"], within="g").collect()}
    assert all(sorted(got[i] for i, _, g in rows if g == k) == list(range(sum(g == k for _, _, g in rows))) for k in "ab")
    probes = spark.createDataFrame([(-1,), (0,), (5,), (99,)], "v int")
    got = {x["v"]: (x["lower"], x["upper"]) for x in order.bound_counts(df, probes, "v", "v").collect()}
    assert got == {p: (sum(v < p for _, v, _ in rows), sum(v <= p for _, v, _ in rows)) for p in (-1, 0, 5, 99)}


def test_caps(spark):
    df = spark.createDataFrame([(1, 5, 0), (1, 9, 1), (1, 5, 2), (1, 9, 3), (2, 1, 0)], "k int, s int, it int")
    assert sorted(tuple(x) for x in order.cap_alternatives(df, ["k"], "s", "it", 3).collect()) == [(1, 5, 0), (1, 9, 1), (1, 9, 3), (2, 1, 0)]
    assert order.cap_alternatives(df, ["k"], "s", "it", 0).count() == 5
    assert order.top_scores(df, ["k"], "s", 1).count() == 3


def test_costs_of_places(spark):
    spots = spark.createDataFrame([(1, "a", 5, 5), (2, "a", 20, 5), (3, "b", 5, 5)], "k int, chrom string, x long, y long")
    boxes = spark.createDataFrame([("a", 0, None, None, None, None, 0, 10), ("a", 1, 0, 10, None, None, 0, 11), ("a", 2, 0, 10, 0, 9, 1, 12), ("a", 3, 5, 6, None, None, 0, 13)], "chrom string, idx int, start_a long, end_a long, start_b long, end_b long, priority int, cost int")
    assert sorted(tuple(x) for x in regions.cost_at(spots, boxes, "k").collect()) == [(1, 12), (2, 10), (3, None)]
    w = spark.createDataFrame([("a", 4, 8)], "chrom string, lo long, hi long")
    got = sorted((x["idx"], x["start_a"], x["end_a"]) for x in regions.rebase_regions(w, boxes).collect())
    assert got == [(0, None, None), (1, 0, 4), (2, 0, 4), (3, 1, 2)]


def test_places_like_the_slow_way(spark):
    r = random.Random(11)
    bound = lambda: r.choice([None, r.randint(-9000, 9000), r.randint(-20, 20), r.randint(-(1 << 40), 1 << 40)])
    boxes = [(r.choice("ab"), i, bound(), bound(), r.choice([None, 0, 3]), r.choice([None, 3, 6]), r.randint(0, 2), i * 10) for i in range(60)]
    spots = [(i, r.choice("abc"), r.choice([r.randint(-9000, 9000), r.randint(-20, 20)]), r.randint(-1, 6)) for i in range(120)]
    lie = lambda lo, hi, v: (lo is None or lo <= v) and (hi is None or v < hi)
    held = {k: [b for b in boxes if b[0] == c and lie(b[2], b[3], x) and lie(b[4], b[5], y)] for k, c, x, y in spots}
    want = {k: max(v, key=lambda b: (b[6], b[1]))[7] if v else None for k, v in held.items()}
    df = spark.createDataFrame(boxes, "chrom string, idx int, start_a long, end_a long, start_b long, end_b long, priority int, cost int")
    got = regions.cost_at(spark.createDataFrame(spots, "k int, chrom string, x long, y long"), df, "k").collect()
    assert {x["k"]: x["cost"] for x in got} == want and len(got) == len(spots)
    windows = [(i, c, x, x + r.randint(1, 9000)) for i, c, x, _ in spots]
    got = regions.rebase_regions(spark.createDataFrame(windows, "k int, chrom string, lo long, hi long"), df).collect()
    touch = [(k, b[1], None if b[2] is None else max(b[2] - lo, 0), None if b[3] is None else min(b[3] - lo, hi - lo)) for k, c, lo, hi in windows for b in boxes if b[0] == c and (b[2] is None or b[2] < hi) and (b[3] is None or b[3] > lo)]
    assert sorted(map(str, touch)) == sorted(str((x["k"], x["idx"], x["start_a"], x["end_a"])) for x in got)


def test_pair_rules_like_the_slow_way(spark):
    r = random.Random(12)
    rules = [(i, *[r.choice([None, r.randint(33, 60)]) for _ in range(4)]) for i in range(8)]
    points = [(i, r.randint(33, 60), r.randint(33, 60)) for i in range(200)] + [(300, None, 40), (301, 40, None)]
    lie = lambda lo, hi, v: (lo is None or (v is not None and lo <= v)) and (hi is None or (v is not None and v <= hi))
    held = {k: [x for x in rules if lie(x[1], x[2], a) and lie(x[3], x[4], b)] for k, a, b in points}
    want = {k: max(v, key=lambda x: (sum(y is not None for y in x[1:]), -x[0]))[0] if v else None for k, v in held.items()}
    got = regions.quality_pair_rules(spark.createDataFrame(points, "k int, qa int, qb int"), spark.createDataFrame(rules, "rule int, a_lo int, a_hi int, b_lo int, b_hi int"), "k").collect()
    assert {x["k"]: x["rule"] for x in got} == want and len(got) == len(points)


def test_regions_of_one_chromosome_are_dealt_out(spark):
    reads = spark.createDataFrame([(i, 0, "((" + chr(41 + i % 2) * 3) for i in range(40)], "id int, chrom long, qual string")
    boxes = [(0, i, i, i + 9, *((None, None) if i % 3 else (i % 4, 3 + i % 4))) for i in range(50)]
    mangles = spark.createDataFrame([(0, 1, 40, 41), (0, 2, 40, 60)], "chrom long, mangle int, q_lo int, q_hi int")
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(k, "-1")
    out = regions.mangled_regions(reads, spark.createDataFrame(boxes, "chrom long, idx int, start_a int, end_a int, start_b int, end_b int"), mangles, "id").cache()
    want = []
    for i in range(40):
        for s, e, q in ((0, 2, 40), (2, 5, 41)) if i % 2 == 0 else ((0, 2, 40), (2, 5, 42)):
            for _, k, a, b, lo, hi in boxes:
                if lo is None or (lo < e and hi > s):
                    want.append((i, k, a, b, s if lo is None else max(s, lo), e if lo is None else min(e, hi), q, 1 if q < 42 else 2))
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(k)


def test_suffixes(spark):
    texts = [(1, "banana"), (2, "ana"), (3, ""), (4, "aaaaaaaa")]
    df = spark.createDataFrame(texts, "id int, text string")
    every = [(k, i, t[i:]) for k, t in texts for i in range(len(t) + 1)]
    ranks = {s: n for n, s in enumerate(sorted({s for _, _, s in every}))}
    got = {(x["id"], x["pos"]): x["rank"] for x in suffix.suffix_array(df, "id").collect()}
    assert got == {(k, i): ranks[s] for k, i, s in every}
    places = {(x["id"], x["pos"]): x["place"] for x in suffix.suffix_order(df, "id").collect()}
    assert sorted(places.values()) == list(range(len(every)))
    q = spark.createDataFrame([("a",), ("an",), ("z",), ("banana",), ("bananas",)], "q string")
    got = {x["q"]: (x["lower"], x["upper"]) for x in suffix.prefix_bounds(df, q, "id", "q").collect()}
    assert got == {t: (sum(s < t for _, _, s in every), sum(s < t or s.startswith(t) for _, _, s in every)) for t in ("a", "an", "z", "banana", "bananas")}


def test_graphs(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 1), (7, 8), (5, 5)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 10)], "node long")
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {x["node"]: (x["level"], x["cyclic"]) for x in graphs.topological_levels(nodes, e).collect()}
    assert got == {6: (0, False), 7: (0, False), 9: (0, False), 8: (1, False), 1: (None, True), 2: (None, True), 3: (None, True), 4: (None, False), 5: (None, False)}
    got = {x["node"]: x["component"] for x in graphs.strong_components(nodes, e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **{i: i for i in range(4, 10)}}
    hop = graphs.neighbourhood(e, spark.createDataFrame([(4,)], "node long"), 2)
    assert {x["node"] for x in hop.collect()} == {4, 3, 5, 2, 1}


def test_trees(spark):
    rows = [(i, float(i), float(i % 2), int(i >= 6)) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    s = trees.best_split(df, ["a", "b"], "y", [0, 1]).first()
    assert (s["dim"], s["val"], s["score"]) == (0, 5.0, 0.0)
    forest = trees.grow_forest(df, ["a", "b"], "y", trees=9, classes=2).cache()
    got = {x["id"]: x["vote"] for x in trees.forest_classes(trees.apply_forest(df, forest, ["a", "b"], "id"), "id").collect()}
    assert sum(got[i] == y for i, _, _, y in rows) >= 11
    means = trees.grow_forest(df, ["a"], "a", trees=3).cache()
    got = trees.forest_means(trees.apply_forest(df, means, ["a"], "id"), "id", 3).collect()
    assert all(abs(x["mean"] - x["id"]) < 6 for x in got)
    nodes, leaves = trees.kd_tree(df, ["a", "b"], "id")
    assert leaves.select("node").distinct().count() == 12 and nodes.count() == 11
    same = trees.kd_tree(spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, a double"), ["a"], "id")
    assert same[0].count() == 0 and {x["node"] for x in same[1].collect()} == {1}


def _plain_tree(x, y, classes):
    """(dim, val, left, right) or a leaf's value, by all splits of each node."""
    import numpy as np

    def impurity(v):
        return 0.0 if not len(v) else 1 - float((np.bincount(v, minlength=classes) ** 2).sum()) / len(v) ** 2 if classes else float(v.var())

    best, found = impurity(y) / 2 - 1e-15, None
    for d in range(x.shape[1]):
        for v in np.unique(x[:, d])[:-1]:
            low = x[:, d] <= v
            score = (impurity(y[low]) + impurity(y[~low])) / 2
            if score < best:
                best, found = score, (d, v, low)
    if not found:
        return float(np.bincount(y, minlength=classes).argmax()) if classes else float(y.mean())
    d, v, low = found
    return d, float(v), _plain_tree(x[low], y[low], classes), _plain_tree(x[~low], y[~low], classes)


def _nested(nodes, at=0):
    dim, val, left, right, value = nodes[at]
    return value if dim < 0 else (dim, val, _nested(nodes, left), _nested(nodes, right))


def test_forest_is_whole_by_both_ways(spark):
    import numpy as np

    r = np.random.default_rng(5)
    x, y = r.integers(0, 12, (120, 3)).astype(float), r.integers(0, 3, 120)
    assert _nested([(n.dim, n.val, n.left, n.right, n.value) for n in trees.grow_tree(x, y, 3)]) == _plain_tree(x, y, 3)
    # a chain deeper than 64 levels: each node parts the one lowest row from the rest
    z = np.arange(90.0)
    deep = {0: 0}
    nodes = trees.grow_tree(z[:, None], 4.0**z, 0)
    for i, n in enumerate(nodes):
        deep |= {c: deep[i] + 1 for c in (n.left, n.right) if c >= 0}
    assert sum(n.dim < 0 for n in nodes) == 90 and max(deep.values()) > 64
    df = spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id int, a double, b double, c double, y int")
    f = ["a", "b", "c"]
    small = trees.grow_forest(df, f, "y", trees=3, classes=3).cache()
    large = trees.grow_forest(df, f, "y", trees=3, classes=3, local_cells=40).cache()  # ten rows: above, by aggregations
    told = [{(k["tree"], k["node"]): (k["dim"], k["val"], (k["tree"], k["left_node"]), (k["tree"], k["right_node"]), k["value"]) for k in t.collect()} for t in (small, large)]
    assert all(_nested(told[0], (t, 0)) == _nested(told[1], (t, 0)) for t in range(3))
    leaves = [sorted(map(tuple, trees.apply_forest(df, t, f, "id", local_cells=n).collect())) for t, n in ((small, 10**6), (large, 0))]
    assert leaves[0] == leaves[1] and len(leaves[0]) == 360


def test_class_splits_are_bounded_without_loss(monkeypatch):
    import numpy as np

    r = np.random.default_rng(8)
    for m, d, values in ((700, 4, 10**6), (500, 3, 9), (300, 2, 40)):
        x, y = r.integers(0, values, (m, d)).astype(float), r.integers(0, 5, m)
        assert _nested([(n.dim, n.val, n.left, n.right, n.value) for n in trees.grow_tree(x, y, 5)]) == _plain_tree(x, y, 5)
    # a node is not summed up once for each class at every place
    summed = []
    monkeypatch.setattr(np, "cumsum", lambda v, *a, f=np.cumsum, **k: (summed.append(np.size(v)), f(v, *a, **k))[1])
    x, y = r.random((4000, 3)), r.integers(0, 5, 4000)
    levels = sum(n.dim >= 0 for n in trees.grow_tree(x, y, 5)) + 1
    assert sum(summed) < levels * x.size


def test_added_trees_are_those_of_the_leaves(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(6)
    rows = [(i, *map(float, v), int(v[0] > 3) + int(v[1] > 5), float(v[0])) for i, v in enumerate(r.integers(0, 9, (60, 2)))] + [(60, None, 4.0, 1, 2.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int, z double")
    votes = trees.grow_forest(df, ["a", "b"], "y", trees=7, classes=3).cache()
    means = trees.grow_forest(df, ["a", "b"], "z", trees=7).cache()
    plain = [trees.apply_forest(df, f, ["a", "b"], "id") for f in (votes, means)]
    added = [trees.apply_forest(df, f, ["a", "b"], "id", add=a) for f, a in ((votes, "votes"), (means, "sum"))]
    assert added[1].count() == 61 and added[0].count() <= 61 * 3  # not a row for each tree
    assert {tuple(x) for x in trees.forest_classes(plain[0], "id").collect()} == {tuple(x) for x in trees.forest_classes(added[0], "id").collect()}
    got = [{x["id"]: x["mean"] for x in trees.forest_means(x, "id", 7).collect()} for x in (plain[1], added[1])]
    assert got[0].keys() == got[1].keys() and all(abs(got[0][k] - got[1][k]) < 1e-9 for k in got[0])


def test_registered_forests_are_whole(spark, tmp_path, monkeypatch):
    from strandloom.plans import registry

    grown = []
    monkeypatch.setattr(trees, "apply_forest", lambda df, forest, *a, f=trees.apply_forest, **k: (grown.append(forest), f(df, forest, *a, **k))[1])
    rows = [(i, i % 2, [0.5] * 40 + [float(i % 2)] + [0.5] * 23) for i in range(20)]  # only component 40 tells the label
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert all(x["vote"] == x["vec_id"] % 2 for x in registry.forest_classify(spark, str(tmp_path)).collect())
    spark.createDataFrame([(i, i % 3, float(i)) for i in range(9)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    assert registry.forest_regress(spark, str(tmp_path)).count() == 9
    assert [f.select("tree").distinct().count() for f in grown] == [1024, 1024]


def test_kd_tree_and_graphs_go_to_their_end(spark):
    import pytest

    df = spark.createDataFrame([(i, 2.0**-i) for i in range(66)], "id int, a double")
    nodes, leaves = trees.kd_tree(df, ["a"], "id")
    assert leaves.count() == 66 and leaves.select("node").distinct().count() == 66
    up = {c: x["node"] for x in nodes.collect() for c in (x["left_node"], x["right_node"])}
    assert len(up) == 130

    def depth(n):
        return 1 + depth(up[n]) if n in up else 0

    assert {x["id"]: depth(x["node"]) for x in leaves.collect()} == {i: min(i + 1, 65) for i in range(66)}
    chain = spark.createDataFrame([(i + 1, i) for i in range(4)], "src int, dst int")
    dots = spark.range(5).select(F.col("id").cast("int").alias("node"))
    for f in (graphs.topological_levels, graphs.strong_components):
        assert f(dots, chain).count() == 5
        with pytest.raises(RuntimeError):
            f(dots, chain, max_rounds=1).count()


def test_category_split_and_impurity(spark):
    import numpy as np

    nodes = trees.grow_tree(np.array([[1.0], [2.0], [3.0], [2.0]]), np.array([0, 1, 0, 1]), 2, [True])
    assert nodes[0].val == 2.0 and len(nodes) == 3
    got = spark.range(1).select(trees.gini(F.array(F.lit(1.0), F.lit(3.0))), trees.gini(F.array().cast("array<double>"))).first()
    assert tuple(got) == (0.375, 0.0)


def test_minimisers():
    import numpy as np

    assert abs(optimise.golden_section(lambda x: (x - 2) ** 2, 0, 5) - 2) < 1e-6
    f = lambda x: float((x[0] - 1) ** 2 + 10 * (x[1] + 2) ** 2)
    assert np.allclose(optimise.lbfgs(f, np.zeros(2)), [1, -2], atol=1e-3)
    assert np.allclose(optimise.gradient_descent(f, np.zeros(2), 0.04, 500), [1, -2], atol=1e-3)


def test_tiles(spark):
    text = "".join(random.Random(1).choices("ACGT", k=70_000))
    seqs = spark.createDataFrame([(0, "c", "c", text, None), (1, "d", "d", "GGGGGG", None), (2, "d", "d", "ACG", None), (3, "e", "e", "AéCG" * 9_000, None), (4, "f", "f", "", None)], "ord long, name string, short_name string, seq string, qual array<double>")
    w = [("c", 0, 10), ("c", 16_380, 16_390), ("c", 69_990, 70_000), ("c", 5, 40_000), ("d", 1, 3), ("e", 20_001, 20_005), ("x", 0, 1)]
    got = reference.cut_windows(spark.createDataFrame(w, "rname string, win_lo long, win_hi long"), seqs).collect()
    assert {(x["rname"], x["win_lo"]): x["window"] for x in got} == {(c, a): {"c": text, "d": "ACG", "e": "AéCG" * 9_000}[c][a:b] for c, a, b in w[:-1]}
