"""Sequence graphs and directed graphs: flattening, neighbourhoods, topological levels, pedigrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import cut


def flatten_graphs(graphs: DataFrame) -> DataFrame:
    """(graph, src, dst) of (graph, seq, edges), and a fall-through from each character to itself as its own origin."""
    jumps = graphs.select("graph", F.explode("edges").alias("e")).select("graph", "e.src", "e.dst")
    places = graphs.filter(F.length("seq") > 0).select("graph", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("i"))
    own = places.select("graph", F.col("i").cast("long").alias("src"), F.col("i").cast("long").alias("dst"))
    return jumps.unionByName(own).distinct()


def invert(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "dst", "dst": "src"}).select(*edges.columns)


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node) within ``hops`` edges of the seeds (node), in either direction; a round joins only what the last one found."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()
    seen = seeds.select("node").distinct()
    front = seen
    for _ in range(hops):
        new = both.join(front, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct()
        front = cut(new.join(seen, "node", "left_anti"))
        seen = seen.unionByName(front)
    return seen


def _check_round(done: int, most: int | None) -> None:
    if most is not None and done >= most:
        raise RuntimeError(f"not finished after {most} rounds")


def topological_levels(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, level, cyclic): the longest path to a node from a node without edges into it. Nodes on or
    behind a cycle get no level; ``cyclic`` says that a node is on a cycle or leads from one to another.

    A round takes off all nodes that no remaining edge leads to; then, from the other end, all that lead nowhere.
    More rounds than ``max_rounds`` are an error.
    """
    edges = edges.select("src", "dst").filter("src <> dst").distinct()
    left = cut(nodes.select("node").distinct())
    live = edges
    done, level = None, 0
    while True:
        free = cut(left.join(live.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            break
        _check_round(level, max_rounds)
        found = free.withColumn("level", F.lit(level))
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(free, "node", "left_anti"))
        live = cut(live.join(free, F.col("src") == F.col("node"), "left_anti"))
        level += 1
        if level % 16 == 0:  # a short plan
            done = cut(done)
    core = live
    while not left.isEmpty():  # trim what only follows the cycles
        out = core.select(F.col("src").alias("node")).distinct()
        inside = cut(left.join(out, "node", "left_semi"))
        smaller = cut(core.join(inside, F.col("dst") == F.col("node"), "left_semi"))
        if smaller.count() == core.count():
            break
        core = smaller
    cyclic = core.select(F.col("src").alias("node")).distinct().withColumn("cyclic", F.lit(True))
    rest = left.join(cyclic, "node", "left").select("node", F.lit(None).cast("int").alias("level"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    if done is None:
        return rest
    return done.select("node", "level", F.lit(False).alias("cyclic")).unionByName(rest)


def strong_components(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, component): strongly connected components, named by their smallest node.

    Forward colouring: every node takes the largest colour (node) that reaches it; the nodes of a colour that reach
    its root backwards within the colour are a component and leave; the rest begins anew. More rounds than ``max_rounds`` are an error.
    """
    live = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    left = cut(nodes.select("node").distinct())
    done = None
    rounds = 0
    while not left.isEmpty():
        _check_round(rounds, max_rounds)
        rounds += 1
        colour = left.withColumn("c", F.col("node"))
        while True:
            pushed = live.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("c").alias("m"))
            new = cut(colour.join(pushed, F.col("node") == F.col("dst"), "left").select("node", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("moved")))
            if new.filter("moved").isEmpty():
                break
            colour = new.drop("moved")
        a, b = colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), colour.select(F.col("node").alias("dst"), F.col("c").alias("cd"))
        inner = cut(live.join(a, "src").join(b, "dst").filter("cs = cd").select("src", "dst"))
        reach = cut(colour.filter("node = c"))
        front = reach
        while not front.isEmpty():
            front = cut(inner.join(front, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "c").distinct().join(reach, "node", "left_anti"))
            reach = reach.unionByName(front)
        done = reach if done is None else done.unionByName(reach)
        if rounds % 16 == 0:  # a short plan
            done = cut(done)
        left = cut(left.join(reach, "node", "left_anti"))
        live = cut(live.join(reach.select(F.col("node").alias("src")), "src", "left_anti").join(reach.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if done is None:
        return nodes.select("node", F.col("node").alias("component"))
    least = done.groupBy("c").agg(F.min("node").alias("component"))
    return done.join(least, "c").select("node", "component")


def parents(people: DataFrame, pedigree: DataFrame) -> DataFrame:
    """(person, parent) for (person), of (child, parent)."""
    return people.join(pedigree.distinct(), F.col("person") == F.col("child")).select("person", "parent")


def children(people: DataFrame, pedigree: DataFrame) -> DataFrame:
    """(person, child) for (person)."""
    return people.join(pedigree.distinct(), F.col("person") == F.col("parent")).select("person", "child")


def explode_profiles(profiles: DataFrame) -> DataFrame:
    """(profile_id, locus, allele_idx, allele) of (profile_id, locus, alleles)."""
    return profiles.select("profile_id", "locus", F.posexplode("alleles").alias("allele_idx", "allele"))
