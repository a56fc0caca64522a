"""Dependency graphs: waves, reachability, cycles and conflicts.

Iterations are joins of distributed edge tables. Each round's result is written to
the shared folder, so the plan stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import drop, materialise


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, wave``: from 1, each node one wave after the last of what it depends on.

    ``edges`` has ``node`` and ``needs``; an edge to an unknown node doesn't count. A
    node in a cycle, or after one, has no wave and doesn't come out. Takes a round a wave.
    """
    known = nodes.select("node").distinct()
    left = materialise(edges.select("node", "needs").distinct().join(known, "node", "left_semi").join(known.withColumnRenamed("node", "needs"), "needs", "left_semi"), "edges")
    rest, out, wave = materialise(known, "nodes"), None, 0
    while True:
        wave += 1
        ready = materialise(rest.join(left, "node", "left_anti"), "wave")
        if ready.isEmpty():
            break
        layer = ready.withColumn("wave", F.lit(wave))
        out = layer if out is None else out.unionByName(layer)
        old = rest, left
        rest = materialise(rest.join(ready, "node", "left_anti"), "nodes")
        left = materialise(left.join(ready.withColumnRenamed("node", "needs"), "needs", "left_anti"), "edges")
        drop(*old)
    return out if out is not None else known.withColumn("wave", F.lit(0)).limit(0)


def closure(edges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``node, needs``: all that each node depends on, directly or not; cycles are fine.

    For all nodes, paths double in length every round, so the rounds are the logarithm
    of the longest path; the result has a row for every pair that is connected. For
    the nodes of ``asked`` only, a round goes one step further from them.
    """
    own = edges.select("node", "needs").distinct()
    if asked is not None:
        return _reached(materialise(own, "edges"), asked.select("node").distinct())
    reach = materialise(own, "closure")
    size = reach.count()
    while True:
        step = reach.select("node", F.col("needs").alias("_via")).join(reach.select(F.col("node").alias("_via"), "needs"), "_via").select("node", "needs")
        longer = materialise(reach.unionByName(step).distinct(), "closure")
        drop(reach)
        reach, grown = longer, longer.count()
        if grown == size:
            return reach
        size = grown


def _reached(edges: DataFrame, asked: DataFrame) -> DataFrame:
    new = materialise(edges.join(asked, "node", "left_semi"), "reached")
    found = new
    while not new.isEmpty():
        step = new.select("node", F.col("needs").alias("_via")).join(edges.select(F.col("node").alias("_via"), "needs"), "_via").select("node", "needs").distinct()
        new = materialise(step.join(found, ["node", "needs"], "left_anti"), "reached")
        found = found.unionByName(new)
    return found


#: Steps along the edges between two stages that are written.
STEPS = 3


def _core(edges: DataFrame) -> DataFrame:
    """The edges left when nodes that nothing leads to, or that lead nowhere, are taken off until there are none."""
    left = materialise(edges.select("node", "needs").distinct(), "core")
    size = left.count()
    while size:
        inner = left
        for _ in range(STEPS):
            inner = inner.join(inner.select(F.col("node").alias("needs")).distinct(), "needs", "left_semi")
            inner = inner.join(inner.select(F.col("needs").alias("node")).distinct(), "node", "left_semi")
        smaller = materialise(inner.select("node", "needs"), "core")
        drop(left)
        left, now = smaller, smaller.count()
        if now == size:
            break
        size = now
    return left


def _greatest(edges: DataFrame, out: str) -> DataFrame:
    """``node, out``: the greatest node that leads to each node along the edges, or the node itself."""
    nodes = edges.select("node").unionByName(edges.select(F.col("needs").alias("node"))).distinct()
    labels = materialise(nodes.withColumn(out, F.col("node")), "labels")
    while True:
        step = labels
        for _ in range(STEPS):
            sent = edges.join(step, "node").select(F.col("needs").alias("node"), out)
            step = step.unionByName(sent).groupBy("node").agg(F.max(out).alias(out))
        after = materialise(step, "labels")
        changed = not after.join(labels, ["node", out], "left_anti").isEmpty()
        drop(labels)
        labels = after
        if not changed:
            return labels


def cycle_groups(edges: DataFrame) -> DataFrame:
    """``node, cycle``: every node that depends on itself, with the greatest node of all that depend on one another.

    What is in no cycle is mostly taken off first. Then every node takes the greatest
    node that leads to it, and the greatest it leads to. Where these are one, the node is
    in a cycle with it, or alone. Nodes of a cycle agree in both, so edges between nodes that don't
    are left out, and the rest goes on. No relation of all pairs is built.
    """
    left, found = _core(edges), None
    while not left.isEmpty():
        to = _greatest(left, "_to")
        colours = materialise(_greatest(left.select(F.col("needs").alias("node"), F.col("node").alias("needs")), "_from").join(to, "node"), "colours")
        met = colours.where("_to = _from").select("node", F.col("_to").alias("cycle"))
        real = met.groupBy("cycle").agg(F.count("*").alias("n")).where("n > 1").select("cycle").unionByName(left.where("node = needs").select(F.col("node").alias("cycle"))).distinct()
        groups = materialise(met.join(real, "cycle", "left_semi").select("node", "cycle"), "cycle")
        found = groups if found is None else found.unionByName(groups)
        rest = colours.where("_to <> _from")
        a, b = rest.select("node", F.struct("_to", "_from").alias("_a")), rest.select(F.col("node").alias("needs"), F.struct("_to", "_from").alias("_b"))
        before, left = left, _core(left.join(a, "node").join(b, "needs").where("_a = _b"))
        drop(before, to)
    if found is None:
        return edges.select("node", F.col("node").alias("cycle")).limit(0)
    return found


def in_cycles(edges: DataFrame) -> DataFrame:
    """``node`` of every node that depends on itself."""
    return cycle_groups(edges).select("node").distinct()


def conflict_counts(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """``path, node, others``: tasks of a path with the number of its other tasks that neither need them nor are needed; none with 0.

    Counted from the path's size and from what is related on it; tasks of a path are not paired.
    """
    p = materialise(paths.select("path", "node").distinct(), "paths")
    reach = closure(edges, p)
    related = reach.where("node <> needs").join(p, "node").join(p.withColumnRenamed("node", "needs"), ["path", "needs"]).select("path", "node", "needs")
    both = related.unionByName(related.select("path", F.col("needs").alias("node"), F.col("node").alias("needs"))).distinct()
    n = both.groupBy("path", "node").agg(F.count("*").alias("_related"))
    sizes = p.groupBy("path").agg(F.count("*").alias("_all"))
    others = F.col("_all") - 1 - F.coalesce("_related", F.lit(0))
    return p.join(sizes, "path").join(n, ["path", "node"], "left").select("path", "node", others.alias("others")).where("others > 0")


def conflicts(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """``a, b``: tasks that share a path without one depending on the other, as pairs; for paths of few tasks, else see ``conflict_counts``.

    ``paths`` has ``node`` and ``path``.
    """
    p = paths.select("node", "path").distinct()
    pairs = p.select(F.col("node").alias("a"), "path").join(p.select(F.col("node").alias("b"), "path"), "path").where("a < b").select("a", "b").distinct()
    reach = closure(edges, p)
    both = reach.select(F.col("node").alias("a"), F.col("needs").alias("b")).unionByName(reach.select(F.col("needs").alias("a"), F.col("node").alias("b")))
    return pairs.join(both, ["a", "b"], "left_anti")
