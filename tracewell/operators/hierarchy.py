"""Trees and graphs: closures, depths, cycles, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.plans.lineage import drop_written, written


def _parents(tree: DataFrame, key: str, parent: str) -> DataFrame:
    return tree.select(F.col(key).alias("k_"), F.col(parent).alias("p_")).where("k_ is not null").distinct()


def closure(tree: DataFrame, key: str, parent: str) -> DataFrame:
    """root, node, depth: every node with each of its ancestors, itself at depth 0.

    Rounds double the distance climbed, so a tree of any depth takes as many rounds as
    its depth has binary digits; each is written, so plans stay short.  Rows that reach
    a cycle climb it once: every pair is given with its least depth, and the rounds end
    when none is new.
    """
    edges = written(_parents(tree, key, parent), "closure-edges")
    jump = edges.where("p_ is not null")
    pairs = written(edges.select(F.col("k_").alias("root"), F.col("k_").alias("node"), F.lit(0).alias("depth")).distinct(), "closure")
    count, step, old = pairs.count(), 1, []
    while True:
        far = pairs.join(jump, F.col("root") == F.col("k_")).select(F.col("p_").alias("root"), "node", (F.col("depth") + step).alias("depth"))
        more = written(pairs.unionByName(far).groupBy("root", "node").agg(F.min("depth").alias("depth")), "closure")
        drop_written(pairs)
        pairs, before, count = more, count, more.count()
        if count == before:
            for table in (edges, *old):
                drop_written(table)
            return pairs
        on = jump.select(F.col("k_").alias("m_"), F.col("p_").alias("q_"))
        jump = written(jump.join(on, F.col("p_") == F.col("m_")).select("k_", F.col("q_").alias("p_")).distinct(), "closure-jumps")
        old.append(jump)
        step *= 2


def below(tree: DataFrame, key: str, parent: str, roots: DataFrame) -> DataFrame:
    """root, node, depth: the nodes at and below each of ``roots`` (root), walked down from them level by level, a node once."""
    edges = _parents(tree, key, parent).where("p_ is not null")
    own = _parents(tree, key, parent).select(F.col("k_").alias("n_")).distinct()
    level = written(roots.select("root").distinct().join(own, F.col("root") == F.col("n_"), "left_semi").select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "below")
    found, depth = [level], 0
    while not level.isEmpty():
        depth += 1
        down = level.join(edges, F.col("node") == F.col("p_")).select("root", F.col("k_").alias("node"), F.lit(depth).alias("depth")).distinct()
        for seen in found:
            # A node stands below a root in one place unless there is a cycle, which comes back to what is known.
            down = down.join(seen.select(F.col("root").alias("r_"), F.col("node").alias("s_")), (F.col("root") == F.col("r_")) & (F.col("node") == F.col("s_")), "left_anti")
        level = written(down, "below")
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def cyclic(tree: DataFrame, key: str, parent: str) -> DataFrame:
    """node: every node that reaches itself by its parents.

    Whoever climbs as many steps as there are nodes has left the tree or stands on a
    cycle, and every node of a cycle is where some other one of it ends up.  Rounds
    double the steps; a node of several parents follows each.  Where one can end up
    gets fewer with every step and stays once a step takes none away, so the rounds
    end when doubling the steps leaves as many; a forest of shallow trees takes few.
    Tables of all nodes are merged, never gathered at the driver to be broadcast.
    """
    jump = written(_parents(tree, key, parent).where("p_ is not null"), "cycle")
    left = jump.select("p_").distinct().count()
    while left:
        on = jump.select(F.col("k_").alias("m_"), F.col("p_").alias("q_")).hint("merge")
        further = written(jump.join(on, F.col("p_") == F.col("m_")).select("k_", F.col("q_").alias("p_")).distinct(), "cycle")
        drop_written(jump)
        jump, before, left = further, left, further.select("p_").distinct().count()
        if left == before:
            break
    return jump.select(F.col("p_").alias("node")).distinct()


def ordered_subtree(tree: DataFrame, key: str, parent: str, nodes: DataFrame, owner: str) -> DataFrame:
    """root and every row of ``nodes`` owned by the root or a division below it."""
    under = closure(tree, key, parent).select("root", F.col("node").alias("n_"), "depth")
    return under.join(nodes, F.col("n_") == F.col(owner)).drop("n_")


def paths(tree: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """node, path: the names from the top joined by slashes."""
    up = closure(tree, key, parent).join(tree.select(F.col(key).alias("k_"), F.col(name).alias("name_")), F.col("root") == F.col("k_"))
    steps = F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), F.col("name_").alias("n"))))
    return up.groupBy("node").agg(F.array_join(F.transform(steps, lambda s: s["n"]), "/").alias("path"))
