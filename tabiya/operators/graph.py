"""Graphs of two tables: level-by-level reachability, path export, edge coverage, and lines drawn by weight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabiya.session import bounded_broadcast, cut, stored

#: Walkers at a node that one task ranks; those of a node with more are dealt out.
RANKED = 1 << 16


def reachable(edges: DataFrame, roots: DataFrame, most_depth: int | None = None) -> DataFrame:
    """node, depth, parent (null at roots) of all nodes that edges (src, dst) reach from roots (node).

    Depths are shortest, and a node's parent is its smallest predecessor of the level before. Each level joins the frontier with
    the edges and drops known nodes; levels are written to the shared folder, so lineage stays short.
    """
    kind = roots.schema["node"].dataType
    edges = stored(edges.select("src", "dst"))  # every level reads it
    frontier = cut(roots.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent")))
    known, depth = frontier, 0
    while most_depth is None or depth < most_depth:
        step = frontier.select(F.col("node").alias("src")).join(edges, "src")
        step = step.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = cut(step.join(known, "node", "left_anti").select("node", F.lit(depth + 1).alias("depth"), "parent"))
        if not frontier.limit(1).count():
            break
        known, depth = known.unionByName(frontier), depth + 1
    return known


def paths(edges: DataFrame, roots: DataFrame, most_depth: int) -> DataFrame:
    """node, depth, parent and path (an array from the root) of reachable nodes: the path is carried, so nothing recurses."""
    kind = roots.schema["node"].dataType
    edges = stored(edges.select("src", "dst"))  # every level reads it
    frontier = cut(roots.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"), F.array("node").alias("path")))
    known = frontier
    for depth in range(1, most_depth + 1):
        step = frontier.select(F.col("node").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        step = step.join(known, "node", "left_anti").join(frontier.select(F.col("node").alias("parent"), "path"), "parent")  # only new nodes meet the paths
        frontier = cut(step.select("node", F.lit(depth).alias("depth"), "parent", F.concat("path", F.array("node")).alias("path")))
        if not frontier.limit(1).count():
            break
        known = known.unionByName(frontier)
    return known


def reached_edges(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """src, dst, ends: the distinct edges between reached nodes, and whether one isn't a tree edge or leads into a node without edges: there a line ends."""
    inner = tree.select(F.col("node").alias("src"))
    out = edges.select(F.col("src").alias("dst")).distinct().withColumn("_inner", F.lit(True))
    parent = tree.select(F.col("node").alias("dst"), F.col("parent").alias("_parent")).join(out, "dst", "left")
    found = edges.select("src", "dst").distinct().join(inner, "src").join(parent, "dst")
    on_tree = F.coalesce(F.col("_parent") == F.col("src"), F.lit(False))
    return found.select("src", "dst", (~on_tree | F.col("_inner").isNull()).alias("ends"))


def covering_lines(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """src, dst, line: each edge that isn't a tree edge, and each tree edge into a node without edges, after the path to its start.

    Together the lines cover every edge between reached nodes, since inner tree edges lie on longer lines.
    """
    path = tree.select(F.col("node").alias("src"), F.col("path").alias("_path"))
    return reached_edges(edges, tree).filter("ends").join(path, "src").select("src", "dst", F.concat("_path", F.array("dst")).alias("line"))


def ranked_out(edges: DataFrame, *others: str) -> DataFrame:
    """edges (src, dst, label, weight, others) with rank among those of src (heaviest first, then by label) and degree, their number."""
    of = W.partitionBy("src")
    return edges.select("src", "dst", "label", "weight", *others).withColumn("rank", F.row_number().over(of.orderBy(F.desc("weight"), "label"))).withColumn("degree", F.count("*").over(of))


def layered_steps(edges: DataFrame, tree: DataFrame, most_depth: int) -> DataFrame:
    """walker, level, src, label, dst, born (whether it is the walker's first): the steps of walkers that together take every edge (src, dst, label, weight) of a node above most_depth.

    tree: node, depth (shortest). Walkers go level by level, all at once. Those that come to a node on the level of its depth take one of
    its edges each, heaviest first; if they are fewer than its edges, new walkers, which came by the node's path, take the rest. Walkers that are
    too many, or come to a node later, take its heaviest edge. So each edge is taken on the level of its source, and walkers go on to a node
    without edges or to most_depth. The labels of src are distinct. A walker meets one edge on each level, never all that a node has; where more than
    RANKED come to a node, several tasks rank them.
    """
    ranked = ranked_out(edges.join(tree.select(F.col("node").alias("src"), F.col("depth").alias("level")), "src"), "level")
    out = cut(ranked.withColumn("id", F.monotonically_increasing_id()))  # a new walker is known by its first edge
    heaviest = cut(out.filter("rank = 1").select(F.col("src").alias("node"), F.col("level").alias("of"), F.col("label").alias("label1"), F.col("dst").alias("dst1")))
    steps, walkers = None, None
    for level in range(most_depth):
        fresh = out.filter(F.col("level") == level).select("src", "rank", "label", "dst", "id")
        if walkers is None:
            step = fresh.select(F.col("id").alias("walker"), "src", "label", "dst", F.lit(True).alias("born"))
        else:
            # Places are those of edges at a node on its level; elsewhere they are below 0, so that they meet no edge.
            placed = _placed(walkers, heaviest).withColumn("place", F.when(F.col("of") == level, F.col("place")).otherwise(-F.col("place")))
            met = fresh.join(placed, (F.col("src") == F.col("node")) & (F.col("rank") == F.col("place")), "full")
            step = met.select(*(F.coalesce(*x).alias(x[-1]) for x in (("walker", "id"), ("node", "src"), ("label", "label1"), ("dst", "dst1"))), F.col("walker").isNull().alias("born"))
            step = step.toDF("walker", "src", "label", "dst", "born")
        step = cut(step.select("walker", F.lit(level).alias("level"), "src", "label", "dst", "born"))
        steps = step if steps is None else steps.unionByName(step)
        walkers = step.select("walker", F.col("dst").alias("node"))
        if not step.limit(1).count():
            break
    return out.select(F.col("id").alias("walker"), F.lit(0).alias("level"), "src", "label", "dst", F.lit(True).alias("born")).limit(0) if steps is None else steps


def _placed(walkers: DataFrame, heaviest: DataFrame) -> DataFrame:
    """walkers (walker, node) at nodes of `heaviest`, with its columns and place, from 1 among those at the node."""
    came = cut(walkers.groupBy("node").agg(F.count("*").alias("came")).join(heaviest, "node"))
    here = lambda most: walkers.join(most, "node").select("walker", *heaviest.columns, "came")
    few = here(came.filter(F.col("came") <= RANKED)).withColumn("place", F.row_number().over(W.partitionBy("node").orderBy("walker"))).drop("came")
    crowded = came.filter(F.col("came") > RANKED)
    if not crowded.limit(1).count():
        return few
    dealt = cut(here(F.broadcast(crowded)).withColumn("part", F.pmod(F.xxhash64("walker"), F.ceil(F.col("came") / RANKED))))  # one row for each RANKED walkers at most
    before = F.sum("n").over(W.partitionBy("node").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = cut(dealt.groupBy("node", "part").agg(F.count("*").alias("n")).select("node", "part", F.coalesce(before, F.lit(0)).cast("int").alias("before")))
    within = F.row_number().over(W.partitionBy("node", "part").orderBy("walker"))
    many = dealt.withColumn("within", within).join(bounded_broadcast(parts), ["node", "part"])
    return few.unionByName(many.select("walker", *heaviest.columns, (F.col("within") + F.col("before")).alias("place")))


def layered_cover(edges: DataFrame, tree: DataFrame, most_depth: int) -> DataFrame:
    """line: arrays of labels from the root, the ways of the walkers of layered_steps(); tree also has path (labels to the node), on which a walker came to its first edge."""
    steps = layered_steps(edges, tree, most_depth)
    ways = steps.groupBy("walker").agg(F.sort_array(F.collect_list(F.struct("level", "label"))).alias("tail"), F.min_by("src", "level").alias("src"))
    return ways.join(tree.select(F.col("node").alias("src"), "path"), "src").select(F.concat("path", F.col("tail.label")).alias("line"))


def sampled_lines(edges: DataFrame, root, n: int, most_depth: int, seed: int = 1, forced: bool = True) -> DataFrame:
    """walker, line (labels), last (the edge row's `payload` where it ended): n lines from root, each next edge drawn by weight (at least 1).

    edges: src, dst, label, weight, payload. All walkers advance by one edge at a time; each draws by a hash of seed, walker and level, so reruns agree and
    no draw depends on others. With `forced`, the first walkers take the root's edges one after the other, heaviest first, before any is drawn.
    """
    spark = edges.sparkSession
    weight = F.greatest(F.col("weight"), F.lit(1)).cast("double")
    upto = F.sum("w").over(W.partitionBy("src").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    ranked = ranked_out(edges).drop("weight").join(edges.select("src", "label", weight.alias("w"), "payload"), ["src", "label"]).withColumn("upto", upto)
    choices = cut(ranked.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "upto", "label", "dst", "payload"))).alias("choices")))  # one position's moves
    kind = edges.schema["src"].dataType
    walkers = spark.range(n).select(F.col("id").alias("walker"), F.lit(root).cast(kind).alias("node"))
    steps = []
    for level in range(most_depth):
        at = walkers.join(choices, F.col("node") == F.col("src"))
        total = F.element_at("choices", -1)["upto"]
        u = (F.pmod(F.xxhash64(F.lit(seed), "walker", F.lit(level)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        drawn = F.get(F.filter("choices", lambda x: x["upto"] > F.col("u") * F.col("total")), F.lit(0))
        at = at.select("walker", "choices", total.alias("total"), u.alias("u"))
        one = F.coalesce(drawn, F.element_at("choices", -1))
        if forced and level == 0:
            one = F.when(F.col("walker") < F.size("choices"), F.get("choices", F.col("walker").cast("int"))).otherwise(one)
        step = cut(at.select("walker", F.lit(level).alias("level"), one.alias("x")).select("walker", "level", "x.label", "x.payload", F.col("x.dst").alias("node")))
        steps.append(step)
        walkers = step.select("walker", "node")
        if not step.limit(1).count():
            break
    found = reduce(DataFrame.unionByName, steps)
    ended = found.groupBy("walker").agg(F.sort_array(F.collect_list(F.struct("level", "label"))).alias("s"), F.max_by("payload", "level").alias("last"))
    return ended.select("walker", F.col("s.label").alias("line"), "last")


def uncovered_edges(edges: DataFrame, lines: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst) that no line passes. steps (src, dst): those of lines that begin with the ones given, each once or more."""
    pairs = F.expr("transform(sequence(0, size(line) - 2), i -> struct(line[i] as src, line[i + 1] as dst))")
    passed = lines.filter(F.size("line") > 1).select(F.inline(pairs)).distinct()
    if steps is not None:
        passed = passed.unionByName(steps.select("src", "dst"))
    return edges.select("src", "dst").distinct().join(passed, ["src", "dst"], "left_anti")
