"""Closures, reachability, cycles and chains over edge tables, as fixpoint loops over DataFrames.

Each loop joins only the newest rows (the frontier), drops what is known by an anti join, and
writes its state to the session's checkpoint folder every round, so plans stay short
and a lost executor costs one round.  `most_rounds` guards against surprises and raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written


def _grown(seen: DataFrame, front: DataFrame, round_no: int) -> DataFrame:
    """seen and front; written as one table every eighth round, so the plan stays short."""
    out = seen.unionByName(front)
    return written(out, "seen") if round_no % 8 == 0 else out


def composition_closure(edges: DataFrame, roots: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """edges(src, dst, required), roots(root): (root, node, membership) of all nodes reached.

    A path of required edges makes a node required; any optional edge on the way makes it
    optional; a node reached both ways is required.
    """
    edges = written(edges.select("src", "dst", "required").distinct(), "edges")
    start = roots.select("root", F.col("root").alias("node"), F.lit(True).alias("required"))
    seen = front = written(start, "closure")
    for round_no in range(1, most_rounds):
        step = front.join(edges.withColumnRenamed("required", "by"), F.col("node") == F.col("src"))
        step = step.select("root", F.col("dst").alias("node"), (F.col("required") & F.col("by")).alias("required")).distinct()
        # a required visit covers an optional one of the same node
        known = seen.groupBy("root", "node").agg(F.max("required").alias("best"))
        new = step.groupBy("root", "node").agg(F.max("required").alias("required")).join(known, ["root", "node"], "left")
        front = written(new.where(F.col("best").isNull() | (F.col("required") & ~F.col("best"))).select("root", "node", "required"), "closure")
        if front.isEmpty():
            break
        seen = _grown(seen, front, round_no)
    else:
        raise RuntimeError("closure did not settle")
    out = seen.groupBy("root", "node").agg(F.max("required").alias("required"))
    return out.where("node <> root").select("root", "node", F.when(F.col("required"), "required").otherwise("optional").alias("membership"))


def impact_closure(edges: DataFrame, focus: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """The same, against the direction of the edges: what depends on each focus."""
    return composition_closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "required"), focus, most_rounds)


def reachability(edges: DataFrame, sources: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(source, node, depth): least number of edges from each source(source), itself at 0."""
    edges = written(edges.select("src", "dst").distinct(), "edges")
    seen = front = written(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("depth")).distinct(), "reach")
    for d in range(1, most_rounds):
        step = front.join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        front = written(step.join(seen, ["source", "node"], "left_anti").withColumn("depth", F.lit(d)), "reach")
        if front.isEmpty():
            return seen
        seen = _grown(seen, front, d)
    raise RuntimeError("reachability did not settle")


def _trimmed(core: DataFrame) -> DataFrame:
    """Without nodes that have no edge in or none out, again and again."""
    n = core.count()
    while n:
        outs, ins = core.select(F.col("src").alias("dst")).distinct(), core.select(F.col("dst").alias("src")).distinct()
        core = written(core.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"), "cycle")
        before, n = n, core.count()
        if n == before:
            break
    return core


def _coloured(core: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches each node, itself included."""
    colour = written(core.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("colour")), "colours")
    while True:
        come = core.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("come"))
        new = colour.join(come, "node", "left").select("node", F.least("colour", "come").alias("colour"), (F.col("come") < F.col("colour")).alias("fell"))
        new = written(new, "colours")
        colour = new.drop("fell")
        if new.where("fell").isEmpty():
            return colour


def cycle_members(edges: DataFrame) -> DataFrame:
    """(node, component): nodes on a cycle (a loop counts) and the smallest node of their strongly connected component.

    Forward and backward colouring: every node takes the smallest node that reaches it as its colour; the
    nodes that reach their colour's own node within the colour are its component.  They are cut out, nodes without edges
    in or out are trimmed away, and what is left is coloured again.  A round passes one value along each edge, so no pairs of nodes are listed.
    """
    core = written(edges.select("src", "dst").distinct(), "cycle")
    loops = core.where("src = dst").select(F.col("src").alias("node"))
    out = core.where("false").select(F.col("src").alias("node"), F.col("dst").alias("component"))
    core = _trimmed(core)
    while not core.isEmpty():
        colour = _coloured(core)
        inside = core.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        inside = written(inside.where("a = b").select("src", "dst", "a"), "inside")
        found = front = written(colour.where("node = colour"), "component")
        round_no = 0
        while not front.isEmpty():
            round_no += 1
            step = front.join(inside, (F.col("node") == F.col("dst")) & (F.col("colour") == F.col("a"))).select(F.col("src").alias("node"), "colour").distinct()
            front = written(step.join(found, "node", "left_anti"), "component")
            found = _grown(found, front, round_no)
        found = written(found, "component")
        several = found.groupBy("colour").agg(F.count("*").alias("n"))
        named = found.join(several, "colour").join(loops.withColumn("loop", F.lit(True)), "node", "left").where("n > 1 or loop")
        out = out.unionByName(named.select("node", F.col("colour").alias("component")))
        gone = found.select("node")
        core = written(core.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "cycle")
        core = _trimmed(core)
    return out


def structural_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, shape): root (no edge in), standalone (none at all) or inner."""
    ins = edges.select(F.col("dst").alias("node")).distinct().withColumn("i", F.lit(True))
    outs = edges.select(F.col("src").alias("node")).distinct().withColumn("o", F.lit(True))
    out = nodes.join(ins, "node", "left").join(outs, "node", "left")
    shape = F.when(F.col("i").isNotNull(), "inner").when(F.col("o").isNotNull(), "root").otherwise("standalone")
    return out.select("node", shape.alias("shape"))


def focus_edges(edges: DataFrame, focus) -> DataFrame:
    """Edges that touch one node."""
    return edges.where((F.col("src") == focus) | (F.col("dst") == focus))
