"""Reachability with more than a distance: the least evidence of each step, and the set of sources of each node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import utf16_key
from ..plans.scratch import written


def least_evidence(references: DataFrame, owners: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """references(src, dst, line, raw), owners(owner): (owner, node, depth, source, line, raw) of all that an owner's references reach.

    Of all references to a node, from the owner (depth 0) or from nodes that it reaches, the least counts: by depth, then the source's UTF-16 text, line and
    raw text.  A node's depth is settled when it is first reached, and with it the sources that can give its least evidence; so each
    round takes the least of the references of the newest nodes, and only new nodes go on.  The owner can be among its nodes, if something refers to it.
    """
    order = F.struct(utf16_key(F.col("src").cast("string")).alias("s"), "line", utf16_key(F.col("raw")).alias("r"), F.col("src").alias("source"), "raw")
    edges = written(references.select("src", "dst", F.struct("line", "raw").alias("at")).groupBy("src", "dst").agg(F.min(F.struct(F.col("at.line").alias("line"), utf16_key(F.col("at.raw")).alias("k"), F.col("at.raw").alias("raw"))).alias("at")).select("src", "dst", "at.line", "at.raw"), "references")
    front = written(owners.select("owner", F.col("owner").alias("node")).distinct(), "evidence")
    known = front
    found = None
    for depth in range(1, most_rounds):
        step = front.join(edges, F.col("node") == F.col("src")).groupBy("owner", "dst").agg(F.min(order).alias("e")).withColumnRenamed("dst", "node")
        seen = known if found is None else found.select("owner", "node")  # an owner can be found once, though it is known from the start
        new = step if found is None else step.join(seen, ["owner", "node"], "left_anti")
        new = written(new.select("owner", "node", F.lit(depth).alias("depth"), F.col("e.source").alias("source"), F.col("e.line").alias("line"), F.col("e.raw").alias("raw")), "evidence")
        if new.isEmpty():
            return new if found is None else found
        found = new if found is None else found.unionByName(new)
        if depth % 8 == 0:
            found = written(found, "evidence")
        front = new.where("node <> owner").select("owner", "node")
    raise RuntimeError("evidence did not settle")


def reach_sets(edges: DataFrame, sources: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """edges(src, dst), sources(source): (node, depth, sources), the sorted sources that reach each node and the least depth.

    Sources are numbered, and a node holds its sources as bits of 64-bit words: one row for each word with a bit, however many sources that stands for.
    A round sends the words that have grown along the edges and joins them by `or`; bits that a node has already go no further.
    """
    edges = written(edges.select("src", "dst").distinct(), "edges")
    numbered = _numbered(sources)
    bit = F.expr("shiftleft(1L, cast(number % 64 as int))")
    front = written(numbered.select(F.col("source").alias("node"), F.floor(F.col("number") / 64).cast("long").alias("word"), bit.alias("bits")).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), "sets")
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, most_rounds):
        come = front.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("come"))
        joined = come.join(seen.select("node", "word", "bits"), ["node", "word"], "left")
        front = written(joined.select("node", "word", F.col("come").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0"), "sets")
        if front.isEmpty():
            break
        both = seen.unionByName(front.withColumn("depth", F.lit(depth)))
        seen = written(both.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"), F.min("depth").alias("depth")), "sets")
    else:
        raise RuntimeError("sets did not settle")
    bits = seen.select("node", "depth", "word", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)).alias("i"))
    named = bits.select("node", "depth", (F.col("word") * 64 + F.col("i")).alias("number")).join(numbered, "number")
    return named.groupBy("node").agg(F.min("depth").alias("depth"), F.array_sort(F.collect_list("source")).alias("sources"))


def _numbered(sources: DataFrame) -> DataFrame:
    """(source, number): dense numbers from 0, by counts of ranges, so that no task sorts all."""
    ranged = written(sources.select("source").distinct().repartitionByRange("source").sortWithinPartitions("source").withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.floor(F.col("at") / (1 << 33)).cast("long")
    sizes = {r.p: r.n for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row for each range
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    start = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv))[part] if starts else F.lit(0)
    return written(ranged.select("source", (start + F.col("at") % (1 << 33)).cast("long").alias("number")), "sources")


def route_reachability(nodes: DataFrame, routes: DataFrame, entrypoints: DataFrame, adoption: str) -> DataFrame:
    """nodes(node, eligible), routes(src, dst), entrypoints(source): (node, mode, state, reason, depth, sources).

    adoption: adopted (the answer covers the repository), partial (it describes what the entrypoints reach) or not-adopted.  Without adoption, or in part
    without an entrypoint, nothing is evaluated; nodes that are not eligible never are.
    """
    mode = "authoritative" if adoption == "adopted" else "descriptive" if adoption == "partial" and not entrypoints.isEmpty() else "not-evaluated"
    none = F.array().cast("array<long>"), F.lit(None).cast("int")
    if mode == "not-evaluated":
        out = nodes.select("node", "eligible", none[1].alias("depth"), none[0].alias("sources"))
        state, reason = F.lit("not-evaluated"), F.lit("coverage-not-evaluated")
    else:
        own = entrypoints.select(F.col("source").alias("node"), F.lit(True).alias("own")).distinct()
        out = nodes.join(reach_sets(routes, entrypoints), "node", "left").join(own, "node", "left")
        state = F.when(F.col("sources").isNull(), "not-reached").otherwise("reachable")
        reason = F.when(F.col("own"), "published-entrypoint").when(F.col("sources").isNotNull(), "reachable-through-usable-route").otherwise("no-usable-path-from-published-entrypoint")
    fit = F.col("eligible")
    return out.select(
        "node",
        F.lit(mode).alias("mode"),
        F.when(fit, state).otherwise("not-evaluated").alias("state"),
        F.when(fit, reason).otherwise("skill-not-discovery-eligible").alias("reason"),
        F.when(fit, F.col("depth")).alias("depth"),
        F.when(fit, F.coalesce("sources", none[0])).otherwise(none[0]).alias("sources"),
    )


def executable_graph(skills: DataFrame, surfaces: DataFrame, invocations: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of skills and executable surfaces.

    skills(skill), surfaces(path, owner, local), invocations(source, target, external) with one row for each piece of evidence, dependencies(src, dst) too.
    Edges (source, target, kind, declaration, resolved, evidence): equal invocations are one edge with their number; a target that is no surface makes no edge unless it is external;
    a local surface is contained in its owner.  Nodes (node, role, invoked_by_skills, fan_in): how many skills invoke a target, and how many sources in all.
    """
    known = surfaces.select(F.col("path").alias("target"))
    ends = skills.select(F.col("skill").alias("source")).unionByName(surfaces.select(F.col("path").alias("source")))
    inside = invocations.where("not external").select("source", "target").join(known, "target", "left_semi").join(ends, "source", "left_semi")
    outside = invocations.where("external").select("source", "target").join(ends, "source", "left_semi")
    needs = dependencies.select(F.col("src").alias("source"), F.col("dst").alias("target")).join(known, "target", "left_semi").join(surfaces.select(F.col("path").alias("source")), "source", "left_semi")
    counted = lambda df, kind, declaration, resolved: df.groupBy("source", "target").agg(F.count("*").alias("evidence")).select("source", "target", F.lit(kind).alias("kind"), F.lit(declaration).alias("declaration"), F.lit(resolved).alias("resolved"), "evidence")
    held = surfaces.where("local").join(skills.select(F.col("skill").alias("owner")), "owner", "left_semi").select(F.col("owner").alias("source"), F.col("path").alias("target"))
    contains = held.distinct().select("source", "target", F.lit("contains").alias("kind"), F.lit("structural-boundary").alias("declaration"), F.lit(True).alias("resolved"), F.lit(None).cast("long").alias("evidence"))
    edges = contains.unionByName(counted(inside, "invokes", "executable-invocation", True)).unionByName(counted(needs, "invokes", "executable-dependency", True)).unionByName(counted(outside, "invokes", "executable-invocation", False))
    calls = edges.where("kind = 'invokes'")
    by_skill = calls.join(skills.select(F.col("skill").alias("source")), "source", "left_semi").select("source", "target").distinct().groupBy("target").agg(F.count("*").alias("invoked_by_skills"))
    fan_in = calls.select("source", "target").distinct().groupBy("target").agg(F.count("*").alias("fan_in"))
    every = skills.select(F.col("skill").alias("node"), F.lit("skill").alias("role")).unionByName(surfaces.select(F.col("path").alias("node"), F.lit("surface").alias("role"))).unionByName(outside.select(F.col("target").alias("node"), F.lit("external-executable").alias("role"))).distinct()
    counts = by_skill.join(fan_in, "target", "full").withColumnRenamed("target", "node")
    zero = F.lit(0).cast("long")
    nodes = every.join(counts, "node", "left").select("node", "role", F.coalesce("invoked_by_skills", zero).alias("invoked_by_skills"), F.coalesce("fan_in", zero).alias("fan_in"))
    return edges, nodes
