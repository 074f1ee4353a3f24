"""Graph operators over edges (source, target, edge_type, weight, created_at, valid_from, valid_until) (of G1-G34, without G2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import valid_at
from ..sources.scratch import written


def of_types(e: DataFrame, types: list[str] | None) -> DataFrame:
    return e if types is None else e.where(F.col("edge_type").isin(types))


def valid(e: DataFrame, at: int) -> DataFrame:
    return e.where(valid_at(F.col("valid_from"), F.col("valid_until"), at))


def reachable(e: DataFrame, start: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """Breadth first from the start nodes (id): id, depth (the least), up to `depth` steps along out-edges.

    A level is one join of the frontier with the edges; a level without news ends the loop.
    """
    e = of_types(e, types).select("source", "target")
    seen = start.select("id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(e, F.col("id") == F.col("source")).select(F.col("target").alias("id")).distinct()
        frontier = written(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
    return seen


def known(e: DataFrame, ids: list[int]) -> DataFrame:
    """Start nodes that the graph has; an unknown start reaches nothing."""
    nodes = e.select(F.col("source").alias("id")).union(e.select("target"))
    return nodes.where(F.col("id").isin(ids)).distinct()


def subgraph(e: DataFrame, start: DataFrame, radius: int) -> DataFrame:
    """Edges between nodes within the radius."""
    near = written(reachable(e, start, radius).select("id"), "near")
    inner = e.join(near, F.col("source") == F.col("id"), "left_semi")
    return inner.join(near, F.col("target") == F.col("id"), "left_semi")


def shortest_path(e: DataFrame, start: int, goal: int, depth: int) -> DataFrame:
    """One row (path) of the least steps, the least path by ids; none if the goal is not reached within `depth`."""
    pairs = e.select("source", "target").distinct()
    paths = known(e, [start]).select("id", F.array("id").alias("path"))
    for _ in range(depth):
        if paths.where(F.col("id") == goal).limit(1).count():
            break
        grown = paths.join(pairs, F.col("id") == F.col("source")).where(~F.array_contains("path", F.col("target")))
        # of several paths to a node the least is enough
        paths = written(grown.select(F.col("target").alias("id"), F.concat("path", F.array("target")).alias("path")).groupBy("id").agg(F.min("path").alias("path")), "paths")
    return paths.where(F.col("id") == goal).select("path")


def contradictions(e: DataFrame, node: int) -> DataFrame:
    """Nodes that contradict the node directly, either way, or that its direct supporters and supported contradict."""
    against = of_types(e, ["contradicts"]).select("source", "target")
    both = against.union(against.select(F.col("target").alias("source"), F.col("source").alias("target")))
    supports = of_types(e, ["supports"])
    friends = supports.where(F.col("target") == node).select(F.col("source").alias("f")).union(supports.where(F.col("source") == node).select("target")).distinct()
    direct = both.where(F.col("source") == node).select(F.col("target").alias("id"))
    hop = against.join(friends, F.col("source") == F.col("f")).select(F.col("target").alias("id"))
    return direct.union(hop).where(F.col("id") != node).distinct()


def superseded_by(e: DataFrame, node: int, depth: int = 64) -> DataFrame:
    """All that the node supersedes, directly or not."""
    start = e.sparkSession.createDataFrame([(node,)], "id long")
    return reachable(e, start, depth, ["supersedes"]).where("depth > 0").select("id")


def history(e: DataFrame, node: int, depth: int) -> DataFrame:
    """The chain along each node's first Supersedes edge (by created_at, target): depth, id."""
    first = of_types(e, ["supersedes"]).groupBy("source").agg(F.min(F.struct("created_at", "target")).alias("f")).select("source", F.col("f.target").alias("target"))
    now = e.sparkSession.createDataFrame([(0, node)], "depth int, id long")
    out = now
    for level in range(1, depth + 1):
        now = written(now.join(first, F.col("id") == F.col("source")).select(F.lit(level).alias("depth"), F.col("target").alias("id")).join(out.select("id"), "id", "left_anti").select("depth", "id"), "chain")
        if not now.limit(1).count():
            break
        out = out.union(now)
    return out


def cycles(e: DataFrame, types: list[str], longest: int) -> DataFrame:
    """Simple cycles of up to `longest` nodes on the edge types, once for each set of nodes: nodes (sorted)."""
    pairs = of_types(e, types).select("source", "target").distinct()
    paths = pairs.where("source <= target").select(F.col("source").alias("first"), F.col("target").alias("last"), F.array("source").alias("path"))
    found = []
    for step in range(longest):
        found.append(paths.where("first = last").select(F.array_sort("path").alias("nodes")))
        if step == longest - 1:
            break
        # a cycle is grown from its least node only
        grown = paths.where("first <> last").join(pairs, F.col("last") == F.col("source")).where("target >= first AND NOT array_contains(path, last)")
        paths = written(grown.select("first", F.col("target").alias("last"), F.concat("path", F.array("last")).alias("path")), "cycles")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def believed(e: DataFrame, confidence: DataFrame, node: int, depth: int = 5) -> DataFrame:
    """Belief propagation, breadth first from one node (its confidence in id, confidence): id, confidence of the changed
    nodes, the start's included; nothing if the node has no confidence.

    Caused: c w 0.9. Supports: clamp(cur + (c - 1) w 0.5). Contradicts: clamp(cur - c w 0.7). Supersedes: min(cur, 0.1 c).
    Other edges stop. A node begins at 1; the first edge into it gives the value c that it passes on, up to `depth` steps
    from the start; every edge passed changes its confidence, the start's too. A node's out-edges are passed by (created_at,
    target, edge_type, weight), the nodes of a level in the order in which they were entered. The edges passed into one
    node are folded in one task.
    """

    def turned(cur, kind, c, w):
        support, against = cur + (c - 1) * w * 0.5, cur - c * w * 0.7
        held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(kind == "supports", support).otherwise(against)))
        return F.when(kind == "caused", c * w * 0.9).when(kind == "supersedes", F.least(cur, c * 0.1)).otherwise(held)

    e = of_types(e, ["caused", "supports", "contradicts", "supersedes"])
    step = F.struct("created_at", "target", "edge_type", F.col("weight").cast("double").alias("weight"))
    start = confidence.where(F.col("id") == node).select("id", F.col("confidence").cast("double").alias("own"))
    first = e.select(F.array(step).alias("path")).schema["path"].dataType
    now = start.select("id", F.col("own").alias("c"), F.array().cast(first).alias("path"))
    seen, passed = start.select("id"), None
    for level in range(depth):
        new = now.join(e, F.col("id") == F.col("source")).select(F.col("target").alias("id"), F.lit(level).alias("level"), F.concat("path", F.array(step)).alias("path"), "c")
        new = written(new, "passed")
        passed = new if passed is None else passed.union(new)
        entered = new.join(seen, "id", "left_anti").groupBy("id").agg(F.min(F.struct("path", "c")).alias("f")).select("id", "f.*")
        last = F.element_at("path", -1)
        now = written(entered.select("id", turned(F.lit(1.0), last["edge_type"], F.col("c"), last["weight"]).alias("c"), "path"), "beliefs")
        if not now.limit(1).count():
            break
        seen = seen.union(now.select("id"))
    if passed is None:
        return start.withColumnRenamed("own", "confidence")
    edges = passed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("level", "path", "c"))).alias("into")).join(start, "id", "full")

    def fold(cur, x):
        last = F.element_at(x["path"], -1)
        return turned(cur, last["edge_type"], x["c"], last["weight"])

    return edges.select("id", F.aggregate(F.coalesce("into", F.array()), F.coalesce("own", F.lit(1.0)), fold).alias("confidence"))


def added(e: DataFrame, new: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """e and the new edges, except those that repeat an open edge (valid_until is null) and, given nodes, those without both ends."""
    if nodes is not None:
        new = new.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    keys = ["source", "target", "edge_type"]
    return e.unionByName(new.select(*e.columns).join(e.where("valid_until IS NULL").select(*keys), keys, "left_anti"))


def strengthened(e: DataFrame, source: int, target: int, delta: float) -> DataFrame:
    hit = (F.col("source") == source) & (F.col("target") == target)
    return e.withColumn("weight", F.when(hit, F.least(F.lit(1.0), F.col("weight") + delta)).otherwise(F.col("weight")))


def without_node(e: DataFrame, ids: DataFrame) -> DataFrame:
    return e.join(ids.select(F.col("id").alias("source")), "source", "left_anti").join(ids.select(F.col("id").alias("target")), "target", "left_anti")


def without_types(e: DataFrame, types: list[str]) -> DataFrame:
    return e.where(~F.col("edge_type").isin(types))


def outgoing(e: DataFrame, node: int, at: int | None = None) -> DataFrame:
    """Edges out of the node, at an instant those that hold then."""
    own = e.where(F.col("source") == node)
    return own if at is None else valid(own, at)


def incoming(e: DataFrame, node: int, at: int | None = None) -> DataFrame:
    """Edges into the node, at an instant those that hold then."""
    own = e.where(F.col("target") == node)
    return own if at is None else valid(own, at)


def type_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("edge_type").agg(F.count("*").alias("n"))


def latest_states(e: DataFrame) -> DataFrame:
    """For each source and type, the latest edge stays open; the others are closed at its start, with weight 0.1."""
    w = Window.partitionBy("source", "edge_type")
    last = F.max(F.struct("created_at", "target")).over(w)
    mine = F.struct("created_at", "target") == last
    return e.withColumn("valid_until", F.when(mine, F.col("valid_until")).otherwise(F.least(F.coalesce("valid_until", last["created_at"]), last["created_at"]))).withColumn("weight", F.when(mine, F.col("weight")).otherwise(0.1))
