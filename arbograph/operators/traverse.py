"""Level-synchronous traversals, trees of simple paths, bounded cycles and views.

A level joins the frontier with the edges. Frontiers are distinct and never visited before, so each node is expanded
once. Levels are written to the shared folder: the plan of a level never contains the levels before it. The edges are
read, not copied: of a graph that is not stored yet, store them first. A frontier within the limit for broadcasts goes to
the edges; beyond it the arcs of hubs are joined apart (split_join).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbograph.operators.graph import Graph
from arbograph.runtime import split_join, stored, stored_with


def _arcs(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (at, to, source_id, target_id, type)."""
    out = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"), "source_id", "target_id", "type")
    into = edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("to"), "source_id", "target_id", "type")
    return {"outgoing": lambda: out, "incoming": lambda: into, "both": lambda: out.unionByName(into)}[direction]()


def touched_edges(graph: Graph, starts: DataFrame, direction: str, depth: int) -> DataFrame:
    """(source_id, target_id, type, level): every edge touched by a node at its expansion, those to visited nodes included; starts(id)."""
    arcs = _arcs(graph.edges, direction)
    frontier, n = stored_with(starts.select("id").distinct(), "frontier", F.lit(True))
    seen, found = frontier, []
    for level in range(1, depth + 1):
        if not n:
            break
        step = stored(split_join(arcs, frontier.withColumnRenamed("id", "at"), "at").withColumn("level", F.lit(level)), "touched")
        found.append(step)
        if level < depth:
            frontier, n = stored_with(step.select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti"), "frontier", F.lit(True))
            seen = seen.unionByName(frontier)
    columns = ["source_id", "target_id", "type", "level"]
    if not found:
        return graph.edges.select("source_id", "target_id", "type", F.lit(0).alias("level")).limit(0)
    return reduce(DataFrame.unionByName, [s.select(*columns) for s in found])


def reached(graph: Graph, starts: DataFrame, direction: str = "incoming", depth: int = 5) -> DataFrame:
    """(id, distance, via_source, via_target, via_type): nodes reached from starts(id), never a start itself.

    via is the discovering edge: of those of the node's first level the least by (the node it comes from, type).
    Ids without a node row are passed through and not reported.
    """
    arcs = _arcs(graph.edges, direction)
    frontier, n = stored_with(starts.select("id").distinct(), "frontier", F.lit(True))
    seen, levels = frontier, []
    for level in range(1, depth + 1):
        if not n:
            break
        # Aggregated before the anti-join, so that a node that many arcs lead to is one row there.
        step = split_join(arcs, frontier.withColumnRenamed("id", "at"), "at").groupBy(F.col("to").alias("id")).agg(F.min(F.struct("at", "type", "source_id", "target_id")).alias("via"))
        step = step.join(seen, "id", "left_anti").select("id", F.lit(level).alias("distance"), F.col("via.source_id").alias("via_source"), F.col("via.target_id").alias("via_target"), F.col("via.type").alias("via_type"))
        step, n = stored_with(step, "level", F.lit(True))
        levels.append(step)
        frontier = step.select("id")
        seen = seen.unionByName(frontier)
    if not levels:
        return graph.edges.select(F.col("source_id").alias("id"), F.lit(0).alias("distance"), F.col("source_id").alias("via_source"), F.col("target_id").alias("via_target"), F.col("type").alias("via_type")).limit(0)
    return reduce(DataFrame.unionByName, levels).join(graph.nodes.select("id"), "id", "left_semi")


def simple_paths(graph: Graph, start: str, direction: str = "outgoing", depth: int = 3) -> DataFrame:
    """(path, depth, edge_type): every simple path from start of 1 to depth edges, ids parted by ' > '; parallel edges give a row each.

    The number of such paths grows with the degrees to the power of depth; the depth is the caller's bound on it.
    """
    arcs = _arcs(graph.edges, direction).select("at", "to", "type")
    paths = graph.edges.sparkSession.createDataFrame([(start, [start])], "at string, path array<string>")
    levels = []
    for level in range(1, depth + 1):
        paths = stored(paths.select("at", "path").join(arcs, "at").filter(~F.array_contains("path", F.col("to"))).select(F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), F.lit(level).alias("depth"), F.col("type").alias("edge_type")), "paths")
        levels.append(paths)
    return reduce(DataFrame.unionByName, levels).select(F.array_join("path", " > ").alias("path"), "depth", "edge_type")


def bounded_cycles(edges: DataFrame, seeds: DataFrame | None = None, max_length: int = 10) -> DataFrame:
    """(cycle, length): the elementary cycles of up to max_length nodes, from the least id on, ids parted by ' > '.

    Nodes that no cycle can pass (no way in, or no way out) are trimmed first, in max_length rounds at most: a longer
    way in or out costs the path search no more than a way of that length. With seeds(id) only cycles through one of them.
    """
    arcs, n = stored_with(edges.select("source_id", "target_id").distinct(), "arcs", F.lit(True))
    for _ in range(max_length if n else 0):
        into, out = arcs.select(F.col("target_id").alias("source_id")).distinct(), arcs.select(F.col("source_id").alias("target_id")).distinct()
        arcs, m = stored_with(arcs.join(into, "source_id", "left_semi").join(out, "target_id", "left_semi").select("source_id", "target_id"), "arcs", F.lit(True))
        if m in (0, n):
            break
        n = m
    # A path starts at its least id and only visits greater ones, so each cycle is found once.
    paths = arcs.filter("target_id >= source_id").select(F.col("source_id").alias("head"), F.col("target_id").alias("at"), F.array("source_id").alias("path"))
    found = []
    for _ in range(max_length):
        paths, n = stored_with(paths, "cycle-paths", F.lit(True))
        found.append(paths.filter("at = head").select("path"))
        if not n:
            break
        paths = paths.filter("at != head").withColumn("path", F.concat("path", F.array("at"))).join(arcs.withColumnRenamed("source_id", "at"), "at").filter((F.col("target_id") >= F.col("head")) & ((F.col("target_id") == F.col("head")) | ~F.array_contains("path", F.col("target_id")))).select("head", F.col("target_id").alias("at"), "path")
    all_ = reduce(DataFrame.unionByName, found)
    if seeds is not None:
        hit = all_.withColumn("id", F.explode("path")).join(seeds.select("id"), "id", "left_semi").select("path").distinct()
        all_ = hit
    return all_.select(F.array_join("path", " > ").alias("cycle"), F.size("path").alias("length"))


def view(graph: Graph, focus: str | None = None, types: tuple[str, ...] | None = None, module: str | None = None, depth: int = 3) -> Graph:
    """A subgraph: around a focus in both directions, else the nodes of some types and a module with the edges among them; by default all nodes of type class."""
    if focus is not None:
        starts = graph.nodes.sparkSession.createDataFrame([(focus,)], "id string")
        edges = touched_edges(graph, starts, "both", depth).select("source_id", "target_id", "type")
        ids = starts.unionByName(edges.select(F.col("source_id").alias("id"))).unionByName(edges.select(F.col("target_id").alias("id"))).distinct()
        return Graph(graph.nodes.join(ids, "id", "left_semi"), edges.distinct().join(graph.edges, ["source_id", "target_id", "type"], "left_semi").withColumn("metadata", F.lit("{}")))
    nodes = graph.nodes
    if types:
        nodes = nodes.filter(F.col("type").isin(*types))
    if module:
        nodes = nodes.filter(F.col("module") == module)
    if not types and not module:
        nodes = graph.of_type("class")
    return Graph(nodes, graph.induced(nodes))


def dependents(graph: Graph, id_: str, direct: tuple[str, ...], further: tuple[str, ...], depth: int = 2) -> DataFrame:
    """(id, level): direct dependents over the edge types `direct`, then over `further`; each at its first level."""
    first = graph.edges.filter((F.col("target_id") == id_) & F.col("type").isin(*direct)).select(F.col("source_id").alias("id")).filter(F.col("id") != id_).distinct()
    found = first.withColumn("level", F.lit(1))
    if depth > 1:
        start = graph.nodes.sparkSession.createDataFrame([(id_,)], "id string")
        base = Graph(graph.edges.select(F.col("source_id").alias("id")).distinct(), graph.edges.filter(F.col("type").isin(*further)))
        more = reached(base, stored(first, "direct"), "incoming", depth - 1).select("id", (F.col("distance") + 1).alias("level"))
        found = found.unionByName(more.join(start, "id", "left_anti"))
    return found
