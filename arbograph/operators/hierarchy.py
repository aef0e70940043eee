"""Parent-child links of unknown depth: paths, depths, roots, descendants and cycles.

Hash splitters cut the forest into short walks. (1) Every node walks to its next splitter or root; the walks are
composed by pointer jumping, so a walk of length g takes log2(g) joins. (2) The splitters alone, an eighth of the
nodes, form the reduced pointer graph, solved the same way. (3) Results and paths are expanded to all nodes by one
join. Nodes that never reach a splitter or root lie on or below a cycle without a splitter and are handled apart; a
splitter among them ends the walks below it, as a root does, and gives them its cycle. Cycles through splitters come
out of the reduced graph. Each round is written to the shared folder; walks that have ended are not written again. A node to which many point is
joined apart (split_join).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbograph.runtime import is_id, split_join, stored, stored_with, union

SPLIT = 8
PARENT_TYPES = ("extends", "extends_module")


def parents(edges: DataFrame, types: tuple[str, ...] = PARENT_TYPES) -> DataFrame:
    """(id, parent): of each child the target of its row with the latest indexed_at, at a tie the largest edge_id.

    Rows whose source or target is null or blank do not count; a null indexed_at is older than any other.
    """
    rows = edges.filter(F.col("type").isin(*types) & is_id(F.col("target_id")) & is_id(F.col("source_id")))
    return rows.groupBy(F.col("source_id").alias("id")).agg(F.max_by("target_id", F.struct("indexed_at", "edge_id", "target_id")).alias("parent"))


def jump(walk: DataFrame, label: str) -> tuple[DataFrame, DataFrame, int]:
    """The walks of walk(id, ptr, d, low, path, done, at_root) that end, composed to their end; those that never do, and their number.

    A walk is done if it ends at ptr; else ptr is the id of the walk that it goes on with. d is its length, low the least
    id passed, path the ids passed, at_root whether it ends at a root. Each round joins the open walks with all and writes
    only what it moved.
    """
    walk, open_n = stored_with(walk, label, ~F.col("done"))
    ended, open_ = [walk.filter("done")], walk.filter("NOT done")
    while open_n:
        ahead = union([*ended, open_]).select(F.col("id").alias("ptr"), F.col("ptr").alias("p"), F.col("d").alias("pd"), F.col("low").alias("pl"), F.col("path").alias("pp"), F.col("done").alias("pdone"), F.col("at_root").alias("proot"))
        moved = split_join(open_.drop("done", "at_root"), ahead, "ptr").select("id", F.col("p").alias("ptr"), (F.col("d") + F.col("pd")).alias("d"), F.least("low", "pl").alias("low"), F.concat("path", "pp").alias("path"), F.col("pdone").alias("done"), F.col("proot").alias("at_root"))
        moved, left = stored_with(moved, label, ~F.col("done"))
        open_ = moved.filter("NOT done")
        # Along an ending walk every shorter length occurs, so a round in which none ends means that the rest are cycles.
        if left == open_n:
            break
        ended.append(moved.filter("done"))
        open_n = left
    return union(ended), open_, open_n


def _cycles(walk: DataFrame, n: int, label: str) -> DataFrame:
    """Of n walks closed under ptr that never end: (id, root = least id on the cycle below which or on which it lies, at = a node of that cycle)."""

    def twice(w: DataFrame) -> DataFrame:
        ahead = w.select(F.col("id").alias("ptr"), F.col("ptr").alias("p"), F.col("low").alias("pl"))
        return w.join(ahead, "ptr").select("id", F.col("p").alias("ptr"), F.least("low", "pl").alias("low"))

    walk = walk.select("id", "ptr", "low")
    for _ in range(max(1, math.ceil(math.log2(n + 1) / 2)) if n else 0):
        walk = stored(twice(twice(walk)), label)
    # After 2^r >= n steps the pointer stands on the cycle, and the low of that node has gone all round.
    on = walk.select(F.col("id").alias("ptr"), F.col("low").alias("root"))
    return walk.join(on, "ptr").select("id", "root", F.col("ptr").alias("at"))


def resolve(parent: DataFrame, paths: bool = False, split: int = SPLIT) -> DataFrame:
    """(id, root_id, depth, path) for each row of parent(id, parent); ids are unique.

    path holds the node first and the root last, only if paths is set and the node hangs on no cycle, else null.
    Nodes on or below a cycle have depth -1 and as root the least id of that cycle.
    """
    parent = stored(parent.select("id", "parent"), "parents")
    stop = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(split)) == 0
    path = F.array("id") if paths else F.array().cast("array<string>")
    heads = parent.select(F.col("id").alias("ptr"), stop.alias("is_split"))
    walk = split_join(parent.withColumnRenamed("parent", "ptr"), heads, "ptr", "left")
    # A walk ends at a splitter or at a node without a parent, a root.
    walk = walk.select("id", "ptr", F.lit(1).cast("long").alias("d"), F.col("id").alias("low"), path.alias("path"), F.coalesce(F.col("is_split"), F.lit(True)).alias("done"), F.col("is_split").isNull().alias("at_root"))
    ended, endless, n = jump(walk, "walks")
    none = F.lit(None).cast("string")
    if n:
        # Splitters whose own walk never ends are ends to the walks below them, with the cycle that they hang on.
        apart = stored(_cycles(endless, n, "splitterless").select("id", F.col("root").alias("cycle")), "apart")
        ended = stored(split_join(ended, apart.filter(stop).select(F.col("id").alias("ptr"), "cycle"), "ptr", "left"), "walks")
    else:
        apart, ended = None, ended.withColumn("cycle", none)
    ended = ended.withColumn("at_end", F.col("at_root") | F.col("cycle").isNotNull())
    small = ended.filter(stop).select("id", "ptr", "d", "low", "path", F.col("at_end").alias("done"), "at_root")
    reduced, round_, n = jump(small, "reduced")
    known = F.col("at_root")
    # The cycle of an end that is no root is looked up there; a splitter of the reduced graph that ends has its own row.
    last = reduced.join(apart.withColumnRenamed("id", "ptr"), "ptr", "left") if apart is not None else reduced.withColumn("cycle", none)
    solved = last.select(F.col("id").alias("ptr"), F.coalesce("cycle", "ptr").alias("root"), F.when(known, F.col("d")).otherwise(-1).alias("rest"), F.when(known, F.col("path")).alias("rest_path"))
    if n:
        solved = solved.unionByName(_cycles(round_, n, "reduced").select(F.col("id").alias("ptr"), "root", F.lit(-1).cast("long").alias("rest"), F.lit(None).cast("array<string>").alias("rest_path")))
    solved = stored(solved, "solved")  # its size decides how it is joined
    whole = F.concat("path", F.array("ptr")) if paths else F.lit(None).cast("array<string>")
    whole_ = F.concat("path", "rest_path", F.array("root")) if paths else F.lit(None).cast("array<string>")
    straight = ended.filter("at_end").select("id", F.coalesce("cycle", "ptr").alias("root_id"), F.when(known, F.col("d")).otherwise(-1).alias("depth"), F.when(known, whole).alias("path"))
    through = split_join(ended.filter("NOT at_end").drop("cycle"), solved, "ptr").select("id", F.col("root").alias("root_id"), F.when(F.col("rest") < 0, -1).otherwise(F.col("d") + F.col("rest")).alias("depth"), F.when(F.col("rest") >= 0, whole_).alias("path"))
    out = straight.unionByName(through)
    if apart is not None:
        out = out.unionByName(apart.select("id", F.col("cycle").alias("root_id"), F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("array<string>").alias("path")))
    return out.select("id", "root_id", F.col("depth").cast("int").alias("depth"), "path")


def tree_nodes(edges: DataFrame) -> DataFrame:
    """(node_id, root_id, depth) for each node with a parent; see resolve()."""
    return resolve(parents(edges)).select(F.col("id").alias("node_id"), "root_id", "depth")


def tree_paths(edges: DataFrame) -> DataFrame:
    """(node_id, root_id, depth, path): path from the root down to the node, ids parted by ' > '; null on or below a cycle."""
    return resolve(parents(edges), paths=True).select(F.col("id").alias("node_id"), "root_id", "depth", F.array_join(F.reverse("path"), " > ").alias("path"))


def descendants(edges: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance): every node below every node, by expanding the exact paths; none for cycles."""
    return resolve(parents(edges), paths=True).filter("path IS NOT NULL").select(F.col("id").alias("node_id"), F.posexplode("path").alias("distance", "ancestor_id")).filter("distance > 0").select("ancestor_id", "node_id", F.col("distance").cast("long").alias("distance"))


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle_id, node_id): the nodes on cycles; cycle_id is the least id on the cycle."""
    parent = parents(edges)
    bad = stored(resolve(parent).filter("depth < 0").select("id", F.col("root_id").alias("cycle_id")), "cycles")
    # On a cycle is what is reached again from its least id: the walk of 2^r >= n steps lands on cycle nodes only.
    own, n = stored_with(bad.join(parent, "id").select("id", F.col("parent").alias("ptr"), F.col("id").alias("low"), "cycle_id"), "cycles", F.lit(True))
    landed = _cycles(own, n, "cycles").select("at").distinct()
    step = own.select(F.col("id").alias("at"), "ptr", "cycle_id").join(landed, "at", "left_semi")
    # Every node of the cycle is the landing place of some node (the map is one-to-one on the cycle).
    return step.select("cycle_id", F.col("at").alias("node_id"))
