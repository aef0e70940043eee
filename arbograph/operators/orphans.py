"""References to records that do not exist at the time of the row, direct and inherited.

Existence is a sweep: beginnings and ends of all lives and all references stand in one order (id, time, kind, row),
made by a range shuffle whose last column is unique. A running sum of open lives decides each reference. Only the
first id of a partition can depend on partitions before; its rows are settled by carries, one number per partition.
A hot id is spread over as many partitions as it needs, on either side, and no life list is ever gathered.

The fixpoint cascade then treats records that hang on an orphaned record as orphans too (`inherited`), by semi-joins
down the structural rows; chains of records with one parent are shortened by pointer jumping first, so that the number
of rounds does not follow the depth of the chains.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbograph.operators.hierarchy import jump
from arbograph.runtime import digest, hashed, is_id, split_join, stored, stored_with, union, width

#: Edge types by which a record is a child of the record it names.
STRUCTURAL = ("extends", "extends_module", "implements")
_OUT = "part int, is_summary boolean, first boolean, tab byte, row_id long, t long, open long, f1 long, f2 long, l1 long, l2 long, many boolean"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _batch(part: int, n: int, **cols) -> pa.RecordBatch:
    types = {"part": pa.int32(), "is_summary": pa.bool_(), "first": pa.bool_(), "tab": pa.int8(), "many": pa.bool_()}
    full = {"part": np.full(n, part, np.int32)} | cols
    return pa.RecordBatch.from_arrays([pa.array(full[c], types.get(c, pa.int64())) if c in full else pa.nulls(n, types.get(c, pa.int64())) for c in _NAMES], names=_NAMES)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    first = last = None
    many, running = False, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        k1, k2, t, tab, row_id, delta = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        if first is None:
            first = last = (k1[0], k2[0])
        change = np.empty(n, bool)
        change[0] = (k1[0], k2[0]) != last
        change[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        total = np.cumsum(delta.astype(np.int64))
        at = np.flatnonzero(change)
        group = np.cumsum(change)
        base = np.concatenate(([-running], total[at] - delta[at]))
        now = total - base[group]
        in_first = (group == 0) & (not many)
        ask = np.flatnonzero((tab >= 0) & (in_first | (now <= 0)))
        if len(ask):
            yield _batch(part, len(ask), is_summary=np.zeros(len(ask), bool), first=in_first[ask], tab=tab[ask], row_id=row_id[ask], t=t[ask], open=now[ask])
        many = many or len(at) > 0
        last, running = (k1[-1], k2[-1]), int(now[-1])
    if first is not None:
        yield _batch(part, 1, is_summary=[True], open=[running], f1=[int(first[0])], f2=[int(first[1])], l1=[int(last[0])], l2=[int(last[1])], many=[many])


def _carries(summaries: list) -> dict[int, int]:
    """Open lives that each partition's first id has from the partitions before (one row per partition in)."""
    out: dict[int, int] = {}
    key, held = None, 0
    for s in sorted(summaries, key=lambda s: s.part):
        into = held if (s.f1, s.f2) == key else 0
        if into:
            out[s.part] = into
        held = s.open + (0 if s.many else into)
        key = (s.l1, s.l2)
    return out


def references(ref_tables: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """The references of (table, row id column, reference column, time column), numbered as `tab` in the list's order; null and blank references are none."""
    return reduce(
        DataFrame.unionByName,
        [df.filter(is_id(F.col(ref))).select(F.lit(i).cast("byte").alias("tab"), F.col(row).cast("long").alias("row_id"), F.col(ref).alias("ref"), F.unix_micros(F.col(time).cast("timestamp")).alias("t")) for i, (df, row, ref, time) in enumerate(ref_tables)],
    )


def missing_at(nodes: DataFrame, refs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(tab, row_id, t) of the refs(tab, row_id, ref, t) for which no real node with that id lives at t.

    A node lives from indexed_at (included) to removed_at (excluded, null = for ever); only is_placeholder = false
    counts; a null indexed_at, or a removal not after it, is no life. A reference without a time has no node at it.
    Repeated rows come out as often as they go in. Extra columns are not read.
    """
    h = hashed(F.col("id"))
    lives = nodes.filter("is_placeholder = false AND indexed_at IS NOT NULL AND id IS NOT NULL AND (removed_at IS NULL OR removed_at > indexed_at)")
    bounds = F.array(
        F.struct(F.unix_micros(F.col("indexed_at").cast("timestamp")).alias("t"), F.lit(1).cast("byte").alias("delta")),
        F.struct(F.unix_micros(F.col("removed_at").cast("timestamp")).alias("t"), F.lit(-1).cast("byte").alias("delta")),
    )
    ends = lives.select(h[0].alias("k1"), h[1].alias("k2"), F.explode(bounds).alias("b")).filter("b.t IS NOT NULL").select("k1", "k2", "b.t", F.lit(-1).cast("byte").alias("tab"), F.lit(0).cast("long").alias("row_id"), "b.delta")
    r = hashed(F.col("ref"))
    asks = refs.filter("t IS NOT NULL").select(r[0].alias("k1"), r[1].alias("k2"), "t", "tab", "row_id", F.lit(0).cast("byte").alias("delta"))
    order = ["k1", "k2", "t", F.col("tab") >= 0, "tie"]
    swept = ends.unionByName(asks).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions or width(nodes.sparkSession), *order).sortWithinPartitions(*order)
    swept = stored(swept.select("k1", "k2", "t", "tab", "row_id", "delta").mapInArrow(_sweep, _OUT), "sweep")
    carries = _carries(swept.filter("is_summary").collect())  # one row per partition
    found = swept.filter("NOT is_summary")
    if carries:
        known = F.broadcast(nodes.sparkSession.createDataFrame(sorted(carries.items()), "part int, carry long"))  # as many rows as partitions at most
        found = found.join(known, "part", "left").filter("open + if(first, coalesce(carry, 0), 0) <= 0")
    else:
        found = found.filter("open <= 0")
    return found.select("tab", "row_id", "t").unionByName(refs.filter("t IS NULL").select("tab", "row_id", "t"))


def _ref_tables(edges: DataFrame, items: DataFrame) -> list[tuple[DataFrame, str, str, str]]:
    return [(edges, "edge_id", "target_id", "indexed_at"), (items, "item_id", "node_id", "packed_at")]


NAMES = ("graph_edges", "context_items")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("ref_table", F.when(F.col("tab") == 0, NAMES[0]).otherwise(NAMES[1]))


def _all_nodes(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select("id", "is_placeholder", "indexed_at", "removed_at") for t in tables])


def orphans(graph_nodes: DataFrame, core_nodes: DataFrame, edges: DataFrame, items: DataFrame, partitions: int | None = None) -> DataFrame:
    """(ref_table, row_id, t): the direct orphans of graph_edges.target_id and context_items.node_id; t is the row's time in microseconds."""
    found = missing_at(_all_nodes(graph_nodes, core_nodes), references(_ref_tables(edges, items)), partitions)
    return _named(found).select("ref_table", "row_id", "t")


def cascade(graph_nodes: DataFrame, core_nodes: DataFrame, edges: DataFrame, items: DataFrame, structural: tuple[str, ...] = STRUCTURAL, partitions: int | None = None) -> DataFrame:
    """(ref_table, row_id, kind, round, t): direct orphans (round 0) and inherited ones.

    An orphaned row of a structural type orphans the record that it belongs to (its source_id); every row that names
    such a record is an inherited orphan, of the round after, and cascades in turn if it is structural, until none is
    new. A row is reported once, in its first round; repeated rows with one id and time are one.
    """
    refs = references(_ref_tables(edges, items))
    direct = stored(missing_at(_all_nodes(graph_nodes, core_nodes), refs, partitions).distinct(), "cascade")
    own = edges.filter(F.col("type").isin(*structural) & is_id(F.col("source_id")) & is_id(F.col("target_id")))
    own = stored(own.select(F.lit(0).cast("byte").alias("tab"), F.col("edge_id").cast("long").alias("row_id"), digest(F.col("source_id")).alias("id"), digest(F.col("target_id")).alias("parent")), "owners")
    broken = own.join(direct.filter("tab = 0").select("row_id").distinct(), "row_id", "left_semi").select("id").distinct()
    known = stored(rounds(own.select("id", "parent").distinct(), stored(broken, "broken")), "cascade")
    named = split_join(refs.withColumn("id", digest(F.col("ref"))).drop("ref"), known, "id").drop("id")
    inherited = named.join(direct, ["tab", "row_id"], "left_anti").groupBy("tab", "row_id", "t").agg(F.min("round").alias("round"))
    out = lambda df, kind: _named(df).select("ref_table", "row_id", F.lit(kind).alias("kind"), F.col("round").cast("int").alias("round"), "t")
    return out(direct.withColumn("round", F.lit(0)), "direct").unionByName(out(inherited, "inherited"))


def rounds(links: DataFrame, broken: DataFrame) -> DataFrame:
    """(id, round) of every record that hangs on a broken one: 1 for broken(id) themselves, else 1 more than the least of its parents in links(id, parent).

    Records with one parent form chains, however long: pointer jumping takes each to the first record above that is
    broken, has several parents, or has none. Only between the records with several parents, the semi-joins of the
    fixpoint are iterated, with the lengths of the chains between them, as long as a round finds a shorter way.
    """
    # A parent that is neither broken nor a child of any can't break: links to such roots say nothing.
    live = stored(links.select(F.col("id").alias("parent")).unionByName(broken.select(F.col("id").alias("parent"))).distinct(), "live")
    links = stored(split_join(links, live, "parent", "left_semi"), "links")
    firsts = broken.select("id", F.lit(True).alias("broken"))
    ways = links.groupBy("id").agg(F.count("*").alias("n"), F.min("parent").alias("parent")).join(firsts, "id", "left").filter("broken IS NULL")
    ways = stored(ways.select("id", "n", "parent"), "ways")
    chain = ways.filter("n = 1").select("id", F.col("parent").alias("ptr"))
    goes_on = chain.select(F.col("id").alias("ptr"), F.lit(False).alias("done"))
    none = F.array().cast("array<string>")
    walk = split_join(chain, goes_on, "ptr", "left").select("id", "ptr", F.lit(1).cast("long").alias("d"), F.col("id").alias("low"), none.alias("path"), F.coalesce("done", F.lit(True)).alias("done"), F.lit(False).alias("at_root"))
    ended, endless, _ = jump(walk, "chains")
    ended = stored(ended.select("id", F.col("ptr").alias("top"), "d"), "chains")
    # What hangs on an endless chain alone hangs on a cycle without a broken record.
    several = links.join(ways.filter("n > 1").select("id"), "id", "left_semi").join(endless.select(F.col("id").alias("parent")), "parent", "left_anti")
    over = split_join(several.withColumnRenamed("parent", "ptr"), ended.select(F.col("id").alias("ptr"), "top", "d"), "ptr", "left")
    arcs = stored(over.select("id", F.coalesce("top", "ptr").alias("top"), (F.lit(1) + F.coalesce("d", F.lit(0))).alias("d")).groupBy("id", "top").agg(F.min("d").alias("d")), "arcs")
    fresh, n = stored_with(broken.select("id", F.lit(1).cast("long").alias("round")), "fresh", F.lit(True))
    found = [fresh]
    while n:
        step = split_join(arcs.withColumnRenamed("id", "child"), fresh.withColumnRenamed("id", "top"), "top").groupBy(F.col("child").alias("id")).agg(F.min(F.col("round") + F.col("d")).alias("round"))
        before = union(found).groupBy("id").agg(F.min("round").alias("old"))
        fresh, n = stored_with(step.join(before, "id", "left").filter("old IS NULL OR round < old").select("id", "round"), "fresh", F.lit(True))
        found.append(fresh)
        if len(found) > 8:
            found = [stored(union(found).groupBy("id").agg(F.min("round").alias("round")), "found")]
    tops = stored(union(found).groupBy("id").agg(F.min("round").alias("round")), "found")
    below = split_join(ended, tops.withColumnRenamed("id", "top"), "top").select("id", (F.col("d") + F.col("round")).alias("round"))
    return tops.unionByName(below)


def orphan_report(found: DataFrame) -> DataFrame:
    """(ref_table, period, kind, n) of cascade()'s rows; period is the row's month as yyyy-MM, null if it has no time."""
    month = F.date_format(F.timestamp_micros(F.col("t")), "yyyy-MM")
    return found.groupBy("ref_table", month.alias("period"), "kind").agg(F.count("*").alias("n"))
