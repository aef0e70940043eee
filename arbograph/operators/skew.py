"""Per-key results where a few keys hold most rows, by exact offset chunking.

(1) Rows that are equal in key and value are counted within each input partition, before any row moves. (2) A prefix
sum over these counts, in the order (key, value, input partition), gives each its offset: its rows are numbered
offset, offset + 1 and so on over the whole table. (3) The numbers are cut into chunks of equal size, whatever the
keys are: a chunk holds a part of a hot key or many rare ones, and one task handles it. (4) A chunk's first and last
key may go on in its neighbours, so they leave boundary states (rows, different values, first and last value), which
are merged in the order of the chunks: a value on both sides of a boundary is taken off once. All other keys are
complete in their chunk.

The counts of a hot key are one a value and input partition, the boundary states two a chunk: no task ever holds more
than its share, and neither does the driver, which sees one number a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbograph.runtime import hashed, is_id, stored, width

CHUNK = 65_536
_KEY = ["side", "node_id"]
_VALUE = ["valid", "o1", "o2"]


def side_rows(edges: DataFrame, source: str = "source_id", target: str = "target_id", values: bool = True) -> DataFrame:
    """Both sides of every edge as (side, node_id, valid, o1, o2): the key, null where it is no id, and the counterpart as 128 bits.

    side is 0 for source and 1 for target. Counterparts that are no ids are not valid. Without values every row has the same.
    """

    def one(code: int, own: str, other: str):
        key = F.when(is_id(F.col(own)), F.col(own)).alias("node_id")
        if not values:
            return F.struct(F.lit(code).cast("byte").alias("side"), key, F.lit(False).alias("valid"), F.lit(0).cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"))
        valid, h = is_id(F.col(other)), hashed(F.col(other))
        o1, o2 = (F.when(valid, x).otherwise(F.lit(0)) for x in h)
        return F.struct(F.lit(code).cast("byte").alias("side"), key, valid.alias("valid"), o1.alias("o1"), o2.alias("o2"))

    return edges.select(F.explode(F.array(one(0, source, target), one(1, target, source))).alias("r")).select("r.*")


def counted(rows: DataFrame) -> DataFrame:
    """(*rows, part, n): the equal rows of each input partition, counted there before the shuffle."""
    return rows.withColumn("part", F.spark_partition_id()).groupBy(*rows.columns, "part").agg(F.count("*").alias("n"))


def _running(schema: pa.Schema, n_at: int):
    """Adds the running sum of n within a partition; its total is one more row, at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, first_side = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            n = batch.column(n_at).to_numpy(zero_copy_only=False)
            sums = np.cumsum(n)
            first_side += int(n[batch.column(0).to_numpy(zero_copy_only=False) == 0].sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(size, part, np.int32)), pa.array(total + sums - n), pa.array(np.zeros(size, bool))], schema=schema)
            total += int(sums[-1])
        if total:
            last = {"slice": part, "before": first_side, "n": total, "is_total": True}
            yield pa.RecordBatch.from_arrays([pa.array([last.get(f.name)], f.type) for f in schema], schema=schema)

    return run


def numbered(counts: DataFrame, partitions: int | None = None) -> tuple[DataFrame, int]:
    """The counts with `at`, the number of their first row in the order of their columns; and the rows of side 0.

    The order's last column is the input partition, by which no two counts are equal: a range shuffle splits any key.
    """
    spark = counts.sparkSession
    order = [c for c in counts.columns if c != "n"]
    kinds = {"byte": pa.int8(), "tinyint": pa.int8(), "string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32()}
    more = [("slice", "int"), ("before", "bigint"), ("is_total", "boolean")]
    fields = [(f.name, f.dataType.simpleString()) for f in counts.schema] + more
    schema = pa.schema([(n, kinds[t]) for n, t in fields])
    ranged = counts.repartitionByRange(partitions or width(spark), *order).sortWithinPartitions(*order)
    swept = stored(ranged.mapInArrow(_running(schema, counts.columns.index("n")), ", ".join(f"{n} {t}" for n, t in fields)), "numbered")
    totals = sorted((r.slice, r.n, r.before) for r in swept.filter("is_total").select("slice", "n", "before").collect())  # one row a partition
    offset, base = 0, []
    for part, n, _ in totals:
        base.append((part, offset))
        offset += n
    bases = F.broadcast(spark.createDataFrame(base, "slice int, base long"))  # as many rows as partitions at most
    return swept.filter("NOT is_total").join(bases, "slice").select(*counts.columns, (F.col("base") + F.col("before")).alias("at")), sum(t[2] for t in totals)


def chunk_states(at: DataFrame, chunk: int = CHUNK, partitions: int | None = None) -> DataFrame:
    """(chunk, side, node_id, n, d, first, last, edge): of each key of each chunk its rows, its different valid values, and its least and greatest value.

    A count whose numbers cross a chunk's end is cut there. edge marks the first and the last key of a chunk.
    """
    begin, end = F.col("at"), F.col("at") + F.col("n")
    cut = at.withColumn("chunk", F.explode(F.sequence(F.floor(begin / chunk), F.floor((end - 1) / chunk))))
    cut = cut.withColumn("n", F.least(end, (F.col("chunk") + 1) * chunk) - F.greatest(begin, F.col("chunk") * chunk))
    # One shuffle, by chunk; both aggregates and the window stay in its partitions.
    placed = cut.select("chunk", *_KEY, *_VALUE, "n").repartition(partitions or width(at.sparkSession), "chunk")
    values = placed.groupBy("chunk", *_KEY, *_VALUE).agg(F.sum("n").alias("n"))
    value, key = F.struct(*_VALUE), F.struct(*_KEY)
    states = values.groupBy("chunk", *_KEY).agg(F.sum("n").alias("n"), F.count_if("valid").alias("d"), F.min(value).alias("first"), F.max(value).alias("last"))
    own = Window.partitionBy("chunk")
    return states.withColumn("edge", (key == F.min(key).over(own)) | (key == F.max(key).over(own)))


def key_degrees(edges: DataFrame, source: str = "source_id", target: str = "target_id", chunk: int = CHUNK, partitions: int | None = None, counterparts: bool = True) -> DataFrame:
    """(side, node_id, n_edges, n_counterparts) for every id on either side of edges.

    Every row counts for n_edges, repeated rows and null or blank counterparts included; n_counterparts is the exact
    number of different counterparts that are ids, 0 if they are not asked for. Null and blank keys give no row; empty
    tables none either. Other columns of edges are never read, whatever their names.
    """
    return _degrees(edges, source, target, chunk, partitions, counterparts)[0]


def _degrees(edges: DataFrame, source: str, target: str, chunk: int, partitions: int | None, counterparts: bool) -> tuple[DataFrame, int]:
    rows = side_rows(edges.select(F.col(source).alias("source_id"), F.col(target).alias("target_id")), values=counterparts)
    at, total = numbered(counted(rows), partitions)
    states = stored(chunk_states(at, chunk, partitions), "chunk-states")
    inner = states.filter("NOT edge").select(*_KEY, "n", "d")
    edge = states.filter("edge")
    ends = edge.groupBy("chunk").agg(F.max(F.struct(*_KEY, "last")).alias("tail"), F.min(F.struct(*_KEY, "first")).alias("head"))
    tails = ends.select((F.col("chunk") + 1).alias("chunk"), "tail")
    # A value that ends one chunk and begins the next was counted in both; the join is one row a chunk on either side.
    same = (F.col("tail.side") == F.col("head.side")) & (F.col("tail.node_id") == F.col("head.node_id")) & (F.col("tail.last") == F.col("head.first")) & F.col("head.first.valid")
    again = ends.join(tails.withColumnRenamed("tail", "t"), "chunk").select("head", F.col("t").alias("tail")).filter(same).select(F.col("head.side").alias("side"), F.col("head.node_id").alias("node_id"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d"))
    merged = edge.select(*_KEY, "n", "d").unionByName(again).groupBy(*_KEY).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    found = inner.unionByName(merged).filter("node_id IS NOT NULL")
    return found.select(F.when(F.col("side") == 0, "source").otherwise("target").alias("side"), "node_id", F.col("n").alias("n_edges"), F.col("d").alias("n_counterparts")), total


def hot_keys(edges: DataFrame, per_hundred: int = 2, source: str = "source_id", target: str = "target_id", chunk: int = CHUNK, partitions: int | None = None) -> DataFrame:
    """(side, node_id) of the ids that stand in at least per_hundred of 100 rows of edges, all rows counted (the offsets give their number)."""
    degrees, total = _degrees(edges, source, target, chunk, partitions, False)
    return degrees.filter(F.col("n_edges") * 100 >= F.lit(per_hundred * total)).select("side", "node_id")
