"""Live refresh: a stream of node_feed rows or of source files kept as the current state, exactly as a batch would have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def current_state(feed: DataFrame) -> DataFrame:
    """(node_id, file, content_hash) of the nodes that are there after all rows of a feed."""
    counts = "node_id IS NOT NULL AND (op = 'delete' OR op = 'upsert' AND content_hash IS NOT NULL)"
    v = F.struct("changed_at", "seq", (F.col("op") == "upsert").alias("live"), "file", "content_hash")
    return feed.filter(counts).groupBy("node_id").agg(F.max(v).alias("v")).filter("v.live").select("node_id", "v.file", "v.content_hash")


def _versions(feed: DataFrame) -> DataFrame:
    v = F.struct("changed_at", "seq", (F.col("op") == "upsert").alias("live"), "file", "content_hash")
    return feed.filter("node_id IS NOT NULL AND (op = 'delete' OR op = 'upsert' AND content_hash IS NOT NULL)").groupBy("node_id").agg(F.max(v).alias("v"))


#: Batches after which the state is folded to one folder.
FOLD = 16


def _folders(target: str, number: int) -> list[str]:
    """The folders that the state after a batch consists of: from the last fold on."""
    return [f"{target}/batch={n}" for n in range(max(0, number // FOLD * FOLD - 1), number + 1)]


def watch(spark: SparkSession, source: str, schema, target: str, checkpoint: str, once: bool = True, seconds: int = 2) -> StreamingQuery:
    """Follows a folder of feed files; target/batch=<n> holds the versions that batch n brought and is overwritten by a retry of it.

    Every FOLD-th batch folds those before it into its own folder, so that writing follows the changes and reading has few
    folders. once handles what is there and stops; else the folder is looked at every few seconds.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = _versions(batch)
        if number % FOLD == FOLD - 1:
            new = new.unionByName(spark.read.parquet(*_folders(target, number - 1))).groupBy("node_id").agg(F.max("v").alias("v"))
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(source)
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def watched_state(spark: SparkSession, target: str, number: int) -> DataFrame:
    """The state after a batch of watch()."""
    rows = spark.read.parquet(*_folders(target, number)).groupBy("node_id").agg(F.max("v").alias("v"))
    return rows.filter("v.live").select("node_id", "v.file", "v.content_hash")


def watch_tree(update: Callable[[], None], spark: SparkSession, seconds: int = 2) -> StreamingQuery:
    """Calls update every few seconds, never twice at once. A source of files reports no deletions, so update compares the whole tree with the index."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _batch, _number: update()).trigger(processingTime=f"{seconds} seconds").start()
