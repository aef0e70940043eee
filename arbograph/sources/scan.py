"""Reading source trees: scan with pruning and ignore patterns, content hashes, change detection and the graph's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbograph.functions import naming
from arbograph.operators.graph import EDGE, NODE, diff_files

NODE_SCHEMA = "id string, fqcn string, name string, file string, line int, end_line int, module string, metadata string, is_placeholder boolean, type string"
EDGE_SCHEMA = "source_id string, target_id string, metadata string, type string"


def read_ignore_file(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The default patterns and those of an ignore file, a short list; a missing file has none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    text = ""
    if fs.exists(at):
        stream = fs.open(at)
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    return (*naming.IGNORED, *(p.strip() for p in text.splitlines() if p.strip() and not p.strip().startswith("#")))


def scan_tree(spark: SparkSession, root: str, glob: str = "*.php", ignore: tuple[str, ...] = naming.IGNORED) -> DataFrame:
    """(path, content_hash, content, module, line_count) of a tree's files; path is relative to root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    prefix = root.rstrip("/").removeprefix("file:") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in prefix), "")
    rows = files.select(path.alias("path"), F.sha2("content", 256).alias("content_hash"), F.col("content").cast("string").alias("content"))
    rows = rows.filter(~naming.is_pruned(F.col("path")) & ~naming.is_ignored(F.col("path"), ignore))
    return rows.withColumns({"module": naming.module_of_path(F.col("path")), "line_count": F.size(F.split("content", "\n"))})


def classify(current: DataFrame, index: DataFrame) -> DataFrame:
    """(path, status): added, modified or deleted files of a scan against the index; newly ignored files count as deleted."""
    return diff_files(index, current)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A snapshot of the graph: nodes by type, edges by type, so that reads of a type touch its files only."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """What write_graph() wrote, empty tables too."""
    nodes, edges = spark.read.schema(NODE_SCHEMA).parquet(f"{folder}/nodes"), spark.read.schema(EDGE_SCHEMA).parquet(f"{folder}/edges")
    return nodes.select(*NODE), edges.select(*EDGE)
