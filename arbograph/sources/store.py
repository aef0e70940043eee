"""The stored graph of a source tree and its incremental update.

A store is a folder of versions. A version is one small file, made exclusively, that names the paths it consists of:
the rows that each file gave (nodes, edges), in deltas; the file index; the folded graph; and the meta values. Readers
take the highest version, so an update is seen whole or not at all, and of two writers one is refused.

An update scans the tree, compares content hashes with the index, and parses only files that were added, changed or
marked dirty. Their rows are a new delta; of each file only the delta that its index entry names counts. A file that
does not parse keeps its old rows and its old entry, so that it is tried again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbograph.functions import naming
from arbograph.operators import extract
from arbograph.operators.graph import EDGE, NODE, Graph
from arbograph.operators.ledger import Ledger
from arbograph.runtime import delete, stored, union
from arbograph.sources import facts, scan

INDEX = "path string, content_hash string, indexed_at long, module string, line_count int, is_dirty boolean, delta long"
NODES = "id string, type string, fqcn string, name string, file string, line int, end_line int, module string, metadata string, is_placeholder boolean, file_seq string, delta long"
EDGES = "source_id string, target_id string, type string, metadata string, file string, seq int, fact int, delta long"
SCHEMA_VERSION = "1"
#: Deltas that are folded to one.
FOLD = 8


class Conflict(RuntimeError):
    """Another writer was quicker."""


@dataclass
class UpdateResult:
    files_scanned: int = 0
    files_errored: int = 0
    nodes_added: int = 0
    nodes_removed: int = 0
    edges_added: int = 0
    edges_removed: int = 0
    duration_ms: int = 0
    errors: list[dict] = field(default_factory=list)
    no_changes: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)


class GraphStore:
    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock
        self._files = Ledger(spark, f"{self.folder}/store")

    # -- versions

    def _version(self) -> tuple[int, dict]:
        names = [n for n in self._files._names(f"{self.folder}/store/versions") if n.endswith(".json")]
        if not names:
            return 0, {"deltas": [], "index": None, "graph": None, "meta": {}}
        return int(names[-1][:-5]), json.loads(self._files._read(f"{self.folder}/store/versions/{names[-1]}"))

    def _publish(self, number: int, content: dict) -> None:
        if not self._files._make(f"{self.folder}/store/versions/{number:010d}.json", json.dumps(content)):
            raise Conflict(f"version {number} of {self.folder} exists already")

    @staticmethod
    def is_store(spark: SparkSession, folder: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/store/versions")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, path: str | None, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    # -- what is stored

    def graph(self) -> Graph:
        at = self._version()[1]["graph"]
        if not at:
            empty = self.spark.createDataFrame([], NODES).select(*NODE)
            return Graph(empty, self.spark.createDataFrame([], EDGES).select(*EDGE))
        return Graph(*scan.read_graph(self.spark, at))

    def index(self) -> DataFrame:
        """(path, content_hash, indexed_at, module, line_count, is_dirty) of the indexed files."""
        return self._read(self._version()[1]["index"], INDEX).drop("delta")

    def indexed(self, path: str) -> DataFrame:
        return self.index().filter(F.col("path") == path)

    def dirty(self) -> DataFrame:
        return self.index().filter("is_dirty")

    def mark_dirty(self, paths: DataFrame) -> None:
        """The files of paths(path) are parsed by the next update, changed or not."""
        number, now = self._version()
        marks = paths.select("path").distinct().withColumn("mark", F.lit(True))
        index = self._read(now["index"], INDEX).join(marks, "path", "left").withColumn("is_dirty", F.col("is_dirty") | F.coalesce("mark", F.lit(False))).drop("mark")
        self._publish(number + 1, now | {"index": self._write(index, number + 1, "index")})

    def meta(self, key: str | None = None):
        """The value of a meta key, None if it has none; without a key all of them."""
        values = self._version()[1]["meta"]
        return values if key is None else values.get(key)

    def set_meta(self, key: str, value: str) -> None:
        number, now = self._version()
        self._publish(number + 1, now | {"meta": now["meta"] | {key: value}})

    def truncate(self) -> None:
        """An empty version: no nodes, edges, files and meta."""
        number, _ = self._version()
        self._publish(number + 1, {"deltas": [], "index": None, "graph": None, "meta": {}})

    # -- updates

    def _write(self, df: DataFrame, number: int, what: str) -> str:
        path = f"{self.folder}/store/data/{what}-{number:010d}"
        df.write.mode("overwrite").parquet(path)
        return path

    def full_build(self, root: str, ignore: tuple[str, ...] = naming.IGNORED, extractors=None) -> UpdateResult:
        self.truncate()
        return self.update(root, ignore, extractors)

    def update(self, root: str, ignore: tuple[str, ...] = naming.IGNORED, extractors=None) -> UpdateResult:
        """Brings the graph to what the tree under root is now, see update_from()."""
        return self.update_from(scan.scan_tree(self.spark, root, ignore=ignore), extractors)

    def update_from(self, tree: DataFrame, extractors=None) -> UpdateResult:
        """Brings the graph to what tree(path, content_hash, content, module, line_count) is; parses only what is new, changed or dirty. One version, published at the end."""
        began = time.monotonic()
        number, now = self._version()
        index = self._read(now["index"], INDEX)
        hashes = index.select("path", F.when(F.col("is_dirty"), F.lit(None)).otherwise(F.col("content_hash")).alias("content_hash"))
        changes = stored(scan.classify(tree.select("path", "content_hash"), hashes), "changes")
        scanned = changes.count()
        if not scanned and now["graph"]:
            return UpdateResult(no_changes=True, duration_ms=int((time.monotonic() - began) * 1000))
        fresh = tree.join(changes.filter("status != 'deleted'").select("path"), "path", "left_semi")
        read = stored(facts.file_facts(fresh.withColumnRenamed("path", "file")), "facts")
        errors = stored(read.filter("kind = 'error'").select("file", "line").distinct(), "errors")
        delta = number + 1
        nodes, edges = extract.extract_rows(read.filter("kind != 'error'"), extractors)
        deltas = [*now["deltas"], delta]
        at = lambda what: [f"{self.folder}/store/data/{what}-{d:010d}" for d in deltas]
        self._write(nodes.withColumn("delta", F.lit(delta).cast("long")), delta, "nodes")
        self._write(edges.withColumn("delta", F.lit(delta).cast("long")), delta, "edges")
        # Files that do not parse keep their entry, if they had one; the others get a new one that names this delta.
        parsed = fresh.join(errors.select(F.col("file").alias("path")), "path", "left_anti")
        entries = parsed.select("path", "content_hash", F.lit(int(self.clock())).cast("long").alias("indexed_at"), "module", F.col("line_count").cast("int"), F.lit(False).alias("is_dirty"), F.lit(delta).cast("long").alias("delta"))
        gone = changes.filter("status = 'deleted'").select("path").unionByName(parsed.select("path"))
        index_path = self._write(index.join(gone, "path", "left_anti").unionByName(entries), delta, "index")
        live = self._read(index_path, INDEX).select("path", "delta")
        rows = {}
        for what, schema, owner in (("nodes", NODES, "file_seq"), ("edges", EDGES, "file")):
            both = union([self.spark.read.schema(schema).parquet(p) for p in at(what)])
            rows[what] = both.join(live.withColumnRenamed("path", owner), [owner, "delta"], "left_semi")
        folded = []
        if len(deltas) > FOLD:
            folded = [p for what in rows for p in at(what)]
            for what in rows:
                self._write(rows[what].withColumn("delta", F.lit(delta + 1).cast("long")), delta + 1, what)
                rows[what] = self.spark.read.schema(NODES if what == "nodes" else EDGES).parquet(f"{self.folder}/store/data/{what}-{delta + 1:010d}")
            index_path = self._write(self._read(index_path, INDEX).withColumn("delta", F.lit(delta + 1).cast("long")), delta + 1, "index")
            deltas, delta = [delta + 1], delta + 1
        folder = f"{self.folder}/store/data/graph-{delta:010d}"
        graph = extract.fold(rows["nodes"].drop("delta"), rows["edges"].drop("delta"))
        scan.write_graph(graph.nodes, graph.edges, folder)
        before, after = self.graph(), Graph(*scan.read_graph(self.spark, folder))
        counts = _counts(before, after)
        failed = [{"file": r.file, "message": f"line {r.line}: syntax error"} for r in errors.orderBy("file").limit(100).collect()]  # shown to people
        meta = now["meta"] | {"last_update": str(int(self.clock())), "total_nodes": str(after.nodes.count()), "total_edges": str(after.edges.count()), "schema_version": SCHEMA_VERSION}
        self._publish(delta, {"deltas": deltas, "index": index_path, "graph": folder, "meta": meta})
        if folded:
            delete(self.spark, *folded)
        return UpdateResult(scanned, errors.count(), **counts, duration_ms=int((time.monotonic() - began) * 1000), errors=failed)


def _counts(before: Graph, after: Graph) -> dict[str, int]:
    """How many nodes and edges came and went."""
    key = {"nodes": ["id"], "edges": ["source_id", "target_id", "type"]}
    out = {}
    for what, on in key.items():
        a, b = getattr(before, what).select(*on), getattr(after, what).select(*on)
        out[f"{what}_added"], out[f"{what}_removed"] = b.join(a, on, "left_anti").count(), a.join(b, on, "left_anti").count()
    return out


def open_graph(spark: SparkSession, folder: str) -> Graph:
    """The graph of a store, or of a folder written by write_graph()."""
    return GraphStore(spark, folder).graph() if GraphStore.is_store(spark, folder) else Graph(*scan.read_graph(spark, folder))


def refresh(store: GraphStore, root: str | None, ignore: tuple[str, ...] = naming.IGNORED) -> str | None:
    """Updates a store before it is read, if its tree is known; a failure never blocks reading: its message is returned."""
    if not root:
        return None
    try:
        store.update(root, ignore)
    except Exception as e:  # noqa: BLE001
        return f"not refreshed: {e}"
    return None
