"""Processing only what is new since the last successful run, by a ledger of work items.

An item is pending, leased or done. A lease is a file made exclusively, numbered with the item's next fencing token;
after its expiry the item is pending again and the next lease has a higher token. Work is written to a path that the
item and the token determine: a retry under one lease overwrites what a failed try left, and a writer that was overtaken
can only write to its own path, which nobody reads. Done is one more exclusive file, refused to any token but the
highest; it names the paths that count, so publishing them is one step.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbograph.runtime import delete, scratch_path


class StaleLease(RuntimeError):
    """The lease was overtaken, or its item is done."""


@dataclass(frozen=True)
class Lease:
    item: str
    token: int
    owner: str
    expires: float


class Ledger:
    """A ledger in a folder that all processes share (any file system that Spark reaches)."""

    def __init__(self, spark: SparkSession, root: str, lease_seconds: float = 3600, clock: Callable[[], float] = time.time):
        jvm = spark._jvm
        self.spark, self.root, self.lease_seconds, self.clock = spark, root.rstrip("/"), lease_seconds, clock
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/items"))

    def _make(self, name: str, content: str) -> bool:
        """Makes a file, false if there is one."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self._fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if "Exist" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def add(self, items: list[str]) -> None:
        """Puts items on the ledger; those that are on it already stay as they are."""
        for item in items:
            self._fs.mkdirs(self._path(f"{self.root}/items/{item}"))

    def items(self) -> list[str]:
        return self._names(f"{self.root}/items")

    def _leases(self, item: str) -> list[int]:
        return sorted(int(n.partition("-")[2]) for n in self._names(f"{self.root}/items/{item}") if n.startswith("lease-"))

    def state(self, item: str) -> str:
        """pending, leased or done."""
        if "done" in self._names(f"{self.root}/items/{item}"):
            return "done"
        tokens = self._leases(item)
        if tokens and not self._released(item, tokens[-1]):
            text = self._read(f"{self.root}/items/{item}/lease-{tokens[-1]:08d}")
            # A lease whose writer died before it wrote the expiry counts as expired.
            if text and json.loads(text)["expires"] > self.clock():
                return "leased"
        return "pending"

    def _released(self, item: str, token: int) -> bool:
        return f"released-{token:08d}" in self._names(f"{self.root}/items/{item}")

    def lease(self, item: str, owner: str) -> Lease | None:
        """A lease of a pending item, None if it is not pending or another writer was quicker."""
        if self.state(item) != "pending":
            return None
        token = ([0] + self._leases(item))[-1] + 1
        got = Lease(item, token, owner, self.clock() + self.lease_seconds)
        return got if self._make(f"{self.root}/items/{item}/lease-{token:08d}", json.dumps(got.__dict__)) else None

    def release(self, lease: Lease) -> None:
        """Gives an item back before its lease expires."""
        self._make(f"{self.root}/items/{lease.item}/released-{lease.token:08d}", lease.owner)

    def check(self, lease: Lease) -> None:
        """Raises StaleLease if a later token is out."""
        if self._leases(lease.item)[-1] != lease.token:
            raise StaleLease(f"{lease.item}: token {lease.token} was overtaken")

    def finish(self, lease: Lease, note: str = "") -> None:
        """Marks the item done, with the highest token only."""
        self.check(lease)
        if not self._make(f"{self.root}/items/{lease.item}/done", json.dumps({"token": lease.token, "note": note})):
            raise StaleLease(f"{lease.item} is done already")

    def note(self, item: str) -> str:
        return json.loads(self._read(f"{self.root}/items/{item}/done"))["note"]


def ok_runs(runs: DataFrame) -> list[tuple[int, int]]:
    """(run_id, cutoff in microseconds) of the runs of status ok in the order of their cutoffs. The runs are a control table of bounded size."""
    rows = runs.filter("status = 'ok' AND cutoff_at IS NOT NULL AND run_id IS NOT NULL").select("run_id", F.unix_micros(F.col("cutoff_at").cast("timestamp")).alias("c")).distinct().collect()
    return sorted(((r.run_id, r.c) for r in rows), key=lambda x: (x[1], x[0]))


def _versions(feed: DataFrame) -> DataFrame:
    """The feed's rows that count, as (node_id, v, arrived): v orders the versions of a node and holds its state."""
    counts = "node_id IS NOT NULL AND arrived_at IS NOT NULL AND (op = 'delete' OR op = 'upsert' AND content_hash IS NOT NULL)"
    live = F.col("op") == "upsert"
    return feed.filter(counts).select("node_id", F.struct("changed_at", "seq", live.alias("live"), F.when(live, F.col("file")).alias("file"), F.when(live, F.col("content_hash")).alias("content_hash")).alias("v"), F.unix_micros(F.col("arrived_at").cast("timestamp")).alias("arrived"))


def changes(feed: DataFrame, wave: list[tuple[int, int]], since: int | None, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """For consecutive runs (id, cutoff): the nodes whose state each changed, and the latest versions of the nodes with new rows.

    Only feed rows that arrived after `since` (the cutoff of the last done run) are read; before(node_id, v) has the
    versions then, several of a node if it was written several times. A node's versions are folded to one per run before
    the running maximum, so a hot node costs a row per run.
    """
    cutoffs = F.array(*[F.lit(c).cast("long") for _, c in wave])
    ids = F.array(*[F.lit(r).cast("long") for r, _ in wave])
    new = _versions(feed)
    if since is not None:
        new = new.filter(F.col("arrived") > since)
    new = new.filter(F.col("arrived") <= wave[-1][1]).withColumn("step", F.size(F.filter(cutoffs, lambda c: c < F.col("arrived")))).groupBy("node_id", "step").agg(F.max("v").alias("v"))
    if before is not None:
        new = new.unionByName(before.join(new.select("node_id").distinct(), "node_id", "left_semi").groupBy("node_id").agg(F.max("v").alias("v")).withColumn("step", F.lit(-1)))
    along = Window.partitionBy("node_id").orderBy("step")
    top = new.withColumn("v", F.max("v").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    old = F.lag("v").over(along)
    state = lambda v: F.when(v["live"], F.struct(v["file"].alias("file"), v["content_hash"].alias("content_hash")))
    found = top.withColumn("old", old).filter("step >= 0").filter(~state(F.col("v")).eqNullSafe(state(F.col("old"))))
    changed = found.select(F.element_at(ids, F.col("step") + 1).alias("run_id"), "node_id")
    return changed, new.groupBy("node_id").agg(F.max("v").alias("v"))


class IncrementalFeed:
    """Replays the ok runs over a feed, each exactly once, whatever failed in between.

    Items are waves of consecutive runs, named by the place of their first run, so that one wave at most is pending or
    leased. A wave's rows go to changes/<place>-<first>-<last>-<token>; the versions of the nodes that it touched go to
    state/ under the same name, as a delta that lies over those before. One exclusive mark, which names the runs and all
    paths that count, makes the whole wave done at once. Every `fold` deltas are folded to one, so that writing follows
    the changes and reading has few folders. What was folded, or left by overtaken leases, is deleted afterwards.
    """

    def __init__(self, spark: SparkSession, root: str, wave: int = 24, lease_seconds: float = 3600, clock: Callable[[], float] = time.time, fold: int = 8):
        self.ledger, self.wave, self.spark, self.root, self.fold = Ledger(spark, root, lease_seconds, clock), wave, spark, root.rstrip("/"), fold

    def _done(self) -> list[dict]:
        """The notes of the done waves in their order: runs, changes, states."""
        notes: list[dict] = []
        at = 0
        while self.ledger.state(item := f"wave-{at:08d}") == "done":
            notes.append(json.loads(self.ledger.note(item)))
            at += len(notes[-1]["runs"])
        return notes

    def process(self, feed: DataFrame, runs: list[tuple[int, int]], owner: str = "worker", fail: Callable[[str], None] = lambda at: None) -> int:
        """Handles what is pending, in order; the number of runs handled. fail is called between the steps (tests make it raise)."""
        notes = self._done()
        done = [tuple(r) for n in notes for r in n["runs"]]
        if done != runs[: len(done)]:
            raise ValueError(f"the {len(done)} runs that are done are no longer the first ones")
        states: list[str] = notes[-1]["states"] if notes else []
        handled = 0
        for i in range(len(done), len(runs), self.wave):
            part = runs[i : i + self.wave]
            item = f"wave-{i:08d}"
            self.ledger.add([item])
            lease = self.ledger.lease(item, owner)
            if lease is None:
                return handled
            name = lambda token: f"{i:08d}-{part[0][0]}-{part[-1][0]}-{token:08d}"  # noqa: B023, E731
            own = name(lease.token)
            before = self.spark.read.parquet(*states) if states else None
            changed, latest = changes(feed, part, runs[i - 1][1] if i else None, before)
            fail("leased")
            changed.write.mode("overwrite").parquet(f"{self.root}/changes/{own}")
            fail("changes written")
            if before is not None and len(states) >= self.fold:
                latest = latest.unionByName(before).groupBy("node_id").agg(F.max("v").alias("v"))
                folded, states = states, []
            else:
                folded = []
            latest.write.mode("overwrite").parquet(f"{self.root}/state/{own}")
            fail("state written")
            states = [*states, f"{self.root}/state/{own}"]
            self.ledger.finish(lease, json.dumps({"runs": part, "changes": f"{self.root}/changes/{own}", "states": states}))
            delete(self.spark, *folded, *[f"{self.root}/{kind}/{name(t)}" for t in range(1, lease.token) for kind in ("changes", "state")])
            handled += len(part)
        return handled

    def result(self) -> DataFrame:
        """(run_id, node_id) of all done runs."""
        paths = [n["changes"] for n in self._done()]
        return self.spark.read.schema("run_id long, node_id string").parquet(*paths) if paths else self.spark.createDataFrame([], "run_id long, node_id string")


def changed_nodes(feed: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, node_id): what each ok run of runs had to handle, by a fresh ledger in the shared folder. No ok run, no rows."""
    spark = feed.sparkSession
    engine = IncrementalFeed(spark, scratch_path(spark, "ledger"))
    engine.process(feed, ok_runs(runs))
    return engine.result()
