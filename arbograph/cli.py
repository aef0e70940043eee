"""Command line: python -m arbograph.cli COMMAND [SUBJECT] --graph FOLDER ..."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbograph.operators import ask, score, traverse
from arbograph.operators import graph as G
from arbograph.operators.graph import Graph
from arbograph.operators.ledger import Ledger
from arbograph.runtime import release, stored
from arbograph.sources import connect, manifest, prompts, render, scan
from arbograph.sources.store import GraphStore, open_graph, refresh
from arbograph.streaming.watch import watch_tree

#: Rows of a Markdown table.
SHOWN = 1000
COMMANDS = ["generate", "stats", "show", "usages", "dependencies", "cross-module", "search", "find", "impact", "component-impact", "event-trace", "flow-trace", "context", "module", "diff", "ask", "capabilities", "hotspots", "doc-gaps", "intent", "watch"]


def _say(pieces: Iterator[str] | str, end: str = "\n") -> None:
    for p in [pieces] if isinstance(pieces, str) else pieces:
        print(p, end=end)


def _show(df: DataFrame, form: str, text: Callable[[], DataFrame] | None = None, kind: str = "row") -> None:
    """Prints a result: all rows as JSON, JSON lines, DOT edges or text lines, a partition at a time, or a Markdown table of SHOWN rows at most that says if there are more."""
    if form == "ndjson":
        _say(render.lines(render.ndjson(df, kind)))
    elif form == "json":
        _say(render.json_array(df), "")
        print()
    elif form == "dot":
        print("digraph g {")
        _say(render.lines(render.dot_edges(df)))
        print("}")
    elif form == "text" and text is not None:
        _say(render.lines(text()))
    else:
        print(render.markdown_table(df, SHOWN))


def _edges(g: Graph, edges: DataFrame, form: str) -> None:
    if form in ("json", "ndjson"):
        _show(render.edge_records(edges if "metadata" in edges.columns else edges.withColumn("metadata", F.lit("{}"))), form, kind="edge")
    else:
        _show(edges.select("source_id", "target_id", "type"), form, lambda: render.edge_lines(g, edges))


def _view(view: Graph, form: str, meta: dict) -> None:
    if form == "json":
        _say(render.view_json(view), "")
        print()
    elif form == "dot":
        _say(render.view_dot(view))
    elif form == "ndjson":
        _say(render.lines(render.ndjson(render.node_records(view.nodes), "node")))
        _say(render.lines(render.ndjson(render.edge_records(view.edges), "edge")))
    elif form == "markdown":
        print(render.view_markdown(view))
    else:
        print(render.view_summary(view, meta.get("last_update"), meta.get("schema_version")))


def stats(store: GraphStore | None, g: Graph) -> dict:
    """What is stored against what is there: files, nodes, edges and nodes by type."""
    meta = store.meta() if store else {}
    types = {r.type: r.n for r in g.count_by_type().orderBy(F.desc("n"), "type").collect()}
    edges = g.edges.count()
    return {"last_generated": meta.get("last_update"), "indexed_files": store.index().count() if store else 0, "total_nodes": int(meta.get("total_nodes") or 0), "live_nodes": sum(types.values()), "total_edges": int(meta.get("total_edges") or edges), "live_edges": edges, "node_counts": types}


def diff(g: Graph, folder: str, module: str | None = None) -> DataFrame:
    """The graph's numbers against those of the call before, which are kept beside the graph."""
    spark = g.nodes.sparkSession
    book = Ledger(spark, f"{folder.rstrip('/')}/stats")
    whole = [n for n in book._names(f"{book.root}/{module or ''}/snapshots") if book._fs.exists(book._path(f"{book.root}/{module or ''}/snapshots/{n}/_SUCCESS"))]
    at = lambda n: f"{book.root}/{module or ''}/snapshots/{n:08d}"
    last = int(whole[-1]) if whole else 0
    g.snapshot(module).write.mode("overwrite").parquet(at(last + 1))
    now = spark.read.parquet(at(last + 1))
    return G.diff_snapshots(spark.read.parquet(at(last)) if last else now.limit(0), now).orderBy("kind", "name")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="arbograph")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("subject", nargs="?", default="")
    parser.add_argument("--graph", default=None, help="folder of the graph; else that of the environment, else var/graph in the tree")
    parser.add_argument("--root", default=None, help="source tree: read by generate and watch, and looked at again before usages, dependencies, cross-module, search, find and impact")
    parser.add_argument("--full", action="store_true", help="generate: from scratch; watch: from scratch at the start")
    parser.add_argument("--no-refresh", action="store_true")
    parser.add_argument("--depth", type=int, default=None)
    parser.add_argument("--module", default=None)
    parser.add_argument("--type", default=None)
    parser.add_argument("--from", dest="from_", default=None)
    parser.add_argument("--to", default=None)
    parser.add_argument("--compact", action="store_true")
    parser.add_argument("--context", action="store_true", help="impact: the packed context instead of the list")
    parser.add_argument("--prompt", default=None, choices=list(prompts.PROMPTS), help="impact: a prompt over the packed context")
    parser.add_argument("--goal", default="")
    parser.add_argument("--vendor", default="")
    parser.add_argument("--include-code", action="store_true", help="event-trace, flow-trace: the files of the members too")
    parser.add_argument("--interval", type=int, default=2)
    parser.add_argument("--rounds", type=int, default=None, help="watch: ends after so many looks")
    parser.add_argument("--format", default="text", choices=["text", "summary", "markdown", "json", "ndjson", "dot", "old"])
    o = parser.parse_args(args)
    if o.depth is not None and o.depth < 1:
        parser.error("--depth must be 1 or more")
    if not o.graph and not o.root:
        parser.error("--graph or --root is needed")
    spark = spark or SparkSession.builder.appName("arbograph").getOrCreate()
    folder = connect.graph_folder(o.root or ".", o.graph)
    ignore = scan.read_ignore_file(spark, f"{o.root}/.graphignore") if o.root else ()
    if o.command in ("generate", "watch"):
        if not o.root or connect.real_path(spark, o.root) is None:
            parser.error(f"{o.command} needs --root, a folder that is there")
        try:
            return (_generate if o.command == "generate" else _watch)(GraphStore(spark, folder), o, ignore)
        finally:
            release(spark)
    is_store = GraphStore.is_store(spark, folder)
    store = GraphStore(spark, folder) if is_store or o.root else None
    if store and not o.no_refresh and o.command in ("usages", "dependencies", "cross-module", "search", "find", "impact") and (failed := refresh(store, o.root, ignore)):
        print(failed, file=sys.stderr)
    try:
        return _answer(open_graph(spark, folder), store, folder, o)
    finally:
        release(spark)


def _generate(store: GraphStore, o, ignore) -> int:
    got = store.full_build(o.root, ignore) if o.full else store.update(o.root, ignore)
    if o.format == "json":
        print(got.to_json())
    elif got.no_changes:
        print("The graph is up to date. No changes.")
    else:
        print(f"{'Full build' if o.full else 'Incremental update'}: {got.files_scanned} files, +{got.nodes_added}/-{got.nodes_removed} nodes, +{got.edges_added}/-{got.edges_removed} edges ({got.duration_ms} ms)")
        _say(f"  {e['file']}: {e['message']}" for e in got.errors)
    return 0


def _watch(store: GraphStore, o, ignore) -> int:
    left = [o.rounds]

    def look() -> None:
        got = store.full_build(o.root, ignore) if o.full and left[0] == o.rounds else store.update(o.root, ignore)
        if not got.no_changes:
            print(got.to_json(), flush=True)
        release(store.spark)
        if left[0] is not None:
            left[0] -= 1

    if o.rounds is not None:
        import time

        while left[0]:
            look()
            if left[0]:
                time.sleep(o.interval)
        return 0
    watch_tree(look, store.spark, o.interval).awaitTermination()
    return 0


def _answer(g: Graph, store: GraphStore | None, folder: str, o) -> int:
    spark, form = g.nodes.sparkSession, o.format
    target = g.resolve_target(o.subject).first() if o.subject else None
    own = target.id if target else o.subject
    start = spark.createDataFrame([(own,)], "id string")
    nodes = lambda df: _show(render.node_records(df), form, lambda: df.select(F.concat("fqcn", F.lit(" ("), "type", F.lit(")")).alias("line")), "node")
    if o.command in ("usages", "dependencies"):
        way, side = ("incoming", "source") if o.command == "usages" else ("outgoing", "target")
        found = traverse.touched_edges(g, start, way, o.depth or 1)
        if o.compact and form == "json":
            _say(render.compact_json(own, g.compact(found, side)), "")
            print()
        elif o.compact:
            groups = g.compact(found, side)
            _show(groups.orderBy("label"), form, lambda: render.compact_lines(groups))
        else:
            _edges(g, found.join(g.edges, ["source_id", "target_id", "type"]), form)
    elif o.command == "cross-module":
        _edges(g, g.cross_module(o.from_, o.to), form)
    elif o.command == "search":
        nodes(g.search(o.subject).drop("place"))
    elif o.command == "find":
        nodes(g.find(o.type, o.module, o.subject or None))
    elif o.command == "show":
        focus = own if o.subject else None
        _view(traverse.view(g, focus, tuple(o.type.split(",")) if o.type else None, o.module, o.depth or 3), form, store.meta() if store else {})
    elif o.command == "stats":
        numbers = stats(store, g)
        print(json.dumps(numbers) if form == "json" else "\n".join(f"{k}: {v}" for k, v in numbers.items()))
    elif o.command == "impact":
        _impact(g, own, start, o)
    elif o.command == "component-impact":
        component = g.resolve_component(o.subject).first()
        own = component.id if component else own
        risk = score.component_risk(g, own)
        found = stored(g.typed(traverse.dependents(g, own, score.DIRECT, score.FURTHER, o.depth or 2)), "dependents")
        home = g.node(own).select("module").first()
        away = found.join(g.nodes.select("id", "module"), "id").filter((F.col("module") != "") & (F.col("module") != (home.module if home else ""))).groupBy("module").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module")
        for df in (risk, found.orderBy("level", "id"), away, score.event_impact(g).filter(F.col("source_id") == own)):
            _show(df, form)
    elif o.command == "event-trace":
        event = ask.resolve_event(g, o.subject)
        rows = g.lifecycle(event) if g.exists(event) else g.event_info(event)
        if form in ("text", "summary", "markdown") and "mode" in rows.columns:
            print(render.lifecycle_markdown(event.partition(":")[2] or event, rows.collect()))
        else:
            _show(rows, form)
        if o.include_code:
            _show(_files(g, rows), form, kind="file")
    elif o.command == "flow-trace":
        _flow(g, o)
    elif o.command == "context":
        matches = stored(ask.task_matches(g, o.subject, o.module), "matches")
        parts = [("matched", matches.orderBy("id")), ("hotspots", ask.task_hotspots(g, matches))]
        if (o.depth or 2) >= 2:
            parts[1:1] = [("links", ask.task_links(g, matches).orderBy("role", "node_id", "other_id", "type"))]
        for kind, df in parts:
            if form != "ndjson":
                print(f"\n## {kind}\n")
            _show(df, form, kind=kind)
    elif o.command == "module":
        _module(g, o.module or o.subject, form)
    elif o.command == "diff":
        _show(diff(g, folder, o.module), form)
    elif o.command == "capabilities":
        made = manifest.build(g, o.type or "all", o.module, dt.datetime.now(dt.timezone.utc).isoformat(), store.meta() if store else None)
        print({"json": manifest.to_json, "old": lambda m: json.dumps(manifest.old_form(m)), "markdown": manifest.to_markdown}.get(form, manifest.to_text)(made))
    elif o.command == "intent":
        row = ask.intent(g, own).first()
        print(render.intent_markdown(own, row.metadata) if row else f"No intent is known of {own}.")
    elif o.command == "hotspots":
        spots = score.stored_hotspots(g, 15)
        if spots.isEmpty():
            _show(score.hotspots(score.class_risk(g), 15), form)
        elif form in ("text", "summary"):
            _say(render.hotspot_markdown(r) for r in spots.orderBy(F.desc("risk"), "id").collect())
        else:
            _show(spots, form)
    elif o.command == "doc-gaps":
        _show(score.doc_gaps(g).orderBy(F.desc("points"), "id"), form)
    else:
        _show(ask.answer(g, o.subject), form)
    return 0


def _impact(g: Graph, own: str, start: DataFrame, o) -> None:
    reached = stored(traverse.reached(g, start, "incoming", o.depth or 5), "impact")
    if o.context or o.prompt:
        spark = g.nodes.sparkSession
        files = spark.createDataFrame([], "file string, content string") if not o.root else scan.scan_tree(spark, o.root).select(F.col("path").alias("file"), "content")
        package = prompts.build(g, [own], reached, files)
        print(prompts.prompt(o.prompt, package, o.goal) if o.prompt else prompts.package_markdown(package))
    elif o.format == "json":
        _say(render.impact_json(g, [own], reached), "")
        print()
    elif o.format == "ndjson":
        _say(render.impact_ndjson(g, reached))
    else:
        _say(render.impact_text(g, [own], reached))
        print()
        _show(score.blast_radius(reached, o.vendor), "markdown")
        _show(score.edge_breakdown(reached, o.vendor).orderBy(F.desc("n"), "type"), "markdown")


def _files(g: Graph, members: DataFrame) -> DataFrame:
    """(id, file, line, end_line) of members(id) that have a file."""
    return g.nodes.join(members.select("id").distinct(), "id", "left_semi").filter("file != ''").select("id", "file", "line", "end_line").orderBy("id")


def _flow(g: Graph, o) -> None:
    found = ask.flow(g, o.subject)
    if o.include_code:
        _show(_files(g, found), o.format, kind="file")
    if o.format in ("text", "summary", "markdown"):
        rows = sorted(found.collect(), key=lambda r: (r.type != "payload", r.id))  # the members of one flow
        if not rows:
            print("No flow found.")
            return
        node = g.node(rows[0].flow_id).first()
        meta = json.loads(node.metadata or "{}") if node else {}
        ids = g.nodes.sparkSession.createDataFrame([(r.id,) for r in rows], "source_id string")
        events = [r.target_id for r in g.edges.filter("type = 'emits'").join(ids, "source_id", "left_semi").select("target_id").distinct().orderBy("target_id").collect()]
        print(render.flow_markdown(rows[0].flow_id.partition(":")[2], meta.get("entry_point", ""), [(r.id, r.type) for r in rows], events))
    else:
        _show(found, o.format)


def _module(g: Graph, module: str, form: str) -> None:
    domain = g.domain_of(f"module:{module}").first()
    if form in ("text", "summary", "markdown"):
        print(f"# Module: {module}\n")
        if domain:
            print(render.domain_markdown(domain))
    events = g.of_type("event", module).select(F.col("id").alias("event_id")).join(g.lifecycles(), "event_id", "left")
    spots = score.stored_hotspots(g, 20).filter(F.col("module") == module).select("node_id", "risk", "level")
    crossing = g.cross_module(module)
    outside = crossing.filter(~F.col("target_id").startswith("module:") & ~F.col("target_id").startswith("class:")).groupBy(F.col("source_module").alias("module")).agg(F.count("*").alias("external"))
    summary = g.overview(("class", "event", "handler", "service", "route")).filter(F.col("module") == module).join(outside, "module", "left").withColumn("external", F.coalesce("external", F.lit(0)))
    parts = [("summary", summary), ("flows", ask.flows_of_module(g, module)), ("events", events), ("hotspots", spots), ("cross_module", crossing.select("source_id", "target_id", "type"))]
    for kind, df in parts:
        if form in ("text", "summary", "markdown"):
            print(f"\n## {kind}\n")
        _show(df, form, kind=kind)


if __name__ == "__main__":
    sys.exit(main())
