"""Renderings of graphs and results: DataFrames of text lines where there may be many, text where there are few."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbograph.functions import naming
from arbograph.operators.graph import Graph
from arbograph.runtime import split_join

#: Modules that a summary lists.
TOP_MODULES = 5


def _quoted(col: Column) -> Column:
    """A DOT string: backslashes first, then quotes."""
    return F.concat(F.lit('"'), F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_edges(edges: DataFrame) -> DataFrame:
    """(line): the DOT line of each edge."""
    return edges.select(F.concat(F.lit("  "), _quoted(F.col("source_id")), F.lit(" -> "), _quoted(F.col("target_id")), F.lit(" [label="), _quoted(F.col("type")), F.lit("];")).alias("line"))


def dot_nodes(nodes: DataFrame) -> DataFrame:
    """(line): the DOT line of each node, labelled by its short name, in its type's colour."""
    return nodes.select(F.concat(F.lit("  "), _quoted(F.col("id")), F.lit(" [label="), _quoted(F.coalesce("name", "id")), F.lit(", color="), _quoted(naming.colour(F.col("type"))), F.lit("];")).alias("line"))


def ndjson(df: DataFrame, kind: str) -> DataFrame:
    """(line): a JSON object for each row, with its kind first."""
    return df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("line"))


def lines(df: DataFrame) -> Iterator[str]:
    """The lines of a DataFrame, a partition at a time at the driver."""
    for r in df.toLocalIterator():
        yield r[0]


def json_array(df: DataFrame) -> Iterator[str]:
    """A JSON array of all rows, in pieces."""
    yield "["
    for n, r in enumerate(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator()):
        yield f"{',' if n else ''}{r[0]}"
    yield "]"


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    """A small result as a Markdown table, cut to `limit` rows: a report for readers. The last line says that there is more, if there is."""
    rows = df.limit(limit + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    shown = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows[:limit])]
    return "\n".join(shown + (["", f"Only the first {limit} rows are shown."] if len(rows) > limit else []))


def edge_lines(graph: Graph, edges: DataFrame) -> DataFrame:
    """(line): each edge as `source --[type]--> target`, by the full names of its ends, their ids where they have no node."""
    return graph.labelled(edges).select(F.concat(F.col("source_label"), F.lit(" --["), F.col("type"), F.lit("]--> "), F.col("target_label")).alias("line"))


def edge_records(edges: DataFrame) -> DataFrame:
    """(source, target, type, metadata) for JSON."""
    return edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type", F.parse_json(F.coalesce("metadata", F.lit("{}"))).alias("metadata"))


def node_records(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "type", "fqcn", "file", "module")


# -- views


def _counts(df: DataFrame, column: str) -> list[tuple[str, int]]:
    """A column's values with their counts, most first: types and modules, of bounded number."""
    return [tuple(r) for r in df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).collect()]


def view_summary(view: Graph, last_update: str | None = None, schema_version: str | None = None) -> str:
    """The numbers of a view in text."""
    total = {r.kind: r.n for r in view.totals().collect()}
    modules = _counts(view.nodes.filter("module != ''"), "module")
    listed = lambda pairs: "    ".join(f"{k}: {n}" for k, n in pairs)
    date = view.nodes.sparkSession.range(1).select(naming.date_text(F.lit(last_update).cast("long"))).first()[0] if last_update else None
    out = ["Graph", "═" * 40, *([f"Last generated: {date}"] if date else []), *([f"Schema version: {schema_version}"] if schema_version else []), ""]
    out += [f"Nodes: {total['nodes']:,}", "  " + listed(_counts(view.nodes, "type")), "", f"Edges: {total['edges']:,}", "  " + listed(_counts(view.edges, "type")), "", f"Modules: {len(modules)}", "  Top: " + listed(modules[:TOP_MODULES]), ""]
    return "\n".join([*out, f"Cross-module edges: {total['cross_module_edges']}", f"Orphan nodes: {total['orphans']}", f"Placeholder nodes: {total['placeholders']}"])


def view_markdown(view: Graph) -> str:
    """The numbers of a view as Markdown tables."""
    total = {r.kind: r.n for r in view.totals().collect()}
    rows = lambda pairs: [f"| {k} | {n} |" for k, n in pairs]
    head = ["# Graph", "", f"**Nodes:** {total['nodes']} | **Edges:** {total['edges']}", f"**Cross-module:** {total['cross_module_edges']} | **Orphans:** {total['orphans']}", "", "## Node Types", "| Type | Count |", "|------|-------|"]
    return "\n".join([*head, *rows(_counts(view.nodes, "type")), "", "## Modules", "| Module | Nodes |", "|--------|-------|", *rows(_counts(view.nodes.filter("module != ''"), "module"))])


def view_json(view: Graph) -> Iterator[str]:
    """A view as one JSON object with all nodes and edges and the counts, in pieces."""
    parsed = F.parse_json(F.coalesce("metadata", F.lit("{}"))).alias("metadata")
    yield '{"nodes":'
    yield from json_array(view.nodes.select("id", "type", "fqcn", "file", "line", F.col("end_line").alias("endLine"), "module", parsed))
    yield ',"edges":'
    yield from json_array(view.edges.select(F.col("source_id").alias("sourceId"), F.col("target_id").alias("targetId"), "type", parsed))
    types, edge_types = _counts(view.nodes, "type"), _counts(view.edges, "type")
    more = {"node_types": dict(types), "edge_types": dict(edge_types), "total_nodes": sum(n for _, n in types), "total_edges": sum(n for _, n in edge_types), "modules": dict(_counts(view.nodes.filter("module != ''"), "module"))}
    yield "," + json.dumps(more, ensure_ascii=False)[1:]


def view_dot(view: Graph) -> Iterator[str]:
    """A view as a DOT graph, line by line."""
    yield from ("digraph g {", "  rankdir=LR;", "  node [shape=box, fontsize=10];", "")
    yield from lines(dot_nodes(view.nodes))
    yield ""
    yield from lines(dot_edges(view.edges))
    yield "}"


# -- relations and impact


def compact_lines(groups: DataFrame) -> DataFrame:
    """(line) of Graph.compact()'s rows, by label."""
    return groups.orderBy("label").select(F.concat("label", F.lit("  ["), F.replace("kinds", F.lit(","), F.lit(", ")), F.lit("] ×"), F.col("n").cast("string")).alias("line"))


def compact_json(anchor: str, groups: DataFrame) -> Iterator[str]:
    """Graph.compact()'s rows as one JSON object about their anchor, in pieces."""
    yield f'{{"anchor":{json.dumps(anchor, ensure_ascii=False)},"classes":{groups.count()},"related":'
    yield from json_array(groups.orderBy("label").select(F.col("label").alias("class"), F.split("kinds", ",").alias("kinds"), F.col("n").alias("edges")))
    yield "}"


def impact_numbers(graph: Graph, impact: DataFrame) -> dict:
    """direct, transitive, total, max_depth and the nodes by module (most first) of reached()'s rows."""
    one = impact.agg(F.count_if(F.col("distance") == 1).alias("direct"), F.count("*").alias("total"), F.coalesce(F.max("distance"), F.lit(0)).alias("max_depth")).first()
    modules = _counts(split_join(impact.select("id"), graph.nodes.select("id", "module"), "id").filter("module != ''"), "module")
    return {"direct": one.direct, "transitive": one.total - one.direct, "total": one.total, "max_depth": one.max_depth, "modules": dict(modules)}


def impacted(graph: Graph, impact: DataFrame) -> DataFrame:
    """(kind, id, fqcn, type, module, distance, action): direct ones to edit, transitive ones to review; by distance and id."""
    direct = F.col("distance") == 1
    rows = split_join(impact.select("id", "distance"), graph.nodes.select("id", "fqcn", "type", "module"), "id")
    return rows.select(F.when(direct, "direct").otherwise("transitive").alias("kind"), "id", "fqcn", "type", "module", "distance", F.when(direct, "edit").otherwise("review").alias("action")).orderBy("distance", "id")


def impact_ndjson(graph: Graph, impact: DataFrame) -> Iterator[str]:
    """A summary, then a line for each impacted node with what to do about it."""
    yield json.dumps({"kind": "summary"} | impact_numbers(graph, impact), ensure_ascii=False)
    yield from lines(impacted(graph, impact).select(F.to_json(F.struct("kind", "fqcn", "type", "module", "distance", "action"))))


def impact_json(graph: Graph, changed: list[str], impact: DataFrame) -> Iterator[str]:
    yield f'{{"changed":{json.dumps(changed, ensure_ascii=False)},"impacted":'
    yield from json_array(impacted(graph, impact).select("id", "fqcn", "type", "module", "distance"))
    numbers = impact_numbers(graph, impact)
    yield "," + json.dumps({k: numbers[k] for k in ("total", "max_depth", "modules")}, ensure_ascii=False)[1:]


def impact_text(graph: Graph, changed: list[str], impact: DataFrame) -> Iterator[str]:
    numbers = impact_numbers(graph, impact)
    yield from ("Impact Analysis", "", f"Changed: {', '.join(changed)}", f"Impacted: {numbers['total']} nodes", f"Max depth: {numbers['max_depth']}")
    if numbers["modules"]:
        yield from ("", "Affected Modules", *(f"{k}: {n} nodes" for k, n in numbers["modules"].items()))
    sizes = dict(_counts(impact, "distance"))
    depth = None
    for r in impacted(graph, impact).toLocalIterator():
        if r.distance != depth:
            depth = r.distance
            yield from ("", f"Depth {depth} ({sizes[depth]} nodes)")
        yield f"{r.fqcn} ({r.type}, {r.module})"


# -- intelligence


def domain_markdown(domain) -> str:
    """A row of Graph.domain_of()."""
    entities = json.loads(domain.key_entities or "[]")
    return f"## Domain: {domain.name}\n\n**Criticality:** {domain.criticality}\n\n" + (f"{domain.description}\n\n" if domain.description else "") + (f"**Key Entities:** {', '.join(entities)}\n\n" if entities else "")


def lifecycle_markdown(event: str, rows: list) -> str:
    """Graph.lifecycle()'s rows of one event."""
    of = lambda role, mode=None: sorted((r for r in rows if r.role == role and (mode is None or r.mode == mode)), key=lambda r: r.label)
    out = [f"## Event Lifecycle: `{event}`\n"]
    if of("emitter"):
        out.append("**Emitted by:** " + ", ".join(f"`{r.label}`" for r in of("emitter")) + "\n")
    for mode, title in (("sync", "Sync"), ("async", "Async"), ("queued", "Queued")):
        if of("listener", mode):
            out += [f"### {title} Listeners", *(f"- `{r.label}`" + (f" (queue: `{r.queue or 'default'}`)" if mode == "queued" else "") for r in of("listener", mode)), ""]
    for r in of("subject"):
        out += ["### Cross-Node Propagation", f"- **Subject:** `{r.label}`", f"- **Stream:** `{r.queue}`"]
        if of("consumer"):
            out.append("- **Replay Handlers:** " + ", ".join(f"`{c.label}`" for c in of("consumer")))
        out.append("- **Idempotency:** by `event_id`")
    if not of("listener") and not of("consumer"):
        out.append("No listeners found. This event may be unused.")
    return "\n".join(out) + "\n"


def _mermaid(id_: str) -> str:
    return id_.rpartition("\\")[2].rpartition(":")[2]


def flow_markdown(name: str, entry: str, steps: list[tuple[str, str]], events: list[str] = ()) -> str:
    """A flow of (node, role) steps as a Mermaid graph; events are emitted by its last step."""
    out = [f"## Execution Flow: {name}\n", f"**Entry:** `{entry}`\n", "```mermaid", "graph LR"]
    for i, (node, role) in enumerate(steps):
        out.append(f'    {_mermaid(node)}["{_mermaid(node)}\\n({role})"]')
        if i:
            out.append(f"    {_mermaid(steps[i - 1][0])} --> {_mermaid(node)}")
    for e in events:
        out += [f'    {_mermaid(e)}{{"{_mermaid(e)}"}}', f"    {_mermaid(steps[-1][0]) if steps else 'unknown'} -. emit .-> {_mermaid(e)}"]
    return "\n".join([*out, "```", ""])


def hotspot_markdown(r) -> str:
    """A row of stored_hotspots()."""
    text = f"**Hotspot:** `{r.node_id}` — {r.level} ({r.risk:g})\n- Incoming deps: {r.incoming_edges}\n- Cross-module: {r.cross_module_deps}\n- Critical path: {'Yes' if r.is_critical_path else 'No'}\n- Complexity: {r.complexity:g}\n"
    return text + (f"- Recommendation: {r.recommendation}\n" if r.recommendation else "")


def intent_markdown(node: str, metadata: str) -> str:
    """The intent of a node by the metadata of its doc node."""
    m = json.loads(metadata)
    duties = m.get("responsibilities") or []
    listed = ["**Responsibilities:**", *(f"- {d}" for d in duties), ""] if duties else []
    return "\n".join([f"## Intent: `{node}`", "", f"**Purpose:** {m.get('purpose', '')}", "", *listed, f"**Confidence:** {round(m.get('confidence', 0) * 100)}%", f"**Inferred from:** {', '.join(m.get('inferred_from') or [])}"]) + "\n"
