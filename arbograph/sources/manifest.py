"""The manifest of a graph's commands and of its project's numbers, as JSON, in an older form, as Markdown and as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from arbograph.operators import ask
from arbograph.operators.graph import Graph

ARTIFACT = "arbograph.capabilities/v2"
OLD_ARTIFACT = "arbograph.capabilities/v1"


def build(graph: Graph, category: str = "all", module: str | None = None, generated_at: str = "", meta: dict[str, str] | None = None, curated: DataFrame | None = None) -> dict:
    """The manifest. Commands, modules and route methods are listed by name: a graph has few of each."""
    commands = [r.asDict() for r in ask.capabilities(graph, category, module, curated=curated).orderBy("name").collect()]
    numbers = graph.context(module).first().asDict()
    modules = {r.module: r.n for r in graph.modules(None if module else "class").filter(f"module = '{module}'" if module else "true").collect()}
    nodes = Graph(graph.of_module(module) if module else graph.nodes, graph.edges)
    routes = {r.method: r.n for r in nodes.routes().orderBy("method").collect()}
    keys = {"services": "service_count", "contracts": "contract_count", "events": "event_count", "listeners": "listener_count", "entities": "entity_count", "relations": "relation_count"}
    context = {"modules": modules, "route_summary": routes} | {to: numbers[k] for k, to in keys.items()} | {"cross_module_edges": numbers["cross_module_edges"]}
    known = meta or {}
    return {"artifact": ARTIFACT, "generated_at": generated_at, "graph_version": known.get("schema_version"), "graph_last_updated": known.get("last_update"), "commands": commands, "project_context": context}


def to_json(manifest: dict) -> str:
    return json.dumps(manifest, ensure_ascii=False)


def old_form(manifest: dict) -> dict:
    """The first version of the format: the commands alone."""
    return {"artifact": OLD_ARTIFACT, "generated_at": manifest["generated_at"], "_deprecated": "Use the v2 format.", "commands": manifest["commands"]}


def _grouped(manifest: dict) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for c in manifest["commands"]:
        out.setdefault(c["kind"], []).append(c)
    return out


def to_markdown(manifest: dict) -> str:
    out = ["# Capabilities", ""]
    for kind, commands in _grouped(manifest).items():
        out += [f"## {kind[:1].upper()}{kind[1:]} ({len(commands)} commands)", ""]
        for c in commands:
            out += [f"### {c['name']}", c["description"], *(f"- **{title}:** {c[key]}" for title, key in (("Use when", "use_when"), ("Avoid when", "avoid_when"), ("Follow-up", "follow_up")) if c[key]), ""]
    x = manifest["project_context"]
    routes = ", ".join(f"{m}: {n}" for m, n in x["route_summary"].items())
    out += ["## Project Context", "", f"- **Modules:** {len(x['modules'])} ({', '.join(x['modules'])})", f"- **Routes:** {sum(x['route_summary'].values())} ({routes})", f"- **Services:** {x['service_count']} with {x['contract_count']} contracts", f"- **Events:** {x['event_count']} with {x['listener_count']} listeners", f"- **Entities:** {x['entity_count']} with {x['relation_count']} relations"]
    return "\n".join(out)


def to_text(manifest: dict) -> str:
    out = []
    for kind, commands in _grouped(manifest).items():
        out += [f"{kind} ({len(commands)})", *(f"  {c['name']}  {c['description']}".rstrip() for c in commands), ""]
    return "\n".join([*out, f"{len(manifest['commands'])} commands, {len(manifest['project_context']['modules'])} modules"])


