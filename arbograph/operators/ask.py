"""Questions in plain words, turned into calls on the graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbograph.functions import naming
from arbograph.operators import score, traverse
from arbograph.operators.graph import Graph
from arbograph.runtime import stored

#: Fixed: the questions that are understood, in the order in which they are tried, anywhere in the text; what is none of them is a search.
QUESTIONS = [
    ("flow", r"how\s+does\s+(?P<x>.+?)\s+work"),
    ("lifecycle", r"what\s+happens\s+when\s+(?P<x>.+?)\s+is\s+emitted"),
    ("lifecycle", r"what\s+happens\s+when\s+(?P<x>.+)"),
    ("impact", r"what\s+breaks\s+if\s+i\s+change\s+(?P<x>.+)"),
    ("handler", r"where\s+is\s+(?P<x>.+?)\s+processed"),
    ("domain", r"what\s+domain\s+(?:is|does)\s+(?P<x>.+?)(?:\s+(?:in|belong\s+to))?$"),
    ("lifecycle", r"trace\s+(?P<x>.+?)\s+lifecycle"),
    ("intent", r"show\s+(?:me\s+)?docs?\s+for\s+(?P<x>.+)"),
    ("hotspots", r"what\s+are\s+(?:the\s+)?(?:hotspots|critical\s+paths)"),
    ("flows", r"what\s+flows?\s+(?:exist|are)\s+in\s+(?P<x>.+)"),
    ("published", r"what\s+nats\s+subjects?\s+does\s+(?P<x>.+?)\s+publish"),
    ("consumers", r"what\s+consumes\s+(?P<x>.+)"),
    ("doc_gaps", r"what\s+modules?\s+lack\s+documentation"),
]


def understand(question: str) -> tuple[str, str]:
    """The kind of a question and its subject; search and the whole text if it is none of QUESTIONS."""
    text = question.strip().rstrip("?!. ")
    for kind, pattern in QUESTIONS:
        if m := re.search(pattern, text, re.I):
            return kind, (m.groupdict().get("x") or "").strip()
    return "search", text


def _id(graph: Graph, text: str) -> str:
    """The id a subject stands for, the subject itself if no node is found."""
    row = graph.resolve_target(text).first()
    return row.id if row else text


def answer(graph: Graph, question: str) -> DataFrame:
    """The rows that answer a question; their columns are those of the operator that its kind names."""
    kind, text = understand(question)
    if kind == "hotspots":
        known = score.stored_hotspots(graph)
        return score.hotspots(score.class_risk(graph)) if known.isEmpty() else known
    if kind == "doc_gaps":
        return score.doc_gaps(graph)
    if kind == "flows":
        return flows_of_module(graph, text)
    if kind == "search":
        return graph.search(text)
    if kind == "handler":
        return graph.search(f"{text}Handler")
    own = _id(graph, text)
    if kind == "impact":
        return traverse.reached(graph, graph.nodes.sparkSession.createDataFrame([(own,)], "id string"))
    if kind == "lifecycle":
        return graph.lifecycles().filter(F.col("event_id") == resolve_event(graph, text))
    if kind == "domain":
        return graph.domain_of(own)
    if kind == "intent":
        return intent(graph, own)
    if kind == "published":
        return graph.edges_of(own, "outgoing", "publishes_to")
    if kind == "consumers":
        return graph.edges_of(own, "incoming", "consumes_from")
    return flow(graph, text)


def resolve_event(graph: Graph, text: str) -> str:
    """The id of an event: that of a class of this name, else of the first hit that is an event or ends in Event; else the class id of the text."""
    row = graph.by_fqcn(text).select("id").unionByName(graph.node(text).select("id")).first()
    row = row or graph.search(text).filter((F.col("type") == "event") | F.col("fqcn").endswith("Event")).orderBy("place", "id").select("id").first()
    return row.id if row else f"class:{text}"


def task_matches(graph: Graph, task: str, module: str | None = None) -> DataFrame:
    """(id, fqcn, type, file, purpose): the search hits of a task's keywords (20 for each), once each, with what intent_for says of them."""
    words = naming.keywords(task)
    if not words:
        return graph.nodes.limit(0).select("id", "fqcn", "type", "file", F.lit("").alias("purpose"))
    # Hits of all words at once; the first 20 of each are taken as search() does: names first, then full names.
    hit = lambda c: F.filter(F.array(*[F.when(F.lower(c).contains(w.lower()), F.lit(w)) for w in words]), lambda x: x.isNotNull())
    rows = graph.nodes.select("id", F.explode(F.arrays_zip(F.array(F.lit(0), F.lit(1)).alias("place"), F.array(hit("name"), hit("fqcn")).alias("words"))).alias("h")).select("id", F.col("h.place").alias("place"), F.explode("h.words").alias("word"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("word", "place").orderBy("id"))).filter("n <= 20")  # Spark keeps the first of each group before the shuffle
    once = first.groupBy("word", "id").agg(F.min("place").alias("place"))
    kept = once.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy("place", "id"))).filter("n <= 20").select("id").distinct()
    found = graph.nodes.join(kept, "id", "left_semi")
    if module:
        found = found.filter(F.col("module") == module)
    docs = graph.edges.filter("type = 'intent_for'").select(F.col("source_id").alias("id"), F.col("target_id").alias("doc")).join(graph.nodes.select(F.col("id").alias("doc"), F.get_json_object("metadata", "$.purpose").alias("purpose")), "doc")
    return found.join(docs.groupBy("id").agg(F.min("purpose").alias("purpose")), "id", "left").select("id", "fqcn", "type", "file", "purpose")


def task_links(graph: Graph, matches: DataFrame) -> DataFrame:
    """(role, node_id, other_id, type): the dependencies and dependents of matches(id) by calls, instantiations and injections."""
    edges = graph.edges.filter(F.col("type").isin(*score.FURTHER))
    ids = stored(matches.select("id"), "matches")
    side = lambda own, other, role: edges.join(ids.withColumnRenamed("id", own), own, "left_semi").select(F.lit(role).alias("role"), F.col(own).alias("node_id"), F.col(other).alias("other_id"), "type")
    return side("source_id", "target_id", "dependency").unionByName(side("target_id", "source_id", "dependent"))


def task_hotspots(graph: Graph, matches: DataFrame) -> DataFrame:
    """(node_id, risk, recommendation): which of the ten first hotspots are among matches(id)."""
    return score.stored_hotspots(graph).join(matches.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("node_id", "risk", "recommendation")


def flow(graph: Graph, text: str) -> DataFrame:
    """(flow_id, id, type): the members of the first flow whose name or entry point contains the text."""
    flows = graph.of_type("execution_flow").filter(F.lower("fqcn").contains(text.lower()) | F.lower(F.coalesce(F.get_json_object("metadata", "$.entry_point"), F.lit(""))).contains(text.lower()))
    named = graph.nodes.filter(F.col("id").isin(f"flow:{text}", f"flow:{text}Flow"))
    first = flows.select("id", F.lit(0).alias("rank")).unionByName(named.select("id", F.lit(1).alias("rank"))).orderBy("rank", "id").limit(1).select(F.col("id").alias("target_id"))
    members = graph.edges.filter("type = 'participates_in_flow'").join(first, "target_id")
    return members.join(graph.nodes.select(F.col("id").alias("source_id"), F.col("type").alias("node_type")), "source_id").select(F.col("target_id").alias("flow_id"), F.col("source_id").alias("id"), F.col("node_type").alias("type"))


def flows_of_module(graph: Graph, module: str) -> DataFrame:
    """(id, fqcn): the flows of a module."""
    return graph.of_type("execution_flow", module).select("id", "fqcn")


def intent(graph: Graph, id_: str) -> DataFrame:
    """(id, metadata): what intent_for leads to from a node."""
    docs = graph.edges_of(id_, "outgoing", "intent_for").select(F.col("target_id").alias("id"))
    return graph.nodes.join(docs, "id", "left_semi").select("id", "metadata")


#: The kind of a command by the start of its name; others are `other`.
COMMAND_KINDS = {"make:": "generator", "describe:": "introspection", "logs:": "introspection", "deploy:": "operations", "graph:": "graph"}


def capabilities(graph: Graph, kind: str | None = None, module: str | None = None, prefixes: dict[str, str] = COMMAND_KINDS, curated: DataFrame | None = None) -> DataFrame:
    """(name, kind, description, use_when, avoid_when, outputs, follow_up, module): the commands of the graph.

    A field is that of curated(name, ...) where it is there and not empty, else that of the command's CapabilityHint
    attribute, else that of its own attribute, else empty. kind filters, singular or plural; `all` is no filter.
    """
    of = lambda path: F.get_json_object("metadata", path)
    hint = lambda key: F.coalesce(F.when(of("$.attributes.name").endswith("CapabilityHint"), of(f"$.attributes.args.{key}")), F.lit(""))
    name = F.coalesce(F.nullif(of("$.commandName"), F.lit("")), F.col("fqcn"))
    found = graph.of_type("command", module).select(name.alias("name"), F.coalesce(of("$.description"), F.lit("")).alias("description"), hint("useWhen").alias("use_when"), hint("avoidWhen").alias("avoid_when"), hint("outputs").alias("outputs"), hint("followUp").alias("follow_up"), "module")
    found = found.withColumn("kind", F.coalesce(*[F.when(F.col("name").startswith(p), F.lit(k)) for p, k in prefixes.items()], F.lit("other")))
    if curated is not None:
        fields = [c for c in curated.columns if c in found.columns and c not in ("name", "module")]
        better = curated.select("name", *[F.col(c).alias(f"better_{c}") for c in fields])
        found = found.join(better, "name", "left").withColumns({c: F.coalesce(F.nullif(F.col(f"better_{c}"), F.lit("")), F.col(c)) for c in fields})
    if kind and kind != "all":
        found = found.filter((F.col("kind") == kind) | (F.col("kind") == kind.removesuffix("s")))
    return found.select("name", "kind", "description", "use_when", "avoid_when", "outputs", "follow_up", "module")
