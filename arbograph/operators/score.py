"""Scores over the graph: blast radius, component risk, relevance, hotspots, documentation gaps, and context packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbograph.functions import naming
from arbograph.operators.graph import Graph

#: Fixed: weights of discovering edges in a blast radius (others 1).
BLAST = {10: ("implements", "extends", "satisfies_contract"), 7: ("serves_route", "handles", "exposes_api"), 6: ("listens_to", "emits", "publishes_to", "consumes_from"), 5: ("accepts", "returns", "injects_readonly", "injects_mutable"), 2: ("uses", "imports", "calls", "instantiates")}
#: Fixed: modules whose change is always a hotspot.
CORE_MODULES = ("Orm", "Ssr", "Auth", "Tenancy", "Workflow")
#: Fixed: relevance of node types (others 3).
RELEVANCE = {10: ("payload", "handler"), 8: ("service", "route"), 7: ("entity", "resource"), 6: ("event_listener", "repository"), 5: ("event", "command"), 4: ("component", "job")}
#: Fixed: relevance of edge types (others 3).
EDGE_RELEVANCE = {10: ("handles",), 9: ("injects_mutable",), 8: ("produces", "satisfies_contract"), 7: ("injects_readonly", "emits", "has_relation"), 6: ("extends", "listens_to", "maps_to_table"), 5: ("implements",), 4: ("calls",)}
#: Fixed: risk of a dependent by its edge (others 1).
RISK = {3: ("injects_readonly", "injects_mutable"), 2: ("instantiates", "extends", "implements")}
#: Fixed: edge types of direct and of further dependents of a component.
DIRECT = ("calls", "instantiates", "injects_readonly", "injects_mutable", "extends", "implements", "listens_to")
FURTHER = DIRECT[:4]


def weight(col: Column, table: dict[int, tuple[str, ...]], default: int) -> Column:
    return reduce(lambda c, kv: c.when(col.isin(*kv[1]), kv[0]), table.items(), F.when(F.lit(False), 0)).otherwise(default)


def blast_radius(impact: DataFrame, vendor: str, core: tuple[str, ...] = CORE_MODULES) -> DataFrame:
    """(score, level, recommendation, n_hotspots, n_impacted) of reached()'s rows; one row, score 0 for none.

    Each node adds its edge's weight, times 1, a half or a quarter by distance 1, 2 or more, times 1.5 if the edge
    joins two modules; each hotspot (a core module, or Contract in the id) adds 15; 100 at most.
    """
    key = lambda c: naming.module_key(F.col(c), vendor)
    near = F.when(F.col("distance") == 1, 1.0).when(F.col("distance") == 2, 0.5).otherwise(0.25)
    part = weight(F.col("via_type"), BLAST, 1) * near * F.when(key("via_source") != key("via_target"), 1.5).otherwise(1.0)
    hot = key("id").isin(*core) | F.col("id").contains("Contract")
    one = impact.select(part.alias("p"), hot.alias("h")).agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("p"), F.count_if("h").alias("n_hotspots"), F.count("*").alias("n_impacted"))
    score = F.least(F.lit(100), F.round(F.col("p") + 15 * F.col("n_hotspots")).cast("int"))
    one = one.withColumn("score", score)
    level = F.when(F.col("score") >= 60, "high").when(F.col("score") >= 30, "medium").otherwise("low")
    return one.select("score", level.alias("level"), F.when(F.col("score") >= 60, "epic_required").otherwise("inline").alias("recommendation"), "n_hotspots", "n_impacted")


def component_risk(graph: Graph, id_: str) -> DataFrame:
    """(risk, level, n_dependents): the risk of changing a component, from its direct dependents and the listeners of the events it emits."""
    direct = graph.edges.filter((F.col("target_id") == id_) & F.col("type").isin(*DIRECT)).agg(F.coalesce(F.sum(weight(F.col("type"), RISK, 1)), F.lit(0)).alias("r"), F.count("*").alias("n_dependents"))
    events = graph.edges.filter((F.col("source_id") == id_) & (F.col("type") == "emits")).select(F.col("target_id").alias("event"))
    heard = graph.edges.filter("type = 'listens_to'").join(events.withColumnRenamed("event", "target_id"), "target_id").agg((F.count("*") * 2).alias("l"))
    both = direct.select("r", "n_dependents").unionByName(heard.select(F.col("l").alias("r"), F.lit(0).cast("long").alias("n_dependents"))).agg(F.sum("r").alias("risk"), F.sum("n_dependents").alias("n_dependents"))
    level = F.when(F.col("risk") >= 20, "CRITICAL").when(F.col("risk") >= 10, "HIGH").when(F.col("risk") >= 5, "MEDIUM").otherwise("LOW")
    return both.select("risk", level.alias("level"), "n_dependents")


def event_impact(graph: Graph) -> DataFrame:
    """(source_id, event_id, n_listeners): for every emitted event the number of its listeners, 0 kept."""
    listeners = graph.edges.filter("type = 'listens_to'").groupBy(F.col("target_id").alias("event_id")).agg(F.count("*").alias("n"))
    return graph.edges.filter("type = 'emits'").select("source_id", F.col("target_id").alias("event_id")).join(listeners, "event_id", "left").select("source_id", "event_id", F.coalesce("n", F.lit(0)).alias("n_listeners"))


def relevance(graph: Graph, impact: DataFrame) -> DataFrame:
    """(id, distance, score): the weight of the node's type over its distance."""
    found = impact.select("id", "distance").join(graph.nodes.select("id", "type"), "id")
    return found.select("id", "distance", (weight(F.col("type"), RELEVANCE, 3) / F.greatest(F.lit(1), F.col("distance"))).alias("score"))


def edge_relevance(edges: DataFrame) -> DataFrame:
    """The edges with the relevance of their type as `relevance`."""
    return edges.withColumn("relevance", weight(F.col("type"), EDGE_RELEVANCE, 3))


def impacted_modules(graph: Graph, impact: DataFrame, origin: str | None = None) -> DataFrame:
    """(module, n) of reached()'s rows, most first; with an origin node, its own module is left out, as only others are crossed into."""
    found = impact.select("id").join(graph.nodes.select("id", "module"), "id").filter("module != ''")
    if origin is not None:
        own = graph.node(origin).select("module")
        found = found.join(own, "module", "left_anti")
    return found.groupBy("module").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module")


def edge_breakdown(impact: DataFrame, vendor: str) -> DataFrame:
    """(type, n, crossing): the discovering edges of reached()'s rows by type, and how many of them join different module keys."""
    key = lambda c: naming.module_key(F.col(c), vendor)
    return impact.groupBy(F.col("via_type").alias("type")).agg(F.count("*").alias("n"), F.count_if(key("via_source") != key("via_target")).alias("crossing"))


def pack(ranked: DataFrame, nodes: int = 20, tokens: int = 8000) -> DataFrame:
    """(id, place, tokens_after) of the rows of ranked(id, score, distance, snippet) that fit: a prefix of the order (score down, distance, id).

    It ends at `nodes` rows, where the tokens so far reach the budget, or where the next snippet would pass it with at
    least one row packed. A row costs a quarter of its bytes, rounded down, and 50. Only a prefix of `nodes` rows can
    be packed, so the ordered prefix is taken first and the windows run over that many rows.
    """
    order = [F.desc("score"), "distance", "id"]
    top = ranked.orderBy(*order).limit(nodes).withColumn("size", F.coalesce(naming.token_estimate(F.col("snippet")), F.lit(0)))
    w = Window.orderBy(*order)
    top = top.withColumns({"place": F.row_number().over(w), "before": F.coalesce(F.sum(F.col("size") + 50).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    stop = (F.col("before") >= tokens) | (F.col("before") + F.col("size") > tokens) & (F.col("place") > 1)
    top = top.withColumn("stopped", F.max(stop.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return top.filter("stopped = 0").select("id", "place", (F.col("before") + F.col("size") + 50).alias("tokens_after"))


def snippets(files: DataFrame, context: int = 5) -> DataFrame:
    """(id, snippet) of files(id, content, line, end_line): the lines from `context` before to `context` after."""
    lines = F.split("content", "\n")
    first = F.greatest(F.lit(1), F.col("line") - context)
    last = F.least(F.size(lines), F.greatest(F.col("end_line"), F.col("line")) + context)
    return files.filter("content IS NOT NULL").select("id", F.when(last >= first, F.array_join(F.slice(lines, first, last - first + 1), "\n")).otherwise("").alias("snippet"))


def risk_score(short: Column, parents: Column, interfaces: Column, traits: Column, attributes: Column) -> Column:
    """A class's risk: by its name's ending, 0.05 for a parent, 0.1 for more than 2 interfaces, 0.05 for more than 1 trait, 0.1 for each attribute of a payload, handler or service; 1 at most."""
    risk = naming.name_risk(short) + F.when(parents > 0, 0.05).otherwise(0.0) + F.when(interfaces > 2, 0.1).otherwise(0.0) + F.when(traits > 1, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), risk + 0.1 * attributes)


def complexity_score(parents: Column, interfaces: Column, traits: Column, props: Column) -> Column:
    """0.3, and 0.05 for each interface and trait, 0.02 for each property and 0.1 for a parent; 1 at most."""
    return F.least(F.lit(1.0), F.round(F.lit(0.3) + 0.05 * interfaces + 0.05 * traits + 0.02 * props + F.when(parents > 0, 0.1).otherwise(0.0), 2))


#: Fixed: node types that an attribute of a payload, handler or service makes.
RISKY_TYPES = ("payload", "handler", "service", "auth_handler", "slot_handler")
#: Fixed: edge types that a property makes.
PROPERTY_EDGES = ("injects_readonly", "injects_mutable", "injects_factory", "injects_config", "has_relation")


def class_risk(graph: Graph) -> DataFrame:
    """(id, risk, complexity) of each real class-like node, from the graph alone.

    Attributes and properties leave nodes and edges: a node of RISKY_TYPES has one attribute that counts, each contract
    of a service one more, and each edge of PROPERTY_EDGES is a property.
    """
    n = lambda *t: F.count_if(F.col("type").isin(*t))
    contract = F.count_if((F.col("type") == "satisfies_contract") & (F.coalesce(F.get_json_object("metadata", "$.contractType"), F.lit("service")) == "service"))
    links = graph.edges.filter(F.col("type").isin("extends", "implements", "uses", "satisfies_contract", *PROPERTY_EDGES)).groupBy(F.col("source_id").alias("id")).agg(n("extends").alias("parents"), n("implements").alias("interfaces"), n("uses").alias("traits"), contract.alias("contracts"), n(*PROPERTY_EDGES).alias("props"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    found = graph.nodes.filter(F.col("id").startswith("class:") & ~F.col("is_placeholder")).join(links, "id", "left")
    marks = zero("contracts") + F.when(F.col("type").isin(*RISKY_TYPES), 1).otherwise(0)
    risk = risk_score(naming.short_name(F.col("fqcn")), zero("parents"), zero("interfaces"), zero("traits"), marks)
    return found.select("id", F.round(risk, 2).alias("risk"), complexity_score(zero("parents"), zero("interfaces"), zero("traits"), zero("props")).alias("complexity"))


def stored_hotspots(graph: Graph, limit: int = 10) -> DataFrame:
    """(id, node_id, module, risk, level, incoming_edges, cross_module_deps, is_critical_path, complexity, recommendation): the `limit` hotspot nodes of the highest risk; module is that of the node each is about."""
    of = lambda key: F.get_json_object("metadata", f"$.{key}")
    spots = graph.of_type("hotspot").select("id", of("target_node_id").alias("node_id"), of("risk_score").cast("double").alias("risk"), of("incoming_edges").cast("int").alias("incoming_edges"), of("cross_module_deps").cast("int").alias("cross_module_deps"), of("is_critical_path").cast("boolean").alias("is_critical_path"), of("complexity_score").cast("double").alias("complexity"), of("recommendation").alias("recommendation"))
    top = spots.orderBy(F.desc("risk"), "id").limit(limit)
    return top.join(graph.nodes.select(F.col("id").alias("node_id"), "module"), "node_id", "left").withColumn("level", risk_level(F.col("risk"))).select("id", "node_id", "module", "risk", "level", "incoming_edges", "cross_module_deps", "is_critical_path", "complexity", "recommendation")


def risk_level(risk: Column) -> Column:
    return F.when(risk >= 0.8, "CRITICAL").when(risk >= 0.6, "HIGH").when(risk >= 0.4, "MEDIUM").otherwise("LOW")


def hotspots(risks: DataFrame, limit: int = 10) -> DataFrame:
    """(id, risk, level): the `limit` highest risks, at a tie by id."""
    return risks.orderBy(F.desc("risk"), "id").limit(limit).select("id", "risk", risk_level(F.col("risk")).alias("level"))


def doc_gaps(graph: Graph, api: str = "App\\Api\\", tokens: tuple[str, ...] = ("AsPayload", "AsPayloadHandler", "AsService")) -> DataFrame:
    """(id, points) over 20 of the nodes without intent_for: 30 for the API namespace, 20 for each token in the id, up to 20 for its edges, up to 15 for its module's outward coupling."""
    out = graph.cross_module().groupBy(F.col("source_module").alias("module")).agg(F.count("*").alias("coupling"))
    found = graph.without("intent_for").select("id", "fqcn", "module").join(graph.degrees().select("id", "degree"), "id", "left").join(out, "module", "left")
    points = F.when(F.col("fqcn").startswith(api), 30).otherwise(0) + reduce(lambda a, b: a + b, [F.when(F.col("id").contains(t), 20).otherwise(0) for t in tokens])
    points = points + F.least(F.lit(20), 2 * F.coalesce("degree", F.lit(0))) + F.least(F.lit(15), F.coalesce("coupling", F.lit(0)))
    return found.select("id", points.cast("long").alias("points")).filter("points > 20")
