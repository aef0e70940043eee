"""Extractors: projections of facts to nodes and edges, folded in a fixed order.

An extractor is a function of a Facts object that returns node rows and edge rows (either may be None). The default
registry is the list EXTRACTORS; others can be passed along. Attribute names are matched by their short names. Attributes
are rules in tables, so a framework's own set is data, not code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbograph.functions import naming
from arbograph.operators import graph as G
from arbograph.operators.graph import Graph
from arbograph.operators.score import complexity_score, risk_score
from arbograph.runtime import stored, union

_NODE = [*G.NODE, "file_seq"]
#: What stands before event and command subjects.
SUBJECT_PREFIX = "app"
#: Fixed: the node type that a class attribute makes.
NODE_ATTRIBUTES = {
    "AsPublicPayload": "payload", "AsProtectedPayload": "payload", "AsServicePayload": "payload", "AsPayload": "payload",
    "AsPayloadHandler": "handler", "AsService": "service", "AsEvent": "event", "AsEventListener": "event_listener", "FromTable": "entity", "AsRepository": "repository",
    "AsAuthHandler": "auth_handler", "AsComponent": "component", "AsSlotHandler": "slot_handler", "AsDataProvider": "data_provider", "AsScheduledJob": "job", "AsPipelineListener": "pipeline_phase", "AsCommand": "command",
}
PAYLOADS = tuple(k for k, v in NODE_ATTRIBUTES.items() if v == "payload")
#: Fixed: the access that a payload's attribute grants.
ACCESS = {"AsPublicPayload": "public", "AsProtectedPayload": "protected", "AsServicePayload": "service"}
#: Fixed: the metadata of a node by its attribute: key, argument names in the order they are tried, value if there is none.
NODE_METADATA = {
    "payload": [("path", ("path", "0"), ""), ("responseClass", ("responseWith",), None)],
    "handler": [("execution", ("execution", "2"), "sync")],
    "event_listener": [("eventClass", ("event", "0"), None), ("executionMode", ("execution", "1"), "sync")],
    "auth_handler": [("priority", ("priority", "0"), "0")],
    "slot_handler": [("slot", ("slot", "0"), "default")],
    "job": [("cron", ("cron", "expression", "0"), "")],
    "pipeline_phase": [("phase", ("phase", "0"), "default")],
    "command": [("commandName", ("name", "0"), ""), ("description", ("description", "1"), "")],
}
#: Fixed: (node type, attribute) whose presence on the class is a flag in the node's metadata.
FLAGS = [("entity", "SoftDelete", "softDelete"), ("slot_handler", "AsDeferred", "deferred"), ("pipeline_phase", "AsServerLifecycleListener", "lifecycleHook")]
#: Fixed: (attribute, argument names in the order they are tried, value if there is none, prefix of the target's id, edge
#: type, metadata as key -> argument names and value if there is none) on classes. Without a value there is no edge.
EDGE_ATTRIBUTES = [
    ("AsPayloadHandler", ("payload", "0"), None, "class:", "handles", {"execution": (("execution", "2"), "sync")}),
    ("AsPayloadHandler", ("resource", "1"), None, "class:", "produces", {}),
    ("AsEventListener", ("event", "0"), None, "class:", "listens_to", {"executionMode": (("execution", "1"), "sync")}),
    ("SatisfiesServiceContract", ("of", "contract", "0"), None, "class:", "satisfies_contract", {"contractType": ((), "service")}),
    ("SatisfiesRepositoryContract", ("of", "contract", "0"), None, "class:", "satisfies_contract", {"contractType": ((), "repository")}),
    ("RequiresPermission", ("permission", "0"), None, "permission:", "requires_permission", {"slug": (("permission", "0"), "")}),
    ("RequiresCapability", ("capability", "0"), None, "capability:", "requires_capability", {"slug": (("capability", "0"), "")}),
    ("TenantIsolated", ("constraint", "strategy", "0"), "default", "constraint:", "tenant_isolated", {"constraint": (("constraint", "strategy", "0"), "default")}),
    ("FromTable", ("name", "0"), None, "table:", "maps_to_table", {"tableName": (("name", "0"), "")}),
    ("AsSlotHandler", ("slot", "0"), "default", "slot:", "renders_slot", {"slotName": (("slot", "0"), "default")}),
    ("AsScheduledJob", ("cron", "expression", "0"), None, "cron:", "scheduled_as", {"cron": (("cron", "expression", "0"), "")}),
    ("AsPipelineListener", ("phase", "0"), "default", "pipeline:", "pipeline_phase", {"phase": (("phase", "0"), "default")}),
    ("AsAuthHandler", (), "handler", "auth:", "authenticates", {}),
]
#: Fixed: attributes of properties: (attribute, argument names, prefix of the target's id, edge type, relation); the property's type is the target where no argument is named.
PROPERTY_ATTRIBUTES = [
    ("InjectAsReadonly", (), "class:", "injects_readonly", None),
    ("InjectAsMutable", (), "class:", "injects_mutable", None),
    ("InjectAsFactory", (), "class:", "injects_factory", None),
    ("Config", ("env", "key", "0"), "config:", "injects_config", None),
    ("HasMany", ("target", "0"), "class:", "has_relation", "hasMany"),
    ("BelongsTo", ("target", "0"), "class:", "has_relation", "belongsTo"),
    ("OneToOne", ("target", "0"), "class:", "has_relation", "oneToOne"),
    ("ManyToMany", ("target", "0"), "class:", "has_relation", "manyToMany"),
]
#: Fixed: class attributes that some extractor handles; the last other one of a command is kept in its metadata.
HANDLED = (*NODE_ATTRIBUTES, *dict.fromkeys(a for a, *_ in EDGE_ATTRIBUTES), *(a for _, a, _ in FLAGS), "TenantScoped", "AsLayoutSlot", "Propagated", "OwnedAggregate", "AsAggregateCommand", "AsTenantLayerStrategy", "AsTenancyLayersProvider")
#: Fixed: endings of the names of a domain's key entities.
ENTITY_SUFFIX = ("Entity", "Model", "Aggregate", "Root")
#: Fixed: by the ending of a class's name its purpose (with the words before the ending) and responsibilities, first match.
INTENT_SUFFIX = {
    "Handler": ("Handles %s requests", ("Process incoming payload", "Coordinate service calls", "Emit domain events")),
    "Service": ("Provides %s business logic", ("Encapsulate domain rules", "Coordinate operations", "Maintain invariants")),
    "Repository": ("Manages %s data persistence", ("Query entities", "Persist aggregates", "Manage transactions")),
    "Entity": ("Represents %s domain concept", ("Hold domain state", "Enforce business rules", "Emit domain events")),
    "Listener": ("Reacts to %s events", ("Handle domain events", "Trigger side effects", "Update read models")),
    "Mapper": ("Transforms %s data representations", ("Map between DTOs and entities", "Transform payloads", "Serialize responses")),
    "Validator": ("Validates %s input", ("Check constraints", "Enforce rules", "Return validation errors")),
    "Provider": ("Supplies %s resources", ("Fetch external data", "Cache responses", "Transform outputs")),
    "Factory": ("Creates %s instances", ("Construct complex objects", "Apply defaults", "Validate construction")),
    "Middleware": ("Intercepts %s pipeline", ("Pre-process requests", "Post-process responses", "Handle cross-cutting concerns")),
    "Phase": ("Executes %s pipeline phase", ("Process pipeline stage", "Transform context", "Pass to next phase")),
}
#: Fixed: by the words in an attribute's name, tried in this order, what its class is for, and how sure that is; the last attribute wins.
INTENT_ATTRIBUTE = [
    (("Payload",), "AsPayload_attribute", "HTTP request payload definition", ("Define request structure", "Validate input", "Route to handler"), 0.85),
    (("Event",), "AsEvent_attribute", "Domain event", ("Carry event data", "Trigger listeners", "Enable async processing"), 0.85),
    (("Service", "Contract"), "SatisfiesServiceContract_attribute", "Service contract interface", ("Define service interface", "Enable dependency inversion", "Allow multiple implementations"), 0.8),
]
#: Fixed: words in the names of classes on a critical path, and from which risk on a class is a hotspot.
CRITICAL_NAMES = ("Application", "Kernel", "Bootstrap", "Dispatcher", "Router", "Container")
HOTSPOT_RISK = 0.4


@dataclass(frozen=True)
class Facts:
    """facts: rows of file_facts(); every row gets file_seq (the file's path, by which the first file wins) and module."""

    facts: DataFrame

    def of(self, kind: str) -> DataFrame:
        return self.facts.filter(F.col("kind") == kind)

    def on_classes(self, *names: str) -> DataFrame:
        """Attributes of classes, with the lines of their class."""
        spans = self.of("class").select("owner", "file", "line", "end_line")
        return self.attributes(*names).filter("owner_kind = 'class'").drop("line", "end_line").join(spans, ["owner", "file"])

    def attributes(self, *names: str) -> DataFrame:
        return self.of("attr").filter(naming.short_name(F.col("name")).isin(*names)).withColumn("attribute", naming.short_name(F.col("name")))


def _json(col: Column) -> Column:
    return F.to_json(col)


def arg(*names: str) -> Column:
    """The first argument of an attribute that is there, as text; null if none is."""
    return F.coalesce(*[F.get_json_object("args", f"$.{n}" if not n.isdigit() else f"$['{n}']") for n in names])


def _class_id(col: str = "owner") -> Column:
    return F.concat(F.lit("class:"), F.col(col))


def _nodes(rows: DataFrame, id_: Column, type_: Column | str, fqcn: Column, metadata: Column | None = None) -> DataFrame:
    kind = F.lit(type_) if isinstance(type_, str) else type_
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    return rows.select(id_.alias("id"), kind.alias("type"), fqcn.alias("fqcn"), naming.short_name(fqcn).alias("name"), "file", zero("line").alias("line"), zero("end_line").alias("end_line"), naming.module_of_path(F.col("file")).alias("module"), (F.lit("{}") if metadata is None else metadata).alias("metadata"), F.lit(False).alias("is_placeholder"), F.col("file").alias("file_seq"))


def _edges(rows: DataFrame, source: Column, target: Column, type_: Column | str, metadata: Column | None = None) -> DataFrame:
    kind = F.lit(type_) if isinstance(type_, str) else type_
    return rows.select(source.alias("source_id"), target.alias("target_id"), kind.alias("type"), (F.lit("{}") if metadata is None else metadata).alias("metadata"), "file", F.col("seq").alias("fact")).filter("target_id IS NOT NULL AND source_id IS NOT NULL")


def _per_class(f: Facts) -> DataFrame:
    """(owner, file, has, other): the short names of each class's attributes, and its last attribute that no extractor handles."""
    rows = f.of("attr").filter("owner_kind = 'class'").withColumn("short", naming.short_name(F.col("name")))
    other = F.when(~F.col("short").isin(*HANDLED), F.struct("seq", "name", "args", F.lit("class").alias("target")))
    return rows.groupBy("owner", "file").agg(F.collect_set("short").alias("has"), F.max(other).alias("other"))


def attribute_nodes(f: Facts) -> tuple[DataFrame | None, DataFrame | None]:
    """A node for each class with a known attribute, with its metadata and flags."""
    rows = f.on_classes(*NODE_ATTRIBUTES).join(_per_class(f), ["owner", "file"])
    kind = F.create_map(*[F.lit(x) for kv in NODE_ATTRIBUTES.items() for x in kv])[F.col("attribute")]
    rows = rows.withColumn("kind", kind)
    has = lambda name: F.array_contains("has", name)

    def of(type_: str) -> Column:
        fields = []
        for key, names, default in NODE_METADATA.get(type_, []):
            value = F.coalesce(arg(*names), F.lit(default).cast("string"))
            fields.append((value.cast("int") if key == "priority" else value).alias(key))
        fields += [F.when(has(a), F.lit(True)).alias(flag) for t, a, flag in FLAGS if t == type_]
        if type_ == "payload":
            listed = lambda name, default: F.coalesce(F.from_json(arg(name), "array<string>"), F.array(F.lit(default))).alias(name)
            access = reduce(lambda c, kv: c.when(F.col("attribute") == kv[0], kv[1]), ACCESS.items(), F.when(F.lit(False), ""))
            fields += [listed("methods", "GET"), listed("produces", "text/html"), access.alias("accessType")]
        if type_ == "auth_handler":
            fields.append(F.when(has("AsPublicPayload"), "public").when(has("AsServicePayload"), "service").alias("accessType"))
        if type_ == "service":
            fields.append(F.lit("worker").alias("scope"))
        if type_ == "entity":
            fields.append(F.coalesce(arg("name", "0"), F.col("owner")).alias("table"))
        if type_ == "command":
            fields.append(F.when(F.col("other").isNotNull(), F.struct(F.col("other.name").alias("name"), F.parse_json("other.args").alias("args"), F.col("other.target").alias("target"))).alias("attributes"))
        return _json(F.struct(*fields)) if fields else F.lit("{}")

    metadata = reduce(lambda c, t: c.when(F.col("kind") == t, of(t)), dict.fromkeys(NODE_ATTRIBUTES.values()), F.when(F.lit(False), ""))
    return _nodes(rows, _class_id(), F.col("kind"), F.col("owner"), metadata), None


def routes(f: Facts) -> tuple[DataFrame | None, DataFrame | None]:
    """A route for each method of a payload (GET if it states none), served by it."""
    methods = F.coalesce(F.from_json(arg("methods"), "array<string>"), F.array(F.lit("GET")))
    rows = f.on_classes(*PAYLOADS).withColumns({"path": F.coalesce(arg("path", "0"), F.lit("")), "methods": methods, "end_line": F.col("line")}).withColumn("method", F.explode("methods"))
    id_ = F.concat(F.lit("route:"), F.col("method"), F.lit(":"), F.col("path"))
    return _nodes(rows, id_, "route", F.concat_ws(" ", "method", "path"), _json(F.struct("method", "path"))), _edges(rows, _class_id(), id_, "serves_route")


def attribute_edges(f: Facts) -> tuple[DataFrame | None, DataFrame | None]:
    """Edges from classes by their attributes' arguments; a tenant's constraint of entities, and the layout mark of slots."""
    rows = f.of("attr").filter("owner_kind = 'class'").withColumn("attribute", naming.short_name(F.col("name"))).join(_per_class(f).select("owner", "file", "has"), ["owner", "file"])

    def rule(attribute, names, default, prefix, type_, metadata, when=None):
        value = F.coalesce(arg(*names), F.lit(default).cast("string")) if names else F.lit(default)
        own = [F.coalesce(arg(*n), F.lit(d)).alias(k) if n else F.lit(d).alias(k) for k, (n, d) in metadata.items()]
        test = (F.col("attribute") == attribute) & (value != "")
        edge = F.struct(F.concat(F.lit(prefix), F.regexp_replace(value, r"^\\+", "")).alias("target"), F.lit(type_).alias("type"), (_json(F.struct(*own)) if own else F.lit("{}")).alias("metadata"))
        return F.when(test if when is None else test & when, edge)

    has = lambda name: F.array_contains("has", name)
    rules = [rule(*r) for r in EDGE_ATTRIBUTES]
    rules.append(rule("AsSlotHandler", ("slot", "0"), "default", "slot:", "renders_slot", {"layout": ((), True)}, has("AsLayoutSlot")))
    rules.append(rule("FromTable", (), "tenant", "constraint:", "tenant_isolated", {}, has("TenantScoped")))
    found = rows.withColumn("e", F.explode(F.array_compact(F.array(*rules)))).withColumn("seq", F.col("seq") + F.when(F.col("e.metadata").contains("layout"), 1).otherwise(0))
    return None, _edges(found, _class_id(), F.col("e.target"), F.col("e.type"), F.col("e.metadata"))


def resources(f: Facts) -> tuple[DataFrame | None, DataFrame | None]:
    """A resource node for what a handler produces, with the handler's file and lines."""
    rows = f.on_classes("AsPayloadHandler").withColumn("resource", arg("resource", "1")).filter("resource != ''")
    return _nodes(rows, _class_id("resource"), "resource", F.col("resource")), None


def injections(f: Facts) -> tuple[DataFrame | None, DataFrame | None]:
    """Edges from classes by their properties' attributes; a property without a class type is unknown:<property>."""
    typed = f.of("prop").select("owner", F.col("name").alias("prop"), F.col("target").alias("prop_type")).distinct()
    rows = f.of("attr").filter("owner_kind = 'property'").withColumns({"attribute": naming.short_name(F.col("name")), "prop": F.col("target")}).join(typed, ["owner", "prop"], "left")
    own = F.coalesce(F.concat(F.lit("class:"), F.col("prop_type")), F.concat(F.lit("unknown:"), F.col("prop")))
    rules = []
    for attribute, names, prefix, type_, relation in PROPERTY_ATTRIBUTES:
        named = F.concat(F.lit(prefix), F.regexp_replace(F.coalesce(arg(*names), F.col("prop") if prefix == "config:" else F.lit(None).cast("string")), r"^\\+", "")) if names else own
        rules.append(F.when(F.col("attribute") == attribute, F.struct((named if relation else F.coalesce(named, own)).alias("target"), F.lit(type_).alias("type"), F.lit(relation).cast("string").alias("relationType"))))
    found = rows.withColumn("e", F.explode(F.array_compact(F.array(*rules))))
    return None, _edges(found, _class_id(), F.col("e.target"), F.col("e.type"), _json(F.struct(F.col("prop").alias("property"), F.col("e.relationType"))))


def inheritance(f: Facts) -> tuple[DataFrame | None, DataFrame | None]:
    """A node for each class-like, with its modifiers, and its extends and implements edges."""
    rows = f.of("class")
    flags = F.split(F.coalesce("detail", F.lit("")), ",")
    metadata = _json(F.struct(*[F.when(F.array_contains(flags, m), F.lit(True)).alias(m) for m in ("abstract", "final", "readonly")]))
    relations = f.of("rel").filter("name IN ('extends', 'implements')")
    return _nodes(rows, _class_id(), F.col("owner_kind"), F.col("owner"), metadata), _edges(relations, _class_id(), _class_id("target"), F.col("name"))


def trait_uses(f: Facts) -> tuple[DataFrame | None, DataFrame | None]:
    """uses edges; composed_of as well from payloads and handlers."""
    rows = f.of("rel").filter("name = 'uses'")
    composed = rows.join(f.attributes(*PAYLOADS, "AsPayloadHandler").select("owner").distinct(), "owner", "left_semi")
    return None, _edges(rows, _class_id(), _class_id("target"), "uses").unionByName(_edges(composed, _class_id(), _class_id("target"), "composed_of"))


def instantiations(f: Facts) -> tuple[DataFrame | None, DataFrame | None]:
    return None, _edges(f.of("new"), _class_id(), _class_id("target"), "instantiates")


def emissions(f: Facts) -> tuple[DataFrame | None, DataFrame | None]:
    return None, _edges(f.of("dispatch"), _class_id(), _class_id("target"), "emits")


def type_hints(f: Facts) -> tuple[DataFrame | None, DataFrame | None]:
    accepts = _edges(f.of("param"), _class_id(), _class_id("target"), "accepts", _json(F.struct(F.col("name").alias("param"))))
    return None, accepts.unionByName(_edges(f.of("return"), _class_id(), _class_id("target"), "returns"))


def imports(f: Facts) -> tuple[DataFrame | None, DataFrame | None]:
    """From every class to every import of its namespace in its file: an equi-join."""
    classes = f.of("class").select("file", "owner", F.when(F.col("owner").contains("\\"), F.regexp_replace("owner", r"\\[^\\]*$", "")).otherwise("").alias("detail"))
    rows = f.of("import").drop("owner").join(classes, ["file", "detail"])
    return None, _edges(rows, _class_id(), _class_id("target"), "imports")


def domains(f: Facts) -> tuple[DataFrame | None, DataFrame | None]:
    """A domain for each class in a named module, by the module's words, with what its file shows of it."""
    rows = f.of("class").withColumn("module", naming.module_of_path(F.col("file"))).filter("module NOT IN ('', 'App')").withColumn("domain", naming.infer_domain(F.col("module")))
    id_ = F.concat(F.lit("domain:"), F.col("domain"))
    short = naming.short_name(F.col("owner"))
    ends = lambda *suffixes: reduce(lambda a, b: a | b, [short.endswith(x) for x in suffixes])
    marked = f.of("attr").filter("owner_kind = 'class'").filter(F.col("name").contains("Propagated") | F.col("name").contains("OwnedAggregate")).select("file", F.lit(True).alias("marked")).distinct()
    files = rows.groupBy("file", "domain").agg(F.bool_or(ends("Handler")).alias("handler"), F.bool_or(ends("Event")).alias("event"), F.bool_or(ends("Entity", "Model")).alias("entity"), F.array_sort(F.collect_set(F.when(ends(*ENTITY_SUFFIX), short))).alias("entities"))  # as many as a file has classes
    files = files.join(marked, "file", "left")
    text = F.concat_ws(" ", F.concat(F.lit("Manages "), F.col("domain"), F.lit(" domain")), F.when(F.col("handler"), "with request handlers"), F.when(F.col("event"), "event-driven flows"), F.when(F.col("entity"), "data entities"))
    criticality = F.when(F.col("domain").isin(*naming.CRITICAL_DOMAINS) | F.coalesce("marked", F.lit(False)), "high").otherwise("medium")
    metadata = _json(F.struct(F.col("domain").alias("name"), F.concat(text, F.lit(".")).alias("description"), criticality.alias("criticality"), F.col("entities").alias("key_entities"), F.array(F.lit("module_name"), F.lit("namespace_patterns")).alias("inferred_from")))
    files = files.withColumns({"line": F.lit(1), "end_line": F.lit(1)})
    return _nodes(files, id_, "domain_context", F.col("domain"), metadata), _edges(rows, _class_id(), id_, "belongs_to_domain")


def flows(f: Facts) -> tuple[DataFrame | None, DataFrame | None]:
    """A flow for each payload with a path, with its entry and first step; the payload and its handlers take part."""
    methods = F.coalesce(F.from_json(arg("methods"), "array<string>"), F.array(F.lit("GET")))
    rows = f.on_classes(*PAYLOADS).withColumns({"flow": naming.flow_name(F.col("owner")), "entry": F.concat(F.lit("route:"), F.array_join(methods, ","), F.lit(":"), arg("path", "0"))}).filter(arg("path", "0") != "")
    handlers = f.attributes("AsPayloadHandler").filter("owner_kind = 'class'").withColumn("payload", arg("payload", "0")).filter("payload != ''").withColumn("flow", naming.flow_name(F.col("payload")))
    id_ = F.concat(F.lit("flow:"), F.col("flow"))
    steps = F.array(F.struct(F.lit(1).alias("order"), _class_id().alias("node"), F.lit("payload").alias("role")))
    metadata = _json(F.struct(F.col("flow").alias("name"), F.col("entry").alias("entry_point"), steps.alias("steps"), F.array().cast("array<string>").alias("events_emitted")))
    entry = _edges(rows, _class_id(), id_, "participates_in_flow", F.lit('{"role":"entry"}'))
    handled = _edges(handlers, _class_id(), id_, "participates_in_flow", _json(F.struct(F.lit("handler").alias("role"), F.coalesce(arg("execution", "2"), F.lit("sync")).alias("execution"))))
    return _nodes(rows, id_, "execution_flow", F.col("flow"), metadata), entry.unionByName(handled)


def subjects(f: Facts, prefix: str = SUBJECT_PREFIX) -> tuple[DataFrame | None, DataFrame | None]:
    """A subject for each propagated event, by its domain and its name in snake case; the aggregate that it belongs to; the subjects of aggregates' commands."""
    rows = f.on_classes("Propagated").withColumns({"domain": F.coalesce(arg("domain", "0"), naming.event_domain(F.col("owner"))), "event_type": naming.snake_case(F.regexp_replace(naming.short_name(F.col("owner")), "(Event|Payload)$", ""))})
    rows = rows.withColumn("pattern", F.concat_ws(".", F.lit(f"{prefix}.events.{{node}}"), "domain", "event_type"))
    id_ = F.concat(F.lit("subject:"), F.col("pattern"))
    metadata = _json(F.struct("pattern", "domain", "event_type", F.lit(True).alias("wildcard"), F.lit("EVENTS").alias("stream")))
    owned = f.on_classes("OwnedAggregate").join(rows.select("owner", "file").distinct(), ["owner", "file"], "left_semi").withColumns({"aggregate": arg("type", "0"), "creates": F.coalesce(arg("creates"), F.lit("false")) == "true"}).filter("aggregate != ''")
    of = F.concat(F.lit("aggregate:"), F.col("aggregate"))
    aggregate = _json(F.struct(F.col("aggregate").alias("aggregate_type"), arg("idField", "1").alias("id_field"), F.when(F.col("creates"), F.col("owner")).alias("creates_event")))
    commands = f.attributes("AsAggregateCommand").filter("owner_kind = 'class'").withColumn("aggregate", arg("aggregateType", "subject", "0")).filter("aggregate != ''")
    routed = _edges(commands, _class_id(), F.concat(F.lit(f"subject:{prefix}.commands."), F.col("aggregate"), F.lit(".{ownerNode}")), "routes_command_to", _json(F.struct(F.col("aggregate").alias("aggregate_type"), arg("aggregateIdField", "1").alias("id_field"))))
    edges = _edges(rows, _class_id(), id_, "publishes_to", _json(F.struct("domain", "event_type"))).unionByName(_edges(owned, _class_id(), of, "is_aggregate_of", _json(F.struct(F.when(F.col("creates"), "creation_event").otherwise("mutation_event").alias("role"))))).unionByName(routed)
    return _nodes(rows, id_, "nats_subject", F.col("pattern"), metadata).unionByName(_nodes(owned, of, "aggregate_root", F.col("aggregate"), aggregate)), edges


def _classes(f: Facts) -> DataFrame:
    """Each class with the numbers that risk and complexity count, and its attributes in their order."""
    related = f.of("rel").groupBy("owner", "file").agg(*[F.count_if(F.col("name") == t).alias(n) for t, n in (("extends", "parents"), ("implements", "interfaces"), ("uses", "traits"))])
    props = f.of("prop").groupBy("owner", "file").agg(F.count("*").alias("props"))
    attributes = f.of("attr").filter("owner_kind = 'class'").groupBy("owner", "file").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("attributes"))  # as many as a class has
    rows = f.of("class").join(related, ["owner", "file"], "left").join(props, ["owner", "file"], "left").join(attributes, ["owner", "file"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("parents", "interfaces", "traits", "props")}
    return rows.withColumns(zero | {"short": naming.short_name(F.col("owner")), "attributes": F.coalesce(F.transform("attributes", lambda a: a["name"]), F.array().cast("array<string>"))})


def hotspots(f: Facts) -> tuple[DataFrame | None, DataFrame | None]:
    """A hotspot for each class of a risk of HOTSPOT_RISK and more, with what makes it one."""
    rows = _classes(f)
    hits = F.size(F.filter("attributes", lambda a: a.contains("Payload") | a.contains("Handler") | a.contains("Service")))
    rows = rows.withColumns({"risk": risk_score(F.col("short"), F.col("parents"), F.col("interfaces"), F.col("traits"), hits), "complexity": complexity_score(F.col("parents"), F.col("interfaces"), F.col("traits"), F.col("props"))}).filter(F.col("risk") >= HOTSPOT_RISK)
    critical = reduce(lambda a, b: a | b, [F.col("short").contains(c) for c in CRITICAL_NAMES])
    advice = (
        F.when((F.col("risk") >= 0.6) & F.col("short").endswith("Service"), "Consider extracting interface and splitting into focused services")
        .when((F.col("risk") >= 0.5) & (F.col("traits") > 2), "High trait usage — consider composition over inheritance")
        .when(F.col("interfaces") > 3, "Many interfaces — verify single responsibility principle")
    )
    score = F.round("risk", 2).alias("risk_score")
    incoming = F.col("interfaces") + F.col("traits") + F.when(F.col("parents") > 0, 1).otherwise(0)
    metadata = _json(F.struct(_class_id().alias("target_node_id"), score, incoming.alias("incoming_edges"), F.lit(0).alias("cross_module_deps"), critical.alias("is_critical_path"), F.col("complexity").alias("complexity_score"), advice.alias("recommendation")))
    id_ = F.concat(F.lit("hotspot:"), F.col("owner"))
    return _nodes(rows, id_, "hotspot", F.col("owner"), metadata), _edges(rows, _class_id(), id_, "is_hotspot", _json(F.struct(score)))


def intents(f: Facts) -> tuple[DataFrame | None, DataFrame | None]:
    """What each class is for: by the ending of its name, over which its attributes go in their order."""
    rows = _classes(f)
    purpose = lambda text, duties, source, sure: F.struct(text.alias("purpose"), F.array(*map(F.lit, duties)).alias("responsibilities"), source.alias("inferred_from"), F.lit(sure).alias("confidence"))
    named = F.when(F.lit(False), purpose(F.lit(""), ("",), F.array(F.lit("")), 0.5))
    for suffix, (text, duties) in INTENT_SUFFIX.items():
        before, after = text.split("%s")
        words = naming.spaced_words(F.regexp_replace("short", f"{suffix}$", ""))
        named = named.when(F.col("short").endswith(suffix), purpose(F.concat(F.lit(before), F.when(words == "", "domain").otherwise(words), F.lit(after)), duties, F.array(F.lit("class_name_suffix")), 0.75))
    none = F.struct(F.lit("").alias("purpose"), F.array().cast("array<string>").alias("responsibilities"), F.array().cast("array<string>").alias("inferred_from"), F.lit(0.5).alias("confidence"))

    def over(known: Column, attribute: Column) -> Column:
        short, out = F.substring_index(attribute, "\\", -1), None
        for needles, source, text, duties, sure in INTENT_ATTRIBUTE:
            test = reduce(lambda a, b: a & b, [short.contains(n) for n in needles])
            new = F.struct(F.lit(text).alias("purpose"), F.array(*map(F.lit, duties)).alias("responsibilities"), F.array_union(known["inferred_from"], F.array(F.lit(source))).alias("inferred_from"), F.greatest(known["confidence"], F.lit(sure)).alias("confidence"))
            out = F.when(test, new) if out is None else out.when(test, new)
        return out.otherwise(known)

    rows = rows.withColumn("intent", F.aggregate("attributes", F.coalesce(named, none), over)).filter("intent.purpose != ''").withColumns({"line": F.lit(1), "end_line": F.lit(1)})
    id_ = F.concat(F.lit("doc:"), _class_id())
    i = F.col("intent")
    metadata = _json(F.struct(_class_id().alias("target_node_id"), i["purpose"].alias("purpose"), i["responsibilities"].alias("responsibilities"), i["inferred_from"].alias("inferred_from"), i["confidence"].alias("confidence"), F.lit("inference").alias("source")))
    return _nodes(rows, id_, "doc_node", F.lit(""), metadata), _edges(rows, _class_id(), id_, "intent_for", _json(F.struct(i["confidence"].alias("confidence"))))


EXTRACTORS: list[Callable[[Facts], tuple[DataFrame | None, DataFrame | None]]] = [routes, attribute_nodes, resources, attribute_edges, injections, domains, flows, subjects, intents, hotspots, inheritance, trait_uses, emissions, instantiations, type_hints, imports]


def extract_rows(facts: DataFrame, extractors=None) -> tuple[DataFrame, DataFrame]:
    """What facts say file by file: nodes merged within each file (file_seq), and all edges with their file and place."""
    f = Facts(facts)
    nodes, edges = [], []
    for seq, run in enumerate(EXTRACTORS if extractors is None else extractors):
        n, e = run(f)
        if n is not None:
            nodes.append(n.withColumn("seq", F.lit(seq)))
        if e is not None:
            edges.append(e.withColumn("seq", F.lit(seq)))
    # Written once: the merges read them several times, and the extractors' plans end here.
    rows = stored(union(nodes), "extracted").withColumn("id", F.struct("file_seq", "id"))
    return G.merge_nodes(rows).select("id.*", *[c for c in G.NODE if c != "id"]), stored(union(edges), "extracted")


def fold(nodes: DataFrame, edges: DataFrame) -> Graph:
    """The graph of extract_rows() of all files: the first file owns an id, edges have the last metadata, missing targets get placeholders."""
    real, links = G.first_file_wins(nodes), G.upsert_edges(edges, ["file", "seq", "fact"])
    return Graph(real.unionByName(G.placeholders(real, links)), links)


def extract(facts: DataFrame, extractors=None) -> Graph:
    """The graph of facts, by extract_rows() and fold()."""
    return fold(*extract_rows(facts, extractors))
