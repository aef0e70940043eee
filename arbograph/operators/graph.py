"""The graph as two DataFrames: write algebra, look-ups, joins and aggregates.

nodes: id, type, fqcn, name, file, line, end_line, module, metadata (JSON), is_placeholder; one row per id.
edges: source_id, target_id, type, metadata; one row per (source, target, type).
Every method takes and returns DataFrames and collects nothing. "First" and limits follow a total order: id for nodes,
(source_id, target_id, type) for edges.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbograph.functions import naming
from arbograph.runtime import is_id, split_join

NODE = ("id", "type", "fqcn", "name", "file", "line", "end_line", "module", "metadata", "is_placeholder")
EDGE = ("source_id", "target_id", "type", "metadata")

#: Fixed: the edge types that count as coupling between modules.
CROSS_MODULE = ("injects_readonly", "injects_mutable", "injects_factory", "calls", "extends", "implements", "handles", "produces", "listens_to", "emits")
#: Fixed: priorities of node types when several rows describe one id; others have 100.
TYPE_PRIORITY = {
    220: ("command",),
    180: ("payload", "handler", "resource", "service", "event", "event_listener", "entity", "repository", "auth_handler", "component", "slot_handler", "data_provider", "job", "pipeline_phase"),
    160: ("domain_context", "execution_flow", "event_flow", "data_lifecycle", "system_boundary", "hotspot", "nats_subject", "aggregate_root", "doc_node"),
    140: ("route", "method", "property", "constant", "enum_case"),
    20: ("class", "interface", "trait", "enum"),
}


def type_priority(type_: Column) -> Column:
    return reduce(lambda c, kv: c.when(type_.isin(*kv[1]), kv[0]), TYPE_PRIORITY.items(), F.when(F.lit(False), 0)).otherwise(100)


def text_json(metadata: Column) -> Column:
    """Metadata with null, [] and {} as one empty object."""
    return F.when(metadata.isNull() | F.trim(metadata).isin("", "[]", "{}"), "{}").otherwise(metadata)


# -- write algebra


def merge_nodes(rows: DataFrame) -> DataFrame:
    """Rows of one file with a column seq (the extractor's place) merged to one per id.

    The type of the highest priority wins, at a tie the later extractor; empty texts and zeros are filled from the
    other rows, the best first; metadata keys of the winner lie over those of the losers; placeholder only if all are.
    """
    rank = F.struct(type_priority(F.col("type")).alias("p"), F.col("seq"))
    best = lambda c: F.max_by(c, rank)
    filled = lambda c, empty: F.coalesce(F.max_by(F.when(F.col(c) != empty, F.col(c)), F.when(F.col(c) != empty, rank)), F.lit(empty))
    maps = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), text_json(F.col("metadata")).alias("m")))), lambda x: F.from_json(x["m"], "map<string,variant>"))  # as many as extractors saw the id
    return (
        rows.groupBy("id")
        .agg(best("type").alias("type"), *[filled(c, "").alias(c) for c in ("fqcn", "name", "file")], *[filled(c, 0).alias(c) for c in ("line", "end_line")], filled("module", "").alias("module"), maps.alias("maps"), F.min("is_placeholder").alias("is_placeholder"))
        .withColumn("metadata", F.to_json(F.aggregate("maps", F.expr("cast(map() as map<string,variant>)"), lambda a, m: F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(m), k)), m))))
        .select(*NODE)
    )


def upsert_nodes(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per id of versions in the order of the columns `order`: real before placeholder, then the last. Null ids are dropped."""
    picked = F.max_by(F.struct(*NODE), F.struct((~F.col("is_placeholder")).alias("real"), *order))
    return rows.filter("id IS NOT NULL").groupBy(F.col("id").alias("key")).agg(picked.alias("n")).select("n.*")


def first_file_wins(rows: DataFrame) -> DataFrame:
    """Rows of several files (column file_seq, the file's place): a real node beats a placeholder, else the first file owns the id."""
    picked = F.min_by(F.struct(*NODE), F.struct("is_placeholder", "file_seq"))
    return rows.groupBy(F.col("id").alias("key")).agg(picked.alias("n")).select("n.*")


def upsert_edges(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per (source, target, type) with the metadata of the last; rows with a null or blank end are dropped."""
    return rows.filter(is_id(F.col("source_id")) & is_id(F.col("target_id"))).groupBy("source_id", "target_id", "type").agg(F.max_by("metadata", F.struct(*order)).alias("metadata"))


def placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes for edge targets that have none: type class, fqcn after the first colon, nothing else."""
    missing = edges.select(F.col("target_id").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    fqcn = naming.fqcn_of_id(F.col("id"))
    empty = F.lit("")
    return missing.select("id", F.lit("class").alias("type"), fqcn.alias("fqcn"), naming.short_name(fqcn).alias("name"), empty.alias("file"), F.lit(0).alias("line"), F.lit(0).alias("end_line"), empty.alias("module"), F.lit("{}").alias("metadata"), F.lit(True).alias("is_placeholder"))


def remove_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, owner: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of files(file). With an owner column only the edges a file owns go; else all that touch its nodes."""
    gone = nodes.join(files.select("file").distinct(), "file", "left_semi").select("id")
    kept = nodes.join(files.select("file").distinct(), "file", "left_anti").select(*nodes.columns)
    if owner:
        return kept, edges.join(files.select(F.col("file").alias(owner)).distinct(), owner, "left_anti").select(*edges.columns)
    left = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return kept, left.select(*edges.columns)


def diff_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) of two snapshots (path, content_hash): added, modified or deleted; what is unchanged is left out. A null hash equals only a null one."""
    a, b = before.select("path", F.col("content_hash").alias("old"), F.lit(True).alias("was")), after.select("path", F.col("content_hash").alias("new"), F.lit(True).alias("is"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status")).filter("status IS NOT NULL")


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, name, before, after, delta, status) of two Graph.snapshot()s; status is new, removed, changed or same, of modules new or removed only."""
    a, b = (df.select("kind", "name", F.col("n").alias(n)) for df, n in ((before, "before"), (after, "after")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = a.join(b, ["kind", "name"], "full_outer")
    status = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    rows = both.select("kind", "name", zero("before").alias("before"), zero("after").alias("after"), (zero("after") - zero("before")).alias("delta"), status.alias("status"))
    return rows.filter("kind IN ('nodes', 'edges') OR kind = 'type' AND delta != 0 OR kind = 'module' AND status IN ('new', 'removed')")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    # -- look-ups

    def node(self, id_: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == id_)

    def by_fqcn(self, fqcn: str) -> DataFrame:
        """The node of a class name: a real one with a class: id, else a real one, else the first."""
        rank = F.when(~F.col("is_placeholder") & F.col("id").startswith("class:"), 0).when(~F.col("is_placeholder"), 1).otherwise(2)
        return self.nodes.filter(F.col("fqcn") == fqcn).orderBy(rank, "id").limit(1)

    def get(self, id_or_fqcn: str) -> DataFrame:
        """By id, else by fqcn."""
        a = self.node(id_or_fqcn).withColumn("rank", F.lit(0))
        return a.unionByName(self.by_fqcn(id_or_fqcn).withColumn("rank", F.lit(1))).orderBy("rank", "id").limit(1).drop("rank")

    def in_file(self, file: str) -> DataFrame:
        return self.nodes.filter(F.col("file") == file)

    def of_type(self, type_: str, module: str | None = None) -> DataFrame:
        found = self.nodes.filter(F.col("type") == type_)
        return found.filter(F.col("module") == module) if module else found

    def of_module(self, module: str) -> DataFrame:
        return self.nodes.filter(F.col("module") == module)

    def search_name(self, text: str, limit: int = 20) -> DataFrame:
        """Names that contain the text, whatever the case; the first `limit` by id."""
        return self.nodes.filter(F.lower("name").contains(text.lower())).orderBy("id").limit(limit)

    def search(self, text: str, limit: int = 20) -> DataFrame:
        """Name hits, then fqcn hits, each node once at its first place, cut to `limit`; (…, place) keeps the order."""
        hits = self.search_name(text, limit).withColumn("kind", F.lit(0)).unionByName(self.nodes.filter(F.lower("fqcn").contains(text.lower())).orderBy("id").limit(limit).withColumn("kind", F.lit(1)))
        first = hits.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("kind"))).filter("n = 1")
        return first.orderBy("kind", "id").limit(limit).drop("n").withColumnRenamed("kind", "place")

    def find(self, type_: str | None = None, module: str | None = None, pattern: str | None = None) -> DataFrame:
        """With a pattern the 20 first hits are filtered by type and module afterwards; without any argument all nodes."""
        found = self.search(pattern).drop("place") if pattern else self.nodes
        if type_:
            found = found.filter(F.col("type") == type_)
        return found.filter(F.col("module") == module) if module else found

    def edges_of(self, id_: str, direction: str = "both", type_: str | None = None) -> DataFrame:
        """Edges out of, into, or of both directions of a node; a self-loop stands twice in both. The type counts in every direction."""
        out, into = self.edges.filter(F.col("source_id") == id_), self.edges.filter(F.col("target_id") == id_)
        found = {"outgoing": lambda: out, "incoming": lambda: into, "both": lambda: out.unionByName(into)}[direction]()
        return found.filter(F.col("type") == type_) if type_ else found

    def edges_of_type(self, type_: str, limit: int | None = None) -> DataFrame:
        found = self.edges.filter(F.col("type") == type_)
        return found.orderBy("source_id", "target_id").limit(limit) if limit else found

    def resolve_target(self, text: str) -> DataFrame:
        """(id): by id, else fqcn, else the first node of that file, else the first search hit."""
        first = lambda df, rank: df.select("id", F.lit(rank).alias("rank"))
        found = first(self.node(text), 0).unionByName(first(self.by_fqcn(text), 1)).unionByName(first(self.in_file(text), 2)).unionByName(first(self.search(text, 1), 3))
        return found.orderBy("rank", "id").limit(1).select("id")

    def resolve_component(self, text: str) -> DataFrame:
        """(id): a class: or module: id as it stands, else class: before it if there is such a node, else the first search hit with the text in its id."""
        if text.startswith(("class:", "module:")):
            return self.nodes.sparkSession.createDataFrame([(text,)], "id string")
        own = self.node(f"class:{text}").select("id", F.lit(0).alias("rank"))
        hits = self.search(text).filter(F.col("id").contains(text)).select("id", F.lit(1).alias("rank"))
        return own.unionByName(hits).orderBy("rank", "id").limit(1).select("id")

    # -- joins

    def ends(self, edges: DataFrame | None = None, columns: tuple[str, ...] = ("module",)) -> DataFrame:
        """Edges with the columns of both ends as source_<c> and target_<c>, null where an end has no node."""
        edges = self.edges if edges is None else edges
        side = lambda s: self.nodes.select(F.col("id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in columns])
        return split_join(split_join(edges, side("source"), "source_id", "left"), side("target"), "target_id", "left").select(*edges.columns, *[f"{s}_{c}" for s in ("source", "target") for c in columns])

    def cross_module(self, from_: str | None = None, to: str | None = None) -> DataFrame:
        """Coupling edges between two named, different modules, with both modules. Only nodes of named modules (of the ones asked for) are joined."""
        edges = self.edges.filter(F.col("type").isin(*CROSS_MODULE))
        for side, module in (("source", from_), ("target", to)):
            named = self.nodes.filter(F.col("module") == module if module else F.col("module") != "")
            edges = split_join(edges, named.select(F.col("id").alias(f"{side}_id"), F.col("module").alias(f"{side}_module")), f"{side}_id")
        return edges.filter("source_module != target_module").select(*self.edges.columns, "source_module", "target_module")

    def labelled(self, edges: DataFrame) -> DataFrame:
        """Edges with a label for each end: its fqcn, or its id where there is no node."""
        both = self.ends(edges, ("fqcn",))
        return both.withColumns({f"{s}_label": F.coalesce(F.col(f"{s}_fqcn"), F.col(f"{s}_id")) for s in ("source", "target")}).drop("source_fqcn", "target_fqcn")

    def compact(self, edges: DataFrame, side: str) -> DataFrame:
        """(label, kinds, n): edges grouped by the label of one side; kinds are sorted and parted by commas."""
        return self.labelled(edges).groupBy(F.col(f"{side}_label").alias("label")).agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("kinds"), F.count("*").alias("n"))

    def induced(self, ids: DataFrame) -> DataFrame:
        """Edges with both ends in ids(id)."""
        return self.edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")

    def implementors(self, contract: str) -> DataFrame:
        sources = self.edges.filter((F.col("type") == "satisfies_contract") & (F.col("target_id") == contract)).select(F.col("source_id").alias("id"))
        return self.nodes.join(sources, "id", "left_semi")

    def related_tests(self, id_: str) -> DataFrame:
        """The tests edges into a node; test_nodes() are the nodes that they come from."""
        return self.edges.filter((F.col("type") == "tests") & (F.col("target_id") == id_))

    def test_nodes(self, id_: str) -> DataFrame:
        return self.nodes.join(self.related_tests(id_).select(F.col("source_id").alias("id")), "id", "left_semi")

    def exists(self, id_: str) -> bool:
        return not self.node(id_).isEmpty()

    def typed(self, ids: DataFrame) -> DataFrame:
        """ids(id) with the type of their node, unknown where there is none."""
        return split_join(ids, self.nodes.select("id", "type"), "id", "left").withColumn("type", F.coalesce("type", F.lit("unknown")))

    def handler_chains(self) -> DataFrame:
        """(route, payload, handler, resource): route <- serves_route payload <- handles handler -> produces resource; missing steps are null, a payload is needed."""
        step = lambda t, a, b: self.edges.filter(F.col("type") == t).select(F.col("source_id").alias(a), F.col("target_id").alias(b))
        return step("handles", "handler", "payload").join(step("serves_route", "payload", "route"), "payload", "left").join(step("produces", "handler", "resource"), "handler", "left").select("route", "payload", "handler", "resource")

    def without(self, edge_type: str) -> DataFrame:
        """Nodes from which no edge of that type goes out."""
        return self.nodes.join(self.edges.filter(F.col("type") == edge_type).select(F.col("source_id").alias("id")), "id", "left_anti")

    def with_domain(self) -> DataFrame:
        """(id, domain_id) of the first belongs_to_domain target of each node that has one."""
        return self.edges.filter("type = 'belongs_to_domain'").groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("domain_id"))

    def domain_of(self, id_: str) -> DataFrame:
        """(domain_id, name, description, criticality, key_entities) of a node's first domain; of module:<name> that of the module's first node that has one."""
        if id_.startswith("module:"):
            own = self.nodes.filter(F.col("module") == id_[7:]).select(F.col("id").alias("source_id"))
            found = self.edges.filter("type = 'belongs_to_domain'").join(own, "source_id", "left_semi")
        else:
            found = self.edges_of(id_, "outgoing", "belongs_to_domain")
        first = found.orderBy("source_id", "target_id").limit(1).select(F.col("target_id").alias("id"))
        of = lambda key, default: F.coalesce(F.get_json_object("metadata", f"$.{key}"), F.lit(default))
        return self.nodes.filter("type = 'domain_context'").join(first, "id").select(F.col("id").alias("domain_id"), F.coalesce(F.get_json_object("metadata", "$.name"), F.col("name")).alias("name"), of("description", "").alias("description"), of("criticality", "medium").alias("criticality"), of("key_entities", "[]").alias("key_entities"))

    def event_info(self, id_: str) -> DataFrame:
        """(role, id): what emits an event and what listens to it, for events without a node of their own."""
        role = lambda type_, name: self.edges_of(id_, "incoming", type_).select(F.lit(name).alias("role"), F.col("source_id").alias("id"))
        return role("emits", "emitter").unionByName(role("listens_to", "listener"))

    def lifecycle(self, id_: str) -> DataFrame:
        """(role, mode, id, label, queue) of one event: its emitters, listeners by mode (sync if none is stated), subject with its stream as queue, and the subject's consumers."""
        name = lambda df: split_join(df, self.nodes.select("id", "fqcn", F.col("metadata").alias("own")), "id", "left")
        row = lambda df, role, mode, queue: df.select(F.lit(role).alias("role"), mode.alias("mode"), "id", F.coalesce(F.when(F.col("fqcn") != "", F.col("fqcn")), F.col("id")).alias("label"), queue.alias("queue"))
        none = F.lit(None).cast("string")
        at = lambda c, key: F.get_json_object(text_json(F.col(c)), f"$.{key}")
        emitters = row(name(self.edges_of(id_, "incoming", "emits").select(F.col("source_id").alias("id"))), "emitter", none, none)
        heard = name(self.edges_of(id_, "incoming", "listens_to").select(F.col("source_id").alias("id"), "metadata"))
        mode = F.coalesce(at("metadata", "executionMode"), F.lit("sync"))
        listeners = row(heard, "listener", F.when(mode.isin("async", "queued"), mode).otherwise("sync"), at("own", "queue"))
        subject = self.edges_of(id_, "outgoing", "publishes_to").orderBy("target_id").limit(1).select(F.col("target_id").alias("id"))
        subjects = name(subject)
        consumers = self.edges.filter("type = 'consumes_from'").join(subject.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id"))
        pattern = subjects.withColumn("fqcn", F.coalesce(at("own", "pattern"), F.col("id")))
        return emitters.unionByName(listeners).unionByName(row(pattern, "subject", none, F.coalesce(at("own", "stream"), F.lit("EVENTS")))).unionByName(row(name(consumers), "consumer", none, none))

    def lifecycles(self) -> DataFrame:
        """(event_id, n_emitters, sync, async, queued, subjects, n_consumers) of the targets of emits and listens_to; listeners by executionMode, sync if it is not stated."""
        e = lambda t: self.edges.filter(F.col("type") == t)
        mode = F.coalesce(F.get_json_object(text_json(F.col("metadata")), "$.executionMode"), F.lit("sync"))
        emitters = e("emits").groupBy(F.col("target_id").alias("event_id")).agg(F.count("*").alias("n_emitters"))
        listeners = e("listens_to").withColumn("mode", mode).groupBy(F.col("target_id").alias("event_id")).agg(*[F.count_if(F.col("mode") == m).alias(m) for m in ("sync", "async", "queued")])
        published = e("publishes_to").select(F.col("source_id").alias("event_id"), F.col("target_id").alias("subject"))
        consumers = e("consumes_from").groupBy(F.col("target_id").alias("subject")).agg(F.count("*").alias("c"))
        subjects = published.join(consumers, "subject", "left").groupBy("event_id").agg(F.count("*").alias("subjects"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_consumers"))
        found = emitters.join(listeners, "event_id", "full_outer").join(subjects, "event_id", "left")
        return found.select("event_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_emitters", "sync", "async", "queued", "subjects", "n_consumers")])

    # -- aggregates

    def count_by_type(self, what: str = "nodes") -> DataFrame:
        return getattr(self, what).groupBy("type").agg(F.count("*").alias("n"))

    def modules(self, type_: str | None = "class") -> DataFrame:
        """(module, n) of the nodes of a type, of all if it is None, most first; nodes of no module don't count."""
        base = self.nodes if type_ is None else self.of_type(type_)
        return base.filter("module != ''").groupBy("module").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module")

    def routes(self) -> DataFrame:
        """(method, n) of the routes, GET where metadata states none."""
        return self.of_type("route").groupBy(F.coalesce(F.get_json_object(text_json(F.col("metadata")), "$.method"), F.lit("GET")).alias("method")).agg(F.count("*").alias("n"))

    def context(self, module: str | None = None) -> DataFrame:
        """One row of a project's (or a module's) numbers: n_modules, n_routes, services, contracts, events, listeners, entities, relations, cross_module_edges (null for a module)."""
        nodes = self.of_module(module) if module else self.nodes
        n = lambda t: F.count_if(F.col("type") == t)
        counts = nodes.agg(F.count_distinct(F.when(F.col("module") != "", F.col("module"))).alias("n_modules"), n("route").alias("n_routes"), n("service").alias("services"), n("event").alias("events"), n("event_listener").alias("listeners"), n("entity").alias("entities"))
        edges = self.edges.filter(F.col("type").isin("satisfies_contract", "has_relation"))
        if module:
            edges = self.ends(edges).filter((F.col("source_module") == module) | (F.col("target_module") == module))
        links = edges.agg(F.count_distinct(F.when(F.col("type") == "satisfies_contract", F.col("target_id"))).alias("contracts"), n("has_relation").alias("relations"))
        crossing = self.cross_module().agg(F.count("*").alias("cross_module_edges")) if not module else self.nodes.sparkSession.range(1).select(F.lit(None).cast("long").alias("cross_module_edges"))
        one = lambda df: df.withColumn("one", F.lit(1))  # one row each
        return one(counts).join(one(links), "one").join(one(crossing), "one").select("n_modules", "n_routes", "services", "contracts", "events", "listeners", "entities", "relations", "cross_module_edges")

    def edge_count(self, type_: str, module: str) -> DataFrame:
        """(n): the edges of a type with an end in the module."""
        return self.ends(self.edges.filter(F.col("type") == type_)).filter((F.col("source_module") == module) | (F.col("target_module") == module)).agg(F.count("*").alias("n"))

    def satisfied_contracts(self) -> DataFrame:
        return self.edges.filter("type = 'satisfies_contract'").agg(F.count_distinct("target_id").alias("n"))

    def overview(self, types: tuple[str, ...] = ("class", "interface", "trait", "enum", "method")) -> DataFrame:
        """(module, n_<type>...): a column for each type."""
        return self.nodes.groupBy("module").agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types])

    def orphan_nodes(self) -> DataFrame:
        """Nodes that no edge touches, routes excepted."""
        touched = self.edges.select(F.col("source_id").alias("id")).unionByName(self.edges.select(F.col("target_id").alias("id"))).distinct()
        return self.nodes.filter("type != 'route'").join(touched, "id", "left_anti")

    def totals(self) -> DataFrame:
        """(kind, n): nodes, edges, placeholders, modules, orphans, cross_module_edges."""
        row = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        parts = [row("nodes", self.nodes), row("edges", self.edges), row("placeholders", self.nodes.filter("is_placeholder")), row("modules", self.nodes.filter("module != ''").select("module").distinct()), row("orphans", self.orphan_nodes()), row("cross_module_edges", self.cross_module())]
        return reduce(DataFrame.unionByName, parts)

    def snapshot(self, module: str | None = None) -> DataFrame:
        """(kind, name, n): the numbers that two states of a graph are compared by: nodes and edges in all, nodes by type, and the modules."""
        nodes = self.of_module(module) if module else self.nodes
        edges = self.ends().filter((F.col("source_module") == module) | (F.col("target_module") == module)) if module else self.edges
        row = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("name"), "n")
        types = nodes.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), "name", "n")
        modules = nodes.filter("module != ''").groupBy(F.col("module").alias("name")).agg(F.count("*").alias("n")).select(F.lit("module").alias("kind"), "name", "n")
        return reduce(DataFrame.unionByName, [row(nodes, "nodes"), row(edges, "edges"), types, modules])

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree, degree) of every node that an edge touches."""
        both = self.edges.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(self.edges.select(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))
