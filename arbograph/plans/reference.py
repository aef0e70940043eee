"""Queries over the code graph of graph_nodes, core_nodes and graph_edges, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbograph.functions import naming
from arbograph.operators import graph as G
from arbograph.operators import extract, score, traverse
from arbograph.operators.graph import Graph
from arbograph.runtime import scratch_path, stored, table, union
from arbograph.sources import facts, render
from arbograph.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VENDOR = "Orchard"

_BLANK = "length(trim({0}, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160))) > 0"


# The constants of the SQL are written out and not taken from the operators, so that a wrong one there shows.
_CROSS = "('injects_readonly', 'injects_mutable', 'injects_factory', 'calls', 'extends', 'implements', 'handles', 'produces', 'listens_to', 'emits')"
_PRIORITY = """CASE WHEN type = 'command' THEN 220
 WHEN type IN ('payload', 'handler', 'resource', 'service', 'event', 'event_listener', 'entity', 'repository', 'auth_handler', 'component', 'slot_handler', 'data_provider', 'job', 'pipeline_phase') THEN 180
 WHEN type IN ('domain_context', 'execution_flow', 'event_flow', 'data_lifecycle', 'system_boundary', 'hotspot', 'nats_subject', 'aggregate_root', 'doc_node') THEN 160
 WHEN type IN ('route', 'method', 'property', 'constant', 'enum_case') THEN 140 WHEN type IN ('class', 'interface', 'trait', 'enum') THEN 20 ELSE 100 END"""
_BLAST = """CASE WHEN via_type IN ('implements', 'extends', 'satisfies_contract') THEN 10 WHEN via_type IN ('serves_route', 'handles', 'exposes_api') THEN 7 WHEN via_type IN ('listens_to', 'emits', 'publishes_to', 'consumes_from') THEN 6
 WHEN via_type IN ('accepts', 'returns', 'injects_readonly', 'injects_mutable') THEN 5 WHEN via_type IN ('uses', 'imports', 'calls', 'instantiates') THEN 2 ELSE 1 END"""
_RISK = "CASE WHEN type IN ('injects_readonly', 'injects_mutable') THEN 3 WHEN type IN ('instantiates', 'extends', 'implements') THEN 2 ELSE 1 END"
_DIRECT = "('calls', 'instantiates', 'injects_readonly', 'injects_mutable', 'extends', 'implements', 'listens_to')"
_FURTHER = "('calls', 'instantiates', 'injects_readonly', 'injects_mutable')"
_RELEVANCE = """CASE WHEN N.type IN ('payload', 'handler') THEN 10 WHEN N.type IN ('service', 'route') THEN 8 WHEN N.type IN ('entity', 'resource') THEN 7 WHEN N.type IN ('event_listener', 'repository') THEN 6
 WHEN N.type IN ('event', 'command') THEN 5 WHEN N.type IN ('component', 'job') THEN 4 ELSE 3 END"""
_EDGE_RELEVANCE = """CASE WHEN type = 'handles' THEN 10 WHEN type = 'injects_mutable' THEN 9 WHEN type IN ('produces', 'satisfies_contract') THEN 8 WHEN type IN ('injects_readonly', 'emits', 'has_relation') THEN 7
 WHEN type IN ('extends', 'listens_to', 'maps_to_table') THEN 6 WHEN type = 'implements' THEN 5 WHEN type = 'calls' THEN 4 ELSE 3 END"""
_NAME_RISK = "CASE WHEN ends_with(s, 'Service') THEN 0.15::DOUBLE WHEN ends_with(s, 'Handler') THEN 0.1::DOUBLE WHEN ends_with(s, 'Manager') THEN 0.1::DOUBLE WHEN ends_with(s, 'Facade') THEN 0.2::DOUBLE WHEN ends_with(s, 'Kernel') THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END"
_DOMAINS = """CASE WHEN regexp_matches(lower(module), 'auth|login|register|permission|capability|rbac') THEN 'Auth' WHEN regexp_matches(lower(module), 'billing|invoice|payment|subscription|pricing') THEN 'Billing'
 WHEN regexp_matches(lower(module), 'inventory|stock|product|warehouse|sku') THEN 'Inventory' WHEN regexp_matches(lower(module), 'order|cart|checkout|fulfillment|shipping') THEN 'Ordering'
 WHEN regexp_matches(lower(module), 'notification|email|sms|push|alert') THEN 'Notification' WHEN regexp_matches(lower(module), 'media|image|video|upload|storage|asset') THEN 'Media'
 WHEN regexp_matches(lower(module), 'search|index|query|filter|facet') THEN 'Search' WHEN regexp_matches(lower(module), 'analytics|metric|report|dashboard|tracking') THEN 'Analytics'
 WHEN regexp_matches(lower(module), 'user|profile|account|preference|avatar') THEN 'User' WHEN regexp_matches(lower(module), 'content|page|article|post|cms|block') THEN 'Content'
 WHEN regexp_matches(lower(module), 'tenant|organization|workspace|team') THEN 'Tenancy' WHEN regexp_matches(lower(module), 'workflow|process|approval|state|transition') THEN 'Workflow'
 WHEN regexp_matches(lower(module), 'schedule|cron|job|task|timer') THEN 'Scheduler' WHEN regexp_matches(lower(module), 'ledger|event|propagat|replay|sequence') THEN 'Ledger'
 WHEN regexp_matches(lower(module), 'cache|redis|ttl|invalidat') THEN 'Cache' WHEN regexp_matches(lower(module), 'locale|language|translation|i18n|l10n') THEN 'Locale' ELSE module END"""


PRELUDE = f"""WITH RECURSIVE N0 AS (SELECT * FROM graph_nodes UNION ALL BY NAME SELECT * FROM core_nodes),
NR AS (SELECT id, type, fqcn, name, file, line, end_line, coalesce(module, '') AS module, metadata, is_placeholder FROM
 (SELECT *, row_number() OVER (PARTITION BY id ORDER BY is_placeholder, indexed_at DESC, node_row DESC) AS rn FROM N0 WHERE removed_at IS NULL AND id IS NOT NULL) WHERE rn = 1),
E AS (SELECT source_id, target_id, type, metadata FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY indexed_at DESC, edge_id DESC) AS rn FROM graph_edges
 WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND {_BLANK.format("source_id")} AND {_BLANK.format("target_id")}) WHERE rn = 1),
P AS (SELECT DISTINCT target_id AS id, CASE WHEN instr(target_id, ':') > 0 THEN substr(target_id, instr(target_id, ':') + 1) ELSE target_id END AS fqcn FROM E WHERE target_id NOT IN (SELECT id FROM NR)),
N AS (SELECT * FROM NR UNION ALL SELECT id, 'class', fqcn, split_part(fqcn, chr(92), -1), '', 0, 0, '', '{{}}', true FROM P),
HUB AS (SELECT target_id AS id FROM E GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
LEAF AS (SELECT source_id AS id FROM E GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4 ORDER BY 1 LIMIT 1),
EV AS (SELECT e.*, s.module AS source_module, t.module AS target_module, s.fqcn AS source_fqcn, t.fqcn AS target_fqcn FROM E e LEFT JOIN N s ON s.id = e.source_id LEFT JOIN N t ON t.id = e.target_id),
XM AS (SELECT * FROM EV WHERE type IN {_CROSS} AND source_module != '' AND target_module != '' AND source_module != target_module)"""


def node_rows(spark: SparkSession, d: str) -> DataFrame:
    """The lives of all nodes, those of the framework too, without those that were removed."""
    both = table(spark, d, "graph_nodes").unionByName(table(spark, d, "core_nodes"))
    return both.filter("removed_at IS NULL").withColumn("module", F.coalesce("module", F.lit("")))


def _fingerprint(spark: SparkSession, d: str) -> str:
    """What the graph's tables consist of: their files with sizes and times."""
    out = []
    for name in ("graph_nodes", "core_nodes", "graph_edges"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        out += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return "\n".join(sorted(out))


def code_graph(spark: SparkSession, d: str) -> Graph:
    """The graph as it is now: one row per live node, one per edge, placeholders for missing targets.

    It is built once for a state of its tables and stored in the shared folder, sorted by type within its files, as a
    graph is generated once and then asked; the queries read what is stored.
    """
    known = spark.sparkContext.__dict__.setdefault("_arbograph_graphs", {})
    key = _fingerprint(spark, d)
    paths = known.get(key)
    if not paths or not all(spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")) for p in paths):
        nodes = G.upsert_nodes(node_rows(spark, d), ["indexed_at", "node_row"])
        paths = [scratch_path(spark, "graph-nodes"), scratch_path(spark, "graph-edges")]
        G.upsert_edges(table(spark, d, "graph_edges"), ["indexed_at", "edge_id"]).sortWithinPartitions("type").write.parquet(paths[1])
        nodes = stored(nodes, "graph-real")
        nodes.unionByName(G.placeholders(nodes, spark.read.schema(EDGE_ROW).parquet(paths[1]))).sortWithinPartitions("type").write.parquet(paths[0])
        known[key] = paths
    return Graph(spark.read.schema(NODE_ROW).parquet(paths[0]), spark.read.schema(EDGE_ROW).parquet(paths[1]))


NODE_ROW = "id string, type string, fqcn string, name string, file string, line int, end_line int, module string, metadata string, is_placeholder boolean"
EDGE_ROW = "source_id string, target_id string, type string, metadata string"


def hub(g: Graph) -> str:
    """The node that most edges point to."""
    row = g.edges.groupBy("target_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_id").first()
    return row.target_id if row else ""


def leaf(g: Graph) -> str:
    """The first node with two to four edges out."""
    row = g.edges.groupBy("source_id").agg(F.count("*").alias("n")).filter("n BETWEEN 2 AND 4").orderBy("source_id").first()
    return row.source_id if row else ""


def query(sql: str | None = None, raw: bool = False):
    """Registers a function of the graph (or, raw, of session and folder) under its name, with its SQL after the prelude."""

    def add(f):
        QUERIES[f.__name__] = f if raw else lambda spark, d: f(code_graph(spark, d), d) if f.__code__.co_argcount == 2 else f(code_graph(spark, d))
        if sql:
            ORACLE[f.__name__] = sql if raw else f"{PRELUDE} {sql}"
        return f

    return add


def _ids(g: Graph, *ids: str) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")


_NODE = "id, type, fqcn, name, file, line, end_line, module, is_placeholder"
_EDGE = "source_id, target_id, type"
_node = lambda df: df.select(*_NODE.split(", "))
_edge = lambda df: df.select(*_EDGE.split(", "))


# -- scans, merges, look-ups


@query(f"SELECT {_NODE} FROM N")
def g_nodes(g):
    return _node(g.nodes)


@query(f"SELECT {_EDGE} FROM E")
def g_edges(g):
    return _edge(g.edges)


@query("SELECT type, count(*) AS n FROM N GROUP BY 1")
def count_by_type(g):
    return g.count_by_type()


@query("SELECT type, count(*) AS n FROM E GROUP BY 1")
def count_edges_by_type(g):
    return g.count_by_type("edges")


@query("SELECT id, fqcn, name FROM N WHERE is_placeholder AND file = '' AND line = 0 AND module = '' AND id IN (SELECT id FROM P)")
def placeholder_nodes(g, d):
    return G.placeholders(live_ids(g.nodes.sparkSession, d), g.edges).select("id", "fqcn", "name")


@query(f"""SELECT source_id, target_id, type, metadata FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY indexed_at DESC, edge_id DESC) AS rn FROM graph_edges
 WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND {_BLANK.format("source_id")} AND {_BLANK.format("target_id")}) WHERE rn = 1""", raw=True)
def edge_upsert_last_wins(spark, d):
    return G.upsert_edges(table(spark, d, "graph_edges"), ["indexed_at", "edge_id"])


@query("SELECT DISTINCT id FROM (SELECT id, removed_at FROM graph_nodes UNION ALL SELECT id, removed_at FROM core_nodes) WHERE removed_at IS NULL AND id IS NOT NULL", raw=True)
def live_ids(spark, d):
    return node_rows(spark, d).filter("id IS NOT NULL").select("id").distinct()


@query(
    f"""SELECT id, arg_max(type, (p, node_row)) AS type, coalesce(arg_max(file, (p, node_row)) FILTER (file != ''), '') AS file, coalesce(arg_max(end_line, (p, node_row)) FILTER (end_line != 0), 0) AS end_line, bool_and(is_placeholder) AS is_placeholder
 FROM (SELECT *, {_PRIORITY} AS p FROM (SELECT * FROM graph_nodes UNION ALL BY NAME SELECT * FROM core_nodes) WHERE removed_at IS NULL) GROUP BY id""",
    raw=True,
)
def merge_priority(spark, d):
    return G.merge_nodes(node_rows(spark, d).withColumn("seq", F.col("node_row"))).select("id", "type", "file", "end_line", "is_placeholder")


@query(f"SELECT {_NODE} FROM N WHERE id = (SELECT id FROM HUB)")
def node_by_id(g):
    return _node(g.node(hub(g)))


@query(f"SELECT {_NODE} FROM N WHERE fqcn = (SELECT fqcn FROM N WHERE id = (SELECT id FROM LEAF)) ORDER BY CASE WHEN NOT is_placeholder AND starts_with(id, 'class:') THEN 0 WHEN NOT is_placeholder THEN 1 ELSE 2 END, id LIMIT 1")
def node_by_fqcn(g):
    return _node(g.by_fqcn(_first(g.node(leaf(g)), "fqcn")))


def _first(df: DataFrame, column: str) -> str:
    row = df.select(column).first()
    return row[0] if row and row[0] else ""


@query(f"SELECT {_NODE} FROM N WHERE id = (SELECT id FROM HUB)")
def get_node(g):
    return _node(g.get(hub(g)))


@query(f"SELECT {_NODE} FROM N WHERE file = (SELECT min(file) FROM N WHERE file != '')")
def nodes_by_file(g):
    return _node(g.in_file(g.nodes.filter("file != ''").agg(F.min("file")).first()[0] or "?"))


_MODULE = "(SELECT min(module) FROM N WHERE module != '')"


def _module(g: Graph) -> str:
    return g.nodes.filter("module != ''").agg(F.min("module")).first()[0] or "?"


@query(f"SELECT {_NODE} FROM N WHERE type = 'class' AND module = {_MODULE}")
def nodes_by_type_module(g):
    return _node(g.of_type("class", _module(g)))


@query(f"SELECT {_NODE} FROM N WHERE module = {_MODULE}")
def nodes_by_module(g):
    return _node(g.of_module(_module(g)))


@query(f"SELECT {_NODE} FROM N WHERE contains(lower(name), 'handler') ORDER BY id LIMIT 20")
def search_name(g):
    return _node(g.search_name("Handler"))


_SEARCH = """H AS (SELECT *, 0 AS place FROM (SELECT * FROM N WHERE contains(lower(name), 'account') ORDER BY id LIMIT 20) UNION ALL SELECT *, 1 FROM (SELECT * FROM N WHERE contains(lower(fqcn), 'account') ORDER BY id LIMIT 20)),
F AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS k FROM H) WHERE k = 1 ORDER BY place, id LIMIT 20)"""


@query(f", {_SEARCH} SELECT {_NODE}, place FROM F")
def search_full(g):
    return g.search("Account").select(*_NODE.split(", "), "place")


@query(f", {_SEARCH} SELECT {_NODE} FROM F WHERE type = 'class'")
def find_nodes_post_filter(g):
    return _node(g.find("class", pattern="Account"))


@query(f"SELECT {_EDGE} FROM E WHERE source_id = (SELECT id FROM LEAF)")
def edges_out(g):
    return _edge(g.edges_of(leaf(g), "outgoing"))


@query(f"SELECT {_EDGE} FROM E WHERE target_id = (SELECT id FROM HUB)")
def edges_in(g):
    return _edge(g.edges_of(hub(g), "incoming"))


@query(f"SELECT {_EDGE} FROM E WHERE source_id = (SELECT id FROM HUB) UNION ALL SELECT {_EDGE} FROM E WHERE target_id = (SELECT id FROM HUB)")
def edges_both(g):
    return _edge(g.edges_of(hub(g)))


@query(f"SELECT {_EDGE} FROM E WHERE type = 'uses' AND target_id = (SELECT id FROM HUB)")
def edges_in_typed(g):
    return _edge(g.edges_of(hub(g), "incoming", "uses"))


@query(f"SELECT {_EDGE} FROM E WHERE type = 'handles' ORDER BY source_id, target_id LIMIT 1000")
def edges_by_type(g):
    return _edge(g.edges_of_type("handles", 1000))


@query("SELECT id FROM LEAF")
def resolve_target(g):
    return g.resolve_target(leaf(g))


@query("SELECT id FROM N WHERE id = (SELECT min(id) FROM N WHERE starts_with(id, 'class:'))")
def resolve_component(g):
    return g.resolve_component((g.nodes.filter(F.col("id").startswith("class:")).agg(F.min("id")).first()[0] or "class:?")[6:])


# -- joins and aggregates


@query(f"SELECT {_EDGE}, source_module, target_module FROM XM")
def cross_module_edges(g):
    return g.cross_module().select(*_EDGE.split(", "), "source_module", "target_module")


@query(f"SELECT {_EDGE}, target_module FROM XM WHERE source_module = {_MODULE}")
def cross_module_from(g):
    return g.cross_module(_module(g)).select(*_EDGE.split(", "), "target_module")


@query("SELECT coalesce(target_fqcn, target_id) AS label, string_agg(DISTINCT type, ',' ORDER BY type) AS kinds, count(*) AS n FROM EV WHERE source_id = (SELECT id FROM LEAF) GROUP BY 1")
def compact_dependencies(g):
    return g.compact(g.edges_of(leaf(g), "outgoing"), "target")


@query("SELECT coalesce(source_fqcn, source_id) AS label, string_agg(DISTINCT type, ',' ORDER BY type) AS kinds, count(*) AS n FROM EV WHERE target_id = (SELECT id FROM HUB) GROUP BY 1")
def compact_usages(g):
    return g.compact(g.edges_of(hub(g), "incoming"), "source")


@query(f"SELECT {_EDGE}, coalesce(source_fqcn, source_id) AS source_label, coalesce(target_fqcn, target_id) AS target_label FROM EV")
def edge_labels(g):
    return g.labelled(g.edges).select(*_EDGE.split(", "), "source_label", "target_label")


@query(f"SELECT {_NODE} FROM N WHERE id IN (SELECT source_id FROM E WHERE type = 'satisfies_contract' AND target_id = (SELECT id FROM HUB))")
def contract_implementors(g):
    return _node(g.implementors(hub(g)))


def order_graph(spark: SparkSession, d: str) -> Graph:
    """A graph of the trade tables: customers and suppliers belong to their nation's domain, suppliers test the part that they delivered first."""
    t = lambda name: table(spark, d, name)
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))

    def node(df, id_, type_, fqcn, module):
        zero, empty = F.lit(0), F.lit("")
        return df.select(id_.alias("id"), F.lit(type_).alias("type"), fqcn.alias("fqcn"), naming.short_name(fqcn).alias("name"), empty.alias("file"), zero.alias("line"), zero.alias("end_line"), module.alias("module"), F.lit("{}").alias("metadata"), F.lit(False).alias("is_placeholder"))

    def edge(df, source, target, type_):
        return df.select(source.alias("source_id"), target.alias("target_id"), F.lit(type_).alias("type"), F.lit("{}").alias("metadata"))

    nodes = [node(t("nation"), key("nation:", "n_nationkey"), "domain_context", F.col("n_name"), F.lit("")), node(t("customer"), key("customer:", "c_custkey"), "payload", F.col("c_name"), key("", "c_nationkey")), node(t("supplier"), key("supplier:", "s_suppkey"), "service", F.col("s_name"), key("", "s_nationkey")), node(t("part"), key("part:", "p_partkey"), "class", F.col("p_name"), F.col("p_brand"))]
    first = t("lineitem").groupBy("l_suppkey").agg(F.min_by("l_partkey", F.struct("l_orderkey", "l_linenumber")).alias("l_partkey"))
    edges = [edge(t("customer"), key("customer:", "c_custkey"), key("nation:", "c_nationkey"), "belongs_to_domain"), edge(t("supplier"), key("supplier:", "s_suppkey"), key("nation:", "s_nationkey"), "belongs_to_domain"), edge(first, key("supplier:", "l_suppkey"), key("part:", "l_partkey"), "tests")]
    return Graph(union(nodes), union(edges))


_TESTS = "T AS (SELECT 'supplier:' || l_suppkey AS source_id, 'part:' || arg_min(l_partkey, (l_orderkey, l_linenumber)) AS target_id, 'tests' AS type FROM lineitem GROUP BY l_suppkey)"


def _tested(g: Graph) -> str:
    row = g.edges_of_type("tests").groupBy("target_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_id").first()
    return row.target_id if row else ""


@query(f"WITH {_TESTS} SELECT {_EDGE} FROM T WHERE target_id = (SELECT target_id FROM T GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", raw=True)
def related_tests(spark, d):
    g = order_graph(spark, d)
    return _edge(g.related_tests(_tested(g)))


@query(f"WITH {_TESTS} SELECT 'supplier:' || s_suppkey AS id, s_name AS fqcn FROM supplier WHERE 'supplier:' || s_suppkey IN (SELECT source_id FROM T WHERE target_id = (SELECT target_id FROM T GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))", raw=True)
def test_nodes(spark, d):
    g = order_graph(spark, d)
    return g.test_nodes(_tested(g)).select("id", "fqcn")


@query("SELECT r.target_id AS route, h.target_id AS payload, h.source_id AS handler, p.target_id AS resource FROM E h LEFT JOIN E r ON r.source_id = h.target_id AND r.type = 'serves_route' LEFT JOIN E p ON p.source_id = h.source_id AND p.type = 'produces' WHERE h.type = 'handles'")
def handler_chain(g):
    return g.handler_chains()


@query("SELECT count(DISTINCT target_id) AS n FROM E WHERE type = 'satisfies_contract'")
def count_satisfied_contracts(g):
    return g.satisfied_contracts()


@query(f"SELECT count(*) AS n FROM EV WHERE type = 'calls' AND (source_module = {_MODULE} OR target_module = {_MODULE})")
def count_edges_module(g):
    return g.edge_count("calls", _module(g))


@query("SELECT module, count(*) AS n FROM N WHERE type = 'class' AND module != '' GROUP BY 1")
def module_summaries(g):
    return g.modules()


@query("SELECT coalesce(json_extract_string(CASE WHEN metadata IS NULL OR metadata IN ('', '[]') THEN '{}' ELSE metadata END, '$.method'), 'GET') AS method, count(*) AS n FROM N WHERE type = 'route' GROUP BY 1")
def route_summary_json(g):
    return g.routes()


@query("SELECT module, " + ", ".join(f"count(*) FILTER (type = '{t}') AS n_{t}" for t in ("class", "interface", "trait", "enum", "method")) + " FROM N GROUP BY 1")
def module_overview(g):
    return g.overview()


_TOUCHED = "(SELECT source_id FROM E UNION SELECT target_id FROM E)"


@query(f"SELECT id FROM N WHERE type != 'route' AND id NOT IN {_TOUCHED}")
def orphan_nodes(g):
    return g.orphan_nodes().select("id")


@query(
    f"""SELECT 'nodes' AS kind, count(*) AS n FROM N UNION ALL SELECT 'edges', count(*) FROM E UNION ALL SELECT 'placeholders', count(*) FROM N WHERE is_placeholder UNION ALL SELECT 'modules', count(DISTINCT module) FROM N WHERE module != ''
 UNION ALL SELECT 'orphans', count(*) FROM N WHERE type != 'route' AND id NOT IN {_TOUCHED} UNION ALL SELECT 'cross_module_edges', count(*) FROM XM"""
)
def view_stats(g):
    return g.totals()


@query("SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM E UNION ALL SELECT target_id, 0, 1 FROM E) GROUP BY 1")
def degrees(g):
    return g.degrees()


@query("SELECT 'customer:' || c_custkey AS id, 'nation:' || c_nationkey AS domain_id FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier", raw=True)
def node_domains(spark, d):
    return order_graph(spark, d).with_domain()


@query("SELECT 'nation:' || n_nationkey AS domain_id, n_name AS name, '' AS description, 'medium' AS criticality, '[]' AS key_entities FROM nation WHERE n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer))", raw=True)
def domain_of_node(spark, d):
    g = order_graph(spark, d)
    return g.domain_of("customer:" + str(table(spark, d, "customer").agg(F.min("c_custkey")).first()[0]))


_MODE = "coalesce(json_extract_string(CASE WHEN metadata IS NULL OR metadata IN ('', '[]') THEN '{}' ELSE metadata END, '$.executionMode'), 'sync')"


@query(
    f""", em AS (SELECT target_id AS id, count(*) AS n FROM E WHERE type = 'emits' GROUP BY 1), li AS (SELECT target_id AS id, count(*) FILTER ({_MODE} = 'sync') AS s, count(*) FILTER ({_MODE} = 'async') AS a, count(*) FILTER ({_MODE} = 'queued') AS q FROM E WHERE type = 'listens_to' GROUP BY 1),
 co AS (SELECT target_id AS id, count(*) AS n FROM E WHERE type = 'consumes_from' GROUP BY 1), pu AS (SELECT e.source_id AS id, count(*) AS k, coalesce(sum(co.n), 0) AS c FROM E e LEFT JOIN co ON co.id = e.target_id WHERE e.type = 'publishes_to' GROUP BY 1)
 SELECT coalesce(em.id, li.id) AS event_id, coalesce(em.n, 0) AS n_emitters, coalesce(s, 0) AS sync, coalesce(a, 0) AS async, coalesce(q, 0) AS queued, coalesce(k, 0) AS subjects, coalesce(c, 0)::BIGINT AS n_consumers FROM em FULL JOIN li ON em.id = li.id LEFT JOIN pu ON pu.id = coalesce(em.id, li.id)"""
)
def event_lifecycles(g):
    return g.lifecycles()


@query("SELECT source_id, target_id AS event_id, (SELECT count(*) FROM E l WHERE l.type = 'listens_to' AND l.target_id = e.target_id) AS n_listeners FROM E e WHERE type = 'emits'")
def event_impact(g):
    return score.event_impact(g)


# -- traversals

_STEP = {"out": ("source_id", "target_id"), "in": ("target_id", "source_id")}


def _bfs(start: str, way: str, depth: int) -> str:
    a, b = _STEP[way]
    return f""", b(id, d) AS (SELECT id, 0 FROM {start} UNION SELECT e.{b}, b.d + 1 FROM b JOIN E e ON e.{a} = b.id WHERE b.d < {depth}), best AS (SELECT id, min(d) AS d FROM b GROUP BY 1)"""


def _touched_sql(start: str, way: str, depth: int) -> str:
    a, _ = _STEP[way]
    return f"{_bfs(start, way, depth - 1)} SELECT e.source_id, e.target_id, e.type, best.d + 1 AS level FROM best JOIN E e ON e.{a} = best.id"


@query(_touched_sql("LEAF", "out", 1))
def dependencies_d1(g):
    return traverse.touched_edges(g, _ids(g, leaf(g)), "outgoing", 1)


@query(_touched_sql("LEAF", "out", 2))
def dependencies_d2(g):
    return traverse.touched_edges(g, _ids(g, leaf(g)), "outgoing", 2)


@query(_touched_sql("LEAF", "out", 3))
def dependencies_d3(g):
    return traverse.touched_edges(g, _ids(g, leaf(g)), "outgoing", 3)


@query(_touched_sql("HUB", "in", 1))
def usages_d1(g):
    return traverse.touched_edges(g, _ids(g, hub(g)), "incoming", 1)


@query(_touched_sql("HUB", "in", 2))
def usages_d2(g):
    return traverse.touched_edges(g, _ids(g, hub(g)), "incoming", 2)


_IMPACT = f"""{_bfs("HUB", "in", 5)}, imp AS (SELECT x.id, x.d AS distance, arg_min((e.target_id, e.type), (e.target_id, e.type)) AS via FROM best x JOIN E e ON e.source_id = x.id JOIN best y ON y.id = e.target_id AND y.d = x.d - 1 WHERE x.d > 0 AND x.id IN (SELECT id FROM N) GROUP BY ALL),
impact AS (SELECT id, distance, id AS via_source, via[1] AS via_target, via[2] AS via_type FROM (SELECT id, distance, [via[1], via[2]] AS via FROM (SELECT id, distance, struct_extract(via, 1) AS v1, struct_extract(via, 2) AS v2, [struct_extract(via, 1), struct_extract(via, 2)] AS via FROM imp)))"""


def _impact(g: Graph) -> DataFrame:
    return traverse.reached(g, _ids(g, hub(g)), "incoming", 5)


@query(f"{_IMPACT} SELECT id, distance, via_source, via_target, via_type FROM impact")
def impact_hub(g):
    return _impact(g)


@query(f"{_IMPACT} SELECT distance, count(*) AS n FROM impact GROUP BY 1")
def impact_by_depth(g):
    return _impact(g).groupBy("distance").agg(F.count("*").alias("n"))


@query(f"{_IMPACT} SELECT N.module, count(*) AS n FROM impact JOIN N USING (id) WHERE N.module != '' GROUP BY 1")
def impact_modules(g):
    return _impact(g).join(g.nodes.select("id", "module"), "id").filter("module != ''").groupBy("module").agg(F.count("*").alias("n"))


@query(f"{_IMPACT} SELECT count(*) FILTER (distance = 1) AS direct, count(*) FILTER (distance > 1) AS transitive, count(*) AS total, max(distance) AS max_depth FROM impact")
def impact_summary(g):
    return _impact(g).agg(F.count_if(F.col("distance") == 1).alias("direct"), F.count_if(F.col("distance") > 1).alias("transitive"), F.count("*").alias("total"), F.max("distance").alias("max_depth"))


@query(f"{_IMPACT} SELECT via_type AS type, count(*) AS n FROM impact GROUP BY 1")
def impact_edge_types(g):
    return _impact(g).groupBy(F.col("via_type").alias("type")).agg(F.count("*").alias("n"))


@query(f"{_bfs('LEAF', 'out', 3)} SELECT id, d AS distance FROM best WHERE d > 0 AND id IN (SELECT id FROM N)")
def forward_closure(g):
    return traverse.reached(g, _ids(g, leaf(g)), "outgoing", 3).select("id", "distance")


@query(""", w(cur, path, depth, edge_type) AS (SELECT id, [id], 0, '' FROM LEAF UNION ALL SELECT e.target_id, list_append(w.path, e.target_id), w.depth + 1, e.type FROM w JOIN E e ON e.source_id = w.cur WHERE w.depth < 2 AND NOT list_contains(w.path, e.target_id))
 SELECT array_to_string(path, ' > ') AS path, depth, edge_type FROM w WHERE depth > 0""")
def dependency_tree_paths(g):
    return traverse.simple_paths(g, leaf(g), "outgoing", 2)


@query(""", xe AS (SELECT DISTINCT source_id, target_id FROM E WHERE type IN ('extends', 'extends_module')), w(head, cur, path) AS (SELECT source_id, target_id, [source_id] FROM xe WHERE target_id >= source_id UNION ALL SELECT w.head, x.target_id, list_append(w.path, w.cur) FROM w JOIN xe x ON x.source_id = w.cur WHERE w.cur != w.head AND x.target_id >= w.head AND (x.target_id = w.head OR NOT list_contains(list_append(w.path, w.cur), x.target_id)) AND len(w.path) < 10)
 SELECT array_to_string(path, ' > ') AS cycle, len(path)::INTEGER AS length FROM w WHERE cur = head""")
def inheritance_cycles(g):
    return traverse.bounded_cycles(g.edges.filter(F.col("type").isin("extends", "extends_module")))


_FOCUS = """, s1 AS (SELECT DISTINCT source_id, target_id, type FROM E WHERE source_id = (SELECT id FROM LEAF) OR target_id = (SELECT id FROM LEAF))"""


@query(f"{_FOCUS} SELECT * FROM s1")
def view_focus(g):
    return _edge(traverse.view(g, leaf(g), depth=1).edges)


@query(f"SELECT {_EDGE} FROM E WHERE source_id IN (SELECT id FROM N WHERE type IN ('interface', 'trait')) AND target_id IN (SELECT id FROM N WHERE type IN ('interface', 'trait'))")
def view_types(g):
    return _edge(traverse.view(g, types=("interface", "trait")).edges)


@query(f"SELECT {_EDGE} FROM E WHERE source_id IN (SELECT id FROM N WHERE module = {_MODULE}) AND target_id IN (SELECT id FROM N WHERE module = {_MODULE})")
def view_module(g):
    return _edge(traverse.view(g, module=_module(g)).edges)


@query(
    f""", a AS (SELECT DISTINCT source_id AS id FROM E WHERE target_id = (SELECT id FROM HUB) AND type IN {_DIRECT} AND source_id != (SELECT id FROM HUB)),
 b AS (SELECT DISTINCT source_id AS id FROM E WHERE target_id IN (SELECT id FROM a) AND type IN {_FURTHER} AND source_id NOT IN (SELECT id FROM a) AND source_id != (SELECT id FROM HUB)) SELECT id, 1 AS level FROM a UNION ALL SELECT id, 2 FROM b"""
)
def component_dependents(g):
    return traverse.dependents(g, hub(g), score.DIRECT, score.FURTHER)


# -- scores and packing


def _key(c: str) -> str:
    return f"(CASE WHEN split_part({_fq(c)}, chr(92), 1) = '{VENDOR}' AND contains({_fq(c)}, chr(92)) THEN split_part({_fq(c)}, chr(92), 2) ELSE split_part({_fq(c)}, chr(92), 1) END)"


def _fq(c: str) -> str:
    return f"(CASE WHEN instr({c}, ':') > 0 THEN substr({c}, instr({c}, ':') + 1) ELSE {c} END)"


@query(
    f"""{_IMPACT}, bp AS (SELECT {_BLAST} * (CASE distance WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.25 END) * (CASE WHEN {_key("via_source")} != {_key("via_target")} THEN 1.5 ELSE 1.0 END) AS p, {_key("id")} IN ('Orm', 'Ssr', 'Auth', 'Tenancy', 'Workflow') OR contains(id, 'Contract') AS h FROM impact),
 s AS (SELECT least(100, round(coalesce(sum(p), 0)::DOUBLE + 15 * count(*) FILTER (h)))::INTEGER AS score, count(*) FILTER (h) AS n_hotspots, count(*) AS n_impacted FROM bp)
 SELECT score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level, CASE WHEN score >= 60 THEN 'epic_required' ELSE 'inline' END AS recommendation, n_hotspots, n_impacted FROM s"""
)
def blast_radius(g):
    return score.blast_radius(_impact(g), VENDOR)


@query(
    f""", r AS (SELECT (SELECT coalesce(sum({_RISK}), 0) FROM E WHERE target_id = (SELECT id FROM HUB) AND type IN {_DIRECT}) + 2 * (SELECT count(*) FROM E l WHERE l.type = 'listens_to' AND l.target_id IN (SELECT target_id FROM E WHERE type = 'emits' AND source_id = (SELECT id FROM HUB))) AS risk,
 (SELECT count(*) FROM E WHERE target_id = (SELECT id FROM HUB) AND type IN {_DIRECT}) AS n_dependents) SELECT risk::BIGINT AS risk, CASE WHEN risk >= 20 THEN 'CRITICAL' WHEN risk >= 10 THEN 'HIGH' WHEN risk >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS level, n_dependents FROM r"""
)
def component_risk(g):
    return score.component_risk(g, hub(g))


_RANK = f"{_IMPACT}, rk AS (SELECT id, distance, {_RELEVANCE}::DOUBLE / greatest(1, distance) AS score FROM impact JOIN N USING (id))"


@query(f"{_RANK} SELECT id, distance, score FROM rk")
def relevance_rank(g):
    return score.relevance(g, _impact(g))


@query(
    f"""{_RANK}, sn AS (SELECT node_id AS id, arg_max(snippet, item_id) AS snippet FROM context_items WHERE snippet IS NOT NULL GROUP BY 1), top AS (SELECT rk.*, coalesce(strlen(snippet) // 4, 0) AS size FROM rk LEFT JOIN sn USING (id) ORDER BY score DESC, distance, id LIMIT 20),
 q AS (SELECT *, row_number() OVER w AS place, coalesce(sum(size + 50) OVER (ORDER BY score DESC, distance, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM top WINDOW w AS (ORDER BY score DESC, distance, id)),
 z AS (SELECT *, max((before >= 8000 OR (before + size > 8000 AND place > 1))::INT) OVER (ORDER BY place) AS stopped FROM q) SELECT id, place, (before + size + 50)::BIGINT AS tokens_after FROM z WHERE stopped = 0""",
    raw=False,
)
def context_pack(g, d):
    items = table(g.nodes.sparkSession, d, "context_items").filter("snippet IS NOT NULL").groupBy(F.col("node_id").alias("id")).agg(F.max_by("snippet", "item_id").alias("snippet"))
    return score.pack(score.relevance(g, _impact(g)).join(items, "id", "left"))


_CLASS = f""", l AS (SELECT source_id AS id, count(*) FILTER (type = 'extends') AS p, count(*) FILTER (type = 'implements') AS i, count(*) FILTER (type = 'uses') AS t, count(*) FILTER (type IN ('injects_readonly', 'injects_mutable', 'injects_factory', 'injects_config', 'has_relation')) AS q,
 count(*) FILTER (type = 'satisfies_contract' AND coalesce(json_extract_string(CASE WHEN metadata IS NULL OR metadata IN ('', '[]') THEN '{{}}' ELSE metadata END, '$.contractType'), 'service') = 'service') AS k FROM E GROUP BY 1),
 c AS (SELECT N.id, split_part(fqcn, chr(92), -1) AS s, coalesce(p, 0) AS p, coalesce(i, 0) AS i, coalesce(t, 0) AS t, coalesce(q, 0) AS q, coalesce(k, 0) + CASE WHEN type IN ('payload', 'handler', 'service', 'auth_handler', 'slot_handler') THEN 1 ELSE 0 END AS a FROM N LEFT JOIN l USING (id) WHERE starts_with(N.id, 'class:') AND NOT is_placeholder),
 cr AS (SELECT id, round(least(1.0, ({_NAME_RISK}) + (CASE WHEN p > 0 THEN 0.05::DOUBLE ELSE 0 END) + (CASE WHEN i > 2 THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN t > 1 THEN 0.05::DOUBLE ELSE 0 END) + 0.1::DOUBLE * a), 2) AS risk,
 least(1.0, round(0.3::DOUBLE + 0.05::DOUBLE * i + 0.05::DOUBLE * t + 0.02::DOUBLE * q + (CASE WHEN p > 0 THEN 0.1::DOUBLE ELSE 0 END), 2)) AS complexity FROM c)"""


@query(f"{_CLASS} SELECT * FROM cr")
def class_risk(g):
    return score.class_risk(g)


@query(f"{_CLASS} SELECT id, risk, CASE WHEN risk >= 0.8 THEN 'CRITICAL' WHEN risk >= 0.6 THEN 'HIGH' WHEN risk >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM cr ORDER BY risk DESC, id LIMIT 10")
def hotspot_rank(g):
    return score.hotspots(score.class_risk(g))


@query(
    """, dg AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM E UNION ALL SELECT target_id FROM E) GROUP BY 1), cm AS (SELECT source_module AS module, count(*) AS n FROM XM GROUP BY 1),
 g AS (SELECT N.id, (CASE WHEN starts_with(fqcn, 'App' || chr(92) || 'Api' || chr(92)) THEN 30 ELSE 0 END) + (CASE WHEN contains(N.id, 'AsPayload') THEN 20 ELSE 0 END) + (CASE WHEN contains(N.id, 'AsPayloadHandler') THEN 20 ELSE 0 END) + (CASE WHEN contains(N.id, 'AsService') THEN 20 ELSE 0 END) + least(20, 2 * coalesce(dg.n, 0)) + least(15, coalesce(cm.n, 0)) AS points
 FROM N LEFT JOIN dg ON dg.id = N.id LEFT JOIN cm ON cm.module = N.module WHERE N.id NOT IN (SELECT source_id FROM E WHERE type = 'intent_for')) SELECT id, points::BIGINT AS points FROM g WHERE points > 20"""
)
def doc_gaps(g):
    return score.doc_gaps(g)


# -- files, snapshots, scalars, renderings

_INDEX = "SELECT path, arg_max(content_hash, (indexed_at, coalesce(content_hash, ''))) AS content_hash FROM graph_file_index GROUP BY 1"
_FEED = "SELECT file AS path, arg_max(content_hash, (changed_at, seq)) AS content_hash FROM node_feed WHERE file IS NOT NULL AND op = 'upsert' AND content_hash IS NOT NULL GROUP BY 1"


@query(
    f"WITH a AS ({_INDEX.replace('arg_max(content_hash,', 'arg_max_null(content_hash,')}), b AS ({_FEED}) SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.content_hash IS DISTINCT FROM b.content_hash",
    raw=True,
)
def snapshot_diff(spark, d):
    before = table(spark, d, "graph_file_index").groupBy("path").agg(F.max_by("content_hash", F.struct("indexed_at", F.coalesce("content_hash", F.lit("")))).alias("content_hash"))
    after = table(spark, d, "node_feed").filter("file IS NOT NULL AND op = 'upsert' AND content_hash IS NOT NULL").groupBy(F.col("file").alias("path")).agg(F.max_by("content_hash", F.struct("changed_at", "seq")).alias("content_hash"))
    return G.diff_files(before, after)


@query("SELECT path, line_count FROM graph_file_index WHERE is_dirty", raw=True)
def dirty_files(spark, d):
    return table(spark, d, "graph_file_index").filter("is_dirty").select("path", "line_count")


_DIRTY = "(SELECT DISTINCT path FROM graph_file_index WHERE is_dirty)"


@query(f"SELECT {_EDGE} FROM E WHERE source_id NOT IN (SELECT id FROM N WHERE file IN {_DIRTY}) AND target_id NOT IN (SELECT id FROM N WHERE file IN {_DIRTY})")
def remove_by_file(g, d):
    files = dirty_files(g.nodes.sparkSession, d).select(F.col("path").alias("file"))
    return _edge(G.remove_files(g.nodes, g.edges, files)[1])


@query(
    """WITH c AS (SELECT max(cutoff_at) AS t FROM index_runs WHERE status = 'ok'), a AS (SELECT type, count(DISTINCT id) AS n FROM graph_nodes, c WHERE indexed_at <= t - INTERVAL 60 DAY AND (removed_at IS NULL OR removed_at > t - INTERVAL 60 DAY) GROUP BY 1),
 b AS (SELECT type, count(DISTINCT id) AS n FROM graph_nodes, c WHERE indexed_at <= t AND (removed_at IS NULL OR removed_at > t) GROUP BY 1) SELECT coalesce(a.type, b.type) AS type, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.type = b.type""",
    raw=True,
)
def graph_diff_by_type(spark, d):
    t = table(spark, d, "index_runs").filter("status = 'ok'").agg(F.max("cutoff_at")).first()[0]
    nodes = table(spark, d, "graph_nodes")
    at = lambda x: nodes.filter((F.col("indexed_at") <= x) & (F.col("removed_at").isNull() | (F.col("removed_at") > x))).groupBy("type").agg(F.count_distinct("id").alias("n"))
    end = F.lit(t).cast("timestamp_ntz")
    a, b = at(end - F.expr("INTERVAL 60 DAYS")), at(end)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.withColumnRenamed("n", "a").join(b.withColumnRenamed("n", "b"), "type", "full_outer").select("type", n("a").alias("before"), n("b").alias("after"), (n("b") - n("a")).alias("delta"))


@query(f"SELECT id, {_fq('id')} AS fqcn, split_part({_fq('id')}, chr(92), -1) AS short FROM N")
def node_fqcn_from_id(g):
    fqcn = naming.fqcn_of_id(F.col("id"))
    return g.nodes.select("id", fqcn.alias("fqcn"), naming.short_name(fqcn).alias("short"))


@query(r"SELECT DISTINCT name, lower(left(name, 1) || regexp_replace(substr(name, 2), '([A-Z])', '_\1', 'g')) AS snake, lower(left(name, 1) || regexp_replace(substr(name, 2), '([A-Z])', ' \1', 'g')) AS spaced, regexp_replace(split_part(fqcn, chr(92), -1), '(Payload|Request|Command)$', '') || 'Flow' AS flow FROM N WHERE type = 'class' AND name IS NOT NULL")
def derived_names(g):
    return g.of_type("class").filter("name IS NOT NULL").select("name", naming.snake_case(F.col("name")).alias("snake"), naming.spaced_words(F.col("name")).alias("spaced"), naming.flow_name(F.col("fqcn")).alias("flow")).distinct()


_STUDLY = "array_to_string([upper(left(w, 1)) || substr(w, 2) FOR w IN regexp_split_to_array({0}, '[^a-zA-Z0-9]+') IF w != ''], '')"


@query(f"SELECT DISTINCT path, CASE WHEN regexp_extract(path, '(?:^|/)packages/([^/]+)/', 1) != '' THEN {_STUDLY.format(chr(40) + 'regexp_extract(path, ' + chr(39) + '(?:^|/)packages/([^/]+)/' + chr(39) + ', 1)' + chr(41))} WHEN regexp_matches(path, '(^|/)(src|tests)/') THEN 'App' ELSE '' END AS module FROM graph_file_index", raw=True)
def module_of_paths(spark, d):
    return table(spark, d, "graph_file_index").select("path", naming.module_of_path(F.col("path")).alias("module")).distinct()


@query(f"SELECT DISTINCT module, {_DOMAINS} AS domain FROM N WHERE module NOT IN ('', 'App')")
def domain_inference(g):
    return g.nodes.filter("module NOT IN ('', 'App')").select("module", naming.infer_domain(F.col("module")).alias("domain")).distinct()


@query("SELECT '{\"kind\":\"edge\",\"source_id\":' || to_json(source_id) || ',\"target_id\":' || to_json(target_id) || ',\"type\":' || to_json(type) || '}' AS line FROM E")
def ndjson_edges(g):
    return render.ndjson(_edge(g.edges), "edge")


@query("SELECT '  \"' || replace(replace(source_id, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) || '\" -> \"' || replace(replace(target_id, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) || '\" [label=\"' || type || '\"];' AS line FROM E")
def dot_lines(g):
    return render.dot_edges(g.edges)


# -- ingest and live refresh


@query(raw=True)
def extracted_nodes(spark, d):
    return extract.extract(_facts(spark, d)).nodes.select("id", "type", "fqcn", "file", "line", "is_placeholder")


@query(raw=True)
def extracted_edges(spark, d):
    return _edge(extract.extract(_facts(spark, d)).edges)


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts of the latest content of each PHP file, written once: every extractor reads them."""
    latest = table(spark, d, "source_files").filter("content IS NOT NULL AND file LIKE '%.php'").groupBy("file").agg(F.max_by("content", F.struct("fetched_at", "file_id")).alias("content"))
    return stored(facts.file_facts(latest), "facts")


_NOW = "SELECT node_id, arg_max({'live': op = 'upsert', 'file': file, 'hash': content_hash}, (changed_at, seq)) AS v FROM node_feed WHERE node_id IS NOT NULL AND (op = 'delete' OR op = 'upsert' AND content_hash IS NOT NULL) GROUP BY 1"


@query(f"SELECT node_id, v.file AS file, v.hash AS content_hash FROM ({_NOW}) WHERE v.live", raw=True)
def current_state(spark, d):
    return watch.current_state(table(spark, d, "node_feed"))


@query(f"SELECT node_id, v.file AS file, v.hash AS content_hash FROM ({_NOW}) WHERE v.live", raw=True)
def stream_incremental(spark, d):
    """The same by the stream, which handles the feed's files as they come."""
    feed, target = f"{d}/node_feed.parquet", scratch_path(spark, "watch")
    # As a pattern, since the table may be one file or a folder.
    run = watch.watch(spark, f"{d}/node_feed.parque[t]", spark.read.parquet(feed).schema, target, f"{target}-checkpoint")
    run.awaitTermination()
    return watch.watched_state(spark, target, run.lastProgress["batchId"])
