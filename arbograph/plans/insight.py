"""Queries over what is inferred from the code graph: intents, hotspots, domains, contexts, lifecycles, snapshots and incremental builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbograph.functions import naming
from arbograph.operators import extract, score, traverse
from arbograph.operators import graph as G
from arbograph.operators.graph import Graph
from arbograph.plans import reference as R
from arbograph.plans.reference import PRELUDE, VENDOR, hub, leaf
from arbograph.runtime import scratch_path, stored, table, union
from arbograph.sources import facts, render, store

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, raw: bool = False):
    """As reference.query(), for this module."""

    def add(f):
        QUERIES[f.__name__] = f if raw else lambda spark, d: f(R.code_graph(spark, d), d) if f.__code__.co_argcount == 2 else f(R.code_graph(spark, d))
        if sql:
            ORACLE[f.__name__] = sql if raw else f"{PRELUDE} {sql}"
        return f

    return add


# -- extractors over the classes of the graph, whose SQL needs no parser

#: The attribute that made a node of a type.
_MADE_BY = {"payload": "AsPayload", "handler": "AsPayloadHandler", "service": "AsService", "event": "AsEvent", "event_listener": "AsEventListener"}


def class_facts(g: Graph) -> DataFrame:
    """The facts that the graph's class-like nodes and their edges show: classes, relations, and the attributes that made types and contracts."""
    empty = {n: F.lit(None).cast("int" if t == "int" else "string").alias(n) for n, t in (x.split() for x in facts.SCHEMA.split(", "))}

    def rows(df: DataFrame, **given) -> DataFrame:
        return df.select(*[(given[n] if n in given else c).alias(n) for n, c in empty.items()])

    own = g.nodes.filter(F.col("id").startswith("class:") & ~F.col("is_placeholder")).select("id", "type", F.col("fqcn").alias("owner"), "file", "line", "end_line")
    classes = rows(own, file=F.col("file"), seq=F.lit(0), kind=F.lit("class"), owner=F.col("owner"), owner_kind=F.lit("class"), line=F.col("line"), end_line=F.col("end_line"))
    links = g.edges.filter(F.col("type").isin("extends", "implements", "uses")).select(F.col("source_id").alias("id"), F.col("type").alias("name"), naming.fqcn_of_id(F.col("target_id")).alias("target")).join(own.drop("type"), "id")
    relations = rows(links, file=F.col("file"), seq=F.lit(1), kind=F.lit("rel"), owner=F.col("owner"), name=F.col("name"), target=F.col("target"))
    made = F.create_map(*[F.lit(x) for kv in _MADE_BY.items() for x in kv])[F.col("type")]
    typed = rows(own.withColumn("attribute", made).filter("attribute IS NOT NULL"), file=F.col("file"), seq=F.lit(2), kind=F.lit("attr"), owner=F.col("owner"), owner_kind=F.lit("class"), name=F.col("attribute"))
    contracts = g.edges.filter("type = 'satisfies_contract'").select(F.col("source_id").alias("id")).join(own, "id")
    satisfied = rows(contracts, file=F.col("file"), seq=F.lit(3), kind=F.lit("attr"), owner=F.col("owner"), owner_kind=F.lit("class"), name=F.lit("SatisfiesServiceContract"))
    return union([classes, relations, typed, satisfied])


_CLASSES = """, cl AS (SELECT id, type, fqcn, file, line, end_line, split_part(fqcn, chr(92), -1) AS s FROM N WHERE starts_with(id, 'class:') AND NOT is_placeholder),
 ln AS (SELECT source_id AS id, count(*) FILTER (type = 'extends') AS p, count(*) FILTER (type = 'implements') AS i, count(*) FILTER (type = 'uses') AS t, count(*) FILTER (type = 'satisfies_contract') AS k FROM E GROUP BY 1),
 cx AS (SELECT cl.*, coalesce(p, 0) AS p, coalesce(i, 0) AS i, coalesce(t, 0) AS t, coalesce(k, 0) AS k FROM cl LEFT JOIN ln USING (id))"""
_WORDS = "CASE WHEN {0} = '' THEN 'domain' ELSE lower(left({0}, 1) || regexp_replace(substr({0}, 2), '([A-Z])', ' \\1', 'g')) END"


def _intent_case() -> str:
    ends = [("Handler", "Handles ", " requests"), ("Service", "Provides ", " business logic"), ("Repository", "Manages ", " data persistence"), ("Entity", "Represents ", " domain concept"), ("Listener", "Reacts to ", " events"), ("Mapper", "Transforms ", " data representations"), ("Validator", "Validates ", " input"), ("Provider", "Supplies ", " resources"), ("Factory", "Creates ", " instances"), ("Middleware", "Intercepts ", " pipeline"), ("Phase", "Executes ", " pipeline phase")]
    return "CASE " + " ".join(f"WHEN ends_with(s, '{e}') THEN '{a}' || {_WORDS.format(f'left(s, length(s) - {len(e)})')} || '{b}'" for e, a, b in ends) + " ELSE '' END"


@query(
    f"""{_CLASSES}, it AS (SELECT id, {_intent_case()} AS named, CASE WHEN k > 0 THEN 'Service contract interface' WHEN type IN ('payload', 'handler') THEN 'HTTP request payload definition' WHEN type IN ('event', 'event_listener') THEN 'Domain event' END AS told,
 greatest(CASE WHEN type IN ('payload', 'handler', 'event', 'event_listener') THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END, CASE WHEN k > 0 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END) AS sure FROM cx)
 SELECT 'doc:' || id AS id, coalesce(told, named) AS purpose, CASE WHEN named != '' THEN greatest(sure, 0.75::DOUBLE) ELSE sure END AS confidence FROM it WHERE coalesce(told, named) != ''"""
)
def intent_nodes(g):
    nodes, _ = extract.intents(extract.Facts(class_facts(g)))
    return nodes.select("id", F.get_json_object("metadata", "$.purpose").alias("purpose"), F.get_json_object("metadata", "$.confidence").cast("double").alias("confidence"))


_HOT = f"""{_CLASSES}, hr AS (SELECT *, least(1.0, (CASE WHEN ends_with(s, 'Service') THEN 0.15::DOUBLE WHEN ends_with(s, 'Handler') THEN 0.1::DOUBLE WHEN ends_with(s, 'Manager') THEN 0.1::DOUBLE WHEN ends_with(s, 'Facade') THEN 0.2::DOUBLE WHEN ends_with(s, 'Kernel') THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END)
 + CASE WHEN p > 0 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN i > 2 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN t > 1 THEN 0.05::DOUBLE ELSE 0 END + 0.1::DOUBLE * (k + CASE WHEN type IN ('payload', 'handler', 'service') THEN 1 ELSE 0 END)) AS risk FROM cx),
 hs AS (SELECT 'hotspot:' || fqcn AS id, id AS node_id, round(risk, 2) AS risk, (i + t + CASE WHEN p > 0 THEN 1 ELSE 0 END)::INTEGER AS incoming_edges, regexp_matches(s, 'Application|Kernel|Bootstrap|Dispatcher|Router|Container') AS is_critical_path,
 least(1.0, round(0.3::DOUBLE + 0.05::DOUBLE * i + 0.05::DOUBLE * t + CASE WHEN p > 0 THEN 0.1::DOUBLE ELSE 0 END, 2)) AS complexity,
 CASE WHEN risk >= 0.6 AND ends_with(s, 'Service') THEN 'Consider extracting interface and splitting into focused services' WHEN risk >= 0.5 AND t > 2 THEN 'High trait usage — consider composition over inheritance' WHEN i > 3 THEN 'Many interfaces — verify single responsibility principle' END AS recommendation FROM hr WHERE risk >= 0.4)"""


def _with_hotspots(g: Graph) -> Graph:
    nodes, edges = extract.hotspots(extract.Facts(class_facts(g)))
    return Graph(g.nodes.unionByName(nodes.select(*g.nodes.columns)), g.edges.unionByName(edges.select(*g.edges.columns)))


@query(f"{_HOT} SELECT id, node_id, risk, incoming_edges, is_critical_path, complexity, recommendation FROM hs")
def hotspot_nodes(g):
    spots = _with_hotspots(g)
    return score.stored_hotspots(spots, 1 << 30).select("id", "node_id", "risk", "incoming_edges", "is_critical_path", "complexity", "recommendation")


@query(f"{_HOT} SELECT h.id, h.node_id, N.module, h.risk, CASE WHEN h.risk >= 0.8 THEN 'CRITICAL' WHEN h.risk >= 0.6 THEN 'HIGH' WHEN h.risk >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT * FROM hs ORDER BY risk DESC, id LIMIT 10) h LEFT JOIN N ON N.id = h.node_id")
def hotspots_with_module(g):
    return score.stored_hotspots(_with_hotspots(g)).select("id", "node_id", "module", "risk", "level")


# -- relevance, impact, contexts


@query("SELECT type, any_value(CASE WHEN type = 'handles' THEN 10 WHEN type = 'injects_mutable' THEN 9 WHEN type IN ('produces', 'satisfies_contract') THEN 8 WHEN type IN ('injects_readonly', 'emits', 'has_relation') THEN 7 WHEN type IN ('extends', 'listens_to', 'maps_to_table') THEN 6 WHEN type = 'implements' THEN 5 WHEN type = 'calls' THEN 4 ELSE 3 END) AS relevance, count(*) AS n FROM E GROUP BY 1")
def edge_relevance(g):
    return score.edge_relevance(g.edges).groupBy("type", "relevance").agg(F.count("*").alias("n"))


@query(f"{R._IMPACT} SELECT N.module, count(*) AS n FROM impact JOIN N USING (id) WHERE N.module != '' AND N.module != (SELECT module FROM N WHERE id = (SELECT id FROM HUB)) GROUP BY 1")
def impact_other_modules(g):
    return score.impacted_modules(g, R._impact(g), hub(g))


@query(f"{R._IMPACT} SELECT via_type AS type, count(*) AS n, count(*) FILTER ({R._key('via_source')} != {R._key('via_target')}) AS crossing FROM impact GROUP BY 1")
def impact_breakdown(g):
    return score.edge_breakdown(R._impact(g), VENDOR)


@query("SELECT count(DISTINCT CASE WHEN module != '' THEN module END) AS n_modules, count(*) FILTER (type = 'route') AS n_routes, count(*) FILTER (type = 'service') AS services, (SELECT count(DISTINCT target_id) FROM E WHERE type = 'satisfies_contract') AS contracts, count(*) FILTER (type = 'event') AS events, count(*) FILTER (type = 'event_listener') AS listeners, count(*) FILTER (type = 'entity') AS entities, (SELECT count(*) FROM E WHERE type = 'has_relation') AS relations, (SELECT count(*) FROM XM) AS cross_module_edges FROM N")
def project_context(g):
    return g.context()


@query(f"SELECT 1::BIGINT AS n_modules, count(*) FILTER (type = 'route') AS n_routes, count(*) FILTER (type = 'service') AS services, (SELECT count(DISTINCT target_id) FROM EV WHERE type = 'satisfies_contract' AND (source_module = {R._MODULE} OR target_module = {R._MODULE})) AS contracts, count(*) FILTER (type = 'event') AS events, count(*) FILTER (type = 'event_listener') AS listeners, count(*) FILTER (type = 'entity') AS entities, (SELECT count(*) FROM EV WHERE type = 'has_relation' AND (source_module = {R._MODULE} OR target_module = {R._MODULE})) AS relations, NULL::BIGINT AS cross_module_edges FROM N WHERE module = {R._MODULE}")
def module_context(g):
    return g.context(R._module(g))


@query("SELECT t.id, coalesce(NR.type, 'unknown') AS type FROM (SELECT DISTINCT target_id AS id FROM E) t LEFT JOIN NR ON NR.id = t.id")
def typed_targets(g, d):
    return Graph(g.nodes.join(R.live_ids(g.nodes.sparkSession, d), "id", "left_semi"), g.edges).typed(g.edges.select(F.col("target_id").alias("id")).distinct())


_TASK = "fix the order account"


@query(
    f""", k AS (SELECT unnest(['fix', 'Fix', 'the', 'The', 'order', 'Order', 'account', 'Account', 'Checkout', 'Fulfillment', 'Cart', 'Payment', 'Billing', 'Stripe', 'User', 'Auth', 'Profile', 'Login', 'Permission', 'Capability']) AS w), kw AS (SELECT w FROM k WHERE w IN {tuple(naming.keywords(_TASK))}),
 h AS (SELECT id, w, 0 AS p, row_number() OVER (PARTITION BY w ORDER BY id) AS r FROM N, kw WHERE contains(lower(name), lower(w)) UNION ALL SELECT id, w, 1, row_number() OVER (PARTITION BY w ORDER BY id) FROM N, kw WHERE contains(lower(fqcn), lower(w))),
 f AS (SELECT w, id, min(p) AS p FROM h WHERE r <= 20 GROUP BY 1, 2), m AS (SELECT DISTINCT id FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY p, id) AS r FROM f) WHERE r <= 20)
 SELECT 'dependency' AS role, source_id AS node_id, target_id AS other_id, type FROM E WHERE source_id IN (SELECT id FROM m) AND type IN ('calls', 'instantiates', 'injects_readonly', 'injects_mutable')
 UNION ALL SELECT 'dependent', target_id, source_id, type FROM E WHERE target_id IN (SELECT id FROM m) AND type IN ('calls', 'instantiates', 'injects_readonly', 'injects_mutable')"""
)
def context_links(g):
    from arbograph.operators import ask

    return ask.task_links(g, ask.task_matches(g, _TASK))


# -- events


_LOUD = "(SELECT target_id FROM E WHERE type = 'listens_to' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _loud(g: Graph) -> str:
    row = g.edges_of_type("listens_to").groupBy("target_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_id").first()
    return row.target_id if row else ""


@query(
    f""", lv AS (SELECT 'emitter' AS role, NULL::VARCHAR AS mode, source_id AS id FROM E WHERE type = 'emits' AND target_id = {_LOUD} UNION ALL SELECT 'listener', CASE WHEN {R._MODE} IN ('async', 'queued') THEN {R._MODE} ELSE 'sync' END, source_id FROM E WHERE type = 'listens_to' AND target_id = {_LOUD})
 SELECT lv.role, lv.mode, lv.id, coalesce(nullif(N.fqcn, ''), lv.id) AS label FROM lv LEFT JOIN N ON N.id = lv.id UNION ALL SELECT 'subject', NULL::VARCHAR, target_id, coalesce(json_extract_string(CASE WHEN N.metadata IS NULL OR N.metadata IN ('', '[]') THEN '{{}}' ELSE N.metadata END, '$.pattern'), target_id) FROM (SELECT target_id FROM E WHERE type = 'publishes_to' AND source_id = {_LOUD} ORDER BY 1 LIMIT 1) s LEFT JOIN N ON N.id = target_id"""
)
def event_lifecycle(g):
    return g.lifecycle(_loud(g)).select("role", "mode", "id", "label")


@query(f"SELECT 'emitter' AS role, source_id AS id FROM E WHERE type = 'emits' AND target_id = {_LOUD} UNION ALL SELECT 'listener', source_id FROM E WHERE type = 'listens_to' AND target_id = {_LOUD}")
def event_info(g):
    return g.event_info(_loud(g))


# -- views and closures from the default depths and from the hub


_BOTH = """, b(id, d) AS (SELECT id, 0 FROM LEAF UNION SELECT CASE WHEN e.source_id = b.id THEN e.target_id ELSE e.source_id END, b.d + 1 FROM b JOIN E e ON e.source_id = b.id OR e.target_id = b.id WHERE b.d < 2), best AS (SELECT DISTINCT id FROM b)"""


@query(f"{_BOTH} SELECT DISTINCT source_id, target_id, type FROM E WHERE source_id IN (SELECT id FROM best) OR target_id IN (SELECT id FROM best)")
def view_focus_default(g):
    return traverse.view(g, leaf(g)).edges.select("source_id", "target_id", "type")


@query(f", BUSY AS (SELECT source_id AS id FROM E GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) {R._bfs('BUSY', 'out', 3)} SELECT id, d AS distance FROM best WHERE d > 0 AND id IN (SELECT id FROM N)")
def forward_closure_busy(g):
    """From the node with most edges out."""
    row = g.edges.groupBy("source_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_id").first()
    return traverse.reached(g, R._ids(g, row.source_id if row else ""), "outgoing", 3).select("id", "distance")


@query(R._touched_sql("HUB", "in", 3))
def usages_d3(g):
    return traverse.touched_edges(g, R._ids(g, hub(g)), "incoming", 3)


@query(""", w(cur, path, depth, edge_type) AS (SELECT id, [id], 0, '' FROM LEAF UNION ALL SELECT e.target_id, list_append(w.path, e.target_id), w.depth + 1, e.type FROM w JOIN E e ON e.source_id = w.cur WHERE w.depth < 3 AND NOT list_contains(w.path, e.target_id))
 SELECT array_to_string(path, ' > ') AS path, depth, edge_type FROM w WHERE depth > 0""")
def dependency_tree_default(g):
    return traverse.simple_paths(g, leaf(g))


@query(""", w(cur, path, depth, edge_type) AS (SELECT id, [id], 0, '' FROM LEAF UNION ALL SELECT e.source_id, list_append(w.path, e.source_id), w.depth + 1, e.type FROM w JOIN E e ON e.target_id = w.cur WHERE w.depth < 2 AND NOT list_contains(w.path, e.source_id))
 SELECT array_to_string(path, ' > ') AS path, depth, edge_type FROM w WHERE depth > 0""")
def usage_tree_paths(g):
    return traverse.simple_paths(g, leaf(g), "incoming", 2)


# -- snapshots, files, renderings


_AT = "(SELECT max(cutoff_at) FROM index_runs WHERE status = 'ok')"
_SNAP = "SELECT 'nodes' AS kind, '' AS name, count(*) AS n FROM {0} UNION ALL SELECT 'type', type, count(*) FROM {0} GROUP BY 2 UNION ALL SELECT 'module', module, count(*) FROM {0} WHERE module != '' GROUP BY 2"


@query(
    f"""WITH x AS (SELECT {_AT} AS t), n0 AS (SELECT id, arg_max(type, node_row) AS type, coalesce(arg_max(module, node_row), '') AS module FROM graph_nodes, x WHERE indexed_at <= t - INTERVAL 60 DAY AND (removed_at IS NULL OR removed_at > t - INTERVAL 60 DAY) AND id IS NOT NULL GROUP BY 1),
 n1 AS (SELECT id, arg_max(type, node_row) AS type, coalesce(arg_max(module, node_row), '') AS module FROM graph_nodes, x WHERE indexed_at <= t AND (removed_at IS NULL OR removed_at > t) AND id IS NOT NULL GROUP BY 1), a AS ({_SNAP.format('n0')}), b AS ({_SNAP.format('n1')}),
 e AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT source_id, target_id, type FROM graph_edges, x WHERE indexed_at <= t - INTERVAL 60 DAY AND {R._BLANK.format('source_id')} AND {R._BLANK.format('target_id')})) AS p, (SELECT count(*) FROM (SELECT DISTINCT source_id, target_id, type FROM graph_edges, x WHERE indexed_at <= t AND {R._BLANK.format('source_id')} AND {R._BLANK.format('target_id')})) AS q),
 j AS (SELECT kind, name, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'removed' WHEN a.n != b.n THEN 'changed' ELSE 'same' END AS status FROM a FULL JOIN b USING (kind, name))
 SELECT kind, name, before, after, after - before AS delta, status FROM j WHERE kind = 'nodes' OR kind = 'type' AND before != after OR kind = 'module' AND status IN ('new', 'removed') UNION ALL SELECT 'edges', '', p, q, q - p, CASE WHEN p = q THEN 'same' ELSE 'changed' END FROM e""",
    raw=True,
)
def graph_diff(spark, d):
    t = F.lit(table(spark, d, "index_runs").filter("status = 'ok'").agg(F.max("cutoff_at")).first()[0]).cast("timestamp_ntz")
    nodes, edges = table(spark, d, "graph_nodes").withColumn("rank", F.lit(0)), table(spark, d, "graph_edges")

    def at(x) -> DataFrame:
        live = nodes.filter((F.col("indexed_at") <= x) & (F.col("removed_at").isNull() | (F.col("removed_at") > x)) & F.col("id").isNotNull())
        one = live.groupBy("id").agg(F.max_by("type", "node_row").alias("type"), F.coalesce(F.max_by("module", F.when(F.col("module").isNotNull(), F.col("node_row"))), F.lit("")).alias("module"))
        return Graph(one, G.upsert_edges(edges.filter(F.col("indexed_at") <= x), ["edge_id"])).snapshot()

    return G.diff_snapshots(at(t - F.expr("INTERVAL 60 DAYS")), at(t))


@query("SELECT path, strftime(make_timestamp(indexed_at * 1000000), '%Y-%m-%d %H:%M:%S') AS indexed FROM graph_file_index", raw=True)
def index_dates(spark, d):
    return table(spark, d, "graph_file_index").select("path", naming.date_text(F.col("indexed_at")).alias("indexed"))


@query("SELECT '  \"' || replace(replace(id, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) || '\" [label=\"' || replace(replace(coalesce(name, id), chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) || '\", color=\"' || CASE type WHEN 'payload' THEN '#4CAF50' WHEN 'handler' THEN '#2196F3' WHEN 'service' THEN '#FF9800' WHEN 'entity' THEN '#9C27B0' WHEN 'resource' THEN '#00BCD4' WHEN 'event_listener' THEN '#E91E63' WHEN 'event' THEN '#F44336' WHEN 'command' THEN '#795548' WHEN 'component' THEN '#607D8B' ELSE '#9E9E9E' END || '\"];' AS line FROM N")
def dot_node_lines(g):
    return render.dot_nodes(g.nodes)


# -- incremental builds


def _trees(spark: SparkSession, d: str) -> list[DataFrame]:
    """The earliest and the latest content of each PHP file that parses in all its contents, as two states of a tree; files with even hashes are missing in the first and a few in the second."""
    rows = stored(table(spark, d, "source_files").filter("content IS NOT NULL AND file LIKE '%.php'").select("file", "content", "fetched_at", "file_id"), "contents")
    bad = stored(facts.file_facts(rows.withColumn("file", F.concat_ws("|", F.col("file_id").cast("string"), "file"))).filter("kind = 'error'").select(F.substring_index("file", "|", -1).alias("file")).distinct(), "bad")
    good = rows.join(bad, "file", "left_anti").groupBy("file")
    order = F.struct("fetched_at", "file_id")

    def tree(content, test: str) -> DataFrame:
        t = good.agg(content.alias("content")).filter(test).withColumnRenamed("file", "path")
        return t.select("path", F.sha2("content", 256).alias("content_hash"), "content", naming.module_of_path(F.col("path")).alias("module"), F.size(F.split("content", "\n")).alias("line_count"))

    return [tree(F.min_by("content", order), "pmod(xxhash64(file), 2) = 0"), tree(F.max_by("content", order), "pmod(xxhash64(file), 10) != 0")]


@query("SELECT 'nodes' AS what, 0::BIGINT AS n_different UNION ALL SELECT 'edges', 0::BIGINT", raw=True)
def incremental_equals_full(spark, d):
    """How many nodes and edges an incremental update from the first to the second tree has that a build of the second has not, and the other way round: none."""
    first, second = (stored(t, "tree") for t in _trees(spark, d))
    step, full = store.GraphStore(spark, scratch_path(spark, "store")), store.GraphStore(spark, scratch_path(spark, "store"))
    step.update_from(first)
    step.update_from(second)
    full.update_from(second)
    a, b = step.graph(), full.graph()
    different = lambda x, y: x.exceptAll(y).unionByName(y.exceptAll(x)).agg(F.count("*").alias("n_different"))
    return union([different(getattr(a, what), getattr(b, what)).select(F.lit(what).alias("what"), "n_different") for what in ("nodes", "edges")])


@query(raw=True)
def intents_from_source(spark, d):
    """The intents of the classes of all PHP sources."""
    g = extract.extract(R._facts(spark, d), [extract.intents, extract.inheritance])
    return g.of_type("doc_node").select("id", F.get_json_object("metadata", "$.purpose").alias("purpose"))


