"""Queries of the general problems p1, p2, p3 and p6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbograph.operators import hierarchy, ledger, orphans, skew
from arbograph.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.hot_keys(table(spark, d, "graph_edges"))


def p1_degrees(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_degrees(table(spark, d, "graph_edges"))


def _orphan_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("graph_nodes", "core_nodes", "graph_edges", "context_items")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.cascade(*_orphan_tables(spark, d)).filter("kind = 'direct'").select("ref_table", "row_id")


def p2_cascade(spark: SparkSession, d: str) -> DataFrame:
    return orphans.cascade(*_orphan_tables(spark, d)).drop("t")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(orphans.cascade(*_orphan_tables(spark, d)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.tree_nodes(table(spark, d, "graph_edges"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.tree_paths(table(spark, d, "graph_edges"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(spark, d, "graph_edges"))


def p3_cycles(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycles(table(spark, d, "graph_edges"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return ledger.changed_nodes(table(spark, d, "node_feed"), table(spark, d, "index_runs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_degrees, p2_found, p2_cascade, p2_report, p3_found, p3_paths, p3_descendants, p3_cycles, p6_found)}

_VALID = "({0} IS NOT NULL AND length(trim({0}, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160))) > 0)"
_S, _T, _N = (_VALID.format(c) for c in ("source_id", "target_id", "node_id"))
_ALL_NODES = "all_nodes AS (SELECT id, is_placeholder, indexed_at, removed_at FROM graph_nodes UNION ALL SELECT id, is_placeholder, indexed_at, removed_at FROM core_nodes)"
_REFS = f"refs AS (SELECT 'graph_edges' AS ref_table, edge_id AS row_id, target_id AS ref, indexed_at AS t FROM graph_edges WHERE {_T} UNION ALL SELECT 'context_items', item_id, node_id, packed_at FROM context_items WHERE {_N})"
_DIRECT = "direct AS (SELECT r.* FROM refs r WHERE NOT EXISTS (SELECT 1 FROM all_nodes n WHERE n.id = r.ref AND n.is_placeholder = false AND n.indexed_at <= r.t AND (n.removed_at IS NULL OR r.t < n.removed_at)))"
_OWN = f"own AS (SELECT edge_id, source_id, target_id FROM graph_edges WHERE type IN ('extends', 'extends_module', 'implements') AND {_S} AND {_T})"
_CASCADE = f"""WITH RECURSIVE {_ALL_NODES}, {_REFS}, {_DIRECT}, {_OWN},
broken0 AS (SELECT DISTINCT source_id AS ref FROM own WHERE edge_id IN (SELECT row_id FROM direct WHERE ref_table = 'graph_edges')),
walk(ref, round) AS (SELECT ref, 1 FROM broken0 UNION SELECT o.source_id, w.round + 1 FROM walk w JOIN own o ON o.target_id = w.ref WHERE w.round < 120),
broken AS (SELECT ref, min(round) AS round FROM walk GROUP BY ref),
marked AS (SELECT ref_table, row_id, t, 'direct' AS kind, 0 AS round FROM direct
 UNION ALL SELECT r.ref_table, r.row_id, r.t, 'inherited', b.round FROM refs r JOIN broken b ON b.ref = r.ref WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.ref_table = r.ref_table AND d.row_id = r.row_id))
"""
_PARENT = f"""parent AS (SELECT source_id AS id, target_id AS parent FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY indexed_at DESC, edge_id DESC) AS rn FROM graph_edges
 WHERE type IN ('extends', 'extends_module') AND {_T} AND {_S}) WHERE rn = 1)"""
_UP = f"""WITH RECURSIVE {_PARENT},
up(id, cur, depth, path) AS (SELECT id, parent, 1, [id, parent] FROM parent UNION ALL SELECT u.id, p.parent, u.depth + 1, list_append(u.path, p.parent) FROM up u JOIN parent p ON p.id = u.cur WHERE NOT list_contains(u.path[:-2], u.cur)),
ends AS (SELECT u.* FROM up u WHERE NOT EXISTS (SELECT 1 FROM parent p WHERE p.id = u.cur)),
loops AS (SELECT u.id, list_min(u.path[list_position(u.path, u.cur):]) AS root FROM up u WHERE list_contains(u.path[:-2], u.cur))
"""
_STATE = """WITH r AS (SELECT run_id, cutoff_at, row_number() OVER (ORDER BY cutoff_at, run_id) AS k FROM index_runs WHERE status = 'ok'),
s AS (SELECT r.k, r.run_id, f.node_id, arg_max({'live': op = 'upsert', 'file': file, 'hash': content_hash}, (changed_at, seq)) AS v
 FROM r JOIN node_feed f ON f.arrived_at <= r.cutoff_at WHERE f.node_id IS NOT NULL AND (op = 'delete' OR op = 'upsert' AND content_hash IS NOT NULL) GROUP BY ALL),
c AS (SELECT k, run_id, node_id, CASE WHEN v.live THEN {'file': v.file, 'hash': v.hash} END AS v FROM s)
"""

ORACLE = {
    "p1_found": f"""SELECT side, node_id FROM (SELECT 'source' AS side, source_id AS node_id, count(*) AS n FROM graph_edges WHERE {_S} GROUP BY ALL UNION ALL SELECT 'target', target_id, count(*) FROM graph_edges WHERE {_T} GROUP BY ALL)
 WHERE n * 100 >= 2 * (SELECT count(*) FROM graph_edges)""",
    "p1_degrees": f"""SELECT 'source' AS side, source_id AS node_id, count(*) AS n_edges, count(DISTINCT CASE WHEN {_T} THEN target_id END) AS n_counterparts FROM graph_edges WHERE {_S} GROUP BY source_id
 UNION ALL SELECT 'target', target_id, count(*), count(DISTINCT CASE WHEN {_S} THEN source_id END) FROM graph_edges WHERE {_T} GROUP BY target_id""",
    "p2_found": f"WITH {_ALL_NODES}, {_REFS}, {_DIRECT} SELECT ref_table, row_id FROM direct",
    "p2_cascade": f"{_CASCADE} SELECT ref_table, row_id, kind, round FROM marked",
    "p2_report": f"{_CASCADE} SELECT ref_table, strftime(t, '%Y-%m') AS period, kind, count(*) AS n FROM marked GROUP BY ALL",
    "p3_found": f"{_UP} SELECT id AS node_id, cur AS root_id, depth FROM ends UNION ALL SELECT id, root, -1 FROM loops",
    "p3_paths": f"{_UP} SELECT id AS node_id, cur AS root_id, depth, array_to_string(list_reverse(path), ' > ') AS path FROM ends UNION ALL SELECT id, root, -1, NULL FROM loops",
    "p3_descendants": f"{_UP} SELECT u.cur AS ancestor_id, u.id AS node_id, u.depth::BIGINT AS distance FROM up u WHERE u.id NOT IN (SELECT id FROM loops)",
    "p3_cycles": f"{_UP} SELECT DISTINCT list_min(path[:-2]) AS cycle_id, id AS node_id FROM up WHERE cur = id AND NOT list_contains(path[2:-2], id)",
    "p6_found": f"{_STATE} SELECT c.run_id, c.node_id FROM c LEFT JOIN c b ON b.k = c.k - 1 AND b.node_id = c.node_id WHERE c.v IS DISTINCT FROM b.v",
}
