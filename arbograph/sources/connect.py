"""Where a graph is stored, and graphs in relational databases."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from arbograph.operators.graph import Graph

#: Environment variables that name the folder of the graph, or the database that holds it.
FOLDER, JDBC_URL, JDBC_USER, JDBC_PASSWORD = "ARBOGRAPH_FOLDER", "ARBOGRAPH_JDBC_URL", "ARBOGRAPH_JDBC_USER", "ARBOGRAPH_JDBC_PASSWORD"


def real_path(spark: SparkSession, path: str) -> str | None:
    """The real path of a file or folder, None if there is none: such paths are skipped by scans."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.resolvePath(at).toString() if fs.exists(at) else None


def graph_folder(root: str, given: str | None = None, env: dict[str, str] | None = None) -> str:
    """The folder of a tree's graph: the given one, else that of the environment, else var/graph in the tree."""
    return given or (os.environ if env is None else env).get(FOLDER) or f"{root.rstrip('/')}/var/graph"


def jdbc_options(env: dict[str, str] | None = None) -> dict[str, str] | None:
    """The options of the database that the environment names, None if it names none."""
    e = os.environ if env is None else env
    if not e.get(JDBC_URL):
        return None
    return {"url": e[JDBC_URL]} | {k: e[v] for k, v in (("user", JDBC_USER), ("password", JDBC_PASSWORD)) if e.get(v)}


def read_jdbc(spark: SparkSession, options: dict[str, str], nodes: str = "graph_nodes", edges: str = "graph_edges") -> Graph:
    """The graph of two tables of a database; filters and columns are pushed down to it."""
    load = lambda t: spark.read.format("jdbc").options(**options, dbtable=t).load()
    return Graph(load(nodes), load(edges))


def write_jdbc(graph: Graph, options: dict[str, str], nodes: str = "graph_nodes", edges: str = "graph_edges") -> None:
    """Replaces the two tables of a database."""

    def save(df: DataFrame, name: str) -> None:
        df.write.format("jdbc").options(**options, dbtable=name).mode("overwrite").save()

    save(graph.nodes, nodes)
    save(graph.edges, edges)
