"""The stored graph: incremental updates against full builds, the index, meta values, failures."""

import pytest
from pyspark.sql import functions as F

from arbograph.sources import connect, scan, store
from arbograph.sources.facts import file_facts

A = "<?php namespace P; class A extends B { function f() { return new C(); } }"
B = "<?php namespace P; class B {}"
C = "<?php namespace P; class C { #[InjectAsReadonly] private B $b; }"


def put(root, **files):
    for name, text in files.items():
        path = root / "packages" / "acme-x" / "src" / f"{name}.php"
        path.parent.mkdir(parents=True, exist_ok=True)
        if text is None:
            path.unlink()
        else:
            path.write_text(text)


def content(g):
    nodes = sorted(map(tuple, g.nodes.select("id", "type", "fqcn", "file", "line", "end_line", "module", "metadata", "is_placeholder").collect()))
    return nodes, sorted(map(tuple, g.edges.select("source_id", "target_id", "type", "metadata").collect()))


def same_as_full(spark, s, root, tmp_path, n):
    other = store.GraphStore(spark, str(tmp_path / f"full{n}"))
    other.full_build(str(root))
    assert content(s.graph()) == content(other.graph())


def test_updates_equal_full_builds(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    put(root, A=A, B=B, C=C)
    monkeypatch.setattr(store, "FOLD", 2)
    parsed = []
    monkeypatch.setattr(store.facts, "file_facts", lambda files: parsed.append(sorted(r.file for r in files.select("file").collect())) or file_facts(files))
    s = store.GraphStore(spark, str(tmp_path / "g"), clock=lambda: 1000.0)
    first = s.update(str(root))
    assert (first.files_scanned, first.nodes_removed, first.edges_removed, first.no_changes) == (3, 0, 0, False) and first.nodes_added == s.graph().nodes.count() and first.edges_added == s.graph().edges.count()
    assert s.meta("last_update") == "1000" and s.meta("total_nodes") == str(first.nodes_added) and s.meta("schema_version") == "1" and s.meta("none") is None
    assert s.update(str(root)).no_changes and len(parsed) == 1
    name = lambda x: f"packages/acme-x/src/{x}.php"
    steps = [dict(B="<?php namespace P; class B extends Gone {}"), dict(C=None), dict(D="<?php namespace P; class D implements I {} class C {}"), dict(A=A.replace("new C", "new D"), C=C)]
    for n, step in enumerate(steps):
        put(root, **step)
        got = s.update(str(root))
        assert got.files_scanned == len(step) and parsed[-1] == sorted(name(x) for x, t in step.items() if t is not None)
        same_as_full(spark, s, root, tmp_path, n)
        parsed.pop()
    ids = {r.id for r in s.graph().nodes.collect()}
    assert "class:Gone" not in ids and "class:P\\Gone" in ids
    # The first file owns an id: C.php comes before D.php.
    assert s.graph().node("class:P\\C").first().file == name("C")


def test_errors_dirty_files_and_truncation(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, A=A, B=B)
    s = store.GraphStore(spark, str(tmp_path / "g"))
    s.update(str(root))
    before = content(s.graph())
    put(root, A="<?php class {", E="<?php class {")
    got = s.update(str(root))
    assert got.files_errored == 2 and [e["file"].rpartition("/")[2] for e in got.errors] == ["A.php", "E.php"] and content(s.graph()) == before
    assert s.index().count() == 2 and s.update(str(root)).files_errored == 2
    put(root, A=A, E=None)
    assert s.update(str(root)).no_changes
    path = spark.createDataFrame([("packages/acme-x/src/A.php",), ("nowhere",)], "path string")
    s.mark_dirty(path)
    assert [r.path for r in s.dirty().collect()] == ["packages/acme-x/src/A.php"] and s.indexed("packages/acme-x/src/B.php").count() == 1
    assert s.update(str(root)).files_scanned == 1 and s.dirty().count() == 0 and content(s.graph()) == before
    s.set_meta("k", "v")
    s.set_meta("k", "w")
    assert s.meta("k") == "w" and content(s.graph()) == before
    s.truncate()
    assert s.graph().nodes.count() == s.graph().edges.count() == s.index().count() == 0 and s.meta() == {}
    assert s.graph().nodes.columns == list(store.NODE)


def test_of_two_writers_one_is_refused(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "g"))
    s.set_meta("a", "1")
    number, now = s._version()
    s.set_meta("b", "2")
    with pytest.raises(store.Conflict):
        s._publish(number + 1, now)
    assert store.refresh(s, str(tmp_path / "no tree")).startswith("not refreshed") and store.refresh(s, None) is None


def test_connections(spark, tmp_path):
    assert connect.graph_folder("/t", None, {}) == "/t/var/graph" and connect.graph_folder("/t", None, {connect.FOLDER: "/e"}) == "/e" and connect.graph_folder("/t", "/g", {connect.FOLDER: "/e"}) == "/g"
    assert connect.jdbc_options({}) is None and connect.jdbc_options({connect.JDBC_URL: "jdbc:x", connect.JDBC_USER: "u"}) == {"url": "jdbc:x", "user": "u"}
    assert connect.real_path(spark, str(tmp_path / "none")) is None and connect.real_path(spark, str(tmp_path)).endswith(tmp_path.name)


def test_plain_folders_are_read_too(spark, tmp_path):
    nodes = spark.createDataFrame([("class:A", "class", "A", "A", "a.php", 1, 1, "", "{}", False)], "id string, type string, fqcn string, name string, file string, line int, end_line int, module string, metadata string, is_placeholder boolean")
    edges = spark.createDataFrame([], "source_id string, target_id string, type string, metadata string")
    scan.write_graph(nodes, edges, str(tmp_path / "g"))
    assert store.open_graph(spark, str(tmp_path / "g")).nodes.filter(F.col("id") == "class:A").count() == 1
