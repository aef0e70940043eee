"""Graph operators on hand graphs with literal answers."""

import json

from arbograph.functions import naming
from arbograph.operators import graph as G
from arbograph.operators import score, traverse
from arbograph.operators.graph import Graph
from arbograph.sources import render

NODES = "id string, type string, fqcn string, name string, file string, line int, end_line int, module string, metadata string, is_placeholder boolean"
EDGES = "source_id string, target_id string, type string, metadata string"


def node(id_, type_="class", module="M", fqcn=None, file="f.php", metadata="{}", placeholder=False, line=1):
    fqcn = fqcn if fqcn is not None else id_.partition(":")[2] or id_
    return (id_, type_, fqcn, fqcn.rpartition("\\")[2], file, line, line, module, metadata, placeholder)


def make(spark, nodes, edges):
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(*e, "{}") if len(e) == 3 else e for e in edges], EDGES))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_diamond(spark):
    g = make(spark, [node(x) for x in "abcd"], [("a", "b", "calls"), ("a", "c", "calls"), ("b", "d", "uses"), ("c", "d", "calls")])
    assert rows(traverse.reached(g, ids(spark, "d"))) == [("a", 2, "a", "b", "calls"), ("b", 1, "b", "d", "uses"), ("c", 1, "c", "d", "calls")]
    assert [r[:3] for r in rows(traverse.touched_edges(g, ids(spark, "d"), "incoming", 2))] == [("a", "b", "calls"), ("a", "c", "calls"), ("b", "d", "uses"), ("c", "d", "calls")]
    assert rows(traverse.simple_paths(g, "a", depth=3).select("path", "depth")) == [("a > b > d", 2), ("a > b", 1), ("a > c > d", 2), ("a > c", 1)]
    assert rows(traverse.bounded_cycles(g.edges)) == []
    assert rows(traverse.reached(g, ids(spark, "missing"))) == []
    assert rows(traverse.view(g, "b", depth=1).nodes.select("id")) == [("a",), ("b",), ("d",)]
    assert rows(traverse.dependents(g, "d", ("calls",), ("calls",), 2)) == [("a", 2), ("c", 1)]


def test_loops(spark):
    g = make(spark, [node("a"), node("b")], [("a", "a", "calls"), ("a", "b", "calls"), ("b", "a", "uses")])
    assert g.edges_of("a").count() == 4 and g.edges_of("a", "both", "uses").count() == 1 and g.edges_of("a", "outgoing").count() == 2
    assert rows(traverse.reached(g, ids(spark, "a"))) == [("b", 1, "b", "a", "uses")]
    assert rows(traverse.bounded_cycles(g.edges)) == [("a > b", 2), ("a", 1)]
    assert rows(traverse.bounded_cycles(g.edges, ids(spark, "b"))) == [("a > b", 2)]
    assert rows(traverse.bounded_cycles(g.edges, max_length=1)) == [("a", 1)]


def test_write_algebra(spark):
    g = make(spark, [node("class:A")], [("class:A", "table:x", "maps_to_table"), ("class:A", "class:A", "calls")])
    assert rows(G.placeholders(g.nodes, g.edges).select("id", "type", "fqcn", "module", "is_placeholder")) == [("table:x", "class", "x", "", True)]
    merged = spark.createDataFrame(
        [
            (*node("n", "class", "", "", "a.php", '{"k": 1, "o": [1]}', line=0), 1),
            (*node("n", "command", "M", "A\\B", "", '{"k": 2}', line=7), 2),
            (*node("n", "hotspot", "", "", "", "[]", line=0), 3),
            (*node("t", "class"), 1),
            (*node("t", "interface"), 2),
        ],
        NODES + ", seq int",
    )
    got = {r.id: r for r in G.merge_nodes(merged).collect()}
    assert (got["n"].type, got["n"].fqcn, got["n"].file, got["n"].line, got["n"].module, json.loads(got["n"].metadata)) == ("command", "A\\B", "a.php", 7, "M", {"k": 2, "o": [1]})
    assert got["t"].type == "interface"
    files = spark.createDataFrame([(*node("d", file="b.php"), "b.php"), (*node("d", file="a.php"), "a.php"), (*node("p", placeholder=True), "a.php"), (*node("p", file="z.php"), "z.php")], NODES + ", file_seq string")
    assert rows(G.first_file_wins(files).select("id", "file", "is_placeholder")) == [("d", "a.php", False), ("p", "z.php", False)]
    edges = spark.createDataFrame([("a", "b", "x", "1", 1), ("a", "b", "x", "2", 2), ("a", None, "x", "3", 3), ("a", " ", "x", "4", 4)], EDGES + ", n int")
    assert rows(G.upsert_edges(edges, ["n"])) == [("a", "b", "x", "2")]
    g = make(spark, [node("a", file="1"), node("b", file="2"), node("c", file="2")], [("a", "b", "x"), ("b", "c", "x"), ("a", "a", "x")])
    kept, left = G.remove_files(g.nodes, g.edges, spark.createDataFrame([("2",)], "file string"))
    assert rows(kept.select("id")) == [("a",)] and rows(left.select("source_id", "target_id")) == [("a", "a")]
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("e", None)], "path string, content_hash string")
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("e", None)], "path string, content_hash string")
    assert rows(G.diff_files(before, after)) == [("b", "modified"), ("c", "deleted"), ("d", "added")]


def test_search(spark):
    g = make(spark, [node(f"class:App\\Foo{i:02}", "interface" if i > 21 else "class") for i in range(25)] + [node("class:foo\\x_y", fqcn="foo\\x_y"), node("class:Z%")], [])
    assert g.search("FOO").count() == 20 and g.find("interface", pattern="foo").count() == 0
    assert rows(g.find("interface").select("id")) == [(f"class:App\\Foo{i}",) for i in (22, 23, 24)]
    assert g.search_name("%").count() == 1 and g.search_name("_").count() == 1 and g.search("App\\Foo").count() == 20 and g.find().count() == 27
    assert rows(g.resolve_target("App\\Foo03")) == [("class:App\\Foo03",)] and rows(g.resolve_component("App\\Foo03")) == [("class:App\\Foo03",)]
    assert rows(g.resolve_component("class:nowhere")) == [("class:nowhere",)]


def test_joins(spark):
    nodes = [node("class:P", "payload", "A"), node("class:H", "handler", "B"), node("class:R", "resource", "B"), node("route:GET:/", "route", "A", metadata='{"method":"PUT"}'), node("class:L", "event_listener", ""), node("class:X", module="A")]
    edges = [("class:P", "route:GET:/", "serves_route"), ("class:H", "class:P", "handles"), ("class:H", "class:R", "produces"), ("class:E", "subject:e", "publishes_to"), ("class:H", "class:E", "emits"), ("class:L", "class:E", "listens_to", '{"executionMode":"queued"}'), ("class:X", "class:E", "listens_to", "[]"), ("class:C", "subject:e", "consumes_from"), ("class:H", "class:S", "satisfies_contract")]
    g = make(spark, nodes, edges)
    assert rows(g.handler_chains()) == [("route:GET:/", "class:P", "class:H", "class:R")]
    assert rows(g.lifecycles()) == [("class:E", 1, 1, 0, 1, 1, 1)]
    assert rows(g.routes()) == [("PUT", 1)]
    assert rows(g.cross_module().select("source_id", "target_id")) == [("class:H", "class:P")] and g.cross_module("A").count() == 0
    assert rows(g.implementors("class:S").select("id")) == [("class:H",)] and rows(g.satisfied_contracts()) == [(1,)]
    assert rows(g.compact(g.edges_of("class:H", "outgoing"), "target")) == [("P", "handles", 1), ("R", "produces", 1), ("class:E", "emits", 1), ("class:S", "satisfies_contract", 1)]
    assert rows(g.edge_count("handles", "A")) == [(1,)] and rows(score.event_impact(g)) == [("class:H", "class:E", 2)]
    assert {r.kind: r.n for r in g.totals().collect()} == {"nodes": 6, "edges": 9, "placeholders": 0, "modules": 2, "orphans": 0, "cross_module_edges": 1}
    assert "class:X" in {r.id for r in g.without("intent_for").collect()}


def test_blast_radius(spark):
    vendor, via = "Core", "id string, distance int, via_source string, via_target string, via_type string"
    low = spark.createDataFrame([("class:App\\S", 1, "class:App\\S", "class:App\\C", "uses")], via)
    assert rows(score.blast_radius(low, vendor)) == [(2, "low", "inline", 0, 1)]
    hot = spark.createDataFrame([("class:Core\\Orm\\Contracts\\E", 1, "class:Core\\Orm\\Contracts\\E", "class:App\\C", "implements")], via)
    assert rows(score.blast_radius(hot, vendor)) == [(30, "medium", "inline", 1, 1)]
    assert rows(score.blast_radius(low.limit(0), vendor)) == [(0, "low", "inline", 0, 0)]
    many = spark.createDataFrame([(f"class:A{i}\\Contract", 2, f"class:A{i}\\x", "class:B\\y", "extends") for i in range(9)], via)
    assert rows(score.blast_radius(many, vendor))[0][:3] == (100, "high", "epic_required")


def test_packing(spark):
    ranked = "id string, score double, distance int, snippet string"
    pack = lambda r, **k: rows(score.pack(spark.createDataFrame(r, ranked), **k))
    assert pack([("a", 9.0, 1, "x" * 31_996), ("b", 8.0, 1, "abcd"), ("c", 7.0, 1, "abcd")]) == [("a", 1, 8049)]
    assert pack([("a", 9.0, 1, "x" * 40), ("b", 8.0, 1, "x" * 32_000), ("c", 7.0, 1, "")]) == [("a", 1, 60)]
    assert pack([("a", 1.0, 1, None), ("b", 1.0, 1, "é" * 4), ("c", 1.0, 2, "")], nodes=2) == [("a", 1, 50), ("b", 2, 102)]
    assert pack([]) == []
    text = "\n".join(f"l{i}" for i in range(1, 21))
    files = spark.createDataFrame([("a", text, 1, 2), ("b", text, 10, 10), ("c", text, 19, 99), ("d", None, 1, 1)], "id string, content string, line int, end_line int")
    got = {r.id: r.snippet.split("\n") for r in score.snippets(files).collect()}
    assert (got["a"][0], got["a"][-1]) == ("l1", "l7") and (got["b"][0], got["b"][-1]) == ("l5", "l15") and got["c"][-1] == "l20" and "d" not in got


def test_scalars(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(naming.short_name(F.lit("A\\B\\C"))) == "C" and value(naming.fqcn_of_id(F.lit("doc:class:A"))) == "class:A" and value(naming.fqcn_of_id(F.lit("A"))) == "A"
    assert value(naming.snake_case(F.lit("OrderShippedEvent"))) == "order_shipped_event" and value(naming.spaced_words(F.lit("AB"))) == "a b"
    assert value(naming.studly_case(F.lit("my-fine_pkg 2x"))) == "MyFinePkg2x"
    assert [value(naming.module_of_path(F.lit(p))) for p in ("packages/acme-billing/src/A.php", "src/A.php", "x/tests/A.php", "lib/A.php")] == ["AcmeBilling", "App", "App", ""]
    assert value(naming.domain_segment(F.lit("App\\Orders\\Domain\\Event"))) == "orders" and value(naming.domain_segment(F.lit("Domain\\Event"))) == ""
    assert value(naming.flow_name(F.lit("A\\MakeOrderRequest"))) == "MakeOrderFlow"
    assert value(naming.module_key(F.lit("class:Core\\Orm\\X"), "Core")) == "Orm" and value(naming.module_key(F.lit("App\\X"), "Core")) == "App"
    assert value(naming.token_estimate(F.lit("ééé"))) == 1
    assert value(naming.infer_domain(F.lit("WebCheckout"))) == "Ordering" and value(naming.infer_domain(F.lit("Zzz"))) == "Zzz"
    assert value(naming.infer_domain(F.lit("login-media"))) == "Media" and value(naming.infer_domain(F.lit("my-zzz_kit"))) == "My Zzz Kit"
    assert value(naming.event_domain(F.lit("App\\Domain\\Event\\OrderMadeEvent"))) == "app" and value(naming.event_domain(F.lit("Event\\OrderMadeEvent"))) == "ordermade"
    assert value(naming.date_text(F.lit(86400))) == "1970-01-02 00:00:00" and value(naming.date_text(F.lit(None).cast("long"))) is None
    assert value(naming.colour(F.lit("payload"))) == "#4CAF50" and value(naming.colour(F.lit("x"))) == "#9E9E9E" and value(naming.first_capital(F.lit("abC"))) == "AbC"
    assert naming.keywords("fix the payment") == ["fix", "Fix", "the", "The", "payment", "Payment", "Billing", "Checkout", "Stripe", "Order", "Cart", "Fulfillment"]
    ignored = lambda p: value(naming.is_ignored(F.lit(p)) | naming.is_pruned(F.lit(p)))
    assert [ignored(p) for p in ("vendor/a.php", "a/vendor/b.php", "tests/fixtures/x.php", "src/x.generated.php", "src/x.php", "src/myvendor/x.php")] == [True, True, True, True, False, False]
    assert naming.keywords("add a cart-page", {"cart": ("Order",), "order": ("Invoice",)}) == ["add", "Add", "cart", "Cart", "page", "Page", "Order", "Invoice"]


def test_renderings(spark):
    g = make(spark, [node('a\\"b')], [('a\\"b', "c", "x")])
    assert g and render.dot_edges(g.edges).first().line == '  "a\\\\\\"b" -> "c" [label="x"];'
    assert json.loads(render.ndjson(g.edges, "edge").first().line) == {"kind": "edge", "source_id": 'a\\"b', "target_id": "c", "type": "x", "metadata": "{}"}
    assert render.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y int")) == "| x | y |\n|---|---|\n| a\\|b |  |"
    assert render.dot_nodes(make(spark, [node("class:A", "event")], []).nodes).first().line == '  "class:A" [label="A", color="#F44336"];'
    assert render.flow_markdown("F", "route:GET:/x", [("class:A\\P", "payload"), ("class:A\\H", "handler")], ["class:A\\E"]).split("```")[1] == 'mermaid\ngraph LR\n    P["P\\n(payload)"]\n    H["H\\n(handler)"]\n    P --> H\n    E{"E"}\n    H -. emit .-> E\n'
    summary = render.view_summary(make(spark, [node("class:A"), node("class:B", "event", "N")], [("class:A", "class:B", "emits")]), "86400", "1")
    assert summary.splitlines()[2:] == ["Last generated: 1970-01-02 00:00:00", "Schema version: 1", "", "Nodes: 2", "  class: 1    event: 1", "", "Edges: 1", "  emits: 1", "", "Modules: 2", "  Top: M: 1    N: 1", "", "Cross-module edges: 1", "Orphan nodes: 0", "Placeholder nodes: 0"]
