"""Questions and the command line."""

import json

import pytest

from arbograph import cli
from arbograph.operators import ask, extract
from arbograph.operators.graph import Graph
from arbograph.runtime import stored
from arbograph.sources import facts, scan


@pytest.mark.parametrize(
    "question,kind,subject",
    [
        ("How does MakeOrder work?", "flow", "MakeOrder"),
        ("what happens when OrderMade is emitted", "lifecycle", "OrderMade"),
        ("What happens when A\\B", "lifecycle", "A\\B"),
        ("what breaks if I change class:X?", "impact", "class:X"),
        ("where is Payment processed?", "handler", "Payment"),
        ("what domain is X in?", "domain", "X"),
        ("trace X lifecycle", "lifecycle", "X"),
        ("show docs for X", "intent", "X"),
        ("What are the hotspots?", "hotspots", ""),
        ("what flows exist in Billing", "flows", "Billing"),
        ("what NATS subjects does X publish", "published", "X"),
        ("what consumes X", "consumers", "X"),
        ("what modules lack documentation?", "doc_gaps", ""),
        ("Handler", "search", "Handler"),
        ("please, how   does Pay work today", "flow", "Pay"),
        ("what domain does X belong to", "domain", "X"),
        ("show me doc for X", "intent", "X"),
        ("what are critical paths", "hotspots", ""),
        ("what flow are in Billing", "flows", "Billing"),
        ("tell me what nats subject does X publish", "published", "X"),
    ],
)
def test_understand(question, kind, subject):
    assert ask.understand(question) == (kind, subject)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [
        ("packages/acme-billing/src/P.php", "<?php namespace A; #[AsPublicPayload(path: '/p')] class PayPayload {} #[AsCommand(name: 'make:pay', description: 'Pays')] class PayCommand {}"),
        ("packages/acme-billing/src/H.php", "<?php namespace A; #[AsPayloadHandler(payload: PayPayload::class)] class PayHandler { function f() { $this->bus->emit(new PaidEvent()); } } #[AsEvent] #[Propagated] class PaidEvent {}"),
    ]
    g = extract.extract(stored(facts.file_facts(spark.createDataFrame(rows, "file string, content string")), "facts"))
    out = str(tmp_path_factory.mktemp("graph"))
    scan.write_graph(g.nodes, g.edges, out)
    return out


def test_answers(spark, folder):
    g = Graph(*scan.read_graph(spark, folder))
    ids = lambda q: {r[0] for r in ask.answer(g, q).select("id").collect()}
    assert ids("what breaks if I change A\\PayPayload") >= {"class:A\\PayHandler"}
    assert ids("how does Pay work") == {"class:A\\PayPayload", "class:A\\PayHandler"}
    assert ids("where is Pay processed") == {"class:A\\PayHandler"} and ask.answer(g, "what domain is A\\PayHandler").first().name == "Billing"
    assert ids("what flows exist in AcmeBilling") == {"flow:PayFlow"}
    assert ask.answer(g, "what happens when A\\PaidEvent is emitted").first().n_emitters == 1
    assert ask.answer(g, "what nats subjects does A\\PaidEvent publish").first().target_id == "subject:app.events.{node}.a.paid"
    assert ask.answer(g, "what are hotspots").count() > 0 and json.loads(ask.answer(g, "show docs for A\\PayHandler").first().metadata)["purpose"] == "HTTP request payload definition"
    assert [tuple(r)[:3] for r in ask.capabilities(g, "generators").collect()] == [("make:pay", "generator", "Pays")] and ask.capabilities(g, "graph").count() == 0
    better = spark.createDataFrame([("make:pay", "", "Pays at once", "always")], "name string, kind string, description string, use_when string")
    assert [tuple(r)[:4] for r in ask.capabilities(g, curated=better).collect()] == [("make:pay", "generator", "Pays at once", "always")]
    assert ask.resolve_event(g, "PaidEvent") == "class:A\\PaidEvent" and ask.resolve_event(g, "nothing") == "class:nothing"


def run(spark, capsys, *args):
    assert cli.main(list(args), spark) == 0
    return capsys.readouterr().out


@pytest.mark.parametrize(
    "args,says",
    [
        (["stats"], "live_nodes"),
        (["usages", "A\\PayPayload", "--compact"], "A\\PayHandler  [handles] ×1"),
        (["usages", "A\\PayPayload"], "A\\PayHandler --[handles]--> A\\PayPayload"),
        (["usages", "A\\PayPayload", "--format", "markdown"], "| class:A\\PayHandler | class:A\\PayPayload | handles |"),
        (["impact", "A\\PayPayload"], "Depth 1 (1 nodes)\nA\\PayHandler (handler, AcmeBilling)"),
        (["impact", "A\\PayPayload", "--context"], "# Context Package"),
        (["impact", "A\\PayPayload", "--prompt", "refactor", "--goal", "split it"], "to achieve: split it"),
        (["search", "Pay", "--format", "ndjson"], '"kind":"node"'),
        (["find", "--type", "command"], "A\\PayCommand (command)"),
        (["show", "--type", "payload,handler", "--format", "dot"], '[label="PayHandler", color="#2196F3"]'),
        (["show", "--type", "payload,handler"], "Nodes: 2"),
        (["show", "--type", "payload,handler", "--format", "markdown"], "| handler | 1 |"),
        (["ask", "what are hotspots"], "risk"),
        (["component-impact", "A\\PayPayload"], "LOW"),
        (["event-trace", "PaidEvent"], "**Emitted by:** `A\\PayHandler`"),
        (["flow-trace", "Pay"], "PayPayload --> PayHandler"),
        (["event-trace", "PaidEvent", "--include-code"], "packages/acme-billing/src/H.php"),
        (["flow-trace", "Pay", "--include-code", "--format", "ndjson"], '"file":"packages/acme-billing/src/P.php"'),
        (["module", "AcmeBilling", "--format", "ndjson"], '"external":0'),
        (["context", "fix the pay handler"], "class:A\\PayHandler"),
        (["module", "AcmeBilling"], "## Domain: Billing"),
        (["capabilities"], "make:pay  Pays"),
        (["capabilities", "--format", "markdown"], "## Generator (1 commands)"),
        (["intent", "A\\PayHandler"], "**Confidence:** 85%"),
        (["hotspots"], "risk"),
        (["doc-gaps"], "points"),
        (["cross-module", "--format", "json"], "[]"),
    ],
)
def test_commands(spark, folder, args, says, capsys):
    assert says in run(spark, capsys, *args, "--graph", folder)


def test_json_outputs(spark, folder, capsys):
    get = lambda *args: json.loads(run(spark, capsys, *args, "--graph", folder, "--format", "json"))
    assert get("usages", "A\\PayPayload", "--compact") == {"anchor": "class:A\\PayPayload", "classes": 1, "related": [{"class": "A\\PayHandler", "kinds": ["handles"], "edges": 1}]}
    assert get("usages", "A\\PayPayload") == [{"source": "class:A\\PayHandler", "target": "class:A\\PayPayload", "type": "handles", "metadata": {"execution": "sync"}}]
    impact = get("impact", "A\\PayPayload")
    assert impact["impacted"] == [{"id": "class:A\\PayHandler", "fqcn": "A\\PayHandler", "type": "handler", "module": "AcmeBilling", "distance": 1}] and (impact["total"], impact["max_depth"], impact["modules"]) == (1, 1, {"AcmeBilling": 1})
    view = get("show", "--type", "payload,handler")
    assert view["total_nodes"] == 2 and view["edges"] == [{"sourceId": "class:A\\PayHandler", "targetId": "class:A\\PayPayload", "type": "handles", "metadata": {"execution": "sync"}}] and view["node_types"] == {"handler": 1, "payload": 1}
    made = get("capabilities", "--type", "generators")
    assert [c["name"] for c in made["commands"]] == ["make:pay"] and made["project_context"]["route_summary"] == {"GET": 1} and made["project_context"]["event_count"] == 1
    lines = [json.loads(x) for x in run(spark, capsys, "impact", "A\\PayPayload", "--graph", folder, "--format", "ndjson").splitlines()]
    assert lines == [{"kind": "summary", "direct": 1, "transitive": 0, "total": 1, "max_depth": 1, "modules": {"AcmeBilling": 1}}, {"kind": "direct", "fqcn": "A\\PayHandler", "type": "handler", "module": "AcmeBilling", "distance": 1, "action": "edit"}]


def test_more_rows_than_a_table_shows(spark, capsys):
    n = cli.SHOWN + 503
    df = spark.range(n).selectExpr("concat('a', id) AS source_id", "'hub' AS target_id", "'calls' AS type").repartition(7)
    cli._show(df, "ndjson")
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {x["source_id"] for x in lines} == {f"a{i}" for i in range(n)} and len(lines) == n
    cli._show(df, "json")
    assert len(json.loads(capsys.readouterr().out)) == n
    cli._show(df, "dot")
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "digraph g {" and out[-1] == "}" and len(set(out[1:-1])) == n == len(out) - 2
    cli._show(df, "markdown")
    assert f"Only the first {cli.SHOWN} rows are shown." in capsys.readouterr().out
    cli._show(df.limit(cli.SHOWN), "markdown")
    assert "Only the first" not in capsys.readouterr().out


def test_generate_refresh_diff_and_watch(spark, tmp_path, capsys):
    src = tmp_path / "t" / "src"
    src.mkdir(parents=True)
    (src / "A.php").write_text("<?php class A extends B {}")
    both = ["--root", str(tmp_path / "t"), "--graph", str(tmp_path / "g")]
    assert "+2/-0 nodes, +1/-0 edges" in run(spark, capsys, "generate", *both) and "up to date" in run(spark, capsys, "generate", *both)
    first = json.loads(run(spark, capsys, "diff", "--graph", str(tmp_path / "g"), "--format", "json"))
    assert {(r["kind"], r["name"]): r["delta"] for r in first} == {("nodes", ""): 2, ("edges", ""): 1, ("type", "class"): 2, ("module", "App"): 1}
    (src / "C.php").write_text("<?php class C extends A {} interface I {}")
    assert "C --[extends]--> A" in run(spark, capsys, "usages", "A", *both)
    assert "No" not in run(spark, capsys, "usages", "A", *both, "--no-refresh")
    again = json.loads(run(spark, capsys, "diff", "--graph", str(tmp_path / "g"), "--format", "json"))
    assert {(r["kind"], r["name"]): (r["delta"], r["status"]) for r in again} == {("nodes", ""): (2, "changed"), ("edges", ""): (1, "changed"), ("type", "class"): (1, "changed"), ("type", "interface"): (1, "new")}
    (src / "C.php").unlink()
    seen = json.loads(run(spark, capsys, "watch", *both, "--rounds", "2", "--interval", "0"))
    assert seen["files_scanned"] == 1 and seen["nodes_removed"] == 2
    numbers = json.loads(run(spark, capsys, "stats", "--graph", str(tmp_path / "g"), "--format", "json"))
    assert (numbers["indexed_files"], numbers["total_nodes"], numbers["live_nodes"], numbers["live_edges"]) == (1, 2, 2, 1)
    assert json.loads(run(spark, capsys, "generate", *both, "--full", "--format", "json"))["files_scanned"] == 1
    with pytest.raises(SystemExit):
        cli.main(["generate", "--root", str(tmp_path / "none"), "--graph", str(tmp_path / "g")], spark)
    with pytest.raises(SystemExit):
        cli.main(["impact", "A", "--graph", str(tmp_path / "g"), "--depth", "0"], spark)
