"""Source trees to graphs: scan, facts, extractors, and the live refresh."""

import datetime as dt
import json

from arbograph.operators import extract
from arbograph.runtime import stored
from arbograph.sources import facts, scan
from arbograph.streaming import watch

PAYLOAD = r"""<?php
namespace Acme\Order;

use Acme\Core\{Bus, Event as Ev};
use Lib\Thing;
use function Lib\helper;

#[AsPublicPayload(path: '/x', methods: ['GET', 'POST'])]
#[RequiresPermission('order.make')]
final class MakeOrderPayload extends Base implements \Countable, Thing
{
    use Shared;
    #[InjectAsReadonly] private ?Bus $bus;
    #[Config(key: 'limit')] public int $n = 1;
    #[InjectAsMutable] public $untyped;

    public function run(Ev $e, int $x, Thing|null $t): Thing
    {
        $this->bus->dispatch(new Done($x));
        $c = new class { public function f(): Thing { return new Other(); } };
        return new Thing();
    }
}
"""
HANDLER = r"""<?php
namespace Acme\Order;

#[AsPayloadHandler(payload: MakeOrderPayload::class, resource: Res::class)]
class MakeOrderHandler {}
#[AsEvent] #[Propagated] class OrderMadeEvent {}
enum Kind: string implements Countable { case A = 'a'; }
"""


def tree(root):
    for path, text in {
        "packages/acme-billing/src/MakeOrderPayload.php": PAYLOAD,
        "packages/acme-billing/src/MakeOrderHandler.php": HANDLER,
        "src/Broken.php": "<?php class {",
        "src/x.generated.php": "<?php",
        "vendor/lib/a.php": "<?php class V {}",
        "tests/fixtures/a.php": "<?php",
        "src/notes.txt": "x",
    }.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    (root / ".graphignore").write_text("# comment\nsrc/old/\n\n*.tmp.php\n")


def test_scan(spark, tmp_path):
    tree(tmp_path)
    ignore = scan.read_ignore_file(spark, str(tmp_path / ".graphignore"))
    assert ignore[-2:] == ("src/old/", "*.tmp.php") and scan.read_ignore_file(spark, str(tmp_path / "none"))[-1] == "*.generated.php"
    files = scan.scan_tree(spark, str(tmp_path), ignore=ignore)
    assert sorted((r.path, r.module) for r in files.collect()) == [("packages/acme-billing/src/MakeOrderHandler.php", "AcmeBilling"), ("packages/acme-billing/src/MakeOrderPayload.php", "AcmeBilling"), ("src/Broken.php", "App")]
    index = spark.createDataFrame([("src/Broken.php", "old"), ("src/Gone.php", "x")], "path string, content_hash string")
    assert sorted(map(tuple, scan.classify(files, index).collect())) == [("packages/acme-billing/src/MakeOrderHandler.php", "added"), ("packages/acme-billing/src/MakeOrderPayload.php", "added"), ("src/Broken.php", "modified"), ("src/Gone.php", "deleted")]


def test_extract(spark, tmp_path):
    tree(tmp_path)
    files = scan.scan_tree(spark, str(tmp_path)).withColumnRenamed("path", "file")
    rows = stored(facts.file_facts(files), "facts")
    assert [r.file for r in rows.filter("kind = 'error'").collect()] == ["src/Broken.php"]
    g = extract.extract(rows)
    edges = {tuple(r) for r in g.edges.select("source_id", "type", "target_id").collect()}
    p, h = "class:Acme\\Order\\MakeOrderPayload", "class:Acme\\Order\\MakeOrderHandler"
    own = "class:Acme\\Order\\"
    assert edges >= {
        (p, "extends", own + "Base"), (p, "implements", "class:Countable"), (p, "implements", "class:Lib\\Thing"), (p, "uses", own + "Shared"), (p, "composed_of", own + "Shared"),
        (p, "imports", "class:Acme\\Core\\Bus"), (p, "imports", "class:Acme\\Core\\Event"), (p, "serves_route", "route:GET:/x"), (p, "serves_route", "route:POST:/x"), (p, "requires_permission", "permission:order.make"),
        (p, "injects_readonly", "class:Acme\\Core\\Bus"), (p, "injects_mutable", "unknown:untyped"), (p, "injects_config", "config:limit"), (p, "emits", own + "Done"), (p, "instantiates", "class:Lib\\Thing"),
        (p, "accepts", "class:Acme\\Core\\Event"), (p, "returns", "class:Lib\\Thing"), (h, "handles", p), (h, "produces", own + "Res"), (p, "participates_in_flow", "flow:MakeOrderFlow"), (h, "participates_in_flow", "flow:MakeOrderFlow"),
        (own + "OrderMadeEvent", "publishes_to", "subject:app.events.{node}.order.order_made"), (own + "Kind", "implements", own + "Countable"), (p, "belongs_to_domain", "domain:Billing"),
    }
    assert not any(t == "imports" and d == "class:Lib\\helper" for _, t, d in edges)
    nodes = {r.id: r for r in g.nodes.collect()}
    assert nodes[p].type == "payload" and nodes[h].type == "handler" and nodes[own + "Res"].type == "resource" and nodes[own + "Kind"].type == "enum"
    assert json.loads(nodes[p].metadata) == {"path": "/x", "methods": ["GET", "POST"], "produces": ["text/html"], "accessType": "public", "final": True} and nodes[p].line == 10 and nodes[p].module == "AcmeBilling"
    assert nodes["class:Lib\\Thing"].is_placeholder and all(t in nodes for _, _, t in edges)
    scan.write_graph(g.nodes, g.edges, str(tmp_path / "out"))
    back = scan.read_graph(spark, str(tmp_path / "out"))
    assert back[0].count() == len(nodes) and back[1].count() == len(edges)


def test_the_whole_graph_of_two_files(spark):
    """Every node and edge, literally."""
    rows = [("packages/acme-billing/src/P.php", PAYLOAD), ("packages/acme-billing/src/H.php", HANDLER)]
    g = extract.extract(facts.file_facts(spark.createDataFrame(rows, "file string, content string")))
    o, p, h = "class:Acme\\Order\\", "P.php", "H.php"
    subject = "subject:app.events.{node}.order.order_made"
    assert {(r.id, r.type, r.file.rpartition("/")[2], r.line, r.end_line) for r in g.nodes.filter("NOT is_placeholder").collect()} == {
        (o + "MakeOrderPayload", "payload", p, 10, 23), (o + "MakeOrderHandler", "handler", h, 5, 5), (o + "Res", "resource", h, 5, 5), (o + "OrderMadeEvent", "event", h, 6, 6), (o + "Kind", "enum", h, 7, 7),
        ("route:GET:/x", "route", p, 10, 10), ("route:POST:/x", "route", p, 10, 10), ("domain:Billing", "domain_context", h, 1, 1), ("flow:MakeOrderFlow", "execution_flow", p, 10, 23), (subject, "nats_subject", h, 6, 6),
        ("doc:" + o + "MakeOrderPayload", "doc_node", p, 1, 1), ("doc:" + o + "MakeOrderHandler", "doc_node", h, 1, 1), ("doc:" + o + "OrderMadeEvent", "doc_node", h, 1, 1),
    }
    assert {(r.id, r.fqcn, r.name, r.type) for r in g.nodes.filter("is_placeholder").collect()} == {(i, i.partition(":")[2], i.partition(":")[2].rpartition("\\")[2], "class") for i in ("class:Acme\\Core\\Bus", "class:Acme\\Core\\Event", o + "Base", o + "Countable", o + "Done", o + "Other", o + "Shared", "class:Countable", "class:Lib\\Thing", "config:limit", "permission:order.make", "unknown:untyped")}
    pay, han, eve, kind = (o + x for x in ("MakeOrderPayload", "MakeOrderHandler", "OrderMadeEvent", "Kind"))
    expected = {
        (kind, o + "Countable", "implements", "{}"), (kind, "domain:Billing", "belongs_to_domain", "{}"),
        (han, pay, "handles", '{"execution":"sync"}'), (han, o + "Res", "produces", "{}"), (han, "doc:" + han, "intent_for", '{"confidence":0.85}'), (han, "domain:Billing", "belongs_to_domain", "{}"), (han, "flow:MakeOrderFlow", "participates_in_flow", '{"role":"handler","execution":"sync"}'),
        (pay, "class:Acme\\Core\\Bus", "imports", "{}"), (pay, "class:Acme\\Core\\Event", "imports", "{}"), (pay, "class:Lib\\Thing", "imports", "{}"), (pay, "class:Acme\\Core\\Bus", "injects_readonly", '{"property":"bus"}'), (pay, "class:Acme\\Core\\Event", "accepts", '{"param":"e"}'),
        (pay, o + "Base", "extends", "{}"), (pay, "class:Countable", "implements", "{}"), (pay, "class:Lib\\Thing", "implements", "{}"), (pay, o + "Done", "emits", "{}"), (pay, o + "Done", "instantiates", "{}"), (pay, o + "Other", "instantiates", "{}"), (pay, "class:Lib\\Thing", "instantiates", "{}"),
        (pay, "class:Lib\\Thing", "returns", "{}"), (pay, o + "Shared", "uses", "{}"), (pay, o + "Shared", "composed_of", "{}"), (pay, "config:limit", "injects_config", '{"property":"n"}'), (pay, "unknown:untyped", "injects_mutable", '{"property":"untyped"}'),
        (pay, "doc:" + pay, "intent_for", '{"confidence":0.85}'), (pay, "domain:Billing", "belongs_to_domain", "{}"), (pay, "flow:MakeOrderFlow", "participates_in_flow", '{"role":"entry"}'), (pay, "permission:order.make", "requires_permission", '{"slug":"order.make"}'), (pay, "route:GET:/x", "serves_route", "{}"), (pay, "route:POST:/x", "serves_route", "{}"),
        (eve, "doc:" + eve, "intent_for", '{"confidence":0.85}'), (eve, "domain:Billing", "belongs_to_domain", "{}"), (eve, subject, "publishes_to", '{"domain":"order","event_type":"order_made"}'),
    }
    assert set(map(tuple, g.edges.collect())) == expected and g.edges.count() == len(expected)


ATTRIBUTES = r"""<?php
namespace Shop\Auth\Event;

#[AsEventListener(event: PaidEvent::class, execution: 'queued')] class OnPaid {}
#[AsService] #[SatisfiesServiceContract(of: PayContract::class)] class PayService extends Kit implements A, B, C, D { use T, U, V; }
#[FromTable('bills')] #[SoftDelete] #[TenantScoped] class BillEntity { #[HasMany(target: Line::class)] private array $lines; #[BelongsTo] private User $user; }
#[AsAuthHandler(priority: 7)] #[AsPublicPayload(path: '/in')] class LoginHandler {}
#[AsSlotHandler('head')] #[AsLayoutSlot] #[AsDeferred] class HeadSlot {}
#[AsScheduledJob(cron: '* * * * *')] class Nightly {}
#[AsPipelineListener] #[AsServerLifecycleListener] class Warm {}
#[AsCommand(name: 'make:bill', description: 'Bills')] #[CapabilityHint(useWhen: 'billing')] class MakeBill {}
#[Propagated(domain: 'pay')] #[OwnedAggregate(type: 'bill', idField: 'id', creates: true)] class PaidEvent {}
#[AsAggregateCommand(aggregateType: 'bill', aggregateIdField: 'id')] class PayBill {}
#[TenantIsolated] #[AsTenantLayerStrategy] class Layered {}
"""


def test_metadata_and_flags(spark):
    g = extract.extract(facts.file_facts(spark.createDataFrame([("packages/shop/src/All.php", ATTRIBUTES)], "file string, content string")))
    node = {r.id.rpartition("\\")[2]: (r.type, json.loads(r.metadata)) for r in g.nodes.filter("NOT is_placeholder AND (id LIKE 'class:%' OR id LIKE 'hotspot:%')").collect() if r.id.startswith("class:")}
    assert node["OnPaid"] == ("event_listener", {"eventClass": "Shop\\Auth\\Event\\PaidEvent", "executionMode": "queued"})
    assert node["PayService"] == ("service", {"scope": "worker"}) and node["BillEntity"] == ("entity", {"table": "bills", "softDelete": True})
    assert node["HeadSlot"] == ("slot_handler", {"slot": "head", "deferred": True}) and node["Nightly"] == ("job", {"cron": "* * * * *"}) and node["Warm"] == ("pipeline_phase", {"phase": "default", "lifecycleHook": True})
    assert node["MakeBill"] == ("command", {"commandName": "make:bill", "description": "Bills", "attributes": {"name": "Shop\\Auth\\Event\\CapabilityHint", "args": {"useWhen": "billing"}, "target": "class"}})
    assert node["LoginHandler"][1]["priority"] == 7 and node["LoginHandler"][1]["accessType"] == "public" and node["Layered"] == ("class", {})
    edges = {(r.source_id.rpartition("\\")[2], r.type, r.target_id.rpartition("\\")[2]): json.loads(r.metadata) for r in g.edges.collect()}
    assert edges["BillEntity", "has_relation", "Line"] == {"property": "lines", "relationType": "hasMany"} and ("BillEntity", "has_relation", "User") not in edges
    assert edges["BillEntity", "tenant_isolated", "constraint:tenant"] == {} and edges["Layered", "tenant_isolated", "constraint:default"] == {"constraint": "default"} and edges["HeadSlot", "renders_slot", "slot:head"] == {"layout": True}
    assert edges["PayService", "satisfies_contract", "PayContract"] == {"contractType": "service"} and edges["LoginHandler", "authenticates", "auth:handler"] == {} and edges["Warm", "pipeline_phase", "pipeline:default"] == {"phase": "default"}
    assert edges["PaidEvent", "is_aggregate_of", "aggregate:bill"] == {"role": "creation_event"} and edges["PayBill", "routes_command_to", "subject:app.commands.bill.{ownerNode}"] == {"aggregate_type": "bill", "id_field": "id"}
    assert edges["PaidEvent", "publishes_to", "subject:app.events.{node}.pay.paid"] == {"domain": "pay", "event_type": "paid"}
    all_ = {r.id: json.loads(r.metadata) for r in g.nodes.filter("NOT is_placeholder").collect()}
    spot = all_["hotspot:Shop\\Auth\\Event\\PayService"]
    # 0.15 for the ending, 0.05 for the parent, 0.1 for four interfaces, 0.05 for three traits, 0.1 for each of two attributes.
    assert (spot["risk_score"], spot["complexity_score"], spot["incoming_edges"], spot["recommendation"]) == (0.55, 0.75, 8, "High trait usage — consider composition over inheritance")
    assert all_["doc:class:Shop\\Auth\\Event\\OnPaid"]["purpose"] == "Domain event" and all_["doc:class:Shop\\Auth\\Event\\PayService"] == {"target_node_id": "class:Shop\\Auth\\Event\\PayService", "purpose": "Service contract interface", "responsibilities": ["Define service interface", "Enable dependency inversion", "Allow multiple implementations"], "inferred_from": ["class_name_suffix", "SatisfiesServiceContract_attribute"], "confidence": 0.8, "source": "inference"}
    assert all_["domain:Shop"]["key_entities"] == ["BillEntity"] and all_["domain:Shop"]["criticality"] == "high" and all_["aggregate:bill"] == {"aggregate_type": "bill", "id_field": "id", "creates_event": "Shop\\Auth\\Event\\PaidEvent"}


def test_extract_nothing(spark):
    none = spark.createDataFrame([("a.php", None), (None, "<?php"), ("b.php", "")], "file string, content string")
    g = extract.extract(facts.file_facts(none))
    assert g.nodes.count() == 0 and g.edges.count() == 0


FEED = "seq long, node_id string, file string, op string, content_hash string, changed_at timestamp_ntz, arrived_at timestamp_ntz"


def test_watch_folds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(watch, "FOLD", 2)
    t = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([(i, f"n{i % 4}", "f", "delete" if i == 9 else "upsert", f"h{i}", t + dt.timedelta(hours=i), t) for i in range(10)], FEED)
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for n in range(5):
        df.filter(f"seq DIV 2 = {n}").coalesce(1).write.mode("append").parquet(source)
        watch.watch(spark, source, df.schema, target, checkpoint).awaitTermination()
        assert sorted(map(tuple, watch.watched_state(spark, target, n).collect())) == sorted(map(tuple, watch.current_state(df.filter(f"seq < {2 * n + 2}")).collect()))


def test_watch_equals_batch(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    feed = [(i, f"n{i * 7 % 10}", "f", "delete" if i % 4 == 0 else "upsert", None if i % 9 == 0 else f"h{i % 3}", t + dt.timedelta(hours=i * 5 % 13), t) for i in range(60)]
    df = spark.createDataFrame(feed, FEED)
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    df.filter("seq < 30").coalesce(1).write.parquet(source)
    watch.watch(spark, source, df.schema, target, checkpoint).awaitTermination()
    df.filter("seq >= 30").coalesce(1).write.mode("append").parquet(source)
    watch.watch(spark, source, df.schema, target, checkpoint).awaitTermination()
    got = sorted(map(tuple, watch.watched_state(spark, target, 1).collect()))
    assert got == sorted(map(tuple, watch.current_state(df).collect())) and got
