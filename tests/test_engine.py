"""End to end on a small project: extraction, resolution, graph queries, tools, snapshots."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestar.engine import Engine
from lodestar.operators import paths

P = "sample_project/"
CHECKOUT = P + "services/order_service.py#checkout_order"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    snap = str(tmp_path_factory.mktemp("snap"))
    e = Engine.scan(spark, str(Path(__file__).parent / "sample_project"), snap)
    e.snap = snap
    return e


def test_symbols(engine):
    rows = {r["id"]: r for r in engine.symbols.collect()}
    own = [i for i in rows if i.startswith(P + "models.py")]
    assert sum(rows[i]["kind"] == "class" for i in own) == 3 and len(own) == 9
    calc = rows[P + "utils/calculator.py#calculate_discount"]
    assert calc["summary"] == "Lower a price." and calc["return_type"] == "float"
    assert [(p["name"], p["type_hint"], p["default_value"]) for p in calc["parameters"]] == [("price", "float", None), ("rate", "float", "0.1")]
    checkout = rows[CHECKOUT]
    assert [p["name"] for p in checkout["parameters"]] == ["email", "price"] and checkout["return_type"] == "dict"
    assert rows[P + "models.py#User.validate_email"]["return_type"] == "bool"


def test_edges(engine):
    got = {(r["source"].removeprefix(P), r["kind"], r["target"].removeprefix(P)) for r in engine.edges.collect()}
    s, m, u = "services/order_service.py#checkout_order", "models.py#", "utils/calculator.py#"
    pay = "services/payment_service.py#"
    want = {
        (m + "User", "contains", m + "User.validate_email"),
        (m + "Order", "contains", m + "Order.mark_as_paid"),
        (m + "BaseEntity", "contains", m + "BaseEntity.get_id"),
        (m + "User", "inherits", m + "BaseEntity"),
        (m + "Order", "inherits", m + "BaseEntity"),
        (s, "instantiates", m + "User"),
        (s, "instantiates", m + "Order"),
        (pay + "process_checkout_payment", "instantiates", pay + "PaymentProcessor"),
        ("main.py#start_application", "calls", s),
        (s, "calls", u + "calculate_discount"),
        (s, "calls", pay + "process_checkout_payment"),
        (s, "calls", m + "User.validate_email"),
        (s, "calls", m + "Order.mark_as_paid"),
        (s, "calls", m + "BaseEntity.get_id"),
        (m + "User.__init__", "calls", m + "BaseEntity.__init__"),
        (pay + "PaymentProcessor.execute_payment", "calls", u + "calculate_tax"),
    }
    assert want <= got, want - got


def test_call_sites_and_pipeline(engine):
    calls = {r["callee_name"] for r in engine.tables["call_sites"].where(F.col("caller_id") == CHECKOUT).collect()}
    assert calls == {"User", "user.validate_email", "calculate_discount", "Order", "process_checkout_payment", "order.mark_as_paid", "order.get_id"}
    steps = engine.tables["pipeline_steps"].collect()
    assert [(r["step"], r["callee_name"]) for r in steps] == [(1, "start_application")]


def test_dead_code(engine):
    dead = {r["name"] for r in engine.dead().collect()}
    assert {"unused_legacy_formula", "abandoned_backup_cron", "deactivate"} <= dead
    assert not dead & {"checkout_order", "calculate_tax", "start_application", "__init__"}


def test_paths(engine):
    way = paths.find_path(engine.symbols, engine.edges, P + "main.py#start_application", P + "utils/calculator.py#calculate_tax").first()
    assert way["found"] and way["total_hops"] >= 2 and len(way["node_ids"]) == way["total_hops"] + 1
    none = paths.find_path(engine.symbols, engine.edges, P + "main.py#abandoned_backup_cron", P + "utils/calculator.py#calculate_tax").first()
    assert not none["found"]
    cheap = paths.find_path(engine.symbols, engine.edges, P + "main.py#start_application", P + "utils/calculator.py#calculate_tax", algorithm="dijkstra").first()
    assert cheap["found"] and cheap["total_cost"] <= way["total_cost"] + 1e-9


def test_search(engine):
    assert CHECKOUT in {r["id"] for r in engine.search("in:float out:dict").collect()}
    assert engine.search("calculate_tax").first()["score"] == 100


def test_server(engine):
    server = engine.server(model=lambda prompts: [p.upper() for p in prompts])
    ask = lambda method, **params: server.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    call = lambda name, **args: json.loads(ask("tools/call", name=name, arguments=args)["result"]["content"][0]["text"])
    assert ask("initialize", protocolVersion="x")["result"]["protocolVersion"] == "x"
    assert ask("ping")["result"] == {} and len(ask("tools/list")["result"]["tools"]) == 6
    assert ask("nothing")["error"]["code"] == -32601
    assert server.handle({"jsonrpc": "2.0", "method": "notifications/initialized"}) is None
    context = call("get_symbol_context", symbolId=CHECKOUT)
    assert len(context["callers"]) >= 1 and len(context["callees"]) >= 5
    trace = call("trace_call_path", fromSymbol=P + "main.py#start_application", toSymbol=P + "utils/calculator.py#calculate_tax")
    assert trace["found"] and len(trace["steps"]) == trace["totalHops"] + 1
    assert call("search_codebase_symbols", query="order")["totalMatches"] > 0
    assert call("get_dead_code_report", limit=1)["totalCandidates"] > 1
    assert call("call_local_llm", prompt="a")["response"] == "A"
    assert [r["output"] for r in call("batch_local_llm", prompts=["a", "b", "c", "d"])["results"]] == ["A", "B", "C", "D"]
    assert "error" in call("no_such_tool") and "error" in call("get_symbol_context", symbolId="x")
    lines = list(server.serve(["", "{bad", json.dumps({"jsonrpc": "2.0", "id": 2, "method": "ping"})]))
    assert [json.loads(x).get("error", {}).get("code") for x in lines] == [-32700, None]


def test_warm_start(engine, spark):
    again = Engine.scan(spark, str(Path(__file__).parent / "sample_project"), engine.snap)
    assert {r["id"] for r in again.edges.collect()} == {r["id"] for r in engine.edges.collect()}


def test_tree_and_macro(engine):
    tree = {r["id"]: r for r in engine.tree().collect()}
    assert tree["file:" + P + "main.py"]["parent_id"] == "folder:sample_project"
    assert tree["folder:sample_project/utils"]["kind"] == "folder"
    unit, found = engine.macro_graph()
    assert unit == "file" and found.count() > 3
