"""The tool server as a process, over a pipe."""

import json
import os
import subprocess
import sys
import threading
import time
from pathlib import Path

from lodestar.operators.tools import Server
from lodestar.server import Loop

ROOT = Path(__file__).resolve().parents[1]
P = "sample_project/"


def test_protocol_over_a_pipe(tmp_path):
    conf = tmp_path / "conf"
    conf.mkdir()
    (conf / "spark-defaults.conf").write_text(f"spark.master local[2]\nspark.sql.shuffle.partitions 2\nspark.ui.enabled false\nspark.checkpoint.dir {tmp_path}/shared\nspark.sql.warehouse.dir {tmp_path}/warehouse\n")
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}", "SPARK_LOCAL_IP": "127.0.0.1"}
    call = lambda i, name, **args: {"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": args}}
    requests = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": "two", "method": "ping"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/list"},
        call(4, "get_symbol_context", symbolId=P + "services/order_service.py#checkout_order"),
        call(5, "trace_call_path", fromSymbol=P + "main.py#start_application", toSymbol=P + "utils/calculator.py#calculate_tax"),
        call(6, "trace_call_path", fromSymbol=P + "main.py#abandoned_backup_cron", toSymbol=P + "utils/calculator.py#calculate_tax"),
        call(7, "get_dead_code_report", limit=2),
        call(8, "no_such_tool"),
        {"jsonrpc": "2.0", "id": 9, "method": "no/method"},
        call(10, "search_codebase_symbols", query="order"),
    ]
    lines = [json.dumps(r) for r in requests]
    text = "\n".join([*lines[:3], "", "{not json", "[1]", *lines[3:]]) + "\n"
    done = subprocess.run([sys.executable, "-m", "lodestar.server", str(ROOT / "tests/sample_project")], input=text, capture_output=True, text=True, env=env, cwd=tmp_path, timeout=400)
    answers = [json.loads(x) for x in done.stdout.splitlines()]
    by_id = {a["id"]: a for a in answers if a["id"] is not None}
    said = lambda i: json.loads(by_id[i]["result"]["content"][0]["text"])
    assert sorted(a["error"]["code"] for a in answers if a["id"] is None) == [-32700, -32600]
    assert set(by_id) == {1, "two", *range(3, 11)} and len(answers) == 12
    assert by_id[1]["result"]["protocolVersion"] == "2024-11-05" and by_id["two"]["result"] == {}
    assert len(by_id[3]["result"]["tools"]) == 6
    context = said(4)
    assert context["totalCallers"] == len(context["callers"]) >= 1 and context["totalCallees"] == len(context["callees"]) >= 5
    assert said(5)["found"] and len(said(5)["steps"]) == said(5)["totalHops"] + 1 >= 3
    assert not said(6)["found"] and len(said(7)["candidates"]) == 2 and said(10)["totalMatches"] > 0
    assert by_id[8]["result"]["isError"] and by_id[9]["error"]["code"] == -32601


class Stub(Server):
    """Slow on one request; the Spark job of another never ends by itself."""

    def handle(self, request):
        if request["method"] == "slow":
            time.sleep(3)
        if request["method"] == "fail":
            raise ValueError("broken")
        if request["method"] == "endless":
            self.nodes.sparkSession.range(8).rdd.foreach(lambda _: time.sleep(300))
        return {"jsonrpc": "2.0", "id": request["id"], "result": request["method"]}


def test_answers_come_as_they_are_done_and_requests_can_be_cancelled(spark):
    out, began = [], time.monotonic()
    nodes = spark.range(0).selectExpr("cast(id as string) id")
    loop = Loop(Stub(nodes, nodes), out.append, workers=3)

    def lines():
        for i, method in enumerate(["endless", "slow", "quick", "fail"]):
            yield json.dumps({"jsonrpc": "2.0", "id": i, "method": method})
        time.sleep(5)
        yield json.dumps({"jsonrpc": "2.0", "method": "notifications/cancelled", "params": {"requestId": 0}})

    runner = threading.Thread(target=loop.serve, args=(lines(),))
    runner.start()
    runner.join(60)
    assert not runner.is_alive() and time.monotonic() - began < 60
    got = [json.loads(x) for x in out]
    assert [a["id"] for a in got if "result" in a] == [2, 1]
    assert [(a["id"], a["error"]["code"]) for a in got if "error" in a] == [(3, -32603)]
