"""Model calls with deadlines, folds of bounded width, tree numbers, and the analysis job."""

import datetime as dt
import itertools
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestar.operators import batch, calls, enrich, folds, preorder, ranges, rollup, tools
from lodestar.sources import reports
from lodestar.sources.store import SummaryStore


def test_a_hanging_call_costs_its_timeout_and_only_its_item():
    def model(prompts):
        if prompts[0] == "hang":
            time.sleep(30)
        if prompts[0] == "fail":
            raise ValueError("no")
        return [prompts[0].upper()]

    began = time.monotonic()
    got = calls.pooled(model, ["a", "hang", "b", "fail", "c", "hang", "d"], calls.Config(timeout_s=1, concurrency=3))
    assert [a for a, _ in got] == ["A", None, "B", None, "C", None, "D"]
    assert [bool(e) for _, e in got] == [False, True, False, True, False, True, False]
    assert time.monotonic() - began < 4
    assert calls.pooled(model, []) == []


def test_never_more_calls_than_the_pool_allows():
    running, most, lock = 0, 0, threading.Lock()

    def model(prompts):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.05)
        with lock:
            running -= 1
        return prompts

    calls.pooled(model, [str(i) for i in range(12)], calls.Config(concurrency=3))
    assert most == 3


def test_retry_and_fallback():
    tries = itertools.count()

    def shaky(prompts):
        if next(tries) < 2:
            raise OSError("busy")
        return ["at last"]

    assert calls.pooled(shaky, ["x"], calls.Config(retries=2)) == [("at last", None)]

    def elsewhere(prompts):
        raise calls.NotServed("404")

    assert calls.pooled(elsewhere, ["x"], fallback=lambda p: ["native"]) == [("native", None)]
    assert calls.pooled(elsewhere, ["x"])[0][0] is None


def test_endpoints_and_config():
    seen = []

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers.get("Authorization")))
            code, answer = (200, {"response": "native " + body["prompt"]}) if self.path == "/api/generate" else (404, {}) if body.get("model") == "old" else (200, {"choices": [{"message": {"content": "chat " + body["messages"][-1]["content"]}}]})
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        config = calls.Config().updated(endpoint=f"http://127.0.0.1:{server.server_port}/v1/", model=" new ", api_key="k", timeout_s=5)
        assert calls.pooled(calls.chat_model(config, "Be brief."), ["p"], config, calls.native_model(config)) == [("chat p", None)]
        path, body, key = seen[-1]
        assert path == "/v1/chat/completions" and body["model"] == "new" and body["temperature"] == 0.2 and key == "Bearer k" and body["messages"][0]["content"] == "Be brief."
        old = config.updated(model="old")
        assert calls.pooled(calls.chat_model(old), ["p"], old, calls.native_model(old)) == [("native p", None)]
        assert calls.Config().updated(model=None).model == "" and config.updated(retries=0) == config
    finally:
        server.shutdown()


def test_batch_tool_keeps_errors_apart(spark):
    def model(prompts):
        if prompts[0] == "b":
            raise ValueError("bad one")
        return [prompts[0] * 2]

    rows = spark.createDataFrame(list(enumerate("abc")), "index long, prompt string")
    assert [tuple(r) for r in tools.run_batch(rows, model).orderBy("index").collect()] == [(0, "aa", None), (1, None, "bad one"), (2, "cc", None)]


def test_prefix_sums(spark):
    rows = [(i * 7919 % 1000, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, w int").repartition(7)
    got = {r["k"]: r["before"] for r in ranges.prefix_sums(df, ["k"], F.col("w"), "before", "t").collect()}
    total, want = 0, {}
    for k, w in sorted(rows):
        want[k], total = total, total + w
    assert got == want
    assert ranges.prefix_sums(df.limit(0), ["k"], F.col("w"), "before", "t").count() == 0


def test_folds_of_a_wide_folder(spark):
    """2,000 texts of one key and a few of others: no row passes the limit, every text is seen once."""
    rows = spark.range(2000).selectExpr("'wide' key", "lpad(id, 5, '0') ord", "concat('t', id, repeat('x', cast(id % 90 as int))) text")
    few = spark.createDataFrame([("a", "1", "one"), ("a", "2", None), (None, "1", "nobody's")], "key string, ord string, text string")
    both = rows.unionByName(few)
    parts = folds.chunked(both, limit=500, piece=80)
    assert parts.agg(F.max(F.length("text"))).first()[0] <= 500
    assert parts.agg(F.sum("n")).first()[0] == 2003
    order = [t for r in parts.where("key = 'wide'").orderBy("chunk").collect() for t in r["text"].split("\n")]
    assert [t.split("x")[0] for t in order] == [f"t{i}" for i in range(2000)]
    widest = []

    def answer(chunks):
        widest.append(chunks.agg(F.max(F.length("text"))).first()[0])
        return chunks.select("key", "chunk", "m", F.concat(F.lit("n"), F.size(F.split("text", "\n")).cast("string")).alias("text"))

    got = {r["key"]: r["text"] for r in folds.folded(both, answer, limit=500, piece=80).collect()}
    assert got["a"] == "n2" and got[None] == "n1" and got["wide"].startswith("n")
    assert len(widest) >= 2 and max(widest) <= 500
    with pytest.raises(ValueError, match="limit"):
        folds.chunked(both, 100, 80)


def test_report_of_a_wide_module(spark):
    symbols = spark.range(3000).selectExpr("concat('s', lpad(id, 5, '0')) name", "'function' kind", "'m' module")
    parts = reports.section_parts(symbols, F.col("module"), 400, 100).orderBy("chunk").collect()
    assert max(len(r["text"]) for r in parts) <= 400
    assert "\n".join(r["text"] for r in parts) == reports.sections(symbols, F.col("module")).first()["body"]


def test_tree_numbers(spark):
    paths = ["b/x.py", "a/z/deep.py", "a/y.py", "a.py", "b-c/q.py", "a/z.py", "b/x/in.py"]
    symbols = spark.createDataFrame([(f"{p}#f", "f", "function", p, None, False) for p in paths], "id string, name string, kind string, file_path string, parent_class_id string, is_dead boolean")
    numbered = preorder.number_tree(rollup.tree_nodes(symbols))
    rows = sorted((r["pre"], r["last"], r["kind"], r["path"]) for r in numbered.collect())
    assert [(p, k) for _, _, k, p in rows] == [("a", "folder"), ("a/z", "folder"), ("a/z/deep.py", "file"), ("a/y.py", "file"), ("a/z.py", "file"), ("b", "folder"), ("b/x", "folder"), ("b/x/in.py", "file"), ("b/x.py", "file"), ("b-c", "folder"), ("b-c/q.py", "file"), ("a.py", "file")]
    assert [r[0] for r in rows] == list(range(12))
    assert {p: last for _, last, k, p in rows if k == "folder"} == {"a": 4, "a/z": 2, "b": 8, "b/x": 7, "b-c": 10}
    assert sorted(r["path"] for r in preorder.members(numbered, "a").collect()) == ["a/y.py", "a/z.py", "a/z/deep.py"]


FILES = "file_path string, content string"
SYMBOLS = "id string, name string, kind string, file_path string, start_line int, end_line int"


@pytest.fixture
def project(spark, tmp_path):
    files = spark.createDataFrame([(f"src/d{i % 3}/f{i}.py", f"def g{i}():\n    return {i}\n") for i in range(12)], FILES)
    symbols = spark.createDataFrame([(f"src/d{i % 3}/f{i}.py#g{i}", f"g{i}", "function", f"src/d{i % 3}/f{i}.py", 1, 2) for i in range(12)], SYMBOLS)
    log = tmp_path / "asked"
    log.write_text("")

    def model(prompts):
        with log.open("a") as f:
            f.write("".join(json.dumps(p) + "\n" for p in prompts))
        return [f"about {p.split(':')[0][-30:]}" for p in prompts]

    clock = itertools.count()
    tick = lambda: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=next(clock))
    summaries = SummaryStore(spark, str(tmp_path / "sums"), tick)
    make = lambda m=model, **more: batch.AnalysisJob(spark, str(tmp_path / "job"), files, symbols, summaries, m, round_items=5, clock=tick, **more)
    return make, summaries, lambda: [json.loads(x) for x in log.read_text().splitlines()], files


def state(job):
    return {r["level"]: tuple(r)[1:] for r in job.progress().collect()}


def test_job_cancelled_halfway_and_resumed_asks_nothing_twice(project):
    make, summaries, asked, files = project
    job = make()
    assert state(job) == {"file": (0, 0, 0, 0), "symbol": (0, 0, 0, 0), "all": (0, 0, 0, 0)}
    job.plan()
    assert state(job)["all"] == (24, 0, 0, 0)
    rounds = itertools.count(1)
    assert not job.run(lambda: job.cancel() if next(rounds) == 3 else None)
    assert state(job)["all"] == (24, 12 + 0, 0, 50) or 24 > state(job)["all"][1] > 0
    again = make()
    again.plan()
    assert again.run()
    assert state(again) == {"file": (12, 12, 0, 100), "symbol": (12, 12, 0, 100), "all": (24, 24, 0, 100)}
    about = [p for p in asked() if p.startswith(("Summarise the file", "Summarise the symbol"))]
    assert len(about) == len(set(about)) == 24
    assert summaries.get("folder").count() == 3 and summaries.get("project").count() == 1
    # what is known isn't asked again
    before = len(asked())
    third = batch.AnalysisJob(files.sparkSession, again.items.path + "-new", files, again.symbols, summaries, again.model)
    third.plan()
    assert state(third)["all"] == (0, 0, 0, 0) and len(asked()) == before


def test_rounds_of_a_level_read_the_store_once(project, monkeypatch):
    make, _, asked, _ = project
    job = make()
    job.plan()
    loads, load = [], job.items.load
    monkeypatch.setattr(job.items, "load", lambda: loads.append(1) or load())
    # three rounds of files, and none of symbols
    assert not job.run(lambda: job.left or job.cancel())
    assert len(loads) == 1 and len(asked()) == 12
    assert state(job) == {"file": (12, 12, 0, 100), "symbol": (12, 0, 0, 0), "all": (24, 12, 0, 50)}


def test_job_broken_off_at_once(project):
    make, _, asked, _ = project

    def slow(prompts):
        time.sleep(60)
        return prompts

    job = make(slow)
    job.plan("folder", "src/d1")
    runner = threading.Thread(target=job.run)
    runner.start()
    time.sleep(6)
    began = time.monotonic()
    job.cancel(now=True)
    runner.join(40)
    assert not runner.is_alive() and time.monotonic() - began < 40
    assert state(job)["all"] == (8, 0, 0, 0)
    again = make()
    assert again.run() and state(again)["all"] == (8, 8, 0, 100)
    assert len([p for p in asked() if p.startswith("Summarise the")]) == 8


def test_scopes_and_failures(project):
    make, summaries, asked, _ = project

    def model(prompts):
        if "f4" in prompts[0]:
            raise ValueError("not this one")
        return ["fine"]

    job = make(model)
    job.plan("file", "src/d1/f4.py")
    job.plan("symbol", "src/d2/f5.py#g5")
    assert state(job)["all"] == (3, 0, 0, 0)
    job.run()
    assert state(job) == {"file": (1, 0, 1, 100), "symbol": (2, 2, 0, 100), "all": (3, 2, 1, 100)}
    assert {r["symbol"] for r in summaries.get("symbol").collect()} == {"src/d1/f4.py#g4", "src/d2/f5.py#g5"}
    assert "not this one" in job.items.load().where("state = 'failed'").first()["error"]


def test_short_rounds_go_several_to_a_spark_job(project):
    """Twelve rounds of one file each are told of, but they and those of symbols are few Spark jobs."""
    make, summaries, asked, _ = project
    job = make()
    job.round_items = 1
    job.plan()
    told = []
    assert job.run(lambda: told.append(job.left))
    assert told[:24] == [*range(11, -1, -1)] * 2
    # the plan, folders and project, and a commit for each lot
    assert len(job.items.manifest()) <= 3 + 8
    assert state(job)["all"] == (24, 24, 0, 100) and len([p for p in asked() if p.startswith("Summarise the")]) == 24
    assert summaries.get("file").count() == summaries.get("symbol").count() == 12


def test_broken_off_lot_keeps_what_its_tasks_answered(project):
    """One file hangs: only its task's files are asked again."""
    make, _, asked, _ = project
    answer = make().model

    def slow(prompts):
        if "/f4.py" in prompts[0]:
            time.sleep(60)
        return answer(prompts)

    job = make(slow)
    job.round_items = 12
    job.plan()
    runner = threading.Thread(target=job.run)
    runner.start()
    deadline = time.monotonic() + 60
    while len(asked()) < 11 and time.monotonic() < deadline:
        time.sleep(0.2)
    time.sleep(3)
    job.cancel(now=True)
    runner.join(40)
    total, done, failed, _ = state(job)["file"]
    assert not runner.is_alive() and total == 12 and 12 - 12 // 4 - 1 <= done < 12 and failed == 0
    again = make()
    assert again.run() and state(again)["all"] == (24, 24, 0, 100)
    asks = [p for p in asked() if p.startswith("Summarise the file")]
    assert len(set(asks)) == 12 and len(asks) <= 12 + (12 - done) - 1


def test_lot_whose_driver_ended_is_settled_by_the_next_job(project):
    make, summaries, asked, _ = project
    job = make()
    job.plan()
    job.settle_lot = lambda *_: (_ for _ in ()).throw(KeyboardInterrupt)
    with pytest.raises(KeyboardInterrupt):
        job.run()
    assert state(job)["file"] == (12, 0, 0, 0) and len(asked()) == 5
    again = make()
    assert not again.run(again.cancel)
    assert state(again)["file"][1] == 10 == summaries.get("file").count()
    assert again.run() and state(again)["all"] == (24, 24, 0, 100)
    asks = [p for p in asked() if p.startswith("Summarise the file")]
    assert len(asks) == len(set(asks)) == 12


def test_calls_share_their_threads():
    threads = set()

    def model(prompts):
        threads.add(threading.current_thread())
        if prompts[0] == "hang":
            time.sleep(2)
        return prompts

    asks = [str(i) for i in range(200)]
    assert calls.pooled(model, asks) == [(x, None) for x in asks] and len(threads) <= 3
    threads.clear()
    got = calls.pooled(model, ["hang", *asks], calls.Config(timeout_s=0.5, concurrency=1))
    assert got[0][0] is None and [a for a, _ in got[1:]] == asks and len(threads) == 2


def test_numbers_without_gaps(spark):
    got, total = ranges.numbered(spark.range(1000).repartition(7), "at", "t")
    rows = [tuple(r) for r in got.select("id", "at").collect()]
    assert total == 1000 and sorted(i for i, _ in rows) == sorted(at for _, at in rows) == list(range(1000))
    none, total = ranges.numbered(spark.range(0), "at", "t")
    assert total == none.count() == 0
