"""The keyed store: interleaved writers, tombstones, clearing, compaction, older stores."""

import datetime as dt
import itertools
import json

import pytest

from lodestar.sources.store import FlowStore, KeyedStore, SummaryStore


def ticking(start=0):
    n = itertools.count(start)
    return lambda: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=next(n))


@pytest.fixture
def store(spark, tmp_path):
    return lambda clock=None: KeyedStore(spark, str(tmp_path / "store"), "k string, v int", ["k"], clock or ticking())


def rows(store):
    return {r["k"]: r["v"] for r in store.load().collect()}


def frame(spark, **values):
    return spark.createDataFrame([(None if k == "none" else k, v) for k, v in values.items()], "k string, v int")


def test_two_interleaved_writers_lose_nothing(spark, store):
    clock = ticking()
    one, two = store(clock), store(clock)
    assert rows(one) == {}
    before = one.live()
    one.upsert(frame(spark, a=1, b=1, none=1))
    two.upsert(frame(spark, b=2, c=2))
    assert before == [] and rows(one) == rows(two) == {"a": 1, "b": 2, "c": 2, None: 1}
    # a commit that another writer makes between reading and writing stays
    seen = one.live()
    two.upsert(frame(spark, d=3))
    one.commit(one.merged(seen).selectExpr("k", "v", "updated_at", "false as __gone"), clock(), seen)
    assert rows(two) == {"a": 1, "b": 2, "c": 2, None: 1, "d": 3}


def test_the_clock_decides_and_not_the_order_of_commits(spark, store):
    late, early = store(ticking(100)), store(ticking(0))
    late.upsert(frame(spark, a=1))
    early.upsert(frame(spark, a=2, b=2))
    assert rows(late) == {"a": 1, "b": 2}
    assert {r["updated_at"].second for r in late.load().where("k = 'a'").collect()} == {40}


def test_tombstones_and_clear(spark, store):
    s = store()
    s.upsert(frame(spark, a=1, b=2, c=3, none=4))
    assert s.delete(frame(spark, a=0, z=0, none=0)) == 2 and rows(s) == {"b": 2, "c": 3}
    assert s.delete(frame(spark, z=0)) == 0
    s.upsert(frame(spark, a=9))
    s.compact()
    assert len(s.live()) == 1 and rows(s) == {"a": 9, "b": 2, "c": 3}
    s.clear()
    assert rows(s) == {}
    s.upsert(frame(spark, b=5))
    assert rows(s) == {"b": 5}


def test_clearing_spares_what_comes_meanwhile(spark, store):
    clock = ticking()
    one, two = store(clock), store(clock)
    one.upsert(frame(spark, a=1))
    seen = one.live()
    two.upsert(frame(spark, b=2))
    one.live = lambda: seen  # as it was when clearing began
    one.clear()
    assert rows(two) == {"b": 2}


def test_half_a_write_is_not_seen(spark, store, tmp_path):
    s = store()
    s.upsert(frame(spark, a=1))
    frame(spark, b=2).selectExpr("k", "v", "current_timestamp() updated_at", "false __gone", "0 bucket").write.partitionBy("bucket").parquet(str(tmp_path / "store/commits/commit=half"))
    assert rows(s) == {"a": 1}


def test_lookup_reads_few_buckets(spark, store):
    s = store()
    s.upsert(spark.range(2000).selectExpr("cast(id as string) k", "cast(id as int) v"))
    found = s.lookup(frame(spark, **{"7": 0, "x": 0}))
    assert [r["v"] for r in found.collect()] == [7]


def test_flows(spark, tmp_path):
    old = tmp_path / "old.json"
    old.write_text(json.dumps({"version": "1.0", "flows": [{"id": "f1", "name": "one", "steps": ["a", "b"]}, {"id": "f2", "name": "two"}]}, indent=2))
    flows = FlowStore(spark, str(tmp_path / "flows"), ticking(), str(old))
    names = lambda: {r["name"]: (r["id"], r["steps"]) for r in flows.load().collect()}
    assert names() == {"one": ("f1", ["a", "b"]), "two": ("f2", None)}
    new = spark.createDataFrame([("f9", "two", ["c"]), ("f3", "three", [])], "id string, name string, steps array<string>")
    flows.save(new)
    assert names() == {"one": ("f1", ["a", "b"]), "two": ("f9", ["c"]), "three": ("f3", [])}
    assert flows.delete(spark.createDataFrame([("f1",)], "id string")) == 1
    assert flows.delete(spark.createDataFrame([("f1",)], "id string")) == 0
    assert set(names()) == {"two", "three"}
    assert FlowStore(spark, str(tmp_path / "none"), ticking(), str(tmp_path / "no.json")).load().count() == 0
    (tmp_path / "bad.json").write_text("{not json")
    assert FlowStore(spark, str(tmp_path / "none"), ticking(), str(tmp_path / "bad.json")).load().count() == 0


def test_summaries(spark, tmp_path):
    s = SummaryStore(spark, str(tmp_path / "sums"), ticking())
    digest = lambda t: __import__("hashlib").md5(t.encode()).hexdigest()
    s.put("file", spark.createDataFrame([("a\\x.py", digest("one"), "says one"), ("b.py", digest("two"), "says two")], "path string, content_hash string, summary string"))
    s.put("symbol", spark.createDataFrame([("b.py", "f", "old"), ("b.py", "g", "kept")], "path string, symbol string, summary string"))
    s.put("symbol", spark.createDataFrame([("b.py", "f", "new")], "path string, symbol string, summary string"))
    s.put("folder", spark.createDataFrame([("a", "a folder")], "path string, summary string"))
    s.put("project", spark.createDataFrame([("all",)], "summary string"))
    files = spark.createDataFrame([("a/x.py", "one"), ("b.py", "changed")], "file_path string, content string")
    assert [r["summary"] for r in s.valid(files).collect()] == ["says one"]
    assert [r["summary"] for r in s.valid(spark.createDataFrame([("b.py", None)], "file_path string, content string")).collect()] == ["says two"]
    assert {(r["symbol"], r["summary"]) for r in s.get("symbol").collect()} == {("f", "new"), ("g", "kept")}
    assert s.get("project").first()["summary"] == "all" and s.stats().first()[:] == (2, 2)
    s.export(str(tmp_path / "out"))
    assert '"summary" : "a folder"' in "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    s.clear()
    assert s.load().count() == 0


def test_some_fields_of_some_keys(spark, tmp_path):
    """Other fields aren't read, and a condition on a key is met before rows are grouped."""
    s = KeyedStore(spark, str(tmp_path / "wide"), "k string, v int, w string", ["k"], ticking())
    s.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string"))
    s.upsert(spark.createDataFrame([("a", 3, "z"), ("a", 3, "z")], "k string, v int, w string"))
    some = s.latest(["v"])
    assert some.columns == ["k", "v", "updated_at"] and sorted(r[:2] for r in some.collect()) == [("a", 3), ("b", 2)]
    plan = s.load().where("k = 'a'")._jdf.queryExecution().optimizedPlan().toString()
    assert "= a)" in plan[plan.index("Aggregate"):] and [r["w"] for r in s.load().where("k = 'a'").collect()] == ["z"]
