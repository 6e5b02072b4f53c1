"""Proportional interleaving against a plain recomputation of ranks, fractions and cuts."""

import random
import zlib

import pytest
import xxhash

from lodestar.llm import sharding

DOC = "doc_id long, text string, source string, shard string, slot int, n long, at double"


def chained(*parts):
    """Spark's xxhash64 of several columns: each with the hash so far as seed, nulls left out."""
    h = 42
    for p in parts:
        if p is not None:
            h = xxhash.xxh64_intdigest(p.to_bytes(8, "little", signed=True) if isinstance(p, int) else p.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


def plain(rows, shards, seed="shard"):
    first = lambda x: (x is not None, x)  # noqa: E731  nulls go first
    ranked = {}
    for doc, text, source in rows:
        t = text or ""
        key = (chained(seed, doc, t if doc is None else None), first(doc) if doc is not None else (False, 0), zlib.crc32(t.encode()), len(t.encode()) + 8)
        ranked.setdefault(source, []).append((key, doc))
    timed = []
    for source, own in ranked.items():
        u = chained(seed, "offset", source) % (1 << 20) / float(1 << 20)
        for r, (key, doc) in enumerate(sorted(own)):
            timed.append(((r + u) / len(own), first(source) if source is not None else (False, ""), key, doc, source))
    timed.sort()
    n, out, slots = len(timed), [], {}
    for at, (_, _, key, doc, source) in enumerate(timed):
        shard = at * shards // n
        slots[shard] = slots.get(shard, -1) + 1
        out.append((doc, source, key[3], key[2], shard, slots[shard]))
    return out


def table(seed, n):
    rnd = random.Random(seed)
    rows = [(i if rnd.random() < 0.97 else None, rnd.choice(["same text", None, "", "ünï", f"own {i}"]), rnd.choice(["a", "a", "a", "b", None, "c"])) for i in range(n)]
    return [*rows, rows[0], (5, "x" * 100_000, "b"), (-7, "minus", "")]


@pytest.mark.parametrize(("n", "shards"), [(300, 24), (40, 7), (3, 24), (1000, 1)])
def test_every_shard_and_slot(spark, n, shards):
    rows = table(n, n)
    df = spark.createDataFrame([(*r, "clash", 1, 2, 0.5) for r in rows], DOC).repartition(4)
    got = sharding.interleave(df, shards).select("doc_id", "source", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows, shards), key=repr)


def test_each_shard_holds_every_source_in_proportion(spark):
    rows = table(2, 1200)
    shares = {s: sum(r[2] == s for r in rows) / len(rows) for s in {r[2] for r in rows}}
    held = {}
    for r in sharding.interleave(spark.createDataFrame([(*r, "c", 1, 2, 0.5) for r in rows], DOC), 12).collect():
        held.setdefault(r["shard"], []).append(r["source"])
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1
    for own in held.values():
        assert all(abs(own.count(s) - share * len(own)) <= 2 for s, share in shares.items())
