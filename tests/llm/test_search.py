"""Ranked lexical search against a plain ranking of every document."""

import collections
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import lexical_search as ls

DOC = "doc_id long, text string, term string, docs int"
ITEM = "item_id long, text string, df int"


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, k):
    counted = [(d, collections.Counter(terms(t))) for d, t, *_ in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    asked = collections.defaultdict(set)
    for item, text, *_ in items:
        asked[item] |= set(terms(text))
    out = []
    for item, ts in asked.items():
        scored = []
        for doc, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if none else doc, -s) for i, (s, none, doc) in enumerate(sorted(scored)[:k])]
    return out


def tables(seed=5, n=160):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Éa", "éa", "naïve", "語", "A1", "a1", "İx"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda k: rnd.choice([" ", ", ", "-", "\n"]).join(rnd.choices(words, weights, k=k))
    docs = [(i * 3 - 50, text(rnd.randint(1, 80)), "x", 1) for i in range(n)]
    docs += [(900, None), (901, ""), (902, " .,;"), (903, text(20_000)), (None, text(30)), (-50, docs[0][1]), *[(1000 + i, docs[7][1]) for i in range(40)]]
    items = [(i, text(rnd.randint(1, 12)), 0) for i in range(25)] + [(99, None, 0), (98, "", 0), (97, "nowhere", 0), (0, "w59 w58", 0), (None, "w1 w2", 0)]
    return [(*d, "x", 1)[:4] for d in docs], items


@pytest.mark.parametrize(("shard_bytes", "block_terms", "k"), [(1 << 20, 1 << 18, 50), (700, 1 << 18, 7), (300, 20, 3)])
def test_ranking(spark, shard_bytes, block_terms, k):
    docs, items = tables()
    index = ls.build_index(spark.createDataFrame(docs, DOC).repartition(3), shard_bytes)
    got = ls.search(index, spark.createDataFrame(items, ITEM), k, block_terms).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(docs, items, k), key=repr)


def test_empty_tables(spark):
    docs, items = tables()
    none = ls.build_index(spark.createDataFrame([], DOC))
    assert ls.search(none, spark.createDataFrame(items, ITEM)).count() == 0
    index = ls.build_index(spark.createDataFrame(docs, DOC))
    assert ls.search(index, spark.createDataFrame([], ITEM)).count() == 0


def test_index_holds_every_posting(spark):
    docs, _ = tables()
    want = collections.Counter(t for _, text, *_ in docs for t in set(terms(text)))
    got = collections.Counter()
    for row in ls.build_index(spark.createDataFrame(docs, DOC), 500).collect():
        row = row.asDict()
        shard = ls.Shard(row, dict.fromkeys(map(bytes, row["term"]), 1), 100, 1000)
        assert (np.diff(shard.ids) >= 0).all()
        for t in row["term"]:
            places, _, _ = shard.postings(bytes(t))
            assert (np.diff(places) > 0).all()
            got[bytes(t).decode()] += len(places)
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 63) - 1), max_size=30))
def test_packing_of_numbers(numbers):
    data, width = ls.packed(np.array(numbers, np.int64))
    assert ls.unpacked(data).tolist() == numbers
    assert int(width.sum()) == len(data)
