"""Operator 10's keys leave the line pass packed and end there unless lines share them; distances of many pairs at a time."""

import random

import numpy as np

from lodestar.llm import line_dedup

SF = "/root/testdata/sf0.001"


def test_only_shared_keys_are_put_down(spark):
    """Lines stand without their keys, and a key of one line alone stands nowhere."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lines, keys = line_dedup.line_table(docs, 5, 512)
    assert "blocks" not in lines.columns
    assert lines.count() == sum((r["text"] or "").count("\n") + 1 for r in docs.collect())
    owners = {}
    for r in keys.collect():
        owners.setdefault(r["k"], set()).add(r["id"])
    assert owners and min(map(len, owners.values())) > 1
    ids = {r["id"] for r in lines.select("id").collect()}
    assert set.union(*owners.values()) <= ids


def test_no_key_gathers_in_one_part():
    """Of a key of very many lines each task sends two to its part, the others spread, and all are found again."""
    rnd = np.random.default_rng(1)
    tasks = []
    for t in range(3):
        keys = np.append(np.full(2000, 7 << 40, np.uint64), rnd.integers(0, 1 << 63, 500).astype(np.uint64))
        ids = np.append(np.arange(t * 1000, t * 1000 + 2000), np.arange(10**6 + 500 * t, 10**6 + 500 * (t + 1))).astype(np.uint64)
        tasks.append(line_dedup.dealt_keys(keys, ids, 16, 64))
    sides = {}
    for batch in tasks:
        for part, alone, known in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            assert (np.frombuffer(alone, np.uint64)[::2] == 7 << 40).sum() in (0, 2) and len(known) < 16 * 2000 / 8
            for side, packed in zip(sides.setdefault(part, ([], [])), (alone, known), strict=True):
                side.append(packed)
    got = [line_dedup.met_keys(*x) for x in sides.values()]
    assert {int(k) for k, _ in got for k in k.tolist()} == {7 << 40}
    assert {i for _, x in got for i in x.tolist()} == set(range(4000))


def test_distances_of_many_pairs():
    """Equal to one pair at a time, over several machine words, empty lines and wide characters."""
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdef é語😀", k=rnd.randint(1, 9))) for _ in range(200)]
    pairs = [("", ""), ("", "b"), ("a", "abc")]
    for n in (1, 4, 12, 30, 60):
        for _ in range(60):
            a = [rnd.choice(words) for _ in range(rnd.randint(0, n))]
            b = [x if rnd.random() > rnd.choice([0, 0.1, 0.3]) else rnd.choice(words) for x in a][rnd.randint(0, 1) :]
            pairs.append(tuple(sorted((" ".join(a), " ".join(b)), key=len)))
    one, two = map(list, zip(*pairs, strict=True))
    exact = [line_dedup.edit_distance(a, b) for a, b in pairs]
    assert line_dedup.edit_distances(one, two).tolist() == exact
    assert all(line_dedup.piece_by_piece(a, b, 10**6) >= d for (a, b), d in zip(pairs, exact, strict=True))
    assert line_dedup.similar_many(one, two, 0.8).tolist() == [d <= int(0.2 * len(b) + 1e-9) for (_, b), d in zip(pairs, exact, strict=True)]
