"""The pipeline on a small table, stage by stage."""

import collections

import pytest

import corpus_pipeline
from lodestar.llm import line_dedup, mixing, packing, queries, toxicity
from lodestar.llm.staging import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def plain_singles(rows):
    """The smallest doc_id of every group that Jaccard similarities of 0.8 over five-word shingles connect, by all pairs."""
    sets = {}
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            a, b = sets[i], sets[j]
            if i < j and (a == b or (a and b and len(a & b) >= 0.8 * len(a | b))):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted({find(i) for i in ids})


def test_stages(spark, steps):
    docs, clean, lines, single, mixed, packed = steps
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = toxicity.score(docs, toxicity.fit(docs, labels))
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in scores.where("score < 0.3").collect()}
    want = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(clean).collect()}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want
    assert sorted(r["doc_id"] for r in single.collect()) == plain_singles(lines.select("doc_id", "text").collect())
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(single).collect()}
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({i: n for i, n in copies.items() if n})
    tokens = packing.tokenized_pieces(mixed, queries.tokenizer_path(), 2048)
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in packed.collect()) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in tokens.collect())


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, SF)
    assert docs.count() == 0
