"""The near-duplicate stage of the pipeline against all pairs of shingle sets."""

import random

import corpus_pipeline
from lodestar.llm import jaccard_dedup
from test_operators import components, prose


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """The smallest doc_id of each group, by the Jaccard similarity of all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[n + 1 :] if (not a and not b) or (a | b and 5 * len(a & b) >= 4 * len(a | b))]
    return sorted(set(components([i for i, _ in rows], links).values()))


def changed(rnd, words, n):
    words = list(words)
    for at in rnd.sample(range(len(words)), n):
        words[at] += "q"
    return " ".join(words)


def copies():
    rnd = random.Random(12)
    texts = []
    for size, n in ((60, 1), (60, 2), (120, 2), (120, 3), (300, 4), (300, 6), (300, 9)):
        for _ in range(5):
            base = prose(rnd, size).split()
            texts += [" ".join(base), changed(rnd, base, n)]
    hot = prose(rnd, 100).split()
    texts += [changed(rnd, hot, 1) for _ in range(60)]
    texts += [" ".join(hot[:70]) + " " + prose(rnd, 14 + i % 5) for i in range(30)]
    texts += [None, "", "word", "Word", "two words"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_stage_against_all_pairs(spark):
    rows = copies()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == plain_kept(rows)


def test_small_tiles_and_odd_rows(spark):
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted({r["root"] for r in jaccard_dedup.near_groups(df, tile=3).collect()}) == plain_kept(rows)
    odd = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, "x"), (3, "y")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in jaccard_dedup.keep_one(odd).collect()) == [0, 1, 3]
    assert jaccard_dedup.keep_one(odd.limit(0)).count() == 0


def test_operator_4_proposes_pairs(spark, monkeypatch):
    """Pairs within four bits are candidates whatever bands they share, and equal fingerprints with them."""
    nodes = spark.createDataFrame([(1, 0), (2, 0b1111), (3, 0b11111 << 40), (4, 0), (5, -1)], "id long, fp long")
    assert {frozenset(r) for r in jaccard_dedup.fingerprint_pairs(nodes).collect()} == {frozenset(p) for p in ((1, 2), (1, 4))}
    asked = []
    whole = jaccard_dedup.fingerprint_pairs
    monkeypatch.setattr(jaccard_dedup, "fingerprint_pairs", lambda n: asked.append(n.columns) or whole(n))
    rows = copies()
    assert sorted({r["root"] for r in jaccard_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}) == plain_kept(rows)
    assert asked == [["id", "fp"]]
