"""What operator 10 compares, against the edit similarity of all pairs."""

import collections
import random

import numpy as np
import pytest

from lodestar.llm import line_dedup
from lodestar.llm.words import xxh64_words

SF = "/root/testdata/sf0.001"


def roots(spark, docs):
    rows = line_dedup.line_groups(docs).select("doc_id", "line_no", "root").collect()
    return {(r["doc_id"], r["line_no"]): r["root"] for r in rows}


def alike(a, b):
    longer = max(len(a), len(b))
    return min(len(a), len(b)) >= 0.8 * longer and line_dedup.edit_distance(a, b) <= int(0.2 * longer + 1e-9)


def test_recall_on_documents(spark):
    """Of all pairs of a drawn line and any other line with an edit similarity of 0.8, nine in ten are in one group."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    at = {}
    for r in docs.collect():
        for no, line in enumerate((r["text"] or "").split("\n")):
            at.setdefault(line_dedup.normalise(line), (r["doc_id"], no))
    lines = [x for x in at if x.count(" ") >= 4]
    asked = random.Random(1).sample(range(len(lines)), 400)
    letters = [collections.Counter(x) for x in lines]  # a distance is no less than the characters that one line has and the other lacks
    pairs = [(i, j) for i in asked for j in range(len(lines)) if i != j and (letters[i] - letters[j]).total() <= 0.2 * max(len(lines[i]), len(lines[j])) and alike(lines[i], lines[j])]
    root = roots(spark, docs)
    found = sum(root[at[lines[i]]] == root[at[lines[j]]] for i, j in pairs)
    assert len(pairs) > 15 and found >= 0.9 * len(pairs)


def test_recall_on_edited_lines(spark):
    """Words replaced, left out and put in, up to the least similarity that counts."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefghilmnoprstu", k=rnd.choice([2, 3, 4, 5, 6, 7, 8, 9])))
    rows, total = [], 0
    while total < 600:
        words = [word() for _ in range(rnd.choice([5, 7, 10, 14, 20, 40, 80]))]
        rate, other = rnd.choice([0.03, 0.06, 0.1, 0.15, 0.2]), []
        for w in words:
            r = rnd.random() / rate
            other += [w] if r >= 1 else [word()] if r < 0.6 else [] if r < 0.8 else [w, word()]
        a, b = " ".join(words), " ".join(other)
        if a != b and len(other) >= 5 and alike(a, b):
            rows += [(2 * total, a), (2 * total + 1, b)]
            total += 1
    root = roots(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(root[2 * i, 0] == root[2 * i + 1, 0] for i in range(total)) >= 0.9 * total


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_recall_by_length(spark, seed):
    """As above, for lines of each length by itself."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghilmnoprstu", k=rnd.choice([2, 3, 4, 5, 6, 7, 8, 9])))
    rows, lengths = [], [5, 7, 10, 14, 20, 40, 80]
    for n in lengths:
        total = 0
        while total < 150:
            words = [word() for _ in range(n)]
            rate, other = rnd.choice([0.03, 0.06, 0.1, 0.15, 0.2]), []
            for w in words:
                r = rnd.random() / rate
                other += [w] if r >= 1 else [word()] if r < 0.6 else [] if r < 0.8 else [w, word()]
            a, b = " ".join(words), " ".join(other)
            if a != b and len(other) >= 5 and alike(a, b):
                rows += [(len(rows), a), (len(rows) + 1, b)]
                total += 1
    root = roots(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    for k, n in enumerate(lengths):
        assert sum(root[i, 0] == root[i + 1, 0] for i in range(300 * k, 300 * (k + 1), 2)) >= 0.9 * 150, n


def test_one_word_of_a_short_line_never_parts_it(spark):
    """Whichever word is replaced, left out or put in: a link as long as the edit similarity allows it."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefghilmnoprstu", k=rnd.choice([4, 5, 6, 7, 8])))
    rows = []
    while len(rows) < 400:
        words = [word() for _ in range(rnd.randint(5, 12))]
        at, how = rnd.randrange(len(words)), rnd.choice("rdi")
        other = words[:at] + ([word()] if how != "d" else []) + words[at + (how != "i") :]
        a, b = " ".join(words), " ".join(other)
        if a != b and len(other) >= 5 and alike(a, b):
            rows += [(len(rows), a), (len(rows) + 1, b)]
    root = roots(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(root[i, 0] == root[i + 1, 0] for i in range(0, 400, 2)) >= 0.98 * 200


def test_short_lines_and_unspaced_scripts(spark):
    rows = [(1, "Read more\n你好世界这是一个很长的句子没有空格"), (2, "read  more!\n你好世界这是一个很长的句子也没有空格"), (3, "Read mote\n完全不同的另外一句话在这里出现了"), (4, None), (5, "")]
    root = roots(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert root[1, 0] == root[2, 0] != root[3, 0] and root[1, 1] == root[2, 1] != root[3, 1]


def test_words_of_unspaced_scripts():
    data = np.frombuffer("ab 你好c\n世 d".encode(), np.uint8)
    first, end = line_dedup.token_bounds(data)
    assert [data[a:b].tobytes().decode() for a, b in zip(first, end)] == ["ab", "你", "好", "c", "世", "d"]


@pytest.mark.parametrize(("words", "least"), [(5, 0.7), (11, 0.9), (14, 0.9), (30, 0.9)])
def test_blocks_outlive_other_edits(words, least):
    """A line keeps the blocks of the classes that an edit doesn't touch."""
    rnd = random.Random(words)
    texts = []
    for _ in range(200):
        own = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(words)]
        texts += [" ".join(own), " ".join([*own[:-1], "changed"])]
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    first, end = line_dedup.token_bounds(data)
    line = np.cumsum(data == ord("\n"))[first]
    offsets, keys = line_dedup.block_keys(xxh64_words(data, first, end), line, len(texts))
    own = [set(keys[offsets[i] : offsets[i + 1]].tolist()) for i in range(len(texts))]
    assert sum(bool(own[i] & own[i + 1]) for i in range(0, len(own), 2)) >= least * 200
    strangers = collections.Counter(k for i in range(0, len(own), 2) for k in own[i])
    assert max(strangers.values()) == 1


def test_pair_counts_never_refuse_a_similar_pair():
    """Four times the edit distance bounds how far the counts of character pairs are apart."""
    rnd = random.Random(1)
    pairs = []
    for _ in range(1500):
        a = "".join(rnd.choices("abcde é語😀", k=rnd.randint(0, 60)))
        b = list(a)
        for _ in range(rnd.randint(0, 8)):
            at, how = rnd.randint(0, len(b)), rnd.random()
            b[at : at + (how < 0.7)] = [rnd.choice("abcxyz語")] if how < 0.4 or how >= 0.7 else []
        pairs.append((a, "".join(b)))
    one, two = (line_dedup.gram_counts([p[i] for p in pairs]) for i in (0, 1))
    apart = np.abs(one.astype(int) - two).sum(1)
    assert all(d <= 4 * line_dedup.edit_distance(*p) for d, p in zip(apart.tolist(), pairs, strict=True))
    near = line_dedup.within_reach(one, two, np.array([max(map(len, p)) for p in pairs]), 0.8)
    assert all(n or not alike(*p) for n, p in zip(near.tolist(), pairs, strict=True))
    assert not line_dedup.within_reach(line_dedup.gram_counts(["quite another line of text"]), line_dedup.gram_counts(["vowels and consonants mixed"]), np.array([27]), 0.8)[0]


def test_keys_of_one_line_are_dropped_and_others_kept(spark):
    rows = [(1, [10, 11]), (2, [11, 12]), (3, [13]), (4, None), *[(100 + i, [77, 1000 + i]) for i in range(40)]]
    nodes = spark.createDataFrame(rows, "id long, blocks array<long>")
    got = sorted(tuple(r) for r in line_dedup.shared_keys(nodes, 16).collect())
    assert got == sorted([(11, 1), (11, 2), *[(77, 100 + i) for i in range(40)]])


def test_bounded_edit_distance():
    rnd = random.Random(2)
    for _ in range(600):
        a, b = ("".join(rnd.choices("abc d", k=rnd.randint(0, 40))) for _ in range(2))
        exact, most = line_dedup.edit_distance(a, b), rnd.randint(0, 30)
        bounded = line_dedup.edit_distance(a, b, most)
        assert bounded == exact if exact <= most else most < bounded <= exact
