"""Chat windows: exact round trip, budget, masks and awkward tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm import chat_windows

TURN = "conv_id long, turn long, role string, text string, window string, piece int"


def awkward():
    rnd = random.Random(8)
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end\\|>", "a<", "|b", "<\\\\|", "\\n \\b \\", "", None, "   ", "line\n<|im_start|>\nline", "ünï 語 😀 <|", "\r\n\t"]
    rows = []
    for conv in range(12):
        for turn in range(rnd.randint(1, 30)):
            role = "system" if turn == 0 and conv % 3 == 0 else rnd.choice(["user", "assistant"])
            rows.append((conv, turn, role, rnd.choice(nasty) if rnd.random() < 0.4 else " ".join("word" for _ in range(rnd.randint(0, 90))), "w", 1))
    rows += [(50, 0, "system", "only the system"), (51, 0, "assistant", "w " * 40_000), (52, 0, "system", "s " * 5000), (52, 1, "assistant", "a")]
    rows += [(53, 0, "assistant", "twice"), (53, 0, "assistant", "twice"), (53, None, "user", "first"), (None, 1, None, "none"), (None, 0, "a\nb<|\\", "role")]
    rows += [(54, 9000 * i, "assistant", f"far {i}") for i in range(40)]
    return [(*r, "w", 1)[:6] for r in rows]


def ordered(rows):
    by_conv = {}
    for conv, turn, role, text, *_ in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in by_conv.items()}


def tokens(text):
    return len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{1,6}|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", text))


@pytest.fixture(scope="module")
def windows(spark):
    df = chat_windows.format_windows(spark.createDataFrame(awkward(), TURN).repartition(5), budget=200, history=40)
    return df.select("*", chat_windows.parsed_turns(F.col("text")).alias("turns"), chat_windows.token_count(F.col("text")).alias("tokens")).collect()


def test_round_trip(spark):
    df = chat_windows.digests(chat_windows.format_windows(spark.createDataFrame(awkward(), TURN).repartition(5), budget=200, history=40))
    got = {r["conv_id"]: r for r in df.collect()}
    want = ordered(awkward())
    assert set(got) == set(want)
    for conv, turns in want.items():
        r, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_windows_keep_whole_turns(windows):
    """Each window: the system turn, a run of history, and new turns that follow it without a gap."""
    want, seen = ordered(awkward()), {}
    for w in sorted(windows, key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["window"])):
        turns, told = want[w["conv_id"]], [(t["role"], t["text"]) for t in w["turns"]]
        assert len(told) == w["n_turns"] + w["n_repeated"]
        done = seen.get(w["conv_id"], 0)
        head, fresh = told[: w["n_repeated"]], told[w["n_repeated"] :]
        assert fresh == turns[done : done + len(fresh)]
        if done and turns[0][0] == "system" and tokens("system") + tokens(turns[0][1]) + 4 <= 50:
            assert head[0] == turns[0]
            head = head[1:]
        assert head == turns[done - len(head) : done]
        seen[w["conv_id"]] = done + len(fresh)
        assert w["tokens"] <= 200 + 8 * len(told) or len(fresh) == 1
        targets = [w["text"][s["start"] : s["start"] + s["length"]] for s in w["loss"]]
        assert len(targets) == sum(role == "assistant" for role, _ in fresh)
    assert seen == {c: len(t) for c, t in want.items()}
    assert any(w["n_repeated"] > 1 for w in windows)


def test_repetition_is_bounded(windows):
    """History and system turn add at most 40 + 200 / 4 tokens to a window, whatever the conversation."""
    for w in windows:
        repeated = [t["text"] for t in w["turns"][: w["n_repeated"]]]
        assert sum(len(t.split()) for t in repeated) <= 90


def test_no_history_and_empty_table(spark):
    none = spark.createDataFrame([], TURN)
    assert chat_windows.digests(chat_windows.format_windows(none)).count() == 0
    df = spark.createDataFrame(awkward(), TURN)
    assert chat_windows.format_windows(df, 200, 0).where("n_repeated > 1").count() == 0
    with pytest.raises(ValueError, match="history"):
        chat_windows.format_windows(df, 100, 60)


def test_prefix_sums_cross_segments(spark, monkeypatch):
    """A conversation whose turns fall into many segments is laid out as in one."""
    df = spark.createDataFrame(awkward(), TURN)
    one = {(r["conv_id"], r["window"], r["text"]) for r in chat_windows.format_windows(df, 200, 40).collect()}
    monkeypatch.setattr(chat_windows, "SEGMENT", 3)
    assert {(r["conv_id"], r["window"], r["text"]) for r in chat_windows.format_windows(df, 200, 40).collect()} == one
