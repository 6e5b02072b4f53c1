"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, one occurrence a group (operator 10)."""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.components import connected_components
from lodestar.llm.hamming import LINK, majority_bits, tiled, whole_buckets
from lodestar.llm.staging import stage
from lodestar.llm.words import P1, P2, P3, word_bounds, xxh64_words

WORD = re.compile(r"[^\W_]+")
CHARS = 1 << 20
#: Pigeonhole keys by number of words: from, below, classes of words, classes to a key, least words of a key. Where ranges overlap a line has both kinds of keys.
LEVELS = ((0, 10, 4, 2, 2), (8, 16, 4, 1, 2), (12, 1 << 62, 9, 1, 2), (48, 1 << 62, 16, 1, 3))
#: Lines of so many words, from and below, have keys that survive any one word, and any two, as well
ALL_BUT_ONE, ALL_BUT_TWO = (3, 13), (4, 7)
LONG_WORD, FEW = 4, 4
#: In lines under so many characters one word moves many bits of a SimHash
SHORT_CHARS, SHORT_RADIUS = 80, 24
GRAMS = 256
LINE = "doc_key long, doc_id long, line_no int, id long, fp long, chars int"
#: Numbers of a key and a line beside each other, of one part of all keys: those that may be alone, and those known to be shared
DEALT = "part int, alone binary, known binary"
LINE_ARROW = pa.schema([("doc_key", pa.int64()), ("doc_id", pa.int64()), ("line_no", pa.int32()), ("id", pa.int64()), ("fp", pa.int64()), ("chars", pa.int32())])
#: Keys that a task holds before it deals them out
HELD_KEYS = 1 << 21
#: Lines up to 64 times so many characters are compared together
COLUMN_WORDS = (1, 2, 3, 4, 6, 8, 12, 16)
#: Characters that join two lines again, and how far behind a difference they are looked for
PIECE, SKIPS = 7, (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 20, 24, 29, 35, 42, 50, 60)


def normalise(line: str) -> str:
    """The lower-case runs of letters and digits of a line, one blank between them."""
    return " ".join(WORD.findall(line.lower()))


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, bit-parallel: one machine-independent big integer holds a column.

    With ``most`` it stops where the distance is sure to pass that, and gives some number above it.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top, left = (1 << len(a)) - 1, 1 << len(a) - 1, len(b)
    up, down, score = full, 0, len(a)
    for x in b:
        eq = masks.get(x, 0)
        d = (((eq & up) + up) ^ up) | eq | down
        grow, shrink = down | ~(d | up) & full, up & d
        if grow & top:
            score += 1
        elif shrink & top:
            score -= 1
        grow, shrink = (grow << 1 | 1) & full, shrink << 1 & full
        up, down = shrink | ~(d | grow) & full, grow & d
        left -= 1
        if most is not None and score - left > most:  # each further character takes off one at most
            return score - left
    return score


def similar(a: str, b: str, least: float) -> bool:
    """Whether 1 - edit distance / longer length, in characters, is ``least`` or more."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return False
    lo = shared_prefix(a, b)
    a, b = a[lo:], b[lo:]
    hi = shared_prefix(a[::-1], b[::-1])
    x, y = a[: len(a) - hi], b[: len(b) - hi]
    if max(len(x), len(y)) <= most or word_by_word(x.split(" "), y.split(" "), most) <= most:
        return True
    return edit_distance(x, y, most) <= most


def edit_distances(one: list[str], two: list[str]) -> np.ndarray:
    """``edit_distance`` of pairs, none longer in ``one`` than in ``two``, a column of all pairs at a time.

    A pair's column lies across words of 64 rows, its last row in the last bit. The rows before
    its first have no difference from one to the next, so a column's cost passes through them.
    """
    m, n = (np.array([len(x) for x in side], np.int64) for side in (one, two))
    words = max(1, -(-int(m.max()) // 64))
    order = np.argsort(-n, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    codes, pair, at = characters(one, m, rank)
    kinds, kind = np.unique(pair << 21 | codes, return_inverse=True)
    row = at + 64 * words - m[order][pair]
    equal = np.zeros((len(kinds) + 1) * words, np.uint64)
    np.bitwise_or.at(equal, kind * words + (row >> 6), np.uint64(1) << (row & 63).astype(np.uint64))
    equal = np.ascontiguousarray(equal.reshape(-1, words).T)
    codes, pair, at = characters(two, n, rank)
    wanted = pair << 21 | codes
    kind = np.searchsorted(kinds, wanted)
    kind[np.append(kinds, -1)[kind] != wanted] = len(kinds)
    column = np.full((int(n.max()), len(order)), len(kinds))
    column[at, pair] = kind
    first = (64 * words - m[order])[None, :] - 64 * np.arange(words)[:, None]  # of each word the rows below this lie before the pair's first
    up = np.where(first >= 64, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) << np.clip(first, 0, 63).astype(np.uint64))
    down = np.zeros_like(up)
    score = m[order]
    one_bit, top = np.uint64(1), np.uint64(63)
    live = np.searchsorted(-n[order], -np.arange(int(n.max())), "left")  # pairs with more than 0, 1, 2, ... columns
    for chosen, k in zip(column, live.tolist(), strict=True):
        chosen = chosen[:k]
        more, less = np.ones(k, np.uint64), np.zeros(k, np.uint64)
        for w in range(words):
            u, d, eq = up[w, :k], down[w, :k], equal[w][chosen]
            side = eq | d
            eq |= less
            across = (((eq & u) + u) ^ u) | eq
            grow, shrink = d | ~(across | u), u & across
            out_more, out_less = grow >> top, shrink >> top
            grow = grow << one_bit | more
            shrink = shrink << one_bit | less
            up[w, :k] = shrink | ~(side | grow)
            down[w, :k] = grow & side
            more, less = out_more, out_less
        score[:k] += more.view(np.int64) - less.view(np.int64)
    return score[rank]


def characters(texts: list[str], sizes: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code point, name of its text, place in it) of all characters."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return codes, np.repeat(names, sizes), np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def similar_many(one: list[str], two: list[str], least: float) -> np.ndarray:
    """``similar`` of each pair.

    A cost that is no less than the distance settles most similar pairs, counts of character pairs
    most others; the rest is measured, together where enough pairs are of about one length.
    """
    out = np.zeros(len(one), bool)
    left: list[tuple[int, str, str, int]] = []
    for i, (a, b) in enumerate(zip(one, two, strict=True)):
        if len(a) > len(b):
            a, b = b, a
        most = int((1 - least) * len(b) + 1e-9)
        if len(b) - len(a) > most:
            continue
        lo = shared_prefix(a, b)
        a, b = a[lo:], b[lo:]
        hi = shared_prefix(a[::-1], b[::-1])
        a, b = a[: len(a) - hi], b[: len(b) - hi]
        if len(b) <= most or piece_by_piece(a, b, most) <= most:
            out[i] = True
        else:
            left.append((i, a, b, most))
    groups: dict[int, list[tuple[int, str, str, int]]] = {}
    for at in range(0, len(left), 4096):
        part = left[at : at + 4096]
        near = within_edits(gram_counts([x[1] for x in part]), gram_counts([x[2] for x in part]), np.array([x[3] for x in part]))
        for x, n in zip(part, near.tolist(), strict=True):
            if n:
                groups.setdefault(bisect_left(COLUMN_WORDS, -(-len(x[1]) // 64)), []).append(x)
    for size, members in groups.items():
        members.sort(key=lambda x: len(x[2]))
        if size == len(COLUMN_WORDS) or len(members) < 8 * COLUMN_WORDS[size]:
            for i, a, b, most in members:
                out[i] = edit_distance(a, b, most) <= most
            continue
        for at in range(0, len(members), 2048):
            i, a, b, most = zip(*members[at : at + 2048], strict=True)
            out[list(i)] = edit_distances(list(a), list(b)) <= np.array(most)
    return out


def piece_by_piece(a: str, b: str, most: int) -> int:
    """The cost of one way to edit ``a`` into ``b``, so no less than the edit distance; past ``most`` it stops.

    Where they part, the nearest piece of ``a`` that ``b`` has close by joins them again.
    """
    i = j = cost = 0
    while i < len(a) and j < len(b) and cost <= most:
        for skip in SKIPS:
            piece = a[i + skip : i + skip + PIECE]
            if len(piece) < PIECE:
                return cost + max(len(a) - i, len(b) - j)
            at = b.find(piece, j, j + 2 * skip + 3 * PIECE)
            if at >= 0:
                cost += max(skip, at - j)
                i, j = i + skip, at
                same = shared_prefix(a[i : i + 64], b[j : j + 64])
                while same == 64:
                    i, j = i + 64, j + 64
                    same = shared_prefix(a[i : i + 64], b[j : j + 64])
                i, j = i + same, j + same
                break
        else:
            return cost + max(len(a) - i, len(b) - j)
    return cost + max(len(a) - i, len(b) - j)


def word_by_word(a: list[str], b: list[str], most: int) -> int:
    """The cost of one way to edit words ``a`` into ``b``, so no less than the edit distance; past ``most`` it stops.

    Unequal words are replaced, or one left out where that makes the next ones equal.
    """
    i = j = cost = 0
    while i < len(a) and j < len(b) and cost <= most:
        if a[i] != b[j]:
            if a[i + 1 : i + 2] == b[j : j + 1] and a[i + 1 : i + 2] != b[j + 1 : j + 2]:
                cost += len(a[i]) + 1
                i += 1
                continue
            if b[j + 1 : j + 2] == a[i : i + 1] and a[i + 1 : i + 2] != b[j + 1 : j + 2]:
                cost += len(b[j]) + 1
                j += 1
                continue
            cost += max(len(a[i]), len(b[j]))
        i += 1
        j += 1
    return cost + sum(len(x) + 1 for x in a[i:]) + sum(len(x) + 1 for x in b[j:])


def shared_prefix(a: str, b: str) -> int:
    """The number of characters with which both begin."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def gram_counts(texts: list[str]) -> np.ndarray:
    """How often each of GRAMS classes of character pairs stands in each text, up to 255."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(codes == ord("\n"))
    row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=-1))
    inside = np.flatnonzero((codes[:-1] != ord("\n")) & (codes[1:] != ord("\n"))) if len(codes) > 1 else np.zeros(0, np.int64)
    kind = (codes[inside] * P1 ^ codes[inside + 1] * P2) * P3 >> np.uint64(64 - GRAMS.bit_length() + 1)
    return np.minimum(np.bincount(row[inside] * GRAMS + kind.astype(np.int64), minlength=len(texts) * GRAMS), 255).astype(np.uint8).reshape(len(texts), GRAMS)


def within_reach(one: np.ndarray, two: np.ndarray, longer: np.ndarray, least: float) -> np.ndarray:
    """Pairs of ``gram_counts`` rows whose texts may have the similarity.

    One edit of a character changes at most four counts by one, so no similar pair is lost: classes
    that coincide, and counts that are cut off, only bring rows closer.
    """
    return within_edits(one, two, np.floor((1 - least) * longer + 1e-9))


def within_edits(one: np.ndarray, two: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Pairs of ``gram_counts`` rows whose texts may be ``most`` edits apart or fewer."""
    out = np.empty(len(one), bool)
    for at in range(0, len(one), 4096):
        part = slice(at, at + 4096)
        out[part] = np.abs(one[part].astype(np.int16) - two[part]).sum(1) <= 4 * most[part]
    return out


def long_enough(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Pairs of lengths that leave room for the similarity."""
    return np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9


def text_key(docs: DataFrame) -> Column:
    """Tells rows apart that share a doc_id; rows equal in doc_id and text share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


@lru_cache(1)
def blanked() -> np.ndarray:
    """For every code point itself, or a blank where ``WORD`` doesn't take it; line ends stay."""
    out = np.full(sys.maxunicode + 1, ord(" "), np.uint32)
    for m in WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        out[m.start() : m.end()] = np.arange(m.start(), m.end())
    out[ord("\n")] = ord("\n")
    return out


@lru_cache(1)
def blanked_bytes() -> bytes:
    """``words_only`` of each byte below 128."""
    return bytes(int(blanked()[ord(chr(i).lower())]) for i in range(128)) + bytes(range(128, 256))


def words_only(text: str) -> bytes:
    """A text in lower case with blanks in place of all that ``WORD`` doesn't take, as UTF-8."""
    if text.isascii():
        return text.encode().translate(blanked_bytes())
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return blanked()[codes].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def token_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of each word of UTF-8 bytes; Chinese and Japanese characters, written without blanks, are words each."""
    inside = (data != ord(" ")) & (data != ord("\n"))
    alone = ((data >= 0xE3) & (data <= 0xE9)).nonzero()[0]  # lead bytes of U+3000 to U+9FFF
    if not len(alone):
        return word_bounds(inside)
    cut = np.zeros(len(data) + 3, bool)
    cut[alone] = cut[alone + 3] = True
    cut = cut[: len(data)] & inside
    last = np.append(~inside[1:], True) & inside
    cut[0:1] |= inside[0:1]
    cut[1:] |= inside[1:] & ~inside[:-1]
    first = np.flatnonzero(cut)
    stops = np.flatnonzero(last) + 1
    return first, np.minimum(np.append(first[1:], len(data)), stops[np.searchsorted(stops, first, "right")])


def content_words(line: np.ndarray, n: int, long: np.ndarray) -> np.ndarray:
    """The words that fingerprints are made of: long ones, in lines with fewer than FEW of them all."""
    return long | (np.bincount(line[long], minlength=n) < FEW)[line]


def block_keys(hashes: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, keys): ``block_rows`` with lines in order."""
    rows, keys = block_rows(hashes, line, n)
    order = np.argsort(rows, kind="stable")
    return np.searchsorted(rows[order], np.arange(n + 1)), keys[order]


def block_rows(hashes: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys): the keys of each line's blocks, in any order.

    A line's words fall into classes by their hash, and a block is the SimHash of the words of
    one class (in short lines of two), so an edit changes the blocks of the words it touches
    and leaves all others as they are: by the pigeonhole principle lines that differ in fewer
    classes than there are blocks share a block, bit for bit; short lines do where one word is
    replaced by another. Blocks of one word (of long lines' many blocks, of two) are left out, for one word alone
    would bring unrelated lines together. A word counts once in a line: repeated, it would
    outvote the others of its class and be one word alone again.
    """
    order = np.argsort(line.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))  # equal words of a line side by side
    hashes, line = hashes[order], line[order]
    first = np.append(True, (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1]))[: len(line)]
    hashes, line = hashes[first], line[first]
    words = np.bincount(line, minlength=n)
    kind = (hashes ^ hashes >> np.uint64(29)) * P2 >> np.uint64(40)
    rows, keys = [], []
    for level, (least, below, classes, together, held_words) in enumerate(LEVELS):
        own = ((words >= least) & (words < below))[line]
        chosen = list(combinations(range(classes), together))
        blocks = len(chosen)
        member = np.array([[i for i, x in enumerate(chosen) if c in x] for c in range(classes)])
        slot = (line[own, None] * blocks + member[(kind[own] % np.uint64(classes)).astype(np.int64)]).ravel()
        placed = np.sort(slot << 24 | np.arange(len(slot))) if len(slot) < 1 << 24 else None  # sorts faster than places alone
        order = np.argsort(slot, kind="stable") if placed is None else placed & (1 << 24) - 1
        slot = slot[order]
        starts = np.flatnonzero(np.diff(slot, prepend=-1))
        bits = majority_bits(np.repeat(hashes[own], member.shape[1])[order], starts)
        held = np.diff(np.append(starts, len(slot))) >= held_words
        slot, bits = slot[starts][held], bits[held]
        mixed = (bits ^ (np.uint64(level * 64) + (slot % blocks).astype(np.uint64)) * P1) * P2
        rows.append(slot // blocks)
        keys.append((mixed ^ mixed >> np.uint64(32)) * P3)
    for r, k in all_but_some(hashes, line, words):
        rows.append(r)
        keys.append(k)
    return np.concatenate(rows), np.concatenate(keys)


def all_but_some(hashes: np.ndarray, line: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys): in short lines the sum of all words, of all but each one, and in very short ones of all but each two.

    Lines that differ in so many words, replaced, left out or put in anywhere, share one of these keys.
    """
    mixed = (hashes ^ hashes >> np.uint64(31)) * P3
    rows, sums = [], []
    for n in range(ALL_BUT_ONE[0], ALL_BUT_ONE[1]):
        own = np.flatnonzero(words == n)
        if not len(own):
            continue
        h = mixed[(words == n)[line]].reshape(-1, n)
        total = h.sum(1, dtype=np.uint64)
        left = [total[:, None], total[:, None] - h]
        if ALL_BUT_TWO[0] <= n < ALL_BUT_TWO[1]:
            i, j = np.triu_indices(n, 1)
            left.append(total[:, None] - h[:, i] - h[:, j])
        left = np.concatenate(left, axis=1)
        rows.append(np.repeat(own, left.shape[1]))
        sums.append(left.ravel())
    if rows:
        mixed = (np.concatenate(sums) ^ P1) * P2
        yield np.concatenate(rows), (mixed ^ mixed >> np.uint64(32)) * P3


def line_rows(keys: list[int], ids: list[int | None], texts: list[str], min_words: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The lines of a few documents, and (keys, ids): their blocks' keys beside the ids of the lines."""
    digest = xxhash.xxh64_intdigest
    data = np.frombuffer(b"\n".join(map(words_only, texts)), np.uint8)
    first, end = token_bounds(data)
    begins = np.append(0, np.flatnonzero(data == ord("\n")) + 1)
    starts = np.searchsorted(first, begins)
    counts = np.diff(np.append(starts, len(first)))
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int32))  # bytes that begin a code point
    long = points[end] - points[first] >= LONG_WORD
    line = np.repeat(np.arange(len(counts)), counts)
    content = content_words(line, len(counts), long)
    line, hashes = line[content], xxh64_words(data, first[content], end[content])
    fps = majority_bits(hashes, np.searchsorted(line, np.arange(len(counts))))
    some = (counts >= min_words)[line]
    rows, blocks = block_rows(hashes[some], line[some], len(counts))
    spaced = np.append(data, np.uint8(ord(" ")))  # the runs, each with the blank or line end behind it
    runs, stops = word_bounds((data != ord(" ")) & (data != ord("\n")))
    spaced[stops] = ord(" ")
    kept = np.append((data != ord(" ")) & (data != ord("\n")), False)
    kept[stops] = True
    spaced = spaced[kept]
    packed = spaced.tobytes()
    at = np.append(0, np.cumsum(stops - runs + 1))
    run_starts = np.searchsorted(runs, np.append(begins, len(data) + 1))
    lo, hi = at[run_starts[:-1]], at[run_starts[1:]]
    points = np.append(0, np.cumsum((spaced & 0xC0) != 0x80, dtype=np.int32))
    chars = np.maximum(points[hi] - points[lo] - 1, 0)
    names = np.array([digest(packed[a : b - 1]) if a < b else 0 for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64)
    per_text = np.array([x.count("\n") + 1 for x in texts])
    key = np.repeat(np.array(keys, np.int64), per_text)
    doc_id = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), per_text)))
    number = np.arange(len(key)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    columns = [pa.array(key), doc_id, pa.array(number.astype(np.int32)), pa.array(names.view(np.int64), mask=counts == 0), pa.array(fps.view(np.int64)), pa.array(chars.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, schema=LINE_ARROW), blocks, names[rows]


def dealt_keys(keys: np.ndarray, ids: np.ndarray, parts: int, most: int) -> pa.RecordBatch:
    """DEALT rows of keys beside ids, one for each part that has any.

    A key's part follows from the key, so all its lines meet there. Of a key with more than ``most``
    lines two go there; the others, known to share it, go where key and id say. So a key brings
    few rows of each task to one part, and loses none.
    """
    order = np.argsort(keys)
    several = beside_equal(keys[order])
    some, owners = distinct_pairs(keys[order[several]], ids[order[several]])
    starts = np.flatnonzero(np.append(True, some[1:] != some[:-1])[: len(some)])
    sizes = np.diff(np.append(starts, len(some)))
    known = (np.repeat(sizes, sizes) > most) & (np.arange(len(some)) - np.repeat(starts, sizes) >= 2)
    single = order[~several]
    keys, ids = np.append(keys[single], some[~known]), np.append(ids[single], owners[~known])
    packed = []
    for k, i, mixed in ((keys, ids, keys), (some[known], owners[known], (some[known] ^ owners[known] * P1) * P2)):
        order = np.argsort(mixed)
        ends = np.searchsorted((mixed[order] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
        pairs = np.stack([k[order], i[order]], axis=1)
        packed.append([pairs[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
    rows = [i for i in range(parts) if packed[0][i] or packed[1][i]]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array([x[i] for i in rows], pa.binary()) for x in packed)], names=["part", "alone", "known"])


def beside_equal(sorted_keys: np.ndarray) -> np.ndarray:
    """Whether a key stands beside one equal to it."""
    same = np.zeros(len(sorted_keys) + 1, bool)
    same[1:-1] = sorted_keys[1:] == sorted_keys[:-1]
    return same[1:] | same[:-1]


def distinct_pairs(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (key, id) once, in order."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))[: len(keys)]
    return keys[fresh], ids[fresh]


def met_keys(alone: list[bytes], known: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ids) of one part: what more than one line has, and what is known to be shared."""
    pairs = np.frombuffer(b"".join(alone), np.uint64).reshape(-1, 2)
    order = np.argsort(np.ascontiguousarray(pairs[:, 0]))
    order = order[beside_equal(pairs[order, 0])]  # few are left to be put in order by line
    keys, ids = distinct_pairs(pairs[order, 0], pairs[order, 1])
    shared = beside_equal(keys)
    pairs = np.frombuffer(b"".join(known), np.uint64).reshape(-1, 2)
    more = distinct_pairs(pairs[:, 0], pairs[:, 1])
    return np.append(keys[shared], more[0]), np.append(ids[shared], more[1])


def key_parts(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def met(dealt: DataFrame) -> DataFrame:
    """(LINE columns, k, kid): the lines that ``dealt`` carries, and the keys that more than one line has.

    Most keys belong to one line; they end here, where a task holds its parts' numbers and nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone: dict[int, list[bytes]] = {}
        known: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, one, two, lines in zip(*(batch.column(c).to_pylist() for c in ("part", "alone", "known", "lines")), strict=True):
                if lines:
                    with pa.ipc.open_stream(lines) as stream:
                        for table in stream:
                            missing = pa.nulls(table.num_rows, pa.int64())
                            yield pa.RecordBatch.from_arrays([*table.columns, missing, missing], names=[*LINE_ARROW.names, "k", "kid"])
                else:
                    alone.setdefault(part, []).append(one)
                    known.setdefault(part, []).append(two)
        for part in alone:
            keys, ids = met_keys(alone[part], known[part])
            empty = [pa.nulls(len(keys), field.type) for field in LINE_ARROW]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(keys.view(np.int64)), pa.array(ids.view(np.int64))], names=[*LINE_ARROW.names, "k", "kid"])

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "part").select("part", "alone", "known", "lines").mapInArrow(run, LINE + ", k long, kid long")


def line_table(docs: DataFrame, min_words: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(lines, keys). Lines: (doc_key, doc_id, line_no, id, fp, chars), all but the first three of the normalised line.

    ``id`` is a hash of the normalised line and ``fp`` the SimHash of its ``content_words``.
    Lines without a letter or digit have no id and are never repeated content.
    Keys: (k, id), the keys of SimHash blocks (``block_rows``) that lines share; those under
    ``min_words`` words have none. Both come from one pass, as rows of many lines and keys.
    """
    parts = key_parts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        sent = 0

        def deal() -> pa.RecordBatch:
            keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            rows = dealt_keys(keys, ids, parts, tile)
            return rows.append_column("lines", pa.nulls(rows.num_rows, pa.binary()))

        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py() or ""))
                size += len(rows[-1][2])
                if size >= CHARS or i == batch.num_rows - 1:
                    lines, keys, ids = line_rows(*map(list, zip(*rows, strict=True)), min_words)
                    held.append((keys, ids))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, lines.schema) as out:
                        out.write_batch(lines)
                    sent += 1
                    place = (rows[0][0] + sent) % parts  # anywhere
                    yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "alone", "known", "lines"])
                    rows, size = [], 0
                    if sum(len(x[0]) for x in held) >= HELD_KEYS:
                        yield deal()
        if held:
            yield deal()

    dealt = docs.select(text_key(docs).alias("doc_key"), F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DEALT + ", lines binary")
    both = stage(met(dealt), "lines")
    return both.where("k is null").drop("k", "kid"), both.where("k is not null").select("k", F.col("kid").alias("id"))


def near_pairs(fps: np.ndarray, chars: np.ndarray, bucket: np.ndarray, side: np.ndarray, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a < b) of one bucket (sorted) that may be similar; of tiles 1 and 2 only across.

    At most ``radius`` bits of their SimHashes as a whole differ, and their lengths leave
    room for the similarity. Row i meets row i + 1, then i + 2, and so on while its bucket
    lasts, all rows at a time; pairs further apart come later.
    """
    if not len(fps):
        return
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    sizes = np.diff(np.append(starts, len(bucket)))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(bucket)) - 1  # rows after each in its bucket
    rows = np.flatnonzero(left)
    step = 1
    while len(rows):
        near = (np.bitwise_count(fps[rows] ^ fps[rows + step]) <= np.where(chars[rows] < SHORT_CHARS, max(radius, SHORT_RADIUS), radius)) & ((side[rows] != side[rows + step]) | (side[rows] == 0))
        a = rows[near]
        a = a[long_enough(chars[a], chars[a + step], similarity)]
        if len(a):
            yield a, a + step
        step += 1
        rows = rows[left[rows] >= step]


def shared_keys(nodes: DataFrame, tile: int) -> DataFrame:
    """(k, id): the keys in ``blocks`` of ``nodes`` that more than one of them has.

    Keys of more than ``tile`` lines never gather in one task (``dealt_keys``).
    """
    parts = key_parts(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(1)
            ids = np.repeat(batch.column(0).to_numpy(), blocks.value_lengths().fill_null(0).to_numpy())
            yield dealt_keys(blocks.flatten().to_numpy().view(np.uint64), ids.view(np.uint64), parts, tile)

    dealt = nodes.select("id", "blocks").mapInArrow(run, DEALT).withColumn("lines", F.lit(None).cast("binary"))
    return met(dealt).select("k", F.col("kid").alias("id"))


def block_hits(nodes: DataFrame, keys: DataFrame, radius: int, similarity: float, tile: int) -> DataFrame:
    """(bucket, side, id, fp, chars, partner): the lines that share a block with one that may be similar.

    ``partner`` is the first such line of the bucket, null for the first itself, so the pairs
    (partner, id) hold a bucket's likely groups together with at most one pair to a line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches, "bucket"):
            bucket, side, ids, fps, chars = (table.column(c).to_numpy() for c in ("bucket", "side", "id", "fp", "chars"))
            hit, partner = np.zeros(len(ids), bool), np.full(len(ids), -1)
            for a, b in near_pairs(fps.view(np.uint64), chars, bucket, side, radius, similarity):
                hit[a] = hit[b] = True
                partner[b] = a  # steps grow, so the first row of all stays
            if hit.any():
                named = pa.array(ids[partner], mask=partner < 0)
                yield from table.append_column("partner", named).filter(pa.array(hit)).to_batches()

    keyed = tiled(keys, ["id"], tile, "lines").join(nodes.select("id", "fp", "chars").hint("shuffle_hash"), "id").select("bucket", "side", "id", "fp", "chars")
    schema = T.StructType([*keyed.schema.fields, T.StructField("partner", T.LongType())])
    return keyed.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(run, schema)


def representative_texts(ids: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, norm) for ``ids(id)``: the normalised line, cut from the document of its first occurrence."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(1).flatten()
            named, numbers, ends = places.field("id").to_pylist(), places.field("line_no").to_pylist(), np.cumsum(batch.column(1).value_lengths().to_numpy()).tolist()
            ids, found, size = [], [], 0
            for i, end in enumerate(ends):
                lines, at = (batch.column(0)[i].as_py() or "").split("\n"), ends[i - 1] if i else 0
                ids += named[at:end]
                found += [lines[no] for no in numbers[at:end]]
                size += sum(map(len, found[len(found) - (end - at) :]))
                if size >= CHARS or i == len(ends) - 1:
                    norm = [" ".join(x.split()) for x in words_only("\n".join(found)).decode("utf-8", "surrogatepass").split("\n")]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(norm, pa.string())], names=["id", "norm"])
                    ids, found, size = [], [], 0

    wanted = ids.select(F.col("id").alias("wi"))
    places = nodes.join(wanted.hint("shuffle_hash"), F.col("id") == F.col("wi")).select("id", F.col("first.doc_key").alias("wk"), F.col("first.line_no").alias("line_no"))
    per_doc = places.groupBy("wk").agg(F.collect_list(F.struct("id", "line_no")).alias("at"))
    own = docs.select(text_key(docs).alias("doc_key"), F.col("text").cast("string").alias("text"))
    return own.join(per_doc.hint("shuffle_hash"), F.col("doc_key") == F.col("wk")).select("text", "at").mapInArrow(cut, "id long, norm string").dropDuplicates(["id"])


def similar_pairs(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose lines are edit-similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield batch.select(["a", "b"]).filter(pa.array(similar_many(one, two, similarity)))

    one, two = (texts.select(F.col("id").alias(f"i{c}"), F.col("norm").alias(f"n{c}")) for c in "ab")
    return pairs.join(one, F.col("a") == F.col("ia")).join(two, F.col("b") == F.col("ib")).select("a", "b", "na", "nb").mapInArrow(run, LINK)


def unsettled(hits: DataFrame, radius: int, similarity: float) -> DataFrame:
    """The rows of ``hits`` with ``part`` that may be similar to one of another part, their partner aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches, "bucket"):
            bucket, side, ids, fps, chars, part = (table.column(c).to_numpy() for c in ("bucket", "side", "id", "fp", "chars", "part"))
            partner = table.column("partner").fill_null(0).to_numpy()
            known = table.column("partner").is_valid().to_numpy()
            left = np.zeros(len(ids), bool)
            for a, b in near_pairs(fps.view(np.uint64), chars, bucket, side, radius, similarity):
                open_ = (part[a] != part[b]) & ~(known[b] & (partner[b] == ids[a]))
                left[a[open_]] = left[b[open_]] = True
            if left.any():
                yield from table.filter(pa.array(left)).to_batches()

    return hits.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(run, hits.schema)


def links_across(rows: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Edges between edit-similar lines of a bucket whose parts differ.

    A pair that its bucket has connected already is not compared, which loses no connection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches, "bucket", 1 << 12):
            bucket, side, ids, fps, chars, part = (table.column(c).to_numpy() for c in ("bucket", "side", "id", "fp", "chars", "part"))
            norm = table.column("norm").to_pylist()
            grams = gram_counts(norm)
            parent: dict[int, int] = {}

            def find(i: int) -> int:
                while (up := parent.get(i, i)) != i:
                    parent[i] = parent.get(up, up)
                    i = up
                return i

            out: list[tuple[int, int]] = []

            def compare(pairs: list[tuple[int, int]]) -> None:
                """Links of those pairs whose parts aren't connected yet."""
                pairs = [(i, j) for i, j in pairs if find(int(part[i])) != find(int(part[j]))]
                ok = similar_many([norm[i] for i, _ in pairs], [norm[j] for _, j in pairs], similarity)
                for (i, j), linked in zip(pairs, ok.tolist(), strict=True):
                    p, q = find(int(part[i])), find(int(part[j]))
                    if linked and p != q:
                        parent[max(p, q)] = min(p, q)
                        out.append((int(part[i]), int(part[j])))

            held: list[tuple[int, int]] = []
            for a, b in near_pairs(fps.view(np.uint64), chars, bucket, side, radius, similarity):
                ok = part[a] != part[b]
                a, b = a[ok], b[ok]
                ok = within_reach(grams[a], grams[b], np.maximum(chars[a], chars[b]), similarity)
                held += zip(a[ok].tolist(), b[ok].tolist(), strict=True)
                if len(held) >= 4096:
                    compare(held)
                    held = []
            compare(held)
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, long work: parts aren't to be joined
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "id").mapInArrow(run, LINK).distinct()


def line_roots(nodes: DataFrame, keys: DataFrame, docs: DataFrame, radius: int, similarity: float, tile: int) -> DataFrame:
    """(node, root) of every line of ``nodes`` that is linked to another.

    First each line is verified against its partner in every bucket, which joins most of a
    group of any size with a few pairs to a line; then the lines of a bucket that this left in
    different parts are compared with each other.
    """
    hits = stage(block_hits(nodes, keys, radius, similarity, tile), "line-hits")
    texts = stage(representative_texts(hits.select("id").distinct(), nodes, docs), "line-texts")
    pairs = hits.where("partner is not null").select(F.least("id", "partner").alias("a"), F.greatest("id", "partner").alias("b")).distinct()
    parts = connected_components(similar_pairs(pairs, texts, similarity), "line-parts")
    placed = hits.join(parts, F.col("id") == F.col("node"), "left").select(*hits.columns, F.coalesce("root", "id").alias("part"))
    left = stage(unsettled(placed, radius, similarity), "line-unsettled")
    if left.isEmpty():
        return parts
    dealt = left.drop("partner").join(texts.withColumnRenamed("id", "i"), F.col("id") == F.col("i")).drop("i")
    merged = connected_components(links_across(dealt, radius, similarity), "line-merged").select(F.col("node").alias("old"), F.col("root").alias("new"))
    own = parts.unionByName(left.join(parts, F.col("id") == F.col("node"), "left_anti").select(F.col("id").alias("node"), F.col("id").alias("root")).distinct())
    moved = own.join(merged, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return moved


def line_groups(docs: DataFrame, min_words: int = 5, radius: int = 20, similarity: float = 0.8, tile: int = 512) -> DataFrame:
    """(doc_key, doc_id, line_no, id, root, kept) for every line with a letter or digit.

    Equal normalised lines are one node, whatever their length and wherever they stand. Nodes
    of ``min_words`` or more words that share a SimHash block, and whose SimHashes as a whole
    differ in at most ``radius`` bits (short ones in SHORT_RADIUS), are compared, and linked where their
    edit similarity is ``similarity`` or more in characters. What is compared doesn't depend on the number of lines. Of each connected group the occurrence with the smallest (doc_id,
    document key, line number) is kept; a null doc_id comes first. ``id`` and ``fp`` together
    name a line, so two lines whose ids collide stay apart.
    """
    lines, keys = line_table(docs, min_words, tile)
    occurrence = F.struct(F.col("doc_id"), F.col("doc_key"), F.col("line_no"))
    nodes = stage(lines.where("id is not null").groupBy("id", "fp").agg(F.min(occurrence).alias("first"), F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n")), "line-nodes")
    roots = line_roots(nodes, keys, docs, radius, similarity, tile)
    rooted = stage(nodes.drop("chars").join(roots.hint("shuffle_hash"), F.col("id") == F.col("node"), "left").select("id", "fp", "first", "n", F.coalesce("root", "id").alias("root"), F.col("root").isNotNull().alias("linked")).where("linked or n > 1"), "line-rooted")
    firsts = rooted.where("linked").groupBy("root").agg(F.min("first").alias("group_first")).select(F.col("root").alias("r"), "group_first")
    repeated = stage(rooted.join(firsts, F.col("linked") & (F.col("root") == F.col("r")), "left").select(F.col("id").alias("g"), F.col("fp").alias("gf"), "root", F.coalesce("group_first", "first").alias("group_first")), "line-repeated")
    same = (F.col("id") == F.col("g")) & (F.col("fp") == F.col("gf"))
    return lines.where("id is not null").join(repeated.hint("shuffle_hash"), same, "left").select("doc_key", "doc_id", "line_no", "id", F.coalesce("root", "id").alias("root"), (F.col("group_first").isNull() | (F.col("group_first") == occurrence)).alias("kept"))


def dedup_lines(docs: DataFrame, min_words: int = 5, radius: int = 20, similarity: float = 0.8) -> DataFrame:
    """``docs`` with extra columns __dropped and a ``text`` that keeps one occurrence of each group.

    Lines are what \\n separates. A document keeps its other lines as they were, in order; it
    may end up empty but never goes. Null texts stay null. Rows equal in doc_id and text are
    one occurrence: what one keeps, all keep. An empty table gives no rows; other columns are
    carried.
    """
    groups = line_groups(docs, min_words, radius, similarity)
    dropped = stage(groups.where("not kept").select("doc_key", "line_no").distinct().groupBy(F.col("doc_key").alias("__key")).agg(F.collect_set("line_no").alias("__lines")), "line-dropped")
    held = docs.withColumn("__doc_key", text_key(docs)).join(dropped.hint("shuffle_hash"), F.col("__doc_key") == F.col("__key"), "left")
    held = held.withColumn("__parts", F.when(F.col("__key").isNotNull(), F.split(F.col("text").cast("string"), "\n", -1)))  # a column of its own: it is cut once
    stay = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), F.col("__lines"))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col("__parts"), i)), "\n")
    return held.withColumn("text", F.when(F.col("__key").isNull(), F.col("text").cast("string")).otherwise(left)).withColumn("__dropped", F.coalesce(F.size("__lines"), F.lit(0))).drop("__doc_key", "__key", "__lines", "__parts")
