"""Best-fit packing by a configuration linear program over the length histogram (operator 2)."""

from __future__ import annotations

import math
import re
import struct
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.ranking import bucketed_rank
from lodestar.llm.staging import stage

ROUNDS, BIAS = 1500, 1.3
#: words that the tokenizer's normalizer leaves as they are and its pre-tokenizer cuts into just these pieces: small letters of
#: Latin-1, digits, signs. Words with "'" aren't among them, for it has pieces of its own for 's and the like.
LETTERS, SIGNS = "a-zß-öø-ÿ", r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(f"[{LETTERS}0-9{SIGNS}]+")
PIECES = re.compile(f"[{LETTERS}]+|[0-9]|[{SIGNS}]+")
#: how the tokenizer writes bytes: the printable ones as they are, the others as signs from 256 on
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
HIDDEN = [b for b in range(256) if b not in SHOWN]
#: each Latin-1 character as the signs of its UTF-8
AS_SIGNS = ["".join(chr(b if b in SHOWN else 256 + HIDDEN.index(b)) for b in chr(c).encode()) for c in range(256)]
PIECE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
PLAN = T.StructType([T.StructField(c, T.LongType()) for c in ("p_length", "first_rank", "end_rank", "per_sequence", "first_sequence", "p_offset")])


class WordIds(dict):
    """A word's UTF-8 to its token ids as little-endian unsigned 32-bit bytes, filled on demand.

    The tokenizer lowers letters, drops white space and never joins across it, so a text's ids
    are its words' ids in order; a full stop or comma after a letter is a word of its own to
    it. The table is emptied when it is full, which bounds memory and changes no result.
    """

    LIMIT, TOGETHER = 400_000, 4096

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model = tokenizer.encode, tokenizer.model
        self.pieces: dict[str, bytes] = {}
        # only for a tokenizer that is known to cut as PIECES does
        probe = "straße12,x<_> été&&&q"
        self.cuts = sys.byteorder == "little" and array("I").itemsize == 4 and b"".join(map(self.plain_ids, probe.split())) == self.ids(probe)

    def ids(self, text: str) -> bytes:
        own = self.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(own)}I", *own)

    def piece_ids(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.translate(AS_SIGNS)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def plain_ids(self, word: str) -> bytes:
        """The ids of a word of PLAIN, by the tokenizer's model alone."""
        if word.isalpha():
            return self.piece_ids(word)
        out = []
        for piece in PIECES.findall(word):
            found = self.pieces.get(piece)
            if found is None:
                found = self.piece_ids(piece)
                if len(piece) <= 2:
                    self.pieces[piece] = found
            out.append(found)
        return b"".join(out)

    def learn(self, words: set[bytes]) -> None:
        """Take up all of ``words`` that are new.

        Words of PLAIN go to the model, which costs a third of a call of the tokenizer; others go many to a call,
        whose offsets tell which ids are whose.
        """
        new = words.difference(self)
        if len(self) + len(new) > self.LIMIT:
            self.clear()
            new = words
        others = []
        for w in new:
            if len(w) > 64 or b"<|" in w:
                continue
            text = w.decode("utf-8", "surrogatepass")
            if self.cuts and PLAIN.fullmatch(text):
                self[w] = self.plain_ids(text)
            else:
                others.append(w)
        for lo in range(0, len(others), self.TOGETHER):
            part = others[lo : lo + self.TOGETHER]
            texts = [w.decode("utf-8", "surrogatepass") for w in part]
            found = self.encode("\n".join(texts), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
            at = np.searchsorted(np.array([o[0] for o in found.offsets], np.int64), begins) * 4
            self.update(zip(part, (ids[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), strict=True))

    def __missing__(self, word: bytes) -> bytes:
        if word[-1:] in (b".", b",") and word[-2:-1].isalpha() and (stem := self.get(word[:-1])) is not None:
            found = stem + self[word[-1:]]
        else:
            text = word.decode("utf-8", "surrogatepass")
            found = self.plain_ids(text) if self.cuts and len(word) <= 64 and b"<|" not in word and PLAIN.fullmatch(text) else self.ids(text)
        if len(word) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = found
        return found


_TABLES: dict[str, WordIds] = {}


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def document_ids(texts: list[str | None], table: WordIds) -> Iterator[bytes]:
    """For each text all its ids, then id 0, as little-endian unsigned 32-bit bytes."""
    special = [bool(t) and "<|" in t for t in texts]  # it may hold special tokens, which are told by case
    words = [[] if own or not t else t.encode("utf-8", "surrogatepass").lower().split() for t, own in zip(texts, special, strict=True)]
    # words of other scripts need the tokenizer, which is called for many at once; others are taken up as they come
    table.learn(set().union(*[w for t, w in zip(texts, words, strict=True) if w and not (table.cuts and latin(t))]))
    for t, own, w in zip(texts, special, words, strict=True):
        yield (table.ids(t) if own else b"".join(map(table.__getitem__, w))) + b"\0\0\0\0"


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents cut into pieces of ``capacity`` ids.

    ``tokenizer`` is the path of a vocabulary file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TABLES:
            _TABLES[tokenizer] = WordIds(tokenizer)
        table = _TABLES[tokenizer]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), document_ids(part.column(1).to_pylist(), table), strict=True):
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=PIECE.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def best_configuration(price: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths within ``capacity`` with the largest summed price.

    ``price[l]`` is the price of length l, -inf where there is none. An unbounded-knapsack table
    over the capacity: best[c] = max over l of best[c - l] + price[l].
    """
    best = np.zeros(capacity + 1)
    choice = [0] * (capacity + 1)
    backwards = price[::-1]
    for c in range(1, capacity + 1):
        total = best[:c] + backwards[capacity - c : capacity]  # entry i: a piece of c - i on top of best[i]
        i = int(total.argmax())  # of equal values the longest piece, so that short ones stay for gaps
        if total[i] >= best[c - 1]:
            best[c], choice[c] = total[i], c - i
        else:
            best[c] = best[c - 1]
    out: dict[int, int] = defaultdict(int)
    c = capacity
    while c > 0:
        if choice[c]:
            out[choice[c]] += 1
        c -= choice[c] or 1
    return out


def fractional_cover(counts: dict[int, int], capacity: int, rounds: int = ROUNDS, rate: float = 0.5) -> list[tuple[dict[int, int], float]]:
    """Configurations with fractional amounts that cover the histogram: multiplicative weights.

    Prices start at each length's share of a sequence, a little more for long pieces, since
    short ones fit anywhere later. Every round prices a configuration with
    the knapsack table, takes half of what its scarcest length still allows, and shrinks the
    prices of the lengths by the covered fraction, so that no length is left for the end. It
    stops when one item per length is left on average, or after ``rounds``.
    """
    left = {l: float(n) for l, n in counts.items()}
    price = {l: (l / capacity) ** BIAS for l in counts}
    taken: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    for _ in range(rounds):
        live = sorted(l for l, n in left.items() if n >= 1)
        if not live or sum(left[l] for l in live) <= len(counts):
            break
        priced = np.full(capacity + 1, -np.inf)
        priced[live] = [price[l] for l in live]
        chosen = best_configuration(priced, capacity)
        most = min(left[l] / a for l, a in chosen.items())
        if most < 1:  # more of a length than is left: the configuration of what there is
            chosen = {l: min(a, int(left[l])) for l, a in chosen.items()}
            most = min(left[l] / a for l, a in chosen.items())
        amount = most / 2 if most >= 4 else float(int(most))
        taken[tuple(sorted(chosen.items()))] += amount
        for l, a in chosen.items():
            left[l] -= a * amount
            price[l] *= (1 - rate * l / capacity) ** (a * amount / counts[l])
    return [(dict(c), x) for c, x in taken.items()]


def dual_bound(counts: dict[int, int], capacity: int, rounds: int, rate: float = 0.05) -> float:
    """A lower bound on the program by multiplicative weights on the prices.

    Any prices bound it: all pieces cost their summed prices, and no sequence is worth more
    than the dearest configuration. The first prices are the lengths; every round lowers those
    of the dearest configuration, by a step that covers none of its lengths more than once.
    """
    lengths = np.array(sorted(counts))
    number = np.array([counts[l] for l in lengths.tolist()], np.float64)
    price, bound = lengths / capacity, 0.0
    for _ in range(rounds):
        priced = np.full(capacity + 1, -np.inf)
        priced[lengths] = price
        chosen = best_configuration(priced, capacity)
        bound = max(bound, float(price @ number) / sum(priced[l] * a for l, a in chosen.items()))
        step = min(counts[l] / a for l, a in chosen.items())
        for l, a in chosen.items():
            price[np.searchsorted(lengths, l)] *= math.exp(-rate * a * step / counts[l])
    return bound


def best_fit(counts: dict[int, int], capacity: int, open_bins: dict[tuple[tuple[int, int], ...], int] | None = None) -> dict[tuple[tuple[int, int], ...], int]:
    """Best-fit decreasing on a histogram: equal bins are one entry (their content, their number)."""
    bins: dict[int, dict[tuple[tuple[int, int], ...], int]] = defaultdict(lambda: defaultdict(int))
    for content, n in (open_bins or {}).items():
        bins[capacity - sum(l * a for l, a in content)][content] += n
    for l in sorted(counts, reverse=True):
        n = counts[l]
        for room in sorted(r for r in bins if r >= l):
            if not n:
                break
            for content in sorted(bins[room]):
                if not n:
                    break
                for fit, k in ((room // l, min(bins[room][content], n // (room // l))), (n % (room // l), 1)):
                    if fit and k and bins[room].get(content, 0) >= k and n >= fit * k:
                        bins[room][content] -= k
                        merged = dict(content)
                        merged[l] = merged.get(l, 0) + fit
                        bins[room - fit * l][tuple(sorted(merged.items()))] += k
                        n -= fit * k
                        if fit < room // l:
                            break
                if not bins[room].get(content):
                    bins[room].pop(content, None)
        fit = capacity // l
        if n >= fit:
            bins[capacity - fit * l][((l, fit),)] += n // fit
        if n % fit:
            bins[capacity - n % fit * l][((l, n % fit),)] += 1
    out: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)
    for group in bins.values():
        for content, k in group.items():
            if k:
                out[content] += k
    return out


def plan_sequences(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], int]:
    """(configuration, number of sequences) that pack the whole histogram, and the least number that any packing needs.

    The linear program's amounts are rounded down; what that leaves is packed best-fit, first
    into the room that the rounded sequences have left. Where best-fit alone needs fewer
    sequences than that, it is the plan. The summed lengths bound the number from below, and
    where the plan is above that, the program's prices do.
    """
    full = counts.get(capacity, 0)
    rest = {l: n for l, n in counts.items() if 0 < l < capacity and n}
    whole: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)
    left = dict(rest)
    for config, amount in fractional_cover(rest, capacity, rounds) if rest else ():
        n = min([int(amount + 1e-9), *(left[l] // a for l, a in config.items())])
        if n > 0:
            whole[tuple(sorted(config.items()))] += n
            for l, a in config.items():
                left[l] -= a * n
    packed = min(best_fit({l: n for l, n in left.items() if n}, capacity, whole), best_fit(rest, capacity), key=lambda bins: sum(bins.values()))
    least = -(-sum(l * n for l, n in rest.items()) // capacity)
    if least < sum(packed.values()):
        least = max(least, math.ceil(dual_bound(rest, capacity, rounds // 5) - 1e-6))
    return ([({capacity: 1}, full)] if full else []) + [(dict(c), n) for c, n in sorted(packed.items())], full + least


def plan_rows(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, ...]]:
    """The plan as ranges of ranks: which sequence and offset the r-th piece of a length gets."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for config, n in plan:
        offset = 0
        for l, a in sorted(config.items(), reverse=True):
            rows.append((l, used[l], used[l] + a * n, a, sequence, offset))
            used[l] += a * n
            offset += a * l
        sequence += n
    return rows


def place(pieces: DataFrame, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """Add (sequence_id, offset) to ``pieces(doc_id, piece, start, length, ...)``.

    Only the histogram of lengths (at most ``capacity`` numbers) reaches the driver. The plan
    that comes back has a row for each length of each configuration; their number is bounded by
    the histogram, not by the pieces. Pieces are ranked within their length in hashed parts, so
    a length that a third of all pieces share is spread over many tasks.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows = plan_rows(plan_sequences(counts, capacity, rounds)[0])
    total = sum(counts.values())
    parts = max(64, -(-total // 200_000))
    ranked = bucketed_rank(pieces, ["length"], F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(parts)), [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")], "rank")
    plan = pieces.sparkSession.createDataFrame(rows, PLAN)
    if len(rows) <= 500_000:  # about 25 MB
        plan = F.broadcast(plan)
    placed = ranked.join(plan, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    at = F.col("rank") - F.col("first_rank")
    return placed.select(*pieces.columns, (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"), (F.col("p_offset") + F.pmod(at, F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for all of ``docs(doc_id, text)``.

    A document is its token ids and an id 0; only documents over ``capacity`` are cut. Null and
    empty texts are the id 0 alone. A null doc_id is carried as null, repeated rows are packed
    as often as they come, and an empty table gives no rows. Other columns are not read.
    """
    return place(stage(tokenized_pieces(docs, tokenizer, capacity), "pack-pieces"), capacity, rounds)
