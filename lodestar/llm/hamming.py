"""Links between 64-bit fingerprints within a small Hamming radius.

Pigeonhole blocks bring fingerprints together; inside a bucket they are compared bit-sliced.
The members are stored vertically, one machine word per bit plane, 64 members to a word. A
query's difference to all 64 at once is counted plane by plane in carry-save bitwise counters,
and a (query, word) pair is abandoned as soon as every lane has passed the radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.staging import stage

LANES = 64
PAIR_CHUNK = 1 << 14
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


#: For every byte its eight bits, each in a byte of its own: sums of up to 255 of them don't carry over.
LANE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def majority_bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fingerprints of segments of ``hashes``: a bit is 1 if set in over half of a segment.

    ``starts`` holds the first index of every segment; an empty segment gives 0. Segments are
    counted in bit-sliced carry-save counters, those with counters of one width together;
    long ones by ``long_majority``.
    """
    sizes = np.append(starts[1:], len(hashes))[: len(starts)] - starts
    out = np.zeros(len(starts), np.uint64)
    least = 1
    for planes in range(1, 8):
        most = 2 ** (planes + 1) - 1
        rows = np.flatnonzero((sizes >= least) & (sizes <= most))
        if len(rows):
            out[rows] = carry_save(hashes, starts[rows], sizes[rows], planes)
        least = most + 1
    for row in np.flatnonzero(sizes >= least).tolist():
        out[row] = long_majority(hashes[starts[row] : starts[row] + sizes[row]])
    return out


def carry_save(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, planes: int) -> np.ndarray:
    """Majority bits of non-empty segments of fewer than 2 ** (planes + 1) hashes.

    The 64 counters of a segment lie across ``planes`` words. They begin so high that one more
    than half of the segment carries out of the last.
    """
    order = np.argsort((255 - sizes).astype(np.uint8), kind="stable")  # bytes are sorted in one pass
    first, size = starts[order], sizes[order]
    bias = (1 << planes) - (size // 2 + 1)
    counter = [np.where(bias >> i & 1, ALL, np.uint64(0)) for i in range(planes)]
    over = np.zeros(len(first), np.uint64)
    live = np.searchsorted(-size, -np.arange(size[0]), "left")  # segments that are longer than 0, 1, 2, ...
    for p, m in enumerate(live.tolist()):
        carry = hashes[first[:m] + p]
        for plane in counter:
            more = plane[:m] & carry
            plane[:m] ^= carry
            carry = more
        over[:m] |= carry
    out = np.empty_like(over)
    out[order] = over
    return out


def long_majority(hashes: np.ndarray) -> np.uint64:
    """Majority bits of one long segment: eight to a word in runs of at most 255 hashes, which bounds memory."""
    sums = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        lanes = LANE_BITS[part.astype("<u8").view(np.uint8).reshape(-1, 8)]
        sums += np.add.reduceat(lanes, np.arange(0, len(part), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(sums * 2 > len(hashes), bitorder="little").view("<u8")[0]


def pigeonhole(n: int, bits: int, radius: int, per_bucket: int = 256) -> tuple[int, int]:
    """(blocks, agreeing): the cheapest key family that is complete for ``radius``.

    Two values within the radius differ in at most ``radius`` blocks, so ``blocks - radius``
    blocks agree. More blocks make longer keys, chosen so that n uniform values leave about
    ``per_bucket`` to a key; the family never loses a pair, at any size.
    """
    for blocks in range(radius + 1, 2 * radius + 2):
        agreeing = blocks - radius
        if n <= per_bucket * 2 ** (bits * agreeing // blocks):
            break
    return blocks, agreeing


def _planes(fps: np.ndarray) -> np.ndarray:
    """(words, 64) bit planes of (words * 64) values: lane i of word w, plane j is bit j of value w*64+i."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, LANES, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def within_radius(fps: np.ndarray, groups: np.ndarray, radius: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield index pairs (i < j) of equal ``groups`` (sorted) whose values differ in 1..radius bits.

    With ``side`` (0 or 1 per row) only pairs across the two sides are compared, unless a group
    has one side only.
    """
    if not len(fps):
        return
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    sizes = np.diff(np.append(starts, len(groups)))
    words = -(-sizes // LANES)
    first_word = np.cumsum(words) - words
    rank = np.arange(len(fps)) - np.repeat(starts, sizes)
    slot = np.repeat(first_word * LANES, sizes) + rank
    row = np.full(int(words.sum()) * LANES, -1, np.int64)
    row[slot] = np.arange(len(fps))
    padded = np.zeros(len(row), np.uint64)
    padded[slot] = fps
    planes = _planes(padded)
    live = np.packbits((row >= 0).reshape(-1, LANES), axis=1, bitorder="little").view("<u8")[:, 0]
    own_word = slot // LANES
    todo = np.repeat(first_word + words, sizes) - own_word  # words from a row's own to its group's last
    ends = np.cumsum(todo)
    order = np.arange(64)
    lo_row = 0
    while lo_row < len(fps):
        hi_row = max(lo_row + 1, int(np.searchsorted(ends, (ends[lo_row - 1] if lo_row else 0) + PAIR_CHUNK, "right")))
        q = np.repeat(np.arange(lo_row, hi_row), todo[lo_row:hi_row])
        w = own_word[q] + (np.arange(len(q)) - np.repeat(ends[lo_row:hi_row] - todo[lo_row:hi_row] - (ends[lo_row - 1] if lo_row else 0), todo[lo_row:hi_row]))
        lo_row = hi_row
        c0 = np.zeros(len(q), np.uint64)
        c1, c2, over = c0.copy(), c0.copy(), ~live[w]
        value = fps[q]
        for j in order:
            d = planes[w, j] ^ (np.uint64(0) - ((value >> np.uint64(j)) & np.uint64(1)))
            carry = c0 & d
            c0 ^= d
            d = c1 & carry
            c1 ^= carry
            over |= c2 & d
            c2 ^= d
            if j % 8 == 7:
                passed = over | _above(c0, c1, c2, radius)
                keep = passed != ALL
                if not keep.all():
                    q, w, value, over, c0, c1, c2 = (x[keep] for x in (q, w, value, passed, c0, c1, c2))
                if not len(q):
                    break
        if len(q):
            near = ~(over | _above(c0, c1, c2, radius)) & (c0 | c1 | c2)
            hit, lane = np.nonzero(np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = q[hit], row[w[hit] * LANES + lane]
            ok = b > a
            if side is not None:
                ok &= side[a] != side[b]
            if ok.any():
                yield a[ok], b[ok]


def _above(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit counter exceeds ``radius`` (0 to 7)."""
    out = np.zeros_like(c0)
    for v in range(radius + 1, 8):
        out |= (c0 if v & 1 else ~c0) & (c1 if v & 2 else ~c1) & (c2 if v & 4 else ~c2)
    return out


def smallest_label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Connected components of n local nodes: the smallest index reachable from each."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def key_masks(n: int, bits: int, radius: int) -> list[int]:
    """The bits of each pigeonhole key: one mask per choice of agreeing blocks."""
    blocks, agreeing = pigeonhole(n, bits, radius)
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    return [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen) for chosen in combinations(range(blocks), agreeing)]


def key_table(values: DataFrame, masks: list[int], tile: int, name: str) -> DataFrame:
    """(bucket, side, id, fp, ..., t): each row of ``values`` once per pigeonhole key, large buckets cut into tiles."""
    keys = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64)))) for t, m in enumerate(masks)]
    others = [c for c in values.columns if c not in ("id", "fp")]
    keyed = values.select("id", "fp", *others, F.posexplode(F.array(*keys)).alias("t", "k"))
    return tiled(keyed, ["fp", "id"], tile, name)


def tiled(keyed: DataFrame, salt: list[str], tile: int, name: str) -> DataFrame:
    """(bucket, side, ...): the rows of ``keyed``, those of a key ``k`` in one bucket, large buckets cut into tiles.

    A bucket of more than ``tile`` members is split by hash of ``salt`` into t tiles and becomes
    the t(t+1)/2 pairs of tiles, so one task never holds more than about two tiles of it while
    every pair of members still meets in one place.
    """
    kept = [c for c in keyed.columns if c != "k"]
    large = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    large = stage(large.select(F.col("k").alias("bk"), F.ceil(F.col("n") / tile).cast("int").alias("tiles")), f"{name}-sizes")
    if large.count() <= 250_000:  # about 5 MB
        large = F.broadcast(large)
    joined = keyed.join(large, F.col("k") == F.col("bk"), "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    joined = joined.withColumn("own", F.pmod(F.xxhash64(*salt), F.col("tiles")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    spread = joined.select(*kept, "k", "own", F.explode(pair).alias("p"))
    bucket = F.when((F.col("p.i") == 0) & (F.col("p.j") == 0), F.col("k")).otherwise(F.xxhash64("k", "p.i", "p.j"))
    side = F.when(F.col("p.i") == F.col("p.j"), F.lit(0)).when(F.col("own") == F.col("p.i"), F.lit(1)).otherwise(F.lit(2))
    return spread.select(bucket.alias("bucket"), side.cast("int").alias("side"), *kept)


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def whole_buckets(batches: Iterator[pa.RecordBatch], column: str, hold: int = 1 << 15) -> Iterator[pa.Table]:
    """Re-cut a sorted stream so that every yielded table ends where a bucket ends."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < hold:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(column).to_numpy()
        cut = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def hamming_links(values: DataFrame, n: int, radius: int = 4, bits: int = 64, tile: int = 512, name: str = "simhash") -> DataFrame:
    """Edges (a, b) that connect the ids of ``values(id, fp)`` as Hamming links within ``radius`` do.

    All pairs that share a pigeonhole key are compared; of a bucket's links only a spanning
    forest leaves the task, which keeps every connection and at most one edge per member.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches, "bucket"):
            fps = table.column("fp").to_numpy().view(np.uint64)
            ids, group, side = (table.column(c).to_numpy() for c in ("id", "bucket", "side"))
            found = list(within_radius(fps, group, radius, np.where(side == 0, np.arange(len(side)) + 3, side)))
            if not found:
                continue
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            label = smallest_label(len(ids), a, b)
            rows = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[label[rows]]), pa.array(ids[rows])], names=["a", "b"])

    dealt = key_table(values.select("id", "fp"), key_masks(n, bits, radius), tile, name).drop("t").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(compare, LINK).distinct()
