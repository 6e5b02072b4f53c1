"""Ranked lexical search: compressed postings per shard, document-at-a-time merge, global merge (operator 12)."""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.staging import stage

#: UTF-8 bytes of text after which a shard is closed, and rows after which it is closed at the latest
SHARD_BYTES, SHARD_ROWS = 16 << 20, 1 << 17
#: distinct (item, term) pairs whose weights one pass over the index takes along
BLOCK_TERMS = 1 << 18
NO_ID = (1 << 63) - 1
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SHARD = "docs long, terms long, ids binary, sizes binary, term array<binary>, df array<int>, ends array<int>, postings binary"
SHARD_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
FOUND = "item long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of everything beyond ASCII, only A-Z lower-cased."""
    return TERM.findall(text.encode().translate(LOWER)) if text else []


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative longs as bytes of seven bits, the last byte of a number under 128; and each number's width."""
    v = values.astype(np.uint64)
    width = np.ones(len(v), np.int64)
    for i in range(1, 10):
        width += v >> np.uint64(7 * i) > 0
    ends = np.cumsum(width)
    out = np.empty(int(ends[-1]) if len(v) else 0, np.uint8)
    for i in range(int(width.max(initial=0))):
        rows = width > i
        more = (width[rows] > i + 1).astype(np.uint8) << 7
        out[(ends - width)[rows] + i] = (v[rows] >> np.uint64(7 * i) & np.uint64(127)).astype(np.uint8) | more
    return out, width


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers of ``packed``."""
    if not len(data):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(data < 128)[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, np.diff(first, append=len(data)))
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first).astype(np.int64)


def shard_row(ids: list[int], found: list[np.ndarray], number: dict[bytes, int]) -> tuple:
    """One shard: its documents by doc_id, and for each term gaps of document places and counts, all packed.

    ``found`` holds each document's terms in the numbers of ``number``. ``postings`` has for every term
    in turn its gaps (the first counted from -1), then its counts; ``ends`` says where each term's part ends.
    """
    order = sorted(range(len(ids)), key=ids.__getitem__)
    sizes = np.array([len(found[i]) for i in order], np.int64)
    flat = np.concatenate([found[i] for i in order]).astype(np.int64)
    pairs, counts = np.unique(flat * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    term, place = pairs // len(ids), pairs % len(ids)
    begins = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(begins, append=len(term))
    gaps = np.diff(place, prepend=0)
    gaps[begins] = place[begins] + 1
    # gaps and counts of a term stand one behind the other
    at = np.arange(len(term)) + np.repeat(begins, df)
    both = np.empty(2 * len(term), np.int64)
    both[at], both[at + np.repeat(df, df)] = gaps, counts
    data, width = packed(both)
    ends = np.cumsum(width)[2 * (begins + df) - 1]
    own = np.array([ids[i] for i in order], np.int64)
    steps = packed(np.diff(own, prepend=own[:1]))[0]
    return (len(ids), int(sizes.sum()), own[:1].tobytes() + steps.tobytes(), packed(sizes)[0].tobytes(), list(number), df.tolist(), ends.tolist(), data.tobytes())


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index as a stage table of shards, one row each: every term of every document that has one.

    A shard holds consecutive documents of an input partition with about ``shard_bytes`` of text
    (at least one document, at most 131,072), so nothing is shuffled and a row stays small.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        found: list[np.ndarray] = []
        number: dict[bytes, int] = {}
        held = 0

        def close() -> pa.RecordBatch:
            row = shard_row(ids, found, number)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, SHARD_TYPES, strict=True)], names=[c.split()[0] for c in SHARD.split(", ")])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                ids.append(NO_ID if doc is None else doc)
                found.append(np.fromiter((number.setdefault(t, len(number)) for t in terms), np.int32, len(terms)))
                held += sum(map(len, terms))
                if held >= shard_bytes or len(ids) >= SHARD_ROWS:
                    yield close()
                    ids, found, number, held = [], [], {}, 0
        if ids:
            yield close()

    return stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, SHARD), "search-index")


class Shard:
    """One shard while it is searched; postings are decoded to impacts when a query first asks for them."""

    def __init__(self, row: dict, weights: dict[bytes, int], documents: int, terms: int) -> None:
        first, steps = np.frombuffer(row["ids"], np.int64, 1)[0], np.frombuffer(row["ids"], np.uint8, offset=8)
        self.ids = first + np.cumsum(unpacked(steps))
        n = unpacked(np.frombuffer(row["sizes"], np.uint8))
        self.norm = 20 * (100 - 50 + (50 * n * documents) // terms)
        self.weights = weights
        self.data = np.frombuffer(row["postings"], np.uint8)
        self.where = {t: (e, d) for t, e, d in zip(row["term"], row["ends"], row["df"], strict=True) if t in weights}
        self.starts = dict(zip(row["term"], [0, *row["ends"]], strict=False))
        self.decoded: dict[bytes, tuple] = {}

    def postings(self, term: bytes) -> tuple[np.ndarray, np.ndarray, int] | None:
        """(places, impacts, largest impact), places ascending."""
        if term not in self.where:
            return None
        if term not in self.decoded:
            end, df = self.where[term]
            numbers = unpacked(self.data[self.starts[term] : end])
            places, tf = np.cumsum(numbers[:df]) - 1, numbers[df:]
            impact = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + self.norm[places]))
            self.decoded[term] = places, impact, int(impact.max())
        return self.decoded[term]


def search_shard(shard: Shard, terms: list[bytes], best: list[tuple[int, int]], k: int) -> None:
    """Put the shard's best documents for ``terms`` into the bounded heap ``best`` of (score, -doc_id).

    The cursors of the lists stand in a heap by document, and a document is scored when all its
    cursors are together. Lists whose largest impacts add up to less than the worst kept score can't lift a
    document into the heap alone: they are probed for documents that other lists bring.
    """
    lists = sorted((p for t in terms if (p := shard.postings(t)) and p[2] > 0), key=lambda p: p[2])
    if not lists:
        return
    bounds = np.cumsum([p[2] for p in lists]).tolist()
    places = [p[0] for p in lists]
    impacts = [p[1] for p in lists]

    def essential() -> int:
        """The first list that is merged; those before it are only probed."""
        return next((i for i, b in enumerate(bounds) if b >= best[0][0]), len(lists)) if len(best) == k else 0

    split = essential()
    cursors = [(int(places[i][0]), i, 0) for i in range(split, len(lists))]
    heapq.heapify(cursors)
    while cursors:
        place, score, whole = cursors[0][0], 0, True
        while cursors and cursors[0][0] == place:
            _, i, at = cursors[0]
            score += int(impacts[i][at])
            at += 1
            if at == len(places[i]):
                heapq.heappop(cursors)
            else:
                heapq.heapreplace(cursors, (int(places[i][at]), i, at))
        for i in range(split - 1, -1, -1):
            if len(best) == k and score + bounds[i] < best[0][0]:
                whole = False
                break
            at = int(places[i].searchsorted(place))
            if at < len(places[i]) and places[i][at] == place:
                score += int(impacts[i][at])
        if not whole or score == 0:
            continue
        entry = (score, -int(shard.ids[place]))
        if len(best) < k:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
        else:
            continue
        if (now := essential()) > split:
            # lists that have just become weak leave the merge
            split = now
            cursors = [c for c in cursors if c[1] >= split]
            heapq.heapify(cursors)


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item; rows with one item_id are one item."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(i, t) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([t for _, t in own], pa.binary())], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(task, "item_id long, term binary").distinct()


def search(index: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents of the index with a score above 0.

    Items go in blocks of about ``block_terms`` (item, term) pairs, chosen by a hash of the item; a
    block's terms and weights are all that the driver and the tasks hold of the queries, and each block is one pass over
    the index. A task keeps one heap of ``k`` for each item of the block over all its shards.

    Null texts, and those without a term, are no documents and no queries; rows with the same item_id
    (or with none) are one item with all their terms. Repeated doc_ids are documents of their own, and a null doc_id
    stands behind all others of its score (inside, it is the largest long). An empty index or an
    item without a match gives no rows.
    """
    spark = index.sparkSession
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    size = index.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    if not size["docs"]:
        return empty
    documents, words = int(size["docs"]), int(size["terms"])
    asked = stage(query_terms(items), "search-terms")
    blocks = max(1, math.ceil(asked.count() / block_terms))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    held = index.select(F.explode(F.arrays_zip("term", "df")).alias("t")).select("t.term", "t.df")
    wanted = asked.select("term").distinct()
    df = stage(held.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")), "search-frequencies")
    parts = []
    for block in range(blocks):
        weights, queries = {}, defaultdict(list)
        for r in asked.where(F.col("block") == block).join(df, "term").collect():
            term = bytes(r["term"])
            weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
            queries[r["item_id"]].append(term)
        if not queries:
            continue
        shared = spark.sparkContext.broadcast((weights, [(i, sorted(t)) for i, t in queries.items()]))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            weights, queries = shared.value
            best: list[list[tuple[int, int]]] = [[] for _ in queries]
            for b in batches:
                for i in range(b.num_rows):
                    shard = Shard(b.slice(i, 1).to_pylist()[0], weights, documents, words)
                    for (_, terms), heap in zip(queries, best, strict=True):
                        search_shard(shard, terms, heap, k)
            rows = [(item, -doc, score) for (item, _), heap in zip(queries, best, strict=True) for score, doc in heap]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

        parts.append(stage(index.mapInArrow(task, "item_id long, doc_id long, score long"), "search-found"))
    if not parts:
        return empty
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
