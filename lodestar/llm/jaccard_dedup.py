"""Near-duplicate documents by the exact Jaccard similarity of their word shingles (pipeline stage near_dedup).

Operator 4's fingerprints and MinHash bands propose candidates; every link is verified on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.components import connected_components
from lodestar.llm.hamming import LINK, hamming_links, tiled, whole_buckets
from lodestar.llm.simhash_dedup import fingerprints, shingle_hashes
from lodestar.llm.staging import stage
from lodestar.llm.words import P1, P2, P3

#: A pair at Jaccard 0.8 shares no band with a chance of (1 - 0.8 ** ROWS) ** BANDS, 3e-8.
BANDS, ROWS = 24, 3
DRAWN = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
SIGNATURE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("s", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    parts = list(shingle_hashes(text, words, 42))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band of a set's MinHash values; an empty set gives zeros."""
    if not len(hashes):
        return np.zeros(BANDS, np.uint64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for lo in range(0, len(hashes), 4096):
        part = hashes[lo : lo + 4096]
        least = np.minimum(least, ((part * (DRAWN[0][:, None] | np.uint64(1))) + DRAWN[1][:, None]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for m in least.reshape(BANDS, ROWS).T:
        key = (key ^ m) * P1
        key = (key ^ (key >> np.uint64(29))) * P2 + P3
    return key


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``similarity`` or more; two empty ones have 1."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared) - 1e-9


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, s, n, fp, keys) per row: a hash and the size of its shingle set, its fingerprint as operator 4 has it, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(1).to_pylist()
                sets = [shingle_set(x, words) for x in texts]
                fps = fingerprints(texts, words, 42).view(np.int64)
                s = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                keys = pa.array([band_keys(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array(np.array([len(x) for x in sets], np.int32)), pa.array(fps), keys], names=SIGNATURE.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SIGNATURE)


def fingerprint_pairs(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Candidate pairs (a, b) of nodes(id, fp): what operator 4 links, equal fingerprints with the smallest id of theirs."""
    firsts = stage(nodes.groupBy("fp").agg(F.min("id").alias("id")), "jaccard-prints")
    equal = nodes.join(firsts.select(F.col("fp").alias("f"), F.col("id").alias("a")), F.col("fp") == F.col("f")).select("a", F.col("id").alias("b"))
    return equal.where("a <> b").unionByName(hamming_links(firsts, firsts.count(), radius).select("a", "b"))


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, hashes): the shingle sets of ``wanted(doc_id, s)``, read again from one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, hashes = [], []
                for s, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    x = shingle_set(text, words)
                    if xxhash.xxh64_intdigest(x.tobytes()) == s & (1 << 64) - 1:  # a doc_id may stand on several texts
                        ids.append(s)
                        hashes.append(x.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["id", "hashes"])

    own = wanted.select(F.col("doc_id").alias("__want"), "s")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(own, F.col("doc_id") == F.col("__want")).select("s", "text")
    return texts.mapInArrow(run, "id long, hashes array<long>").dropDuplicates(["id"])


def agreeing(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = [alike(x[i].values.to_numpy().view(np.uint64), y[i].values.to_numpy().view(np.uint64), similarity) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one, two = (sets.select(F.col("id").alias(f"i{c}"), F.col("hashes").alias(f"h{c}")) for c in "ab")
    return pairs.join(one, F.col("a") == F.col("ia")).join(two, F.col("b") == F.col("ib")).select("a", "b", "ha", "hb").mapInArrow(run, LINK)


def links_across(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges between similar members of a bucket whose parts differ; of tiles 1 and 2 only across.

    ``rows`` are (bucket, side, id, part, hashes). A pair connected already, by its part or by
    links of its bucket, is not compared again, which loses no connection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches, "bucket", 1 << 11):
            bucket, side, ids, part = (table.column(c).to_numpy() for c in ("bucket", "side", "id", "part"))
            hashes = [x.values.to_numpy().view(np.uint64) for x in table.column("hashes")]
            size = np.array(list(map(len, hashes)))
            out: list[tuple[int, int]] = []
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                label = part[lo:hi].copy()
                for i in range(lo, hi - 1):
                    j = np.arange(i + 1, hi)
                    fit = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
                    for k in j[fit & ((side[j] != side[i]) | (side[j] == 0))].tolist():
                        if label[k - lo] != label[i - lo] and alike(hashes[i], hashes[k], similarity):
                            label[label == label[k - lo]] = label[i - lo]
                            out.append((int(ids[i]), int(ids[k])))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, LINK)


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, tile: int = 256) -> DataFrame:
    """(doc_id, root): each doc_id and shingle set with the smallest doc_id of its near-duplicate group.

    Two texts are linked where their sets of ``words``-word shingles have a Jaccard similarity of
    ``similarity`` or more. First the pairs that operator 4 links are verified, and each candidate against the
    smallest member of its bands, which joins most of a group of any size with as many links as it has members; then
    all members of a band that this left in different groups are compared. Bands with the same
    members are compared once.
    """
    rows = stage(signatures(docs, words).where("doc_id is not null"), "jaccard-rows")
    nodes = stage(rows.groupBy(F.col("s").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys")), "jaccard-nodes")
    keyed = nodes.select("id", "doc_id", "n", F.explode("keys").alias("k"))
    met = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("hub"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members")).where("c > 1")
    bands = stage(met.groupBy("c", "hub", "members").agg(F.min("k").alias("bk")).select("bk", "hub"), "jaccard-bands")
    shared = stage(keyed.join(bands, F.col("k") == F.col("bk")).select("id", "doc_id", "n", "k", "hub"), "jaccard-shared")
    close = stage(fingerprint_pairs(nodes.select("id", "fp")).distinct(), "jaccard-close")
    met_by_print = close.select(F.explode(F.array("a", "b")).alias("i")).distinct().join(nodes, F.col("i") == F.col("id")).select("doc_id", F.col("id").alias("s"))
    wanted = shared.select("doc_id", F.col("id").alias("s")).unionByName(met_by_print).distinct()
    sets = stage(sets_of(docs, wanted, words), "jaccard-sets")
    stars = shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).unionByName(close).distinct()
    found = stage(agreeing(stars, sets, similarity), "jaccard-stars")
    parts = connected_components(found, "jaccard-parts")
    placed = stage(shared.join(parts, F.col("id") == F.col("node"), "left").select("id", "k", F.coalesce("root", "id").alias("part")), "jaccard-placed")
    mixed = placed.groupBy(F.col("k").alias("mk")).agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("mk")
    left = stage(placed.join(mixed, F.col("k") == F.col("mk")).select("id", "k", "part"), "jaccard-left")
    dealt = tiled(left, ["id"], tile, "jaccard").join(sets.withColumnRenamed("id", "i"), F.col("id") == F.col("i")).select("bucket", "side", "id", "part", "hashes")
    roots = connected_components(found.unionByName(links_across(dealt, similarity)), "jaccard")
    rooted = stage(nodes.join(roots, F.col("id") == F.col("node"), "left").select("id", "doc_id", F.coalesce("root", "id").alias("g")), "jaccard-rooted")
    least = rooted.groupBy("g").agg(F.min("doc_id").alias("root"))
    classes = stage(rooted.select("id", F.col("g").alias("og")).join(least, F.col("og") == F.col("g")).select("id", "root"), "jaccard-classes")
    return rows.join(classes, F.col("s") == F.col("id")).select("doc_id", "root")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id.

    Of rows that repeat that doc_id one stays. Rows without doc_id stay, for they belong to no
    group. The columns are those of ``docs``.
    """
    kept = near_groups(docs, words, similarity).where("doc_id = root").select(F.col("doc_id").alias("__keep")).distinct()
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("__keep"), "left_semi")
    return named.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
