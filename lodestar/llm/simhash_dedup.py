"""SimHash near-duplicate groups with bit-sliced comparison (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.components import connected_components
from lodestar.llm.hamming import hamming_links, majority_bits
from lodestar.llm.staging import stage

SHINGLE_BLOCK = 1 << 17


def shingle_hashes(text: str | None, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every word shingle of ``text``, in blocks; fewer words make one shingle, none makes none.

    A-Z become lower case and words are split at the ASCII white space \\x20 and \\x09-\\x0D,
    which is what ``bytes.lower`` and ``bytes.split`` do.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    if len(tokens) <= words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tokens), seed)], np.uint64)
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    lo, hi = starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(lo), SHINGLE_BLOCK):
        yield np.array([digest(joined[i:j], seed) for i, j in zip(lo[k : k + SHINGLE_BLOCK], hi[k : k + SHINGLE_BLOCK], strict=True)], np.uint64)


def fingerprints(texts: list[str | None], words: int = 4, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of every text (0 where a text has no word)."""
    out = np.zeros(len(texts), np.uint64)
    held: list[np.ndarray] = []
    rows: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, rows, size
        if rows:
            starts = np.cumsum([0, *map(len, held[:-1])])
            out[rows] = majority_bits(np.concatenate(held), starts)
        held, rows, size = [], [], 0

    for i, text in enumerate(texts):
        parts = list(shingle_hashes(text, words, seed))
        if parts:
            held.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
            rows.append(i)
            size += len(held[-1])
        if size >= SHINGLE_BLOCK:
            flush()
    flush()
    return out


def with_fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per input row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                fps = fingerprints(part.column(1).to_pylist(), words, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text)``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked, and component_id is
    the smallest doc_id reachable. Null and blank texts have fingerprint 0 and are linked like
    any other. A row without doc_id names no node: it keeps its fingerprint, links nothing and
    has a null component_id. Repeated rows share a class; an empty table gives no rows. Other
    columns are not read.
    """
    rows = stage(with_fingerprints(docs, words, seed), "simhash-rows")
    nodes = stage(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    links = hamming_links(nodes, nodes.count(), radius)
    roots = connected_components(links, "simhash")
    classes = stage(nodes.join(roots, F.col("id") == F.col("node"), "left").select(F.col("fp").alias("class_fp"), F.coalesce("root", "id").alias("component_id")), "simhash-classes")
    return rows.join(classes, F.col("fp") == F.col("class_fp"), "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, radius: int = 4) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id.

    Of rows that repeat that doc_id one stays. Rows without doc_id stay, for they belong to no
    group. The columns are those of ``docs``.
    """
    found = near_duplicates(docs, words, radius=radius)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("__keep"), "left_semi")
    return named.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
