"""Exact top-k by inner product with a Voronoi kNN join (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.staging import stage

MOST_PIVOTS, PIVOT_SAMPLE, CELL_ROWS = 1024, 4096, 4096
BLOCK_ROWS = 8192
SLACK = 1e-9  # relative, on bounds: they are kept on the safe side of rounding
EXACT = float(1 << 53)
RESULT = "query_id long, rank int, vec_id long, score long"


def integer_vectors(table: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, for vectors without null or non-finite ones."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c * F.lit(float(scale))) == F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.when(F.abs(c * F.lit(float(scale))) < F.lit(EXACT), F.floor(c * F.lit(float(scale))).cast("double")).otherwise(c * F.lit(float(scale))))
    return table.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(~bad).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first points of a sample, so that pivots spread over the data."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def padded(column: pa.Array, dim: int) -> np.ndarray:
    """The lists of a column as rows, shorter ones with zeros behind."""
    offsets = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    if (sizes == dim).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, dim)
    m = np.zeros((len(sizes), dim))
    for i, (a, n) in enumerate(zip(offsets[:-1].tolist(), sizes.tolist(), strict=True)):
        m[i, :n] = flat[a : a + n]
    return m


@dataclass
class Cells:
    """The Voronoi cells: pivots, and what is known of the rows of each (at most MOST_PIVOTS numbers of each kind)."""

    pivots: np.ndarray
    radius: np.ndarray
    longest: np.ndarray
    rows: np.ndarray

    def gaps(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.pivots.T + (self.pivots**2).sum(1)[None], 0))

    def needed(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Cells that may hold a row whose product with query i is ``least[i]`` or more.

        For a row x of a cell with pivot p, q x = q p + q (x - p) is at most q p + |q| radius,
        and at most |q| times the longest row of the cell.
        """
        length = np.sqrt((q**2).sum(1))[:, None]
        most = np.minimum(q @ self.pivots.T + length * self.radius[None], length * self.longest[None])
        size = length * (np.sqrt((self.pivots**2).sum(1)) + self.radius)[None]
        return (most + SLACK * (1 + size) >= least[:, None]) & (self.rows > 0)[None]


def best_of(asks: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int, exact: bool) -> pd.DataFrame:
    """(query_id, vec_id, score): the k largest products of every query with the rows, its own aside."""
    order = np.argsort(ids, kind="stable")
    ids, y = ids[order], y[order]
    who, near, score = [], [], []
    for lo in range(0, len(x), 256):
        own = asks[lo : lo + 256, None] == ids[None]
        if exact:
            s = x[lo : lo + 256] @ y.T
            s[own] = -np.inf
            keep = s >= np.partition(s, s.shape[1] - k, axis=1)[:, -k][:, None] if s.shape[1] > 4 * k else np.ones(s.shape, bool)
            keep &= s > -np.inf
            r, c = np.nonzero(keep)
            best = np.lexsort((ids[c], -s[r, c], r))
            r, c = r[best], c[best]
        else:  # products that a double doesn't hold: whole numbers of any size
            whole = [[int(v) for v in row] for row in y]
            s = np.array([[sum(int(a) * b for a, b in zip(q, row, strict=True)) for row in whole] for q in x[lo : lo + 256]], object)
            pairs = sorted((r, -s[r, c], ids[c], c) for r, c in zip(*np.nonzero(~own), strict=True))
            r, c = (np.array([p[i] for p in pairs], np.int64) for i in (0, 3))
        top = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
        r, c = r[top], c[top]
        who.append(asks[lo + r])
        near.append(ids[c])
        score.append(s[r, c].astype(np.int64))
    return pd.DataFrame({"query_id": np.concatenate(who), "vec_id": np.concatenate(near), "score": np.concatenate(score)})


def find_cells(rows: DataFrame, dim: int, pivots: int | None) -> tuple[DataFrame, Cells]:
    """(cell, vec_id, v) as bytes for every row, and the cells.

    Pivots come from a sample of PIVOT_SAMPLE rows, one to CELL_ROWS rows and at most
    MOST_PIVOTS; they move work, not results.
    """
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(PIVOT_SAMPLE).collect()
    sample = np.zeros((len(drawn), dim))
    for i, r in enumerate(drawn):
        sample[i, : len(r[0])] = r[0]
    chosen = choose_pivots(sample, pivots or min(MOST_PIVOTS, max(16, -(-n // CELL_ROWS))))
    none = Cells(chosen, *np.zeros((3, len(chosen))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = padded(part.column(1), dim)
                gaps = none.gaps(x)
                cell = gaps.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(gaps[np.arange(len(x)), cell]), pa.array(np.sqrt((x**2).sum(1))), part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["cell", "gap", "size", "vec_id", "v"])

    placed = stage(rows.mapInArrow(assign, "cell int, gap double, size double, vec_id long, v binary"), "topk-cells")
    radius, longest, held = np.zeros((3, len(chosen)))
    for r in placed.groupBy("cell").agg(F.max("gap"), F.max("size"), F.count(F.lit(1))).collect():  # at most one row a pivot
        radius[r[0]], longest[r[0]], held[r[0]] = r[1], r[2], r[3]
    return placed.select("cell", "vec_id", "v"), Cells(chosen, radius, longest, held)


def asked_cells(queries: DataFrame, tops: DataFrame, cells: Cells, dim: int) -> DataFrame:
    """(cell, vec_id, v): each query once for every cell that may hold one of its k best.

    ``tops(query_id, least)`` holds a score that k rows reach, where k are known.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                q = np.frombuffer(b"".join(part.column(1).to_pylist()), np.float64).reshape(-1, dim)
                least = part.column(2).fill_null(-np.inf).to_numpy()
                who, cell = np.nonzero(cells.needed(q, least))
                at = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), part.column(0).take(at), part.column(1).take(at)], names=["cell", "vec_id", "v"])

    known = queries.join(tops, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.col("least").cast("double"))
    return known.mapInArrow(spread, "cell int, vec_id long, v binary")


def solve(asked: DataFrame, data: DataFrame, k: int, dim: int, exact: bool) -> DataFrame:
    """(query_id, vec_id, score): the k best of every (cell, d_part, q_part) that both tables name."""
    block = ["cell", "d_part", "q_part"]

    def local(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({c: np.array([], np.int64) for c in ("query_id", "vec_id", "score")})
        x, y = (np.frombuffer(b"".join(t), np.float64).reshape(-1, dim) for t in (q["q_v"], d["d_v"]))
        return best_of(q["q_vec_id"].to_numpy(), x, d["d_vec_id"].to_numpy(), y, k, exact)

    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in (*block, "vec_id", "v")])  # names of their own: both sides read one table
    data = data.select(*[F.col(c).alias(f"d_{c}") for c in (*block, "vec_id", "v")])
    return asked.groupBy(*[f"q_{c}" for c in block]).cogroup(data.groupBy(*[f"d_{c}" for c in block])).applyInPandas(local, T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")]))


def per_cell(values: np.ndarray) -> F.Column:
    """The value of a row's cell."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)


def parts_of(rows: np.ndarray) -> np.ndarray:
    """How many blocks the rows of each cell fill."""
    return np.maximum(1, -(-rows.astype(np.int64) // BLOCK_ROWS))


def top_k(table: DataFrame, k: int = 20, query_modulus: int = 20, scale: int = 64, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products over all other rows.

    Queries are the rows whose id is divisible by ``query_modulus``. Rows go to the cell of
    their nearest pivot, queries too. A query first meets one block of its own cell, which
    gives it a score that its k-th best reaches; with the pivots, radii and longest rows of
    all cells that bounds the cells it needs, and it is replicated to those only, while every
    row stays in its one cell. Cells of many rows or many queries are cut into blocks, solved
    locally and merged. On clustered vectors most cells are skipped; on vectors spread evenly
    over a sphere of many dimensions no bound can skip any, and all products are taken.

    Shorter vectors count as padded with zeros. Rows that repeat an id count once, with the
    smallest vector in order of components. Ties go to the smaller id; fewer candidates give
    fewer rows; an empty table gives none. Scores are exact at any size of components that a
    long can hold; beyond that the job fails. Other columns are not read.
    """
    spark = table.sparkSession
    rows = stage(integer_vectors(table, scale, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")), "topk-rows")
    shape = rows.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    if shape[0] is None:
        return spark.createDataFrame([], RESULT)
    dim, exact = max(int(shape[0]), 1), float(shape[1]) < EXACT
    data, cells = find_cells(rows, dim, pivots)
    queries = data.where(F.col("vec_id") % query_modulus == 0)
    d_parts = parts_of(cells.rows)
    hashed = F.pmod(F.xxhash64("vec_id"), per_cell(d_parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), per_cell(parts) - 1))
    home = data.withColumn("d_part", hashed).where("d_part = 0").withColumn("q_part", every(d_parts))
    first = solve(queries.withColumn("d_part", F.lit(0)).withColumn("q_part", hashed), home, k, dim, exact)
    tops = stage(first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n"), "topk-least")
    asked = stage(asked_cells(queries, tops, cells, dim), "topk-asked")
    wanted = np.zeros(len(cells.pivots))
    for r in asked.groupBy("cell").count().collect():  # at most one row a pivot
        wanted[r[0]] = r[1]
    q_parts = parts_of(wanted)
    q_side = asked.withColumn("q_part", F.pmod(F.xxhash64("vec_id"), per_cell(q_parts)).cast("int")).withColumn("d_part", every(d_parts))
    d_side = data.withColumn("d_part", hashed).withColumn("q_part", every(q_parts))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return solve(q_side, d_side, k, dim, exact).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
