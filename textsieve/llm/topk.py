"""Exact top-k search by inner product: columnar branch and bound.

Rows and queries meet in cells of a grid, a bounded number of rows and of queries in each. A cell lays its rows out by
dimension and adds up scores one block of dimensions after another. After each block a row's score can rise at most by the
product of the lengths that are left of it and of the query; rows that can't reach the query's k best any more go, and the
others are compacted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and queries of a cell, on average; queries whose first block is computed at once; dimensions of a block.
ROWS, QUERIES, AT_ONCE, BLOCK = 16_384, 1024, 32, 8
#: Rows whose scores give each query a first bound. They are a sample, and only a bound comes from them.
SAMPLE = 2000
#: Up to this, sums of products are exact in double precision.
EXACT = 1 << 53


def scaled(df: DataFrame, by: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """_id and _v (array<bigint>): each component x becomes floor(by * x), x as double. Rows without an id, and vectors
    that are null or hold null or non-finite components, are left out. A component too large for a long stops the query."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.when(fine, v).alias("_x")).where(F.col("_id").isNotNull() & F.col("_x").isNotNull())
    whole = lambda x: F.when(F.abs(x * by) < float(1 << 63), F.floor(x * by)).otherwise(F.raise_error(F.lit("a vector's component is too large")).cast("long"))
    return rows.select("_id", F.transform("_x", whole).alias("_v"))


class Cell:
    """Vectors of one length by dimension, those with most weight first, with the lengths that are left after each block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], x[order]
        # of several vectors of an id the least stands for it
        if len(self.ids) > 1 and (self.ids[1:] == self.ids[:-1]).any():
            order = np.lexsort((*x.T[::-1], self.ids))
            self.ids, x = self.ids[order], x[order]
            kept = np.r_[True, self.ids[1:] != self.ids[:-1]]
            self.ids, x = self.ids[kept], x[kept]
        self.most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
        wide = x.astype(np.float64)
        self.dims = np.argsort(-(wide * wide).sum(axis=0), kind="stable")
        self.x = x.T[self.dims]
        self.cols = np.ascontiguousarray(wide.T[self.dims])
        self.left = self.lengths(self.cols.T)
        self.added = 0  # rows that a block after the first was added to

    def lengths(self, x: np.ndarray) -> np.ndarray:
        """left[b]: the length of each of the vectors x (dimensions in order) from block b on, rounded up."""
        squares = np.add.reduceat(x * x, np.arange(0, x.shape[1], BLOCK), axis=1) if x.shape[1] else np.zeros((len(x), 0))
        left = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9)
        return np.concatenate([left, np.zeros((len(x), 1))], axis=1).T

    def best(self, qids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its position, and ids and scores of the k best rows, of those that reach its bound, its own id
        left out; ties go to the smaller id."""
        most = max(abs(int(q.max())), abs(int(q.min()))) if q.size else 0
        if self.most * most * max(1, len(self.dims)) >= EXACT:
            for j in range(len(qids)):  # numbers without a bound
                yield j, *self.ranked(qids[j], np.arange(len(self.ids)), np.array([sum(int(a) * int(b) for a, b in zip(q[j][self.dims], col, strict=True)) for col in self.x.T], object), bounds[j], k)
            return
        wide = q[:, self.dims].astype(np.float64)
        mine = self.lengths(wide)
        for start in range(0, len(qids), AT_ONCE):
            some = slice(start, start + AT_ONCE)
            sums = wide[some, :BLOCK] @ self.cols[:BLOCK]
            for j, total in zip(range(start, start + len(sums)), sums, strict=True):
                yield j, *self.search(qids[j], wide[j], mine[:, j], total, bounds[j], k)

    def search(self, qid: int, q: np.ndarray, mine: np.ndarray, sums: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.ids != qid)
        sums = sums[at]
        for b in range(1, -(-len(q) // BLOCK)):
            if len(at) > k:  # the rows likeliest so far are scored in full: the worst of k is a bound
                likely = at[np.argpartition(-sums, k - 1)[:k]]
                bound = max(bound, (q @ self.cols[:, likely]).min())
            alive = sums + mine[b] * self.left[b, at] >= bound
            at, sums = at[alive], sums[alive]
            dims = slice(b * BLOCK, (b + 1) * BLOCK)
            sums = sums + q[dims] @ self.cols[dims][:, at]
            self.added += len(at)
        return self.ranked(qid, at, sums.astype(np.int64), bound, k)

    def ranked(self, qid: int, at: np.ndarray, scores: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        kept = (self.ids[at] != qid) & (scores >= bound)
        at, scores = at[kept], scores[kept]
        best = np.array(sorted(range(len(at)), key=lambda i: (-scores[i], self.ids[at[i]]))[:k], int) if scores.dtype == object else np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[best]], scores[best]


def _matrix(lists: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), dims)


def _met(sample: dict[int, Cell], k: int, dims: int, rows: pa.Table, asked: pa.Table) -> pa.Table:
    """The k best of a cell's rows for each of its queries."""
    out: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
    if rows.num_rows and asked.num_rows:
        cell = Cell(rows.column("_id").to_numpy(), _matrix(rows.column("_v"), dims))
        # a query's own row, of several the one that stands for its id
        own = Cell(asked.column("_id").to_numpy(), _matrix(asked.column("_v"), dims))
        q = np.empty((len(own.ids), dims), np.int64)
        q[:, own.dims] = own.x.T
        bounds = np.full(len(own.ids), -np.inf)
        if dims in sample and len(sample[dims].ids) > k:
            for j, _, scores in sample[dims].best(own.ids, q, bounds, k):
                bounds[j] = float(scores[-1]) if len(scores) == k and abs(int(scores[-1])) < EXACT else -np.inf
        for j, ids, scores in cell.best(own.ids, q, bounds, k):
            out.append((np.full(len(ids), own.ids[j]), ids, [int(s) for s in scores]))
    cols = zip(*out, strict=True) if out else ([], [], [])
    q, c, s = (list(x) for x in cols)
    flat = lambda a: np.concatenate(a) if a else np.zeros(0, np.int64)
    return pa.table({"q": pa.array(flat(q), pa.int64()), "c": pa.array(flat(c), pa.int64()), "s": pa.array([x for part in s for x in part], pa.int64())})


def search(rows: DataFrame, is_query: Callable[[Column], Column], k: int = 20, per_cell: tuple[int, int] = (ROWS, QUERIES), sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of rows (_id bigint, _v array<bigint>) for which is_query(id)
    holds the k rows of highest inner product, all if there are fewer, its own id left out; ties go to the smaller id.

    Vectors meet those of their own length only. Of several vectors of one id the least stands for it; repeated rows count
    once. Scores are exact whatever the numbers, a score too large for a long stops the query. Every row meets every query
    in one cell of the grid; each row is sent to as many cells as there are groups of queries, each query to as many as
    there are groups of rows, and a task holds one cell."""
    spark = rows.sparkSession
    rows = rows.withColumn("_dims", F.size("_v"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if(is_query(F.col("_id")))).first()
    down, across = max(1, -(-n // per_cell[0])), max(1, -(-asked // per_cell[1]))
    got: dict[int, list[tuple[int, list[int]]]] = {}
    # of an id's vectors the least comes first, so the sample's end can't cut it off
    for r in rows.orderBy(F.xxhash64("_id"), "_id", "_v").limit(sample).collect() if n > per_cell[0] else []:
        got.setdefault(r["_dims"], []).append((r["_id"], r["_v"]))
    known = {dims: Cell(np.array([i for i, _ in some]), np.array([v for _, v in some], np.int64).reshape(len(some), dims)) for dims, some in got.items()}
    at = lambda n, salt: F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("_id", "_v", "_dims", at(down, 1).alias("_r")).withColumn("_c", every(across))
    right = rows.where(is_query(F.col("_id"))).select("_id", "_v", "_dims", at(across, 2).alias("_c")).withColumn("_r", every(down))
    cells = left.groupBy("_r", "_c", "_dims").cogroup(right.groupBy("_r", "_c", "_dims"))
    met = cells.applyInArrow(lambda key, a, b: _met(known, k, key[2].as_py(), a, b), "q long, c long, s long")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "c"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("c").alias("vec_id"), F.col("s").alias("score"))


#: DuckDB SQL for search(scaled(embeddings), id % 20 = 0).
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 20"""
