"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector by several random projections, cut into slots of a width taken from a sample's distances. A
query visits its own bucket and those that lie one slot off in some projections, in the order of their estimated chance
to hold near vectors. Candidates of all tables are merged and ranked by exact distance.

Buckets are grouped by the slots of their first projections; such a group is cut into chunks of bounded size, and meets
blocks of the queries that probe it. Equal vectors are one entry of the index.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Index entries in a chunk, on average, and queries in a block, at most.
CHUNK, BLOCK = 1000, 64
_MIX = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)


@dataclass
class Hashes:
    """directions: tables x dimensions x projections; shifts: tables x projections, in slots."""

    directions: np.ndarray
    shifts: np.ndarray
    width: float
    coarse: int
    probes: list[tuple[int, ...]]

    def slots(self, t: int, x: np.ndarray) -> np.ndarray:
        return x @ self.directions[t] / self.width + self.shifts[t]

    def keys(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key of the group of buckets, and of the bucket."""
        mixed = slots.astype(np.int64).astype(np.uint64) * _MIX[: slots.shape[-1]]
        return mixed[..., : self.coarse].sum(-1, dtype=np.uint64).astype(np.int64), mixed.sum(-1, dtype=np.uint64).astype(np.int64)

    def probed(self, t: int, q: np.ndarray) -> np.ndarray:
        """The slots of the buckets to visit, likeliest first: perturbations of the projections nearest to a border."""
        at = self.slots(t, q)
        own = np.floor(at).astype(np.int64)
        k = len(own)
        off = np.concatenate([at - own, 1 - (at - own)])
        order = np.argsort(off, kind="stable")
        out = np.repeat(own[None], len(self.probes), axis=0)
        for row, picked in zip(out, self.probes, strict=True):
            for p in picked:
                which = order[p]
                row[which % k] += -1 if which < k else 1
        return out


def perturbations(k: int, most: int) -> list[tuple[int, ...]]:
    """Sets of places among the 2k borders sorted by distance, by rising expected squared distance; no set takes both
    borders of one projection."""
    j = np.arange(1, 2 * k + 1)
    expected = np.where(j <= k, j * (j + 1) / (4 * (k + 1) * (k + 2)), 1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2)))
    out: list[tuple[int, ...]] = [()]
    heap = [(expected[0], (0,))]
    while heap and len(out) < most:
        total, places = heapq.heappop(heap)
        if all(2 * k - 1 - p not in places for p in places):
            out.append(places)
        if (last := places[-1]) + 1 < 2 * k:
            heapq.heappush(heap, (total - expected[last] + expected[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (total + expected[last + 1], (*places, last + 1)))
    return out


def valid(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """_id and _v (array<double>) of the rows that take part: an id, and a vector that isn't null, empty or zero and has
    only finite components. Of several vectors of one id the least stands for it."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).where(F.col("_id").isNotNull() & F.col("_v").isNotNull() & fine).groupBy("_id").agg(F.min("_v").alias("_v"))


def fit(rows: DataFrame, tables: int = 8, projections: int = 8, probes: int = 600, slot: float = 1.15, coarse: int = 3, sample: int = 1000, seed: int = 3) -> Hashes | None:
    """Slots are `slot` times the median distance in a sample of at most `sample` rows (the first by a hash of the id)."""
    got = [r["_v"] for r in rows.orderBy(F.xxhash64("_id")).limit(sample).select("_v").collect()]
    if not got:
        return None
    dims = max(set(map(len, got)), key=lambda n: sum(len(v) == n for v in got))
    x = np.array([v for v in got if len(v) == dims])
    d = np.sqrt(((x[: len(x) // 2, None] - x[None, len(x) // 2 :][:, :200]) ** 2).sum(-1)) if len(x) > 1 else np.ones(1)
    draw = np.random.default_rng(seed)
    width = slot * float(np.median(d)) or 1.0
    return Hashes(draw.normal(size=(tables, dims, projections)), draw.uniform(0, 1, (tables, projections)), width, coarse, perturbations(projections, probes))


def _matrix(packed: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), np.float64).reshape(-1, dims)


def _indexed(classes: DataFrame, h: Hashes, chunks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = h.directions.shape[1]
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = _matrix(b.column(1), dims), b.column(0).to_numpy()
            for t in range(len(h.directions)):
                group, bucket = h.keys(np.floor(h.slots(t, x)))
                chunk = (ids.astype(np.uint64) * _MIX[1] >> np.uint64(33)).astype(np.int64) % chunks
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), pa.array(group), pa.array(chunk), pa.array(bucket), b.column(0), b.column(1)], names=["t", "g", "chunk", "bucket", "c", "v"])

    flat = classes.select("c", "packed").mapInArrow(run, "t int, g long, chunk long, bucket long, c long, v binary")
    return flat.groupBy("t", "g", "chunk").agg(F.collect_list(F.struct("bucket", "c", "v")).alias("entries"))


def _probing(queries: DataFrame, h: Hashes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = h.directions.shape[1]
        for b in batches:
            rows = []
            for q, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(v, np.float64).reshape(dims)
                for t in range(len(h.directions)):
                    group, bucket = h.keys(h.probed(t, x))
                    for g in np.unique(group).tolist():
                        rows.append((t, g, q, v, bucket[group == g].tolist()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["t", "g", "q", "v", "buckets"])

    flat = queries.select("q", "packed").mapInArrow(run, "t int, g long, q long, v binary, buckets array<long>")
    block = F.pmod(F.xxhash64("q"), F.greatest(F.lit(1), F.ceil(F.lit(queries.count()) / BLOCK)).cast("long"))
    return flat.groupBy("t", "g", block.alias("block")).agg(F.collect_list(F.struct("q", "v", "buckets")).alias("asked"))


def _nearest(met: DataFrame, dims: int, k: int) -> DataFrame:
    """q, c, d: for each row of met the k nearest entries to each query among the buckets it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                entries, asked = b.column(0)[i].values, b.column(1)[i].values
                x = _matrix(entries.field(2), dims)
                buckets, ids = entries.field(0).to_numpy(zero_copy_only=False), entries.field(1).to_numpy()
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for q, v, probed in zip(asked.field(0).to_pylist(), asked.field(1).to_pylist(), asked.field(2).to_pylist(), strict=True):
                    hit = np.flatnonzero(np.isin(buckets, probed)) if probed is not None else np.arange(len(ids))
                    d = np.sqrt(((x[hit] - np.frombuffer(v, np.float64)) ** 2).sum(axis=1))
                    best = np.lexsort((ids[hit], d))[:k]
                    out.append((np.full(len(best), q, np.int64), ids[hit][best], d[best]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["q", "c", "d"])

    return met.select("entries", "asked").mapInArrow(run, "q long, c long, d double")


def _pack(v: str):
    def run(batches):
        for b in batches:
            lists = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(x).tobytes() for x in lists], pa.binary())], names=["c", "packed"])

    return run


def search(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", hashes: Hashes | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query(id column) holds, its own id left
    out; ties go to the smaller id. The score is the Euclidean distance in double precision.

    Rows with a null id, or a vector that is null, empty, zero, of another length than most or holds null or non-finite
    components, take no part. A repeated id counts once, with the least of its vectors. A query for which fewer than k are
    found is compared with all rows; an empty table has no queries; other columns take no part."""
    rows = valid(df, id_col, vec_col)
    h = hashes or fit(rows)
    spark = df.sparkSession
    if h is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = h.directions.shape[1]
    rows = written(rows.where(F.size("_v") == dims), "vectors")
    # equal vectors: the k + 1 smallest ids are all that can be asked for
    order = Window.partitionBy("_v").orderBy("_id")
    members = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    classes = members.groupBy("_v").agg(F.min("_id").alias("c"), F.sort_array(F.collect_list("_id")).alias("ids"))
    classes = written(classes.select("c", "ids", "_v"), "classes")
    packed = classes.select("c", "_v").mapInArrow(_pack("_v"), "c long, packed binary")
    queries = rows.where(is_query(F.col("_id"))).select(F.col("_id").alias("c"), "_v").mapInArrow(_pack("_v"), "c long, packed binary").withColumnRenamed("c", "q")
    chunks = max(1, classes.count() // (50 * CHUNK))
    met = _probing(queries, h).join(_indexed(packed, h, chunks), ["t", "g"])
    found = written(_top(_nearest(met, dims, k + 1), classes, k), "found")
    # too few found: all rows, in blocks
    short = queries.join(found.groupBy(F.col("query_id").alias("q")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k), "q", "left_anti")
    if short.isEmpty():
        return found
    parts = max(1, classes.count() // CHUNK)
    everything = packed.groupBy(F.pmod(F.xxhash64("c"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct(F.lit(0).cast("long").alias("bucket"), "c", F.col("packed").alias("v"))).alias("entries"))
    blocks = short.groupBy(F.pmod(F.xxhash64("q"), F.lit(max(1, short.count() // BLOCK))).alias("block")).agg(F.collect_list(F.struct("q", F.col("packed").alias("v"), F.lit(None).cast("array<long>").alias("buckets"))).alias("asked"))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    rest = _top(_nearest(blocks.join(everything, "part"), dims, k + 1), classes, k)
    return found.join(short.select(F.col("q").alias("query_id")), "query_id", "left_anti").unionByName(rest)


def _top(near: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    one = near.groupBy("q", "c").agg(F.min("d").alias("d"))
    best = one.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy("d", "c"))).where(F.col("_n") <= k + 1)
    ids = best.join(classes.select("c", "ids"), "c").select("q", "d", F.explode("ids").alias("vec_id")).where("q <> vec_id")
    ranked = ids.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))
