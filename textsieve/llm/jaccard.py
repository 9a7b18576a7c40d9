"""N-gram Jaccard join with count vectors in R-trees.

A document's distinct word shingles are hashed to a fixed number of groups; the counts of its groups are a point. Two
sets share at most the sum over groups of the smaller count, so a pair whose sum is too small can't be similar enough;
for boxes of points the same holds of the boxes' upper corners. Trees of such boxes are joined with themselves, and the
pairs that survive are verified on their shingles.

One tree over all documents can't be cut by machine: the counts of unrelated texts fill the same box, and no box can be
left out. So there is one tree for each shard, and a shard is the documents that hold one shingle among the first of an
order over all shingles, rarest first: two sets of similarity t have one of their first (1 - t) * n + 1 shingles in
common, so every similar pair meets in a shard (exactly, not with some probability). At the first shingle that two sets
have in common they share no more than either has left from there on, which bounds the size of the other set: a document
that no other one of its shard fits by that is left out of it. Documents that already are in one component need not be
compared, so a shard first links its documents to one of them; the tree then joins what is left,
and does not compare boxes of one component. A large shard is cut into blocks, and each pair of these is a task's work.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_sums, forget, powers, slices, written
from .components import components

GROUPS, COARSE, FAN_OUT, WORDS = 1024, 128, 16, 5
#: Members of a shard, or of a block of a larger one, that one task compares with each other or with those of another block.
BLOCK = 1000
#: Members of a shard that are held together; of a larger one none is left out.
HELD = 200_000
#: Bits of the map by which ids are looked for in a table that isn't shuffled: 4 MB at most, whatever the number of ids.
ID_BITS = 1 << 25
#: Bytes that are hashed at once.
_SEGMENT = 1 << 19
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SPACE = re.compile(rb"[\t-\r ]")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, odd in ((32, 3), (29, 4)):
        h ^= h >> np.uint64(shift)
        h *= _ODD[odd]
    h ^= h >> np.uint64(32)
    return h


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the start of each word, in order."""
    hashes, places, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        cut = _SPACE.search(data, at + _SEGMENT)
        end = cut.start() if cut else len(data)
        part = np.frombuffer(data, np.uint8, end - at, at)
        space = _IS_SPACE[part]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        edges = np.concatenate([[] if space[0] else [0], edges, [] if space[-1] else [len(part)]]).astype(np.int64)
        starts, ends = edges[::2], edges[1::2]
        sums = byte_sums(part)
        hashes.append(_mixed((sums[ends] - sums[starts]) * powers(len(part) + 1)[1][starts]))
        places.append(starts + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def _combined(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of so many words."""
    n = len(h) - width + 1
    total = h[:n] * _ODD[0] + np.uint64(width)
    for i in range(1, width):
        total *= _ODD[1]
        total += h[i : i + n] * _ODD[(i % 4) + 1]
    return _mixed(total)


def hashed(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the hashes (64 bits) of its shingles of so many words, in order; of all words, if there are fewer."""
    parts = [(t or "").encode().lower() for t in texts]
    h, places = _words(b"\n".join(parts))
    bounds = np.searchsorted(places, np.cumsum([0, *(len(p) + 1 for p in parts)]))
    runs = _combined(h, words) if len(h) >= words else h[:0]
    for a, z in itertools.pairwise(bounds.tolist()):
        yield runs[a : z - words + 1] if z - a >= words else _combined(h[a:z], z - a) if z > a else h[:0]


def distinct(hashes: np.ndarray) -> np.ndarray:
    own = np.sort(hashes)
    return own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return distinct(next(hashed([text], words)))


def frequent(docs: DataFrame, share: float = 0.001, text_col: str = "text") -> np.ndarray:
    """Shingles that more than `share` of the documents hold, by counts over all documents. Each task keeps those that
    are frequent in it (lossy counting over slices of texts), and only these are summed, so what reaches the driver is at
    most (shingles per document) / share hashes. They only come last in the order of shingles; any order gives the same
    result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, seen, n_docs = np.empty(0, np.uint64), np.empty(0, np.int64), 0, 0
        for n, held in _held(batches, round(1 / share)):
            n_docs, seen = n_docs + n, seen + 1
            new, times = np.unique(held, return_counts=True)
            new, times = new[times > 1], times[times > 1]
            merged = np.concatenate([keys, new])
            order = np.argsort(merged, kind="stable")
            merged, all_counts = merged[order], np.concatenate([counts, times])[order]
            first = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]]) if len(merged) else np.empty(0, np.int64)
            keys, counts = merged[first], np.add.reduceat(all_counts, first) if len(first) else all_counts
            stay = counts > seen
            keys, counts = keys[stay], counts[stay]
        stay = counts >= max(3, share * n_docs / 2)
        yield pa.RecordBatch.from_arrays([pa.array(keys[stay].view(np.int64)), pa.array(counts[stay])], names=["key", "n"])

    total = docs.count()
    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= share * total).select("key")
    return np.sort(found.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def _held(batches: Iterator[pa.RecordBatch], docs: int, most: int = 4_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """How many documents, and the hashes of all their shingles: so many documents at a time, or fewer with most hashes."""
    n, size, held = 0, 0, []
    for b in slices(batches, 0, 1 << 20):
        for h in hashed(b.column(0).to_pylist()):
            n, size = n + 1, size + len(h)
            held.append(h)
            if n >= docs or size >= most:
                yield n, np.concatenate(held)
                n, size, held = 0, 0, []
    if held:
        yield n, np.concatenate(held)


def first_shingles(own: np.ndarray, hot: np.ndarray, percent: int) -> np.ndarray:
    """The first of a set in the order of all shingles (hot ones last, else by hash): enough that two sets of this
    similarity share one."""
    n = len(own)
    wanted = n - -(-percent * n // 100) + 1
    late = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own if len(hot) else np.zeros(n, bool)
    return np.concatenate([own[~late], own[late]])[:wanted]


def packed(counts: np.ndarray) -> bytes:
    """A count vector in few bytes: most counts are 0, 1 or 2."""
    return zlib.compress(counts.astype(np.min_scalar_type(counts.max())).tobytes(), 1)


def unpacked(vectors: Iterable[bytes]) -> np.ndarray:
    """Packed count vectors as rows."""
    raw = map(zlib.decompress, vectors)
    return np.array([np.frombuffer(r, f"u{len(r) // GROUPS}") for r in raw], np.int32).reshape(-1, GROUPS)


def _sets(docs: DataFrame, hot: np.ndarray, percent: int, with_text: bool = False) -> DataFrame:
    """doc_id, n, sign and sign2 (of the set), counts, first shingles; and text, if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 1 << 20):
            n, signs, signs2, counts, firsts = [], [], [], [], []
            for own in map(distinct, hashed(b.column(1).to_pylist())):
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                n.append(len(own))
                signs.append(int.from_bytes(digest[:8], "little", signed=True))
                signs2.append(int.from_bytes(digest[8:], "little", signed=True))
                counts.append(packed(np.bincount((own >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)))
                firsts.append(first_shingles(own, hot, percent).view(np.int64) if len(own) else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(np.concatenate(firsts) if firsts else []))
            more = {"text": b.column(1)} if with_text else {}
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(signs, pa.int64()), pa.array(signs2, pa.int64()), pa.array(counts, pa.binary()), lists, *more.values()], names=["doc_id", "n", "sign", "sign2", "counts", "firsts", *more])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sign long, sign2 long, counts binary, firsts array<long>" + ", text string" * with_text)


def _fitting(shard: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which members have one of another set in their shard (ascending numbers) so that neither is larger than the other's
    `most`."""
    order = np.lexsort((n, shard))
    base = shard[order].astype(np.int64) << 32  # values of a later shard are greater than those of all before
    size, upto = base + n[order], base + most[order]
    top = np.maximum.accumulate(upto)
    second = np.maximum.accumulate(np.minimum(upto, np.r_[-1, top[:-1]]))
    last = np.searchsorted(size, upto, "right") - 1  # the largest set that a member may meet
    own = (np.arange(len(size)) <= last) & (upto >= top[last])
    out = np.empty(len(size), bool)
    out[order] = (last >= 0) & (np.where(own, second[last], top[last]) >= size)
    return out


def _shards(sets: DataFrame, percent: int) -> DataFrame:
    """key, doc_id, n, most, center, center_n, center_most: the members of each shard that another one fits by its size, one
    document for equal sets, and the first of them as the shard's center. `most` is the size of the largest set that can be
    similar, if the shard's shingle is the first in common. Shards stream through their tasks, sorted, whatever their size:
    of one with over HELD members all are given out, in pieces."""

    def given(key: np.ndarray, doc: np.ndarray, n: np.ndarray, most: np.ndarray, center: tuple | None) -> pa.RecordBatch:
        if center is None:
            fits = _fitting(np.cumsum(np.r_[False, key[1:] != key[:-1]]), n, most)
            key, doc, n, most = (c[fits] for c in (key, doc, n, most))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(key)])
            centers = [np.repeat(c[starts], sizes) for c in (doc, n, most)]
        else:
            centers = [np.full(len(key), c) for c in center]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (key, doc, n, most, *centers)], names=["key", "doc_id", "n", "most", "center", "center_n", "center_most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last shard's members so far; its last set and its center, if its first members are given out
        held, last, center = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy() for c in b.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            key, sign = cols[:2]
            new = np.r_[last != (key[0], sign[0]), (key[1:] != key[:-1]) | (sign[1:] != sign[:-1])]
            key, sign, doc, n, most = cols = [c[new] for c in cols]
            if not len(key):
                held = None
                continue
            if center is not None and (at := int(np.searchsorted(key, last[0], "right"))):
                yield given(*(c[:at] for c in (key, doc, n, most)), center)
                last = (key[at - 1], sign[at - 1])
                key, sign, doc, n, most = cols = [c[at:] for c in cols]
            if not len(key):
                held = None
                continue
            last, center = None, None
            at = int(np.searchsorted(key, key[-1]))
            if at:
                yield given(key[:at], doc[:at], n[:at], most[:at], None)
            held = [c[at:] for c in cols]
            if len(held[0]) > HELD:
                key, sign, doc, n, most = held
                center, last = (doc[0], n[0], most[0]), (key[-1], sign[-1])
                yield given(key, doc, n, most, center)
                held = None
        if held is not None:
            key, _, doc, n, most = held
            yield given(key, doc, n, most, None)

    # of n shingles the first so many are not in common
    most = F.expr(f"least((100 * n - {100 + percent} * place) div {percent}, {(1 << 32) - 1})") if percent else F.lit((1 << 32) - 1)
    rows = sets.select(F.posexplode("firsts").alias("place", "key"), "sign", "doc_id", "n").select("key", "sign", "doc_id", "n", most.cast("long").alias("most"))
    rows = rows.repartition("key").sortWithinPartitions("key", "sign", "doc_id")
    return rows.mapInArrow(run, "key long, doc_id long, n long, most long, center long, center_n long, center_most long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """a, b, linked of the pairs, by their texts' shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = None, None
        for b in batches:
            out = []
            for doc, left, right in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if of != (doc, left):
                    of, own = (doc, left), shingles(left)
                other = shingles(right)
                both = len(np.intersect1d(own, other, assume_unique=True))
                out.append(both > 0 and 100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    joined = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return joined.mapInArrow(run, "a long, b long, linked boolean")


def shared_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most so many shingles two sets have in common: the summed minima of their counts."""
    return np.minimum(a, b).sum(axis=-1)


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """a, b, shared of the pairs that the bound lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (unpacked(b.column(i).to_pylist()) for i in (2, 3))
                shared = shared_counts(x, y).astype(np.int64)
                may = pa.array(shared * (100 + percent) >= percent * (x.sum(axis=1) + y.sum(axis=1)))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(may), b.column(1).filter(may), pa.array(shared).filter(may)], names=["a", "b", "shared"])

    x, y = points.select(F.col("doc_id").alias("a"), F.col("counts").alias("x")), points.select(F.col("doc_id").alias("b"), F.col("counts").alias("y"))
    return pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, shared long")


def forest(i: np.ndarray, j: np.ndarray, weight: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of the edges (i, j) make up a forest of greatest weight over the components `of` (Boruvka): it joins all that
    the edges join, with fewer edges than there are components."""
    own = np.unique(of, return_inverse=True)[1]
    alive, picked = np.argsort(-weight, kind="stable"), []
    while True:
        x, y = own[i[alive]], own[j[alive]]
        apart = x != y
        alive, x, y = alive[apart], x[apart], y[apart]
        if not len(alive):
            return np.sort(np.concatenate(picked)) if picked else np.empty(0, np.int64)
        best = np.full(own.max() + 1, len(alive))  # of each component its heaviest edge
        np.minimum.at(best, x, np.arange(len(alive)))
        np.minimum.at(best, y, np.arange(len(alive)))
        at = np.flatnonzero(best < len(alive))
        edge = best[at]
        picked.append(alive[np.unique(edge)])
        parent = np.arange(len(best))
        parent[at] = x[edge] + y[edge] - at
        both = (parent[parent] == np.arange(len(parent))) & (np.arange(len(parent)) < parent)
        parent[both] = np.flatnonzero(both)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        own = parent[own]


class CountTree:
    """An R-tree of count vectors, packed level by level from points sorted by size and then by their largest groups. Of
    each of `labels` (one value for each point) the boxes hold the least and the greatest: two boxes whose members all have
    one and the same value of a label are not compared."""

    def __init__(self, points: np.ndarray, percent: int, labels: tuple[np.ndarray, ...] = ()):
        self.percent, self.full, self.sizes = percent, points, points.sum(axis=1)
        points = points.reshape(len(points), COARSE, -1).sum(axis=2)  # neighbouring groups as one: smaller boxes to compare
        # a label that fills a box comes first, so that such boxes are of one label
        first = []
        for label in labels:
            _, inverse, times = np.unique(label, return_inverse=True, return_counts=True)
            first.append(np.where(times[inverse] >= FAN_OUT, inverse, -1))
        self.order = np.lexsort((points[:, 1], points[:, 0], self.sizes, *first))
        self.points, self.sizes = points[self.order], self.sizes[self.order]
        self.levels = []
        self.labels = [[(label[self.order], label[self.order]) for label in labels]]
        high, low = self.points, self.sizes
        while len(high) > 1:
            starts = np.arange(0, len(high), FAN_OUT)
            high, low = np.maximum.reduceat(high, starts), np.minimum.reduceat(low, starts)
            self.levels.append((high, low))
            self.labels.append([(np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)) for least, most in self.labels[-1]])

    def _may(self, high_a, low_a, high_b, low_b) -> np.ndarray:
        """Can two members be similar? They share at most the summed minima, and need percent of their union."""
        shared = np.minimum(high_a, high_b).sum(axis=-1)
        return shared * (100 + self.percent) >= self.percent * (low_a + low_b)

    def pairs(self) -> np.ndarray:
        """Places (i, j) of points that the bound lets through, and the bound; none of two points that share a label."""
        if len(self.points) < 2:
            return np.empty((0, 3), np.int64)
        todo = np.zeros((1, 2), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low = (self.points, self.sizes) if depth == 0 else self.levels[depth - 1]
            out = []
            for at in range(0, len(todo), 256):  # so many nodes at a time, to bound the memory
                some = todo[at : at + 256]
                i = (some[:, 0, None] * FAN_OUT + np.arange(FAN_OUT)).repeat(FAN_OUT, axis=1).ravel()
                j = np.tile(some[:, 1, None] * FAN_OUT + np.arange(FAN_OUT), FAN_OUT).ravel()
                fits = (i < len(high)) & (j < len(high)) & ((i < j) if depth == 0 else (i <= j))
                i, j = i[fits], j[fits]
                for least, most in self.labels[depth]:
                    apart = (least[i] != most[i]) | (least[j] != most[j]) | (least[i] != least[j])
                    i, j = i[apart], j[apart]
                may = self._may(high[i], low[i], high[j], low[j])
                out.append(np.column_stack([i[may], j[may]]))
            todo = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        todo = self.order[todo]
        shared = [shared_counts(self.full[some[:, 0]], self.full[some[:, 1]]) for some in np.array_split(todo, max(1, len(todo) // 4096))]
        shared = np.concatenate(shared)
        n = self.full.sum(axis=1)
        may = shared * (100 + self.percent) >= self.percent * (n[todo[:, 0]] + n[todo[:, 1]])
        return np.column_stack([todo[may], shared[may]])


def _units(members: DataFrame, shards: DataFrame) -> DataFrame:
    """unit, doc_id, component, side: the work to compare members (key, doc_id, component) of shards (key, size), in units
    of about 2 * BLOCK members at most. A shard of more than BLOCK members is cut into blocks, of one large component or of
    whole small ones, and each pair of blocks is a unit of two sides, which are compared with each other; each block is a
    unit of its own. Blocks of one and the same component are not compared."""
    small = members.join(shards.where(F.col("size") <= BLOCK).select("key"), "key", "left_semi")
    small = small.select(F.col("key").alias("unit"), "doc_id", "component", F.lit(None).cast("int").alias("side"))
    large = members.join(shards.where(F.col("size") > BLOCK).select("key"), "key", "left_semi")
    parts = large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).withColumn("alone", F.col("n") > BLOCK)
    rest = parts.where("not alone").groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).alias("rest"))
    cut = F.when(F.col("alone"), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BLOCK))).otherwise(F.pmod(F.xxhash64("component"), F.coalesce("rest", F.lit(1))))
    placed = large.join(parts, ["key", "component"]).join(rest, "key", "left")
    placed = placed.select("key", "doc_id", "component", F.when(F.col("alone"), F.col("component")).alias("whole"), cut.alias("cut"))
    blocks = placed.select("key", "whole", "cut").distinct()
    name = F.struct("whole", "cut")
    x, y = blocks.select("key", name.alias("x")), blocks.select("key", name.alias("y"))
    met = x.join(y, "key").where("x <= y and not coalesce(x.whole = y.whole, false)")
    met = met.withColumn("unit", F.xxhash64("key", "x", "y"))
    sides = met.select("key", "unit", F.col("x").alias("at"), F.when(F.expr("x <> y"), 0).alias("side"))
    sides = sides.unionByName(met.where("x <> y").select("key", "unit", F.col("y").alias("at"), F.lit(1).alias("side")))
    sides = sides.select("key", "unit", "side", F.col("at.whole").alias("w"), F.col("at.cut").alias("c"))
    of = placed.withColumnRenamed("key", "k").join(sides, (F.col("k") == F.col("key")) & F.col("whole").eqNullSafe(F.col("w")) & (F.col("cut") == F.col("c")))
    return small.unionByName(of.select("unit", "doc_id", "component", "side"))


def _tree_pairs(members: DataFrame, percent: int, spanning: bool) -> DataFrame:
    """unit, a, b, shared from members (unit, doc_id, component, side, counts): pairs of different components that a unit's
    tree gives; if `spanning`, only the likeliest that join all that these join, fewer than the unit's members."""

    def join(rows: list[tuple]) -> pa.RecordBatch:
        units, docs, parts, sides, counts = zip(*rows, strict=True)
        points = unpacked(counts).astype(np.int64)
        docs, parts = np.array(docs), np.array(parts)
        # sides are null in a unit that is compared with itself
        labels = (parts,) if None in sides else (parts, np.array(sides))
        found = CountTree(points, percent, labels).pairs()
        if spanning:
            n = points.sum(axis=1)
            found = found[forest(found[:, 0], found[:, 1], found[:, 2] / (n[found[:, 0]] + n[found[:, 1]]), parts)]
        a, b = docs[found[:, 0]], docs[found[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), units[0])), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(found[:, 2])], names=["unit", "a", "b", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for small in slices([batch], 4, 4 << 20):
                for row in zip(*(c.to_pylist() for c in small.columns), strict=True):
                    if held and row[0] != held[0][0]:
                        if (pairs := join(held)).num_rows:
                            yield pairs
                        held = []
                    held.append(row)
        if held:
            yield join(held)

    return members.select("unit", "doc_id", "component", "side", "counts").repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "unit long, a long, b long, shared long")


def _in_components(rows: DataFrame, found: DataFrame, of: str, name: str) -> DataFrame:
    return rows.join(found.select(F.col("node").alias(of), F.col("component").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of new links and those that are known, which are freed."""
    out = components(links if found is None else links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    if found is not None:
        forget(found)
    return out


def _holding(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is one of ids (distinct). A map of bits, of bounded size, keeps most others out of the
    shuffle."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    maps = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = docs.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("bucket")).where(F.getbit(byte, (bit % 8).cast("int")) == 1)
    return some.select(docs.columns).join(ids, "doc_id")  # a semi join would be made before the map is used


def _texts(docs: DataFrame, pairs: DataFrame, several: DataFrame | None, percent: int) -> DataFrame:
    """doc_id, text of the documents in pairs (a, b): of those with several sets (doc_id, least), a text of the one that is
    compared."""
    texts = _holding(docs, pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    if several is not None:
        marked = _sets(texts.join(several, "doc_id", "left_semi"), np.empty(0, np.uint64), percent, True).join(several, "doc_id").where("sign = least")
        texts = texts.join(several, "doc_id", "left_anti").unionByName(marked.groupBy("doc_id").agg(F.min("text").alias("text")))
    return written(texts.dropDuplicates(["doc_id"]), "texts")


def _settled(candidates: DataFrame, found: DataFrame | None, texts: DataFrame, percent: int, rounds: int, whole: bool) -> DataFrame:
    """The components after verifying candidates (a, b, shared); found are those before. Pairs within one component need no
    look: in each of `rounds` rounds, of the pairs between two components the likeliest is verified; then, if `whole`, all
    that are left."""
    tried: list[DataFrame] = []
    for k in range(rounds + whole):
        left = candidates
        for t in tried:
            left = left.join(t.select("a", "b"), ["a", "b"], "left_anti")
        if found is not None:
            of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
            left = left.join(of("a"), "a", "left").join(of("b"), "b", "left")
            left = left.select("a", "b", "shared", F.coalesce("a_in", "a").alias("x"), F.coalesce("b_in", "b").alias("y")).where("x <> y")
        else:
            left = left.select("a", "b", "shared", F.col("a").alias("x"), F.col("b").alias("y"))
        if k < rounds:
            # one for each smaller component, its likeliest: as many as there are components, not pairs of them
            left = left.groupBy(F.greatest("x", "y")).agg(F.max_by(F.struct("a", "b"), F.struct("shared", "a", "b")).alias("p")).select("p.*")
        tried.append(written(verified(left, texts, percent), "tried"))
        found = _joined(found, tried[-1].where("linked").select("a", "b"))
    forget(*tried)
    return found


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: documents link if their shingle sets have at least `percent` of their union in
    common; component_id is the least doc_id that links reach, its own included.

    A null, empty or blank text has no shingles and links with nothing; a text may have any length; an empty table gives an
    empty one. Rows without an id are left out. Rows that repeat an id are one document, each with a row of its own in the
    result: equal sets are links whatever their ids, and of an id's different sets that of the least hash is compared with
    others. Other columns take no part."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sets = written(_sets(docs, frequent(docs), percent), "sets")
    ids = written(sets.select("doc_id", "n", "sign", "sign2"), "ids")
    full = ids.where("n > 0")
    equal = full.groupBy("sign", "sign2").agg(F.min("doc_id").alias("same_as"))
    several = written(full.groupBy("doc_id").agg(F.min("sign").alias("least"), F.max("sign").alias("most")).where("least <> most").select("doc_id", "least"), "several")
    own = sets.where("n > 0")
    if not several.isEmpty():
        own = own.join(several, "doc_id", "left").where("least is null or sign = least").drop("least")
    shards = written(_shards(own, percent), "shards")
    points = written(own.select("doc_id", "n", "counts", "sign").join(shards.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "points")
    forget(sets)
    several = None if several.isEmpty() else several

    def settled(pairs: DataFrame, found: DataFrame | None, whole: bool) -> DataFrame:
        texts = _texts(docs, pairs, several, percent)
        out = _settled(pairs, found, texts, percent, 1, whole)
        forget(texts)
        return out

    # 1: members and their shard's center
    near = shards.where("doc_id <> center and n <= center_most and center_n <= most").select(F.least("center", "doc_id").alias("a"), F.greatest("center", "doc_id").alias("b")).distinct()
    near = written(_bounded(near, points, percent), "near")
    found = settled(near, None, False)
    forget(near)

    # 2: what different components have in a shard, by its tree
    members = _in_components(shards, found, "doc_id", "component")
    mixed = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("doc_id")).alias("mark"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("mark2")).where("x <> y")
    once = written(mixed.groupBy("size", "mark", "mark2").agg(F.min("key").alias("key")).select("key", "size"), "once")  # many shards have the same members
    units = written(_units(members.select("key", "doc_id", "component"), once), "units")
    forget(shards, once)
    counts = points.select("doc_id", "counts")
    likeliest = lambda pairs: pairs.groupBy("a", "b").agg(F.max("shared").alias("shared"))
    # the likeliest pairs that span what may be linked: as many as members, however large a group
    spans = written(_tree_pairs(units.join(counts, "doc_id"), percent, True), "spans")
    found = settled(likeliest(spans), found, True)
    # 3: where all of a unit's were links, what its tree gives is in one component; where one was not, every pair that still
    # lies between two is verified
    open_units = _in_components(_in_components(spans, found, "a", "x"), found, "b", "y").where("x <> y").select("unit").distinct()
    rest = _in_components(units.join(open_units, "unit", "left_semi").drop("component"), found, "doc_id", "component")
    pairs = written(likeliest(_tree_pairs(rest.join(counts, "doc_id"), percent, False)), "pairs")
    forget(units, spans, points)
    if not pairs.isEmpty():
        found = settled(pairs, found, True)
    forget(pairs)

    # equal sets, and ids that are repeated, are links too
    same = full.join(equal, ["sign", "sign2"]).where("doc_id <> same_as").select(F.col("same_as").alias("a"), F.col("doc_id").alias("b"))
    final = _joined(found, same)
    return ids.select("doc_id", F.col("n").alias("n_shingles")).join(final, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
