"""Removal of repeated substrings by suffix sorting, one bucket at a time.

Sorting all suffixes of a corpus needs many times its size. A difference cover bounds this: a sparse sample of positions
such that any two equal strings of the wanted length hold a sampled position at the same offset; only sampled suffixes
are ranked, and a tie between two others is resolved by the bytes up to the sample and the ranks from there. A periodic
cover would sample a seventh or more of all positions; the cover here is chosen by content (each string of `length`
bytes samples the place of its least k-gram hash, a string synchronising set), which samples two in `length - k`, has
the property across documents, and lets suffixes be dealt to buckets by the k-gram at the sample: strings that are equal
meet in one bucket.

A bucket's samples are ranked by the bytes to their right and, reversed, by those to their left; with the common prefixes
of neighbours in both orders, two strings at offset o are equal if their samples' left ranks agree for o bytes and their
right ranks for the rest. Equal surroundings are one row. A bucket that is too large for one task is sorted on: its range
of offsets is halved, and in each half the rows are dealt by all the bytes that strings of these offsets are known to
hold, and cut to what they can hold. After log2(length) such steps a bucket is one string, and so one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_sums, forget, powers, slices, written

GRAM = 32
#: Rows of distinct surroundings that are sorted at once; a bucket of more is split first.
BUCKET_ROWS = 50_000
_SEGMENT = 4 << 20
_PLACE = np.uint64((1 << 24) - 1)


def _window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of `width` bytes, the same wherever the bytes are the same."""
    sums = byte_sums(data)
    h = (sums[width:] - sums[:-width]) * powers(len(data) + 1)[1][: len(data) - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def samples(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): the cover of one document's strings of `length` bytes. Strings starting from first to
    last sample this place, that of the least k-gram hash in them (leftmost among equals)."""
    parts = []
    for base in range(0, max(len(data) - length + 1, 0), _SEGMENT):
        part = data[base : base + _SEGMENT + length - 1]
        h = _window_hashes(part, GRAM)
        least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        wide, width = length - GRAM + 1, 1
        while 2 * width <= wide:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if wide > width:
            least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
        at = (least & _PLACE).astype(np.int64)
        firsts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        lasts = np.r_[firsts[1:] - 1, len(at) - 1]
        parts.append((h[at[firsts]], at[firsts] + base, firsts + base, lasts + base))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)


def _sampled(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 4 << 20):
            ids, texts, copies = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_pylist(), b.column(1).to_numpy()
            found = [samples(np.frombuffer(x.encode(), np.uint8), length) for x in texts]
            n = [len(f[0]) for f in found]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[0] for f in found]).view(np.int64)), pa.array(np.repeat(copies, n)), pa.array(np.concatenate([f[1] for f in found]).astype(np.int32)), pa.array(np.repeat(ids, n))], names=["h", "same", "at", "doc_id"])

    return docs.mapInArrow(run, "h long, same long, at int, doc_id long")


def _repeated(sampled: DataFrame) -> DataFrame:
    """same, doc_id, at of the samples whose hash is at several places; copies of one document count as one place, and
    the copy of least id stands for them. Samples are sorted over all tasks by range, so that one hash with many of them
    is spread. A range's first and last hash may go on in the ranges beside it and stay in any case; that and the 64 bits
    of a hash only keep places that later turn out to be alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out_already, first = None, False, None
        names = ["same", "at", "doc_id"]
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            first = cols[0][0] if first is None else first
            if held is not None:
                cols = [np.r_[x, c] for x, c in zip(held, cols, strict=True)]
            h, same, at, _ = cols
            new = np.r_[True, (h[1:] != h[:-1]) | (same[1:] != same[:-1]) | (at[1:] != at[:-1])]
            cols = [c[new] for c in cols]
            h = cols[0]
            with_next = np.r_[h[1:] == h[:-1], False]
            keep = with_next | np.r_[False, with_next[:-1]] | (h == first)
            emitted_last = bool(keep[-1])
            if out_already:
                if len(h) == 1:
                    emitted_last = True
                keep[0] = False
            out_already, held = emitted_last, [c[-1:] for c in cols]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols[1:]], names=names)
        if held is not None and not out_already:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[1:]], names=names)

    dealt = sampled.repartitionByRange("h", "same", "at").sortWithinPartitions("h", "same", "at", "doc_id")
    return dealt.mapInArrow(run, "same long, at int, doc_id long")


#: Of a row: its bucket, the range of offsets that counts there, the bytes around its sample that strings of these offsets
#: can hold, the row's own range of offsets, and where it is.
_ROW = "key long, a int, b int, sign binary, around binary, low int, high int, doc_id long, same long, at long"
_ROWS = [f.split()[0] for f in _ROW.split(", ")]
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


def _row(key: int, a: int, b: int, around: bytes, *more: int) -> tuple:
    return (key, a, b, hashlib.blake2b(around, digest_size=12).digest(), around, *more)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_ROWS)


def _surroundings(docs: DataFrame, repeated: DataFrame, length: int) -> DataFrame:
    """A row for each repeated sample: the bytes around it that strings with this sample can hold."""
    places = repeated.groupBy("doc_id", "same").agg(F.collect_list("at").alias("places"))
    left = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 2 << 20):
            rows: list[tuple] = []
            for doc, same, text, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode()
                h, at, first, last = samples(np.frombuffer(raw, np.uint8), length)
                wanted = np.isin(at, places)
                padded = b"\0" * left + raw + b"\0" * length
                for key, p, lo, hi in zip(h[wanted].view(np.int64).tolist(), at[wanted].tolist(), first[wanted].tolist(), last[wanted].tolist(), strict=True):
                    rows.append(_row(key, 0, left, padded[p : p + left + length], p - hi, p - lo, doc, same, p))
            yield _batch(rows)

    return docs.join(places, ["doc_id", "same"]).select("doc_id", "same", "text", "places").mapInArrow(run, _ROW)


def _split(rows: DataFrame, length: int) -> DataFrame:
    """The rows of large buckets in two smaller ones: each half of the offsets with the bytes known for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for _, a, b, _, around, low, high, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                middle = (a + b) // 2
                for x, y in ((a, middle), (middle + 1, b)):
                    if max(low, x) <= min(high, y):
                        known = around[b - x : b + length - y]
                        key = int.from_bytes(hashlib.blake2b(known, digest_size=8).digest(), "little", signed=True)
                        out.append(_row(key, x, y, around[b - y : b + length - x], max(low, x), min(high, y), *place))
            yield _batch(out)

    return rows.select(*_ROWS).mapInArrow(run, _ROW)


def repeated_offsets(around: list[bytes], low: np.ndarray, high: np.ndarray, order: np.ndarray, left: int, length: int) -> list[list[int]]:
    """For each row the offsets o (sample minus start) of its strings that a row of smaller `order` holds too. `around` has
    `left` bytes before the sample."""
    m = len(around)
    grid = np.frombuffer(b"".join(around), np.uint8).reshape(m, -1)

    def ranked(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows in suffix order, and how many bytes each shares with the one before."""
        part = np.ascontiguousarray(part)
        keys = [r.tobytes() for r in part]
        rows = np.array(sorted(range(m), key=keys.__getitem__), dtype=np.int64)
        if not part.shape[1]:
            return rows, np.r_[-1, np.zeros(m - 1, np.int64)]
        differ = part[rows[1:]] != part[rows[:-1]]
        return rows, np.r_[-1, np.where(differ.any(axis=1), differ.argmax(axis=1), part.shape[1])]

    to_right, to_left = ranked(grid[:, left:]), ranked(grid[:, left - 1 :: -1] if left else grid[:, :0])
    out: list[list[int]] = [[] for _ in range(m)]
    for o in range(int(low.min()), int(high.max()) + 1):
        mine = np.flatnonzero((low <= o) & (o <= high))
        if len(mine) < 2:
            continue
        classes = []
        for (rows, shared), depth in ((to_right, length - o), (to_left, o)):
            c = np.empty(m, np.int64)
            c[rows] = np.cumsum(shared < depth)
            classes.append(c[mine])
        by = np.lexsort((order[mine], classes[1], classes[0]))
        x, y = classes[0][by], classes[1][by]
        again = np.r_[False, (x[1:] == x[:-1]) & (y[1:] == y[:-1])]
        for row in mine[by[again]].tolist():
            out[row].append(o)
    return out


_SPAN = "doc_id long, same long, start long, end long"


def _sorted_buckets(rows: DataFrame, length: int) -> DataFrame:
    """doc_id, same, start, end of what to remove, from the rows of buckets that fit."""

    def resolve(rows: list[tuple]) -> pa.RecordBatch:
        _, _, b, around, low, high, doc, same, at = zip(*rows, strict=True)
        places = np.array([doc, same, at], np.int64)
        order = np.empty(len(rows), np.int64)
        order[np.lexsort(places[::-1])] = np.arange(len(rows))
        found = repeated_offsets(list(around), np.array(low), np.array(high), order, b[0], length)
        times = [len(o) for o in found]
        starts = np.repeat(places[2], times) - np.array([o for of in found for o in of], np.int64)
        return _runs(np.repeat(places[0], times), np.repeat(places[1], times), starts, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[1] != held[-1][1] or len(held) >= 20_000 and row[0] != held[-1][0]):
                    yield resolve(held)
                    held = []
                held.append(row)
        if held:
            yield resolve(held)

    dealt = rows.select("key", "a", "b", "around", "low", "high", "doc_id", "same", "at").repartition("a", "key").sortWithinPartitions("a", "key")
    return dealt.mapInArrow(run, _SPAN)


def _runs(docs: np.ndarray, same: np.ndarray, starts: np.ndarray, length: int) -> pa.RecordBatch:
    by = np.lexsort((starts, same, docs))
    docs, same, starts = docs[by], same[by], starts[by]
    new = np.r_[True, (docs[1:] != docs[:-1]) | (same[1:] != same[:-1]) | (starts[1:] > starts[:-1] + 1)] if len(docs) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(docs) - 1] if len(docs) else first
    return pa.RecordBatch.from_arrays([pa.array(docs[first]), pa.array(same[first]), pa.array(starts[first]), pa.array(starts[last] + length)], names=["doc_id", "same", "start", "end"])


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, same (64-bit hash of the text), start, end: bytes to remove, in runs that may overlap. docs: doc_id, same,
    text without nulls. A byte goes if a string of `length` bytes over it also starts earlier: in a smaller doc_id, in a text
    of smaller `same` where texts share an id, or before in the same text."""
    rows = docs.select("doc_id", "same", F.octet_length("text").cast("long").alias("n"), F.md5(F.encode("text", "UTF-8")).alias("md5"))
    first = rows.groupBy("md5").agg(F.min("doc_id").alias("first"))
    copies = rows.join(first, "md5").where((F.col("doc_id") > F.col("first")) & (F.col("n") >= length)).select("doc_id", "same", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    # of copies, _repeated() keeps the one of least id
    repeated = written(_repeated(_sampled(docs, length)), "repeated")
    found = written(_surroundings(docs, repeated, length), "surroundings")
    forget(repeated)
    gone = [written(copies, "copies")]
    bucket, key, place = ["a", "key"], ["a", "key", "sign", "low", "high"], F.struct("doc_id", "same", "at")
    while True:
        firsts = written(found.groupBy(*key).agg(F.min(place).alias("first"), F.first("b").alias("b"), F.first("around").alias("around")).select(*key, "b", "around", "first.*"), "firsts")
        later = found.select(*key, "doc_id", "same", "at").join(firsts.select(*key, place.alias("first")), key).where(place > F.col("first"))
        gone.append(written(later.select("doc_id", "same", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end")), "later"))
        forget(found)
        sizes = written(firsts.groupBy(*bucket).count().where("count > 1"), "sizes")  # alone in its bucket, a row has nothing to meet
        fits = firsts.join(sizes.where(F.col("count") <= BUCKET_ROWS).select(*bucket), bucket, "left_semi")
        gone.append(written(_sorted_buckets(fits, length), "resolved"))
        large = sizes.where(F.col("count") > BUCKET_ROWS).select(*bucket)
        if large.isEmpty():
            forget(firsts, sizes)
            break
        found = written(_split(firsts.join(large, bucket, "left_semi"), length), "split")
        forget(firsts, sizes)
    return reduce(DataFrame.unionByName, gone)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of start and end, maximal runs of removed bytes), kept (binary).

    Null texts count as empty; texts shorter than `length` lose nothing; a text may have any length; an empty table gives
    an empty one; rows without an id are left out. A row repeated with its id and text is the same document twice and is
    treated alike. Different texts of one id are documents of their own, ordered by a hash of the text. Other columns take
    no part."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null").withColumn("same", F.xxhash64("text"))
    docs = docs.select("doc_id", "same", "text")
    gone = repeats(docs, length).groupBy("doc_id", "same").agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 4 << 20):
            rows = []
            for doc, text, gone in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode()
                spans = [s for s in merged([(x["start"], min(x["end"], len(raw))) for x in gone or []]) if s[0] < s[1]]
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc, len(raw), len(raw) - len(kept), [{"start": s, "end": e} for s, e in spans], kept))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return docs.join(gone, ["doc_id", "same"], "left").select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def cut_texts(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs (doc_id, text and any other columns) without the repeated bytes in text, cut at characters: of a character
    that is only partly covered nothing goes. Null texts stay null, rows without an id stay as they are; repeated ids as in
    without_repeats()."""
    rows = docs.where("doc_id is not null and text is not null")
    id_of, same = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    known = rows.select(id_of.alias("doc_id"), same.alias("same"), F.col("text").cast("string").alias("text"))
    gone = repeats(known, length).groupBy(F.col("doc_id").alias("__cut_id"), F.col("same").alias("__cut_same")).agg(F.collect_list(F.struct("start", "end")).alias("__cut"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, 4 << 20):
            texts = []
            for text, gone in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if text is None or not gone:
                    texts.append(text)
                    continue
                raw, kept, done = text.encode(), [], 0
                for s, e in merged([(x["start"], min(x["end"], len(raw))) for x in gone]):
                    while s < len(raw) and raw[s] & 0xC0 == 0x80:
                        s += 1
                    while s < e < len(raw) and raw[e] & 0xC0 == 0x80:
                        e -= 1
                    if s < e:
                        kept.append(raw[done:s])
                        done = e
                texts.append(b"".join([*kept, raw[done:]]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)], names=b.schema.names[:-1])

    joined = docs.join(gone, (id_of == F.col("__cut_id")) & (same == F.col("__cut_same")), "left")
    return joined.select(*docs.columns, "__cut").mapInArrow(run, docs.schema)
