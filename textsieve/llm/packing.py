"""Best-fit packing of token pieces into sequences under several capacities at once.

A piece is a vector: its tokens, 1 document, and the attention cost of its tokens (their square). A sequence starts with
the capacities and keeps their residuals. Pieces go, largest first, to the open sequence that can take them in every
dimension and whose weighted residual norm is then least; where none can, a new sequence opens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written


@dataclass(frozen=True)
class Capacity:
    """Of one sequence; the weights are those of the shares left of each capacity in the norm."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)


class _Ids:
    """Packed ids of texts by a byte-level tokenizer file of the tokenizers library. Its vocabulary lists merges in the
    order of their ids, so the ids are ranks and tiktoken's merge loop gives the same ids ten times faster; the two are
    held against each other when a worker loads the file. As in the library, a special token's own string in a text is that
    token, and texts are cut there first."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        slow = Tokenizer.from_file(path)
        # the byte that each character of the vocabulary stands for, as the library itself maps bytes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        added = slow.get_added_tokens_decoder()
        special = {t.content: k for k, t in added.items()}
        ranks = {bytes(map(byte_of.__getitem__, token)): k for token, k in slow.get_vocab().items() if token not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        same = set(byte_of) == set(pre_tokenizers.ByteLevel.alphabet()) and not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        if not same or any(self.fast.encode(text, allowed_special="all") != slow.encode(text, add_special_tokens=False).ids for text in _SAMPLES):
            raise ValueError(f"{path} isn't a byte-level vocabulary in the order of its merges")

    def ids(self, text: str) -> bytes:
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes() if text else b""


_SAMPLES = ("", "It's 12 o'clock,  and\n\n all is well.\t ", "a<|endoftext|> naïve <|endoftext|><|endoftext|>Größe año façade 東京 😀 #$%", "thndeaing reation ererst" * 5)

_ids: dict[tuple[str, str], _Ids] = {}


def pieces_of(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one, or if there are more than most, the first takes what is over."""
    first = n if n <= most else n % most or most
    return [(0, first), *((at, most) for at in range(first, n, most))]


def token_pieces(docs: DataFrame, path: str, pattern: str, most: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (packed little-endian unsigned 32-bit) of each document's ids and then end_id,
    cut only where there are more than most; pattern is that by which the tokenizer splits texts. Null texts count as empty (end_id alone); null and repeated ids stay as they
    are; other columns take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids.get((path, pattern)) or _ids.setdefault((path, pattern), _Ids(path, pattern))
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for b in slices(batches, 1, 4 << 20):
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packed = ids.ids(text or "") + end
                rows += [(doc, k, at, n, packed[4 * at : 4 * (at + n)]) for k, (at, n) in enumerate(pieces_of(len(packed) // 4, most))]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], names=[id_col, "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids binary")


def fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the offset of each piece; lengths must not rise."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=np.float64)
    weights = np.asarray(capacity.weights) / full**2
    n = len(lengths)
    bin_of, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left, used = np.zeros((3, n)), np.zeros(n, np.int64)
    names = np.zeros(n, np.int64)  # of the open sequences, whose residuals are the first `open_` columns
    open_ = made = 0
    least = float(lengths[-1]) if n else 0
    for i, length in enumerate(lengths.tolist()):
        item = np.array([length, 1, length * length], dtype=np.float64)[:, None]
        after = left[:, :open_] - item
        can = (after >= 0).all(axis=0)
        if open_ and can.any():
            norm = np.where(can, weights @ (after * after), np.inf)
            k = int(norm.argmin())
        else:
            k, open_, made = open_, open_ + 1, made + 1
            left[:, k], used[k], names[k] = full, 0, made - 1
        bin_of[i], offset[i] = names[k], used[k]
        left[:, k] -= item[:, 0]
        used[k] += length
        if left[0, k] < least or left[1, k] < 1:  # nothing more fits: the last open one takes its column
            open_ -= 1
            left[:, k], used[k], names[k] = left[:, open_], used[open_], names[open_]
    return bin_of, offset


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), shard_rows: int = 15_000, id_col: str = "doc_id") -> DataFrame:
    """pieces (id_col, piece, start, length, more) with sequence_id and offset. Pieces that fill a sequence in some dimension
    stand alone, without a shuffle; the others are dealt by a hash to shards of about shard_rows and packed there, so at most one
    loosely filled sequence is left per shard. Lengths must be from 1 to capacity.tokens. An empty table gives an empty
    one; null ids and repeated rows are packed like any other."""
    alone = (F.col("length") >= capacity.tokens) | (F.col("length") * F.col("length") >= capacity.attention) | F.lit(capacity.documents <= 1)
    rest = pieces.where(~alone)
    shards = max(1, -(-rest.count() // shard_rows))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["_shard"].iloc[0])
        pdf = pdf.drop(columns="_shard").sort_values("length", ascending=False, kind="stable")
        bin_of, pdf["offset"] = fit(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = 2 * (bin_of * shards + shard) + 1
        return pdf

    packed = rest.withColumn("_shard", F.pmod(F.xxhash64(id_col, "piece", "start"), F.lit(shards)).cast("int")).groupBy("_shard").applyInPandas(run, schema)
    return packed.unionByName(pieces.where(alone).withColumn("sequence_id", 2 * F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: Capacity = Capacity()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all documents. The ids themselves only pass from
    the tokenizer to their checksum; what is shuffled is a few numbers a piece."""

    pieces = token_pieces(docs, path, pattern, capacity.tokens)
    return pack(written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"), capacity)


__all__ = ["Capacity", "fit", "pack", "pack_documents", "pieces_of", "token_pieces"]
