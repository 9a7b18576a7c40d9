"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

For each byte prefix of a piece there is exactly one token that can be the last of its encoding. A token that ends the
prefix is that one if it follows the last token of the remaining shorter prefix *compatibly*: merging the bytes of the
two from scratch gives these two tokens again. So a table with one token per prefix holds the encodings of all
prefixes; appending bytes adds entries, and an edit only recomputes entries from its place on until they agree again.

Texts are first split by the tokenizer's pattern, and each match is encoded on its own.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that each of a worker's memo tables may hold before it starts anew.
MEMO = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks, which tokens may follow each other, and an automaton that finds all tokens in a string of bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self._follows: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._edges: dict[tuple[int, bool], list[tuple[bytes, float, float]]] = {}
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            found.add_word(token.decode("latin-1"), rank)
        found.make_automaton()
        self.tokens_in = found.iter

    def merges(self, piece: bytes) -> Iterator[list[bytes]]:
        """The parts of a piece as the adjacent pair of least rank is merged, leftmost first, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        yield parts
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
            yield parts

    def merged(self, piece: bytes) -> list[int]:
        """The encoding by definition."""
        for parts in self.merges(piece):
            pass
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Is the token the encoding of its own bytes?"""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def _edge(self, token: int, at_end: bool) -> list[tuple[bytes, float, float]]:
        """What stands at the end (or start) of a token's bytes while these are merged: (part, rank of the greatest merge
        until it is there, rank of the greatest merge until it is merged away)."""
        if (known := self._edges.get((token, at_end))) is None:
            if len(self._edges) >= MEMO:
                self._edges.clear()
            known, at, done, n = [], -1.0, -1.0, 0
            for parts in self.merges(self.bytes_of[token]):
                part = parts[-1 if at_end else 0]
                if n:
                    done = max(done, merge_rank(before, parts, self.ranks))
                if n and part != last:
                    known.append((last, at, done))
                    at = done
                before, last, n = list(parts), part, n + 1
            known.append((last, at, float("inf")))
            self._edges[token, at_end] = known
        return known

    def follows(self, left: int, right: int) -> bool:
        """Do the bytes of both, merged from scratch, give these two tokens? They do unless a part at the end of the left
        one and a part at the start of the right one, there at the same time, are merged."""
        if (known := self._follows.get((left, right))) is None:
            if len(self._follows) >= MEMO:
                self._follows.clear()
            known = self._follows[left, right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        if not (self.whole(left) and self.whole(right)):
            return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        for a, from_a, to_a in self._edge(left, True):
            for b, from_b, to_b in self._edge(right, False):
                rank = self.ranks.get(a + b)
                if rank is not None:
                    when = max(rank, from_a, from_b)
                    # of merges of one rank the leftmost comes first
                    if when < to_a and when <= to_b:
                        return False
        return True

    def extend(self, last: list[int], piece: bytes) -> None:
        """Append the last tokens of all prefixes of the piece longer than those that `last` has. A prefix's last token is
        one that ends it and follows the last token of what comes before."""
        done = len(last)
        last += [-1] * (len(piece) + 1 - done)
        base = max(0, done - self.longest)
        follows, length, known, left = self.follows, self.length, self._follows, len(last) - done
        for j, token in self.tokens_in(piece[base:].decode("latin-1")):
            j += base + 1
            if j >= done and last[j] < 0:
                if i := j - length[token]:
                    if (ok := known.get((last[i], token))) is None:
                        ok = follows(last[i], token)
                else:
                    ok = self.whole(token)
                if ok:
                    last[j] = token
                    left -= 1
        if left:
            raise ValueError("a byte has no token")

    def ids(self, last: list[int]) -> list[int]:
        """The encoding of the longest prefix, from the last tokens of all."""
        out, j, length = [], len(last) - 1, self.length
        while j:
            out.append(token := last[j])
            j -= length[token]
        return out[::-1]


def merge_rank(before: list[bytes], after: list[bytes], ranks: dict[bytes, int]) -> int:
    """The rank of the one merge between two states of the parts."""
    at = next((i for i, (x, y) in enumerate(zip(before, after, strict=False)) if x != y), len(after) - 1)
    return ranks[after[at]]


class PrefixTable:
    """The encodings of all prefixes of a piece. last[j] is the last token of the encoding of the first j bytes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.vocabulary.extend(self.last, self.piece)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put new in place of bytes start to end. Entries up to start stay; those behind the edit are computed, block by
        block, until a run of them as long as the longest token equals the old ones, and the rest is taken over. Returns
        how many were computed."""
        old, shift = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last, same = old[: start + 1], 0
        while (at := len(self.last)) <= len(self.piece):
            self.vocabulary.extend(self.last, self.piece[: at + self.vocabulary.longest - 1])
            for j in range(at, len(self.last)):
                same = same + 1 if j - shift > end and old[j - shift] == self.last[j] else 0
            if same >= self.vocabulary.longest:
                at = len(self.last)
                self.last += old[at - shift :]
                return at - start - 1
        return len(self.piece) - start

    def ids(self) -> list[int]:
        return self.vocabulary.ids(self.last)


class _Words(dict):
    """Packed ids of `prefix + word`, computed when first asked for. When full, it starts anew but for the words that are
    asked for again."""

    def __init__(self, encoder: Encoder, prefix: str):
        self.piece, self.by_pattern, self.prefix = encoder.piece, encoder.by_pattern, prefix
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.before = dict(self)
            self.clear()
        packed = self.before.get(word)
        if packed is None:  # letters alone are one match of the pattern
            packed = (self.piece if word.isalpha() else self.by_pattern)(self.prefix + word)
        self[word] = packed
        return packed


class Encoder:
    """Encodes texts to ids, packed as little-endian unsigned 32-bit integers.

    White space after another character always starts a match of the pattern, so texts are cut at spaces first and words
    seen before are looked up; where a space comes after white space, the words at both sides are one.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.pieces: dict[str, bytes] = {}
        self.first, self.later = _Words(self, ""), _Words(self, " ")

    def piece(self, piece: str) -> bytes:
        packed = self.pieces.get(piece)
        if packed is None:
            last = [-1]
            self.vocabulary.extend(last, piece.encode())
            packed = array("I", self.vocabulary.ids(last)).tobytes()
            if len(packed) <= 256:
                if len(self.pieces) >= MEMO:
                    self.pieces.clear()
                self.pieces[piece] = packed
        return packed

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        words = text.split(" ")
        if not all(words) or any(map(str.isspace, map(itemgetter(-1), words))):
            words = list(_joined(words))
        return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, array("I", packed)))


def _joined(words: list[str]) -> Iterator[str]:
    """The words again, those that are empty or end in white space as one with what follows."""
    held: list[str] = []
    for word in words:
        held.append(word)
        if word and not word[-1].isspace():
            yield " ".join(held)
            held = []
    if held:
        yield " ".join(held)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process: its memo tables last from task to task."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(Vocabulary(read_ranks(path)), pattern)
    return _encoders[path, pattern]


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode the ids again. One row for each row of df, in no order: the id column, `ids` (packed
    little-endian unsigned 32-bit integers), `decoded` (bytes). Null texts count as empty: no ids. Ids are kept as they
    are, null or repeated; other columns take no part. Row by row, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                packed = [e.encode(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), pa.array(map(e.decode, packed), pa.binary())], names=[id_col, "ids", "decoded"])

    rows = df.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids binary, decoded binary")


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_texts()."""
    rows = encode_texts(df, path, pattern)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


__all__ = ["Encoder", "PrefixTable", "Vocabulary", "digests", "encode_texts", "encoder", "read_ranks"]
