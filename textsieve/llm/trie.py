"""The prefix trie of conversations: which ones begin alike, how far, and what a cache of their prefixes would save.

Turns count by a digest of role and text, so texts are not moved. Conversations of equal turns are one sequence with a
count. Sequences are dealt by a hash of their first turn, and each part builds its tries with dictionaries of child
pointers. A first turn whose sequences are too many for a part becomes a node of its own: its sequences are dealt again by
their second turn, and so on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: A turn whose sequences have more turns than this from there on, and are more than FEW, is dealt again by the next turn.
MOST_TURNS, FEW = 50_000, 64
#: Up to so many paths of 32 bytes are broadcast.
BROADCAST_PATHS = 500_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """conv_id, digests (array<binary>, of a turn's role and text) and sizes (array<bigint>, UTF-8 bytes of its text):
    conversation c begins with the first h turns of conversation c - c % every (all if fewer, none if it isn't there) and
    goes on with its own turns after its first h, if any; h = crc32(decimal c) % most. Remainders have the sign of c, as in SQL.

    Turns stand by turn, nulls first, then by role, then by the sha256 of their text; null roles and texts count as empty;
    repeated rows are turns of their own; rows without a conv_id take no part, nor do other columns. Conversations of one
    base, fewer than 2 * every, lie together, so that one shuffle of digests serves for all; a conversation is one row."""
    c = F.col("conv_id").cast("long")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = lambda x: F.unhex(F.sha2(x, 256))
    rows = turns.where(c.isNotNull()).select(c.alias("conv_id"), (c - c % every).alias("base"), F.struct(F.col("turn"), role.alias("role"), sha(F.encode(text, "UTF-8")).alias("text"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    digest = lambda t: sha(F.concat(F.encode(F.concat(F.char_length(t["role"]).cast("string"), F.lit(":"), t["role"]), "UTF-8"), t["text"]))
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    own = own.select("base", F.struct("conv_id", F.transform("ts", lambda t: F.struct(digest(t).alias("d"), t["size"].alias("n"))).alias("ts")).alias("x"))
    near = own.groupBy("base").agg(F.collect_list("x").alias("all"))
    first = F.coalesce(F.get(F.filter("all", lambda x: x["conv_id"] == F.col("base")), F.lit(0))["ts"], F.array().cast("array<struct<d:binary,n:bigint>>"))
    h = (F.crc32(F.encode(F.col("x.conv_id").cast("string"), "UTF-8")) % most).cast("int")
    each = near.withColumn("first", first).select("first", F.explode("all").alias("x")).withColumn("h", h)
    joined = each.select(F.col("x.conv_id").alias("conv_id"), F.concat(F.slice("first", F.lit(1), F.col("h")), F.slice("x.ts", F.col("h") + 1, F.greatest(F.size("x.ts"), F.lit(1)))).alias("ts"))
    return joined.select("conv_id", F.col("ts.d").alias("digests"), F.col("ts.n").alias("sizes"))


def sequences(convs: DataFrame) -> DataFrame:
    """Of convs (conv_id, digests, sizes; each id once) the distinct sequences: digests, sizes, n (conversations), conv
    (the smallest), ends (lower-case sha256 hex of their decimal ids in rising order, joined by commas).

    Ids are dealt by range and joined to pieces there, a batch of rows at a time, so that the one hash of many copies
    takes pieces in, not rows; it streams, and no group is held."""
    key = F.sha2(F.array_join(F.transform("digests", F.hex), ""), 256)
    ranged = convs.select("conv_id", key.alias("seq"), "digests", "sizes").repartitionByRange("conv_id").sortWithinPartitions("conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: dict[str, list[int]] = {}
            first: dict[str, int] = {}
            for i, (c, s) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                of.setdefault(s, []).append(c)
                first.setdefault(s, i)
            at = pa.array(list(first.values()), pa.int64())
            cols = [pa.array(list(of), pa.string()), b.column(0).take(at), pa.array([len(x) for x in of.values()], pa.int64()), pa.array([",".join(map(str, x)) for x in of.values()], pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, b.column(2).take(at), b.column(3).take(at)], names=["seq", "conv", "n", "ids", "digests", "sizes"])

    pieces = ranged.mapInArrow(joined, "seq string, conv long, n long, ids string, digests array<binary>, sizes array<long>")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, n, conv, row = None, None, 0, 0, None
        out: list[tuple] = []

        def done() -> tuple:
            return *row, n, conv, sha.hexdigest()

        def batch() -> pa.RecordBatch:
            digests, sizes, *rest = zip(*out, strict=True)
            cols = [pa.concat_arrays(digests), pa.concat_arrays(sizes), *(pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.int64(), pa.string()), strict=True))]
            return pa.RecordBatch.from_arrays(cols, names=["digests", "sizes", "n", "conv", "ends"])

        for b in batches:
            for i, (s, c, k, ids) in enumerate(zip(*(b.column(j).to_pylist() for j in range(4)), strict=True)):
                if s != now:
                    if now is not None:
                        out.append(done())
                    if len(out) >= 1000:
                        yield batch()
                        out = []
                    now, sha, n, conv, row = s, hashlib.sha256(ids.encode()), k, c, (b.column(4).slice(i, 1), b.column(5).slice(i, 1))
                else:
                    sha.update(b"," + ids.encode())
                    n += k
        if now is not None:
            out.append(done())
            yield batch()

    return pieces.repartition("seq").sortWithinPartitions("seq", "conv").mapInArrow(hashed, "digests array<binary>, sizes array<long>, n long, conv long, ends string")


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _built(depth: int):
    """A part's nodes from its sequences below paths of `depth` turns; _path is the path that a node hangs from, null for
    nodes that hang from another node of the part."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        kids: list[dict[bytes, int]] = []
        parent, level, size, n, conv, ends, path, above = ([] for _ in range(8))
        tops: dict[tuple[bytes, bytes], int] = {}

        def node(of: int, d: int, s: int, c: int, p: bytes | None, up: int | None) -> int:
            kids.append({})
            for held, x in zip((parent, level, size, n, conv, ends, path, above), (of, d, s, 0, c, NO_ENDS, p, up), strict=True):
                held.append(x)
            return len(kids) - 1

        for p, up, digests, sizes, count, c, end in zip(*(rows[x] for x in ("path", "up", "digests", "sizes", "n", "conv", "ends")), strict=True):
            at = -1
            for k in range(depth, len(digests)):
                d, known = bytes(digests[k]), tops if at < 0 else kids[at]
                key = (bytes(p), d) if at < 0 else d
                if key not in known:
                    known[key] = node(at, k + 1, int(sizes[k]), c, bytes(p) if at < 0 else None, up if at < 0 else None)
                at = known[key]
                n[at] += count
                conv[at] = min(conv[at], c)
            ends[at] = end
        leaves, saved = [0] * len(kids), [0] * len(kids)
        stack, order = list(tops.values()), []
        while stack:  # each node before its children, so in reverse after them
            order.append(stack.pop())
            stack.extend(kids[order[-1]].values())
        for i in reversed(order):
            leaves[i] = leaves[i] or 1
            saved[i] += (n[i] - 1) * size[i]
            if parent[i] >= 0:
                leaves[parent[i]] += leaves[i]
                saved[parent[i]] += saved[i]
        up = [conv[p] if p >= 0 else u for p, u in zip(parent, above, strict=True)]
        return pd.DataFrame({"conv_id": conv, "depth": level, "parent_conv_id": up, "n_convs": n, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "_path": path})

    return build


def nodes(convs: DataFrame, most_turns: int = MOST_TURNS, few: int = FEW) -> DataFrame:
    """The trie of convs (conv_id, digests, sizes; each id once), a row for each node: each distinct sequence of the first
    d turns of a conversation, from the root of none (d = 0). conv_id is the smallest member, the members are the
    conversations that begin with the sequence; depth d; parent_conv_id (null for the root); n_convs, the members;
    n_children; n_leaves, childless nodes in the subtree, itself included; saved_tokens, the sum over the subtree of
    (n_convs - 1) * bytes of a node's last text; ends_sha256, the sha256 of the decimal ids, in rising order, of the members
    that have no more turns.

    Conversations without turns end at the root; no conversations have no root. A part's memory is bounded by most_turns,
    or by `few` conversations where these alone are longer."""
    spark = convs.sparkSession
    convs = written(convs, "conversations")
    seqs = written(sequences(convs), "sequences")
    forget(convs)
    n, conv, turns = seqs.agg(F.sum("n"), F.min("conv"), F.sum(F.size("digests"))).first()
    if n is None:
        return spark.createDataFrame([], NODE)
    going = seqs.withColumn("path", F.lit(b"")).withColumn("up", F.lit(conv).cast("long"))
    # at each depth: nodes that are dealt again (path, and that of their parent), what ends there, and the parts' nodes
    split = [spark.createDataFrame([(b"", None, conv, None, n, 0)], "path binary, from binary, conv_id long, parent_conv_id long, n_convs long, size long")]
    parts, ended, spent = [], [], [seqs]
    while True:
        d = len(parts)
        ended.append(going.where(F.size("digests") == d).select("path", F.col("ends").alias("ends_sha256")))
        going = going.where(F.size("digests") > d).withColumn("next", F.unhex(F.sha2(F.concat("path", F.get("digests", F.lit(d))), 256)))
        sums = going.groupBy("next").agg(F.sum(F.size("digests") - d).alias("_turns"), F.count(F.lit(1)).alias("_seqs"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), F.first(F.get("sizes", F.lit(d))).alias("size"), F.first("path").alias("from"), F.first("up").alias("parent_conv_id"))
        large = written(sums.where((F.col("_turns") > most_turns) & (F.col("_seqs") > few)).select(F.col("next").alias("path"), "from", "conv_id", "parent_conv_id", "n_convs", "size"), f"split_{d + 1}")
        spent.append(large)
        again = large.count()
        hint = (lambda t: F.broadcast(t)) if again <= BROADCAST_PATHS else (lambda t: t)
        small = going.join(hint(large.select(F.col("path").alias("next"))), "next", "left_anti") if again else going
        part = F.pmod(F.xxhash64("next"), F.lit(max(1, -(-turns // most_turns))))
        fields = ["path", "up", "digests", "sizes", "n", "conv", "ends"]
        parts.append(written(small.select(*fields, part.alias("_part")).groupBy("_part").applyInPandas(_built(d), f"{NODE}, _path binary"), f"nodes_{d}"))
        if not again:
            break
        split.append(large)
        below = large.select(F.col("path").alias("next"), F.col("conv_id").alias("_conv"))
        going = going.drop("path", "up").join(hint(below), "next").withColumnRenamed("next", "path").withColumnRenamed("_conv", "up")
    found, below = None, None
    for own, ends, made in zip(reversed(split), reversed(ended), reversed(parts), strict=True):
        kids = made.where("_path is not null").select(F.col("_path").alias("path"), "n_leaves", "saved_tokens")
        if below is not None:
            kids = kids.unionByName(below)
        sums = kids.groupBy("path").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("_below"))
        rows = own.withColumn("depth", F.lit(len(split) - 1).cast("long")).join(sums, "path", "left").join(ends, "path", "left")
        rows = rows.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("n_leaves", F.coalesce("n_leaves", F.lit(1).cast("long")))
        rows = rows.withColumn("saved_tokens", F.coalesce("_below", F.lit(0)) + (F.col("n_convs") - 1) * F.col("size")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
        rows = written(rows.select("path", "from", *(x.split()[0] for x in NODE.split(", "))), "node_rows")
        split.pop()
        below = rows.select(F.col("from").alias("path"), "n_leaves", "saved_tokens")
        both = rows.drop("path", "from").unionByName(made.drop("_path"))
        found = both if found is None else found.unionByName(both)
    forget(*spent)
    return found


#: DuckDB SQL for nodes(rebuilt(conversations)).
SQL = r"""
WITH o AS (SELECT conv_id AS c, list(struct_pack(d := md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), n := octet_length(encode(coalesce(text, ''))))
    ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, ts, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 9 AS h FROM o),
r AS (SELECT h.c, list_concat(coalesce(p.ts, [])[1:h], h.ts[h + 1:]) AS ts FROM h LEFT JOIN o p ON p.c = h.c - h.c % 5),
k AS (SELECT c, d, array_to_string(list_transform(ts[1:d], lambda x: x.d), '') AS p, CASE WHEN d = 0 THEN 0 ELSE ts[d].n END AS size, len(ts) = d AS fin FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
g AS (SELECT p, d, min(c) AS c, count(*) AS n, (count(*) - 1) * min(size) AS own, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE fin), '')) AS ends FROM k GROUP BY p, d),
q AS (SELECT p[1:32 * (d - 1)] AS p, count(*) AS kids FROM g WHERE d > 0 GROUP BY 1),
s AS (SELECT p[1:32 * e] AS p, sum(own) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM (SELECT g.p, own, q.p IS NULL AS leaf, unnest(range(0, d + 1)) AS e FROM g LEFT JOIN q USING (p)) GROUP BY 1)
SELECT g.c AS conv_id, g.d AS depth, u.c AS parent_conv_id, g.n AS n_convs, coalesce(q.kids, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, g.ends AS ends_sha256
FROM g JOIN s USING (p) LEFT JOIN q USING (p) LEFT JOIN g u ON g.d > 0 AND u.d = g.d - 1 AND u.p = g.p[1:32 * (g.d - 1)]"""
