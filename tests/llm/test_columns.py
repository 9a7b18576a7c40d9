"""The queries' own columns against brute force: tokens, removed passages, and neighbours."""

import base64
import hashlib
import math
import random
import struct

import numpy as np
import public_tokenizers
import tiktoken

from textsieve.llm import queries

DRAW = random.Random(12)
DOCS = "doc_id long, text string, n_tokens int, _id long, ids string, n_bytes int, same string"


def documents(spark, path, texts):
    spark.createDataFrame([(i, t, 1, 2, "x", 3, "y") for i, t in texts], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_tokens(spark, tmp_path):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    said = ["", None, " ", "\n\n  \t x", "it's 12345 naïve — 漢字 𝄞\u0000", "<|endoftext|>", "a" * 5000, "ab" * 9000 + " ", "é" * 3000, "Hello, world! " * 400, "\r\n \r\n", "don't DON'T we'LL"]
    said += ["".join(DRAW.choice(["the ", "in", "G", "ß", "  ", "\n", "42", "...", "'s", "и", "🙂"]) for _ in range(DRAW.randint(1, 300))) for _ in range(60)]
    texts = [*enumerate(said), (None, "no id"), (3, said[3])]
    got = queries.QUERIES["op5_byte_bpe"](spark, documents(spark, tmp_path, texts)).collect()
    want = []
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, (tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in got))) == sorted(map(str, want))
    documents(spark, tmp_path / "none", [])
    assert queries.QUERIES["op5_byte_bpe"](spark, str(tmp_path / "none")).collect() == []


def test_removed_passages(spark, tmp_path):
    word = lambda n: "".join(DRAW.choice("abcdefgh ") for _ in range(n))
    shared = [word(n) for n in (100, 101, 99, 150, 400)]
    said = [word(DRAW.randint(0, 200)) + DRAW.choice(shared) + word(DRAW.randint(0, 80)) + DRAW.choice(shared) for _ in range(60)]
    said += ["x" * 500, "xy" * 200, "", None, "é" * 120, "z" + "é" * 120, said[0], said[0], shared[0], shared[2], "𝄞" * 60]
    got = queries.QUERIES["op7_suffix_dedup"](spark, documents(spark, tmp_path, list(enumerate(said)))).collect()
    seen, want = set(), []
    for i, t in enumerate(said):
        raw, gone = (t or "").encode(), set()
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(raw[p : p + 100])
        runs = sum(1 for k in gone if k - 1 not in gone)
        want.append((i, len(raw), len(gone), runs, hashlib.sha256(bytes(b for k, b in enumerate(raw) if k not in gone)).hexdigest()))
    assert sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got) == want


def test_neighbours(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(0, 260)]
    rows += [(300 + i, rows[100][1]) for i in range(15)]  # ties
    odd = [(400, None), (401, [0.0] * 8), (402, [math.nan] + [1.0] * 7), (500, [None] + [1.0] * 7), (600, [math.inf] + [1.0] * 7), (None, [1.0] * 8), (7, [9.0] * 8), (7, rows[7][1]), (9, rows[9][1])]
    spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<float>, label int, _v int, c int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    least = {}
    for i, v in rows + odd[6:]:
        least[i] = min(v, least.get(i, v))
    found = queries.QUERIES["op8_neighbours"](spark, str(tmp_path))
    assert found.schema.simpleString() == "struct<query_id:bigint,rank:int,vec_id:bigint,score:double>"
    got: dict[int, list] = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert sorted(got) == [0, 100, 200, 300]
    x = {i: np.array(v, np.float64) for i, v in least.items()}
    right = 0
    for q, near in got.items():
        best = sorted((math.sqrt(((x[q] - x[c]) ** 2).sum()), c) for c in x if c != q)[:10]
        assert len(near) == 10 and near == sorted(near) and q not in {c for _, c in near}
        for d, c in near:
            assert d == np.sqrt(((x[c] - x[q]) ** 2).sum())
        right += len({c for _, c in near} & {c for _, c in best})
    assert right >= 0.9 * 40
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert queries.QUERIES["op8_neighbours"](spark, f"{tmp_path}/none").collect() == []
