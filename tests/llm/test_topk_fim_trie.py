"""Exact top-k, fill-in-the-middle and the prefix trie against brute force, with nulls, ties, repeats and clashing names."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textsieve.llm import fim, queries, topk, trie

# Top-k


def best(rows, k, every=20):
    """rows: (id, tuple of ints), each id once."""
    out = []
    for q, v in rows:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in rows if c != q and len(w) == len(v))
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("cell", [(10**6, 10**6), (50, 4)])
@pytest.mark.parametrize("dims", [3, 8, 30])
def test_topk_any_grid(spark, dims, cell):
    draw = np.random.default_rng(dims)
    rows = [(i, tuple(map(int, v))) for i, v in enumerate(draw.integers(-9, 9, (300, dims)) * draw.integers(1, 5, (300, 1)))]
    rows += [(1000 + i, rows[20][1]) for i in range(90)]  # a vector that many share
    df = spark.createDataFrame(rows, "_id long, _v array<long>")
    assert rows_of(topk.search(df, lambda i: i % 20 == 0, 7, cell, sample=60)) == best(rows, 7)


def test_topk_large_numbers_and_lengths(spark):
    rows = [(0, (1 << 30, -(1 << 29), 3)), (1, (1 << 30, 5, 1 << 30)), (2, (7, -(1 << 31), 1)), (20, (3, 4)), (21, (1, 1)), (22, (2, 0)), (40, ()), (41, ())]
    df = spark.createDataFrame(rows, "_id long, _v array<long>")
    assert rows_of(topk.search(df, lambda i: i % 20 == 0)) == best(rows, 20)
    with pytest.raises(Exception):
        topk.search(spark.createDataFrame([(0, [1 << 40]), (1, [1 << 40])], "_id long, _v array<long>"), lambda i: i % 20 == 0).collect()
    with pytest.raises(Exception, match="too large"):
        topk.scaled(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>")).collect()


def test_topk_query_leaves_out_and_repeats(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.51]), (1, [0.25, 0.75]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (None, [1.0, 1.0]), (6, [0.0, 0.0]), (7, [0.25, 0.75]), (7, [0.25, 0.75]), (8, [1.0, 1.0]), (8, [-1.0, 1.0])]
    spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, _id int, _v int, rank int").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = {0: (32, -33), 1: (16, 48), 6: (0, 0), 7: (16, 48), 8: (-64, 64)}  # of id 8 the lesser vector
    got = queries.QUERIES["op11_topk"](spark, str(tmp_path))
    assert rows_of(got) == best(list(whole.items()), 20)
    assert got.schema.simpleString() == "struct<query_id:bigint,rank:int,vec_id:bigint,score:bigint>"
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(topk.scaled(none), lambda i: i % 20 == 0).collect() == []


def test_topk_prunes(spark):
    """Where some dimensions have more weight than others, rows that can't come near any more aren't carried through all
    blocks."""
    draw = np.random.default_rng(4)
    x = np.floor(draw.normal(size=(5000, 64)) * 60 / (1 + draw.permutation(64))).astype(np.int64)
    cell = topk.Cell(np.arange(5000), x)
    for _, ids, _ in cell.best(np.arange(40), x[:40], np.full(40, -np.inf), 10):
        assert len(ids) == 10
    assert cell.added < 0.25 * 40 * 5000 * 7


# Fill in the middle


def arranged_by_hand(i, text):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 50
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "\n", "\n\n\n", "one", "one\ntwo", "a\nb\nc\n", "x<P>y", "<S", "<\n<\n<M", "é𝄞\n漢字\r\n z\x85q\n", "\r\r\n", "line of some length\n" * 40_000, "no feed " * 200_000, "dup\nrow\n", "dup\nrow\n", "$1\\n\n\\2\n"]


def test_fim_by_hand(spark, tmp_path):
    rows = [*enumerate(TEXTS), (None, "a\nb"), (None, None), (3, "again\nb\n"), (-5, "a\nb\nc"), *((i, "".join(f"{k}\n" for k in range(i % 9))) for i in range(100, 160))]
    df = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, n int, form string, _n int")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, *arranged_by_hand(i, t)) for i, t in rows]
    made = fim.arranged(df)
    assert sorted(map(str, (tuple(r) for r in made.collect()))) == sorted(map(str, want))
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted((str(r["doc_id"]), r["t"]) for r in back) == sorted((str(i), t or "") for i, t in rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = queries.QUERIES["op12_fim"](spark, str(tmp_path)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((*w[:5], sha(w[5]), sha(t or ""))) for w, (_, t) in zip(want, rows))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fim_options(spark):
    df = spark.createDataFrame([(i, "a b c d") for i in range(200)], "doc_id long, text string")
    some = fim.arranged(df, rate=30, spm_rate=0, unit=r"\S+\s*|\s+", sentinels=("[[p]]", "[[s]]", "[[m]]"))
    forms = [r["form"] for r in some.collect()]
    assert set(forms) == {"plain", "psm"} and 30 <= forms.count("psm") <= 90
    assert some.where(fim.restored(F.col("output"), F.col("form"), ("[[p]]", "[[s]]", "[[m]]")) != "a b c d").count() == 0
    assert fim.arranged(df.limit(0)).collect() == []
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("", "a", "b"), ("aba", "x", "y"), ("<<P>>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.arranged(df, sentinels=bad)


def test_fim_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = fim.digests(fim.arranged(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Trie


def trie_by_hand(rows):
    """rows: (conv_id, turn, role, text)."""
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by.setdefault(c, []).append(((turn is not None, turn or 0), role, hashlib.sha256(text.encode()).hexdigest(), text))
    own = {c: [(t[1], t[3]) for t in sorted(ts)] for c, ts in by.items()}
    members, made = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
        for d in range(len(made[c]) + 1):
            members.setdefault(tuple(made[c][:d]), []).append(c)
    out = []
    for p, some in members.items():
        below = [x for x in members if x[: len(p)] == p]
        childless = [x for x in below if not any(y[:-1] == x for y in members if y)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in some if tuple(made[c]) == p)))
        kids = sum(1 for y in members if y and y[:-1] == p)
        out.append((min(some), len(p), min(members[p[:-1]]) if p else None, len(some), kids, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def conversations():
    draw = np.random.default_rng(8)
    rows = []
    for c in range(0, 120):
        if c not in (10, 35):  # bases that aren't there
            rows += [(c, k, ["user", "assistant", None][k % 3 if c % 7 == 0 else k % 2], ["hi", "há", "", None, "long " * 50][draw.integers(0, 5)] if k else "start") for k in range(draw.integers(1, 12))]
    rows += [(500 + 5 * i, k, "user", f"same {k}") for i in range(40) for k in range(6)]  # copies
    rows += [(1000, None, "b", "null turn"), (1000, None, "a", "null turn"), (1000, 0, "a", "y"), (1000, 0, "a", "x"), (1000, 0, "a", "x"), (None, 0, "a", "lost"), (-3, 0, "user", "start"), (-5, 0, "user", "start")]
    rows += [(2001, 0, "user", "one turn only"), (2002, 0, "user", "one turn only")]
    return rows


COLUMNS = "conv_id long, turn long, role string, text string, base int, d int, path string"


@pytest.mark.parametrize("most, few", [(50_000, 64), (8, 1), (1, 0)])
def test_trie_by_hand(spark, most, few):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], COLUMNS).repartition(5)
    got = trie.nodes(trie.rebuilt(df), most, few)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == trie_by_hand(rows)


def test_trie_query(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame([(*r, 1, 2, "x") for r in rows], COLUMNS).write.parquet(f"{tmp_path}/full/conversations.parquet")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/none/conversations.parquet")
    got, none = (queries.QUERIES["op13_conversation_trie"](spark, f"{tmp_path}/{x}") for x in ("full", "none"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == trie_by_hand(rows)
    assert none.schema == got.schema and none.collect() == []


def test_trie_of_turnless_and_long(spark):
    # of base 0 nothing is there, and conversation 1 has no turns after its first h
    one = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert zlib.crc32(b"1") % 9 > 0
    assert sorted(map(str, (tuple(r) for r in trie.nodes(trie.rebuilt(one)).collect()))) == trie_by_hand([(1, 0, "user", "x")])
    many = [(c, k, "user", f"{k}") for c in (0, 5) for k in range(4000)]
    got = trie.nodes(trie.rebuilt(spark.createDataFrame(many, "conv_id long, turn long, role string, text string")))
    assert got.count() == 4001 and got.where("n_leaves <> 1").count() == 0
