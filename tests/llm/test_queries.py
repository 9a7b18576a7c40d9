"""The numbered queries and the pipeline's stages over small tables with nulls, empty and long texts, ties, repeated rows and
ids, and columns of clashing names."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textsieve.llm import fingerprint, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id int, _v int, _row int, _keep string, __ld_host string, h long"


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(21)
    words = ["".join(draw.choice(list("abcdeinorst"), draw.integers(2, 8))) for _ in range(300)]
    said = [" ".join(draw.choice(words, 80)) + "\nprivacy terms contact\n" + " ".join(draw.choice(words, 20)) for _ in range(40)]
    said += [said[0], said[0] + " more", said[3][:300] + " " + said[4][:300], "", None, "$$ ## !! " * 40, "short", " \n\t ", "long " * 60_000]
    out = [(i, t) for i, t in enumerate(said)]
    return [*out, out[5], (6, "another text of the same id " + said[7][:200]), (None, said[8]), (None, None)]


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    made = {}
    for name, some in (("full", rows), ("empty", [])):
        d = made[name] = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame([(i, t, None, None if i is None else f"s{i % 2}", None if t is None else len(t), 1, 1, 1, "k", "x", 0) for i, t in some], DOCS).write.parquet(f"{d}/documents.parquet")
        labels = [(i, int("$" not in (t or "$")), int(i % 7 == 0)) for i, t in some if i is not None]
        spark.createDataFrame([*labels, (None, 1, 1)][: len(some)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        turns = [(c, k, "user" if k % 2 == 0 else "assistant", t) for c, (_, t) in enumerate(some) for k in range(3)]
        spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
        vectors = [(i, [float(x) for x in np.random.default_rng(i).normal(size=6)], 0) for i in range(90)] if some else []
        vectors += [(90, None, 0), (100, [math.nan] * 6, 0), (120, [0.0] * 6, 0), (121, [1.0, math.inf, 0.0, 0.0, 0.0, 0.0], 0), (122, vectors[20][1], 0), (123, vectors[20][1], 0)] if some else []
        spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return made


def got(spark, tables, name):
    empty = queries.QUERIES[name](spark, tables["empty"])
    assert empty.count() == (1 if name.startswith("op9") else 0)
    full = queries.QUERIES[name](spark, tables["full"])
    assert full.schema == empty.schema
    return full.collect()


@pytest.mark.parametrize("name, kept", [("op1_toxicity", True), ("op4_line_dedup", True), ("op5_byte_bpe", True), ("op6_quality", True), ("op7_suffix_dedup", False), ("op2_jaccard_join", False)])
def test_one_row_a_document(spark, tables, rows, name, kept):
    found = got(spark, tables, name)
    want = sorted(str(i) for i, _ in rows if kept or i is not None)
    assert sorted(str(r["doc_id"]) for r in found) == want
    if "score" in found[0].asDict():
        n, left = (3, 1) if name == "op1_toxicity" else (4, 2)
        for r in found:
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
            assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % n == left)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{tables['full']}/{t}.parquet/*.parquet')" + (" where doc_id is not null and doc_id not in (5, 6)" if t == "documents" else ""))
    found = queries.QUERIES[name](spark, tables["full"])
    if "doc_id" in found.columns:
        found = found.where("doc_id is not null and doc_id not in (5, 6)")
    result = con.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in found.collect()))) == sorted(map(str, result.fetchall()))


def test_fingerprints_by_hand(spark, tables, rows):
    """Each fingerprint from the lexicon, term by term, and both likenesses."""
    held = [(i, t or "") for i, t in rows if i is not None]
    terms = lambda t: {w for w in re.split(r"[^a-z0-9]+", t.lower()) if w}
    n = len(held)
    df = {}
    for _, t in held:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    lexicon = [w for w, k in df.items() if k >= 2 and 3.0 <= math.log(n / k) <= 7.6]
    known = {r["_term"]: set(r["_subsets"]) for r in fingerprint.lexicon(spark.read.parquet(f"{tables['full']}/documents.parquet").where("doc_id is not null")).collect()}
    assert len(known) == len(lexicon)
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in df], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    found = {r["doc_id"]: r for r in got(spark, tables, "op3_imatch") if r["doc_id"] not in (5, 6)}
    for i, t in held:
        if i in found:
            subsets = set().union(*(known.get(hashes[w], set()) for w in terms(t)))
            mine = [int(x.split(":")[0]) for x in found[i]["fingerprint"].split(".") if x]
            assert mine == (sorted(subsets) or ([-1] if t else []))
            assert found[i]["n_chars"] == len(t)
    order = sorted(found)
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len({x.split(":")[0] for x in a | b})
    prints = lambda r, c: {x for x in r[c].split(".") if x}
    for i in order:
        assert abs(found[i]["near_edited"] - like(prints(found[i], "fingerprint"), prints(found[i], "edited_fingerprint"))) < 1e-12
        if i - 1 in found:
            assert abs(found[i]["near_next"] - like(prints(found[i], "fingerprint"), prints(found[i - 1], "fingerprint"))) < 1e-12
    assert found[40]["fingerprint"] == found[0]["fingerprint"]


@pytest.mark.parametrize("name", ["op11_topk", "op12_fim", "op13_conversation_trie"])
def test_empty_tables(spark, tables, name):
    assert got(spark, tables, name)


def test_chat_rows(spark, tables, rows):
    assert len(got(spark, tables, "op9_chat_format")) == len(rows) + 1


def test_pack_rows(spark, tables, rows):
    found = got(spark, tables, "op10_pack")
    assert sum(r["start"] == 0 for r in found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        ends = np.cumsum([0, *(n for _, n in sorted(spans))])
        assert [o for o, _ in sorted(spans)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_pipeline(spark, tables, rows):
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "suffix_dedup", "pack"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables["full"])
        path = f"{tables['full']}/stage_{name}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "pack":
            assert docs.columns == before.columns
    ids = lambda name: [r["doc_id"] for r in kept[name]]
    assert 45 not in ids("quality") and set(range(40)) <= set(ids("quality"))
    texts = {r["doc_id"]: r["text"] for r in kept["line_dedup"] if r["doc_id"] not in (None, 6)}
    assert all("privacy terms" not in (t or "") for t in texts.values()) and ids("line_dedup").count(5) == 2
    near = ids("near_duplicates")
    assert 40 not in near and 41 not in near and near.count(5) == 1 and near.count(6) == 2 and near.count(None) == ids("quality").count(None)
    cut = {r["doc_id"]: r["text"] for r in kept["suffix_dedup"] if r["doc_id"] not in (None, 6)}
    seen, want = set(), {}
    for r in sorted(((r["doc_id"], r["text"]) for r in kept["near_duplicates"] if r["doc_id"] is not None), key=lambda r: r[0]):
        raw, gone = (r[1] or "").encode(), set()
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(raw[p : p + 100])
        want[r[0]] = bytes(b for k, b in enumerate(raw) if k not in gone).decode()
    assert {i: t or "" for i, t in cut.items()} == {i: t for i, t in want.items() if i != 6}
    assert sum(r["start"] == 0 for r in kept["pack"]) == len(kept["suffix_dedup"])
    plain = lambda found: sorted(str(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))) for r in found)
    assert plain(corpus_pipeline.run(spark, tables["full"]).collect()) == plain(kept["pack"])
    assert corpus_pipeline.run(spark, tables["empty"]).count() == 0
