"""Operators against brute force on small tables, with nulls, empty texts, ties, repeats and extra columns."""

import hashlib
import itertools
import re
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textsieve.llm import bpe, chat, fingerprint, jaccard, linededup, neighbours, packing, quality, substrings, toxicity
from textsieve.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id int, h string"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, None, "s" if i is None or i % 2 else None, None, 1, "x") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    draw = np.random.default_rng(1)
    words = ["".join(draw.choice(list("abcdeé"), draw.integers(1, 6))) for _ in range(80)]
    said = [" ".join(draw.choice(words, 60)) for _ in range(25)]
    near = [" ".join([*said[0].split()[:-1], f"w{k}"]) for k in range(12)]
    return [*said, *near, said[1], said[1], "", None, "a", said[2] + " " + said[3], "ab " * 200, "  A\tB\n C "]


def test_bpe(spark, texts):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [*texts, "a  b \n\n c", " x ", "It's 'LL don't", "<|endoftext|>", "é" * 300, "😀 a\xa0b", "\x1ca \x85b"]
    got = {r["doc_id"]: r for r in bpe.encode_texts(docs_of(spark, odd), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(odd):
        assert list(array("I", bytes(got[i]["ids"]))) == known.encode_ordinary(t or "")
        assert bytes(got[i]["decoded"]) == (t or "").encode()


def test_prefix_table():
    v = bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    t = bpe.PrefixTable(v, b"thinking")
    t.append(b"aloudwithoutend" * 20)
    assert t.ids() == v.merged(t.piece)
    t.replace(3, 5, b"xyz")
    assert t.ids() == v.merged(t.piece)


def test_packing(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    slow, pattern = Tokenizer.from_file(path), public_tokenizers.PATTERN
    texts = [*texts, "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext| > 'LL x  \n"]
    rows = packing.token_pieces(docs_of(spark, texts), path, pattern, 50).collect()
    for i, t in enumerate(texts):
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in mine for x in array("I", bytes(r["ids"]))] == [*slow.encode(t or "", add_special_tokens=False).ids, 0]
    packed = packing.pack(packing.token_pieces(docs_of(spark, texts), path, pattern, 50).drop("ids"), packing.Capacity(tokens=50, attention=2500)).collect()
    assert len(packed) == len(rows)
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 50
    assert packing.pack(packing.token_pieces(docs_of(spark, []), path, pattern)).count() == 0


def test_packing_keeps_every_capacity():
    draw = np.random.default_rng(12)
    lengths = np.sort(draw.integers(1, 40, 300))[::-1]
    for capacity in (packing.Capacity(100, 3, 10_000), packing.Capacity(100, 100, 2000), packing.Capacity(100, 2, 1700, (1.0, 1.0, 1.0))):
        bins, offsets = packing.fit(lengths, capacity)
        for b in np.unique(bins):
            mine = lengths[bins == b]
            assert mine.sum() <= capacity.tokens and len(mine) <= capacity.documents and (mine**2).sum() <= capacity.attention
            assert offsets[bins == b].tolist() == [0, *np.cumsum(mine)[:-1].tolist()]


def test_chat(spark):
    rows = [(1, 0, "user", "<|im_end|>\\ <|x"), (1, 1, "assistant", "<|im_start|>ok\\n"), (2, None, None, None), (2, 1, "assistant", "é😀"), (None, 0, "assistant", "x")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.digests(out).collect()}
    assert got[1]["loss_sha256"] == hashlib.sha256("<|im_start|>ok\\n".encode()).hexdigest() and got[2]["loss_chars"] == 2 and got[None]["n_turns"] == 1
    assert not any(r["rewrites"] for r in out.collect())
    keys = spark.createDataFrame([(1, 0, "user", "x")], "conv_id short, turn long, role string, text string")
    assert chat.format_conversations(keys).first()["conv_id"] == 1 and chat.format_conversations(keys.limit(0)).count() == 0
    last_only = chat.render([("a", "x" + chat.MARK + "y"), ("b", "2")], lambda t: f"{len(t)}:" + "".join(x for _, x in t))
    assert [last_only.output[s.text_start : s.text_end] for s in last_only.spans] == ["x" + chat.MARK + "y", "2"]
    assert chat.render([("a", "1"), ("b", "2")], lambda t: f"{len(t)}:" + "".join(x for _, x in t)).rewrites


def test_line_dedup(spark):
    lines = [f"menu\nbody {i}\nmenu" for i in range(40)] + [None, "", "only"]
    got = {r["doc_id"]: r["text"] for r in linededup.drop_lines(docs_of(spark, lines)).collect()}
    assert got[3] == "body 3" and got[40] is None and got[41] == "" and got[42] == "only"


def test_jaccard(spark, texts):
    def sets(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    all_sets, of = [sets(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(all_sets):
            for j, b in enumerate(all_sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    of[i] = of[j] = min(of[i], of[j])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(docs_of(spark, texts)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i]["component_id"] for i in range(len(texts))] == of
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in all_sets]


def test_tree_keeps_every_similar_pair():
    draw = np.random.default_rng(2)
    base = draw.poisson(0.2, (60, jaccard.GROUPS))
    points = np.vstack([base, np.maximum(base - (draw.random(base.shape) < 0.01), 0)])
    found = {tuple(sorted(p[:2])) for p in jaccard.CountTree(points, 80).pairs().tolist()}
    n = points.sum(1)
    assert found == {(i, j) for i in range(120) for j in range(i + 1, 120) if np.minimum(points[i], points[j]).sum() * 180 >= 80 * (n[i] + n[j])}


@pytest.mark.parametrize("cap", [50_000, 1])
def test_repeats(spark, texts, cap, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_ROWS", cap)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        raw, gone = (t or "").encode(), set()
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(raw[p : p + 100])
        want[i] = bytes(b for k, b in enumerate(raw) if k not in gone)
    assert {r["doc_id"]: bytes(r["kept"]) for r in substrings.without_repeats(docs_of(spark, texts)).collect()} == want
    assert substrings.cut_texts(docs_of(spark, texts)).count() == len(texts)


def test_repeated_ids_with_other_texts(spark):
    draw = np.random.default_rng(13)
    a, b = ("".join(draw.choice(list("abcdefgh "), 400)) for _ in range(2))
    rows = docs_of(spark, [a, a[:200], b, b], [1, 2, 2, 2])
    kept = sorted(bytes(r["kept"]).decode() for r in substrings.without_repeats(rows).collect())
    assert kept == sorted([a, "", b, b])  # the half is gone, the other text of its id is whole
    cut = sorted((r["doc_id"], r["text"]) for r in substrings.cut_texts(rows).collect())
    assert cut == sorted([(1, a), (2, ""), (2, b), (2, b)])


def test_neighbours(spark):
    x = np.random.default_rng(3).normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, x[0].tolist()), (301, None), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [None] * 16), (305, [1.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).collect()
    hits = 0
    for q in range(0, 301, 20):
        full = np.vstack([x, x[:1]])
        d = np.sqrt(((full - full[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(301), d))[:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(mine) == 10 and all(abs(d[r["vec_id"]] - r["score"]) < 1e-12 for r in mine)
        hits += len(set(best.tolist()) & {r["vec_id"] for r in mine})
    assert hits >= 0.9 * 10 * 16


def test_fingerprint(spark, texts):
    rows = sorted(fingerprint.edited_and_next(docs_of(spark, texts)).collect(), key=lambda r: -r["doc_id"])
    clean = [t or "" for t in texts][::-1]
    for r, t, after in zip(rows, clean, [*clean[1:], clean[0]]):
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()
    prints = {}
    for r, t in zip(rows, clean):
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_next"] <= 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_classifiers(spark):
    draw = np.random.default_rng(4)
    clean = ["".join(draw.choice(list("aeiourstln"), 6)) for _ in range(400)]
    said = [(" ".join(draw.choice(clean, 40)), 0) for _ in range(120)]
    said += [(" ".join([*draw.choice(clean, 30), *draw.choice(["wombatic", "dufflehead"], 4)]), 1) for _ in range(60)]
    model = toxicity.fit([(toxicity.tokens_of(t), len(toxicity.tokens_of(t)), y) for t, y in said])
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs_of(spark, [said[0][0], said[-1][0], "w.o.m.b.a.t.i.c dufflexhead wombatic " + said[1][0], None]), model).collect()}
    assert score[0] < 0.5 < score[1] and score[2] > 0.5 and score[3] < 0.5
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(90)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, ["GOOD words here. " * 5 if i % 3 else "$$$ !!! ### " * 9 for i in range(90)] + [None])
    stats = quality.with_statistics(docs)
    held = (stats["doc_id"] % 4 == 2) & stats["doc_id"].isNotNull()
    fitted = quality.fit(quality.train_rows(stats, labels, "quality", held), "quality")
    score = {r["doc_id"]: r["score"] for r in quality.scored(stats, fitted).collect()}
    assert min(score[i] for i in range(90) if i % 3) > max(score[i] for i in range(90) if i % 3 == 0)
    assert quality.accepted(docs, fitted).count() < 91


def test_pooled():
    assert quality.pooled(np.array([1.0, 0.0, 2.0]), np.array([1.0, 1.0, 1.0])).tolist() == [0.5, 0.5, 2.0]


def test_fingerprint_without_rare_terms(spark):
    """Texts of frequent terms only, and a group of copies of a third of the rows."""
    draw = np.random.default_rng(6)
    common = ["a b c d", "a b c e", "d e", "!!! ???", "--- ---", "A b, c d."]
    copies = ["one large group of copies has terms of its own"] * 40
    rest = [" ".join(["a b c d e", *(f"w{x}" for x in draw.integers(0, 60, 12))]) for _ in range(80)]
    texts = [*common, *copies, *rest, "", None]
    rows = {r["doc_id"]: r for r in fingerprint.edited_and_next(docs_of(spark, texts)).collect()}
    prints = [rows[i]["fingerprint"] for i in range(len(texts))]
    assert prints[-1] == prints[-2] == "" and "" not in prints[:-2]
    assert len(set(prints[:6])) == 5 and prints[0] == prints[5]  # the same terms
    assert len(set(prints[6:46])) == 1 and prints[6] not in prints[:6] + prints[46:]
    for i in range(len(texts)):
        a, b = prints[i], prints[i - 1]
        assert (rows[i]["near_next"] == 1) == (a == b)
    few = fingerprint.edited_and_next(docs_of(spark, ["x y", "x z", ""])).collect()  # no term is in the band
    assert len({r["fingerprint"] for r in few}) == 3 and all(r["near_next"] == 0 for r in few)


def hot_group(m):
    """m near copies, of which few are alike enough to a given one, and texts that share only their first words."""
    draw = np.random.default_rng(8)
    words = np.array([f"w{k}" for k in range(900)])
    base = draw.choice(words, 120)
    group = []
    for _ in range(m):
        own = base.copy()
        own[draw.integers(6, 120, draw.integers(0, 5))] = draw.choice(words, 1)
        group.append(" ".join(own))
    return group + [" ".join([*base[:5], *draw.choice(words, 115)]) for _ in range(m // 3)]


def brute_components(texts, percent=80):
    sets, of = [set(jaccard.shingles(t).tolist()) for t in texts], np.arange(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if of[i] != of[j] and both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                of[(of == of[i]) | (of == of[j])] = min(of[i], of[j])
    return of.tolist()


@pytest.mark.parametrize("block", [1000, 7])
def test_jaccard_hot_group(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    made, tree_pairs = [], jaccard._tree_pairs
    def noted(members, *a):
        out = tree_pairs(members, *a)
        made.append((members.count(), members.groupBy("unit", "side").count().agg({"count": "max"}).first()[0], out.count()))
        return out
    monkeypatch.setattr(jaccard, "_tree_pairs", noted)
    texts = hot_group(60)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)
    assert made[0][0] and all(pairs <= members for members, _, pairs in made)
    assert block > 7 or all((most or 0) <= 4 * block for _, most, _ in made)


def test_jaccard_moves_what_may_link(spark, monkeypatch):
    """Texts of one passage but else unrelated: few are members of shards, their vectors are short, and no text is moved."""
    draw, words = np.random.default_rng(21), [f"w{i}" for i in range(5000)]
    passage = " ".join(draw.choice(words, 30))
    texts = [f"{passage} {' '.join(draw.choice(words, 40 + 60 * (i % 8)))}" for i in range(80)]
    copies = [" ".join(draw.choice(words, 300)) for _ in range(3)]
    texts += [t for c in copies for t in (c, c + " other")]
    made, written, tree_pairs = {}, jaccard.written, jaccard._tree_pairs
    def noted(df, name):
        out = written(df, name)
        made.setdefault(name, []).append(out.count())
        return out
    def measured(members, *a):
        made.setdefault("bytes", []).append(members.agg(F.avg(F.length("counts"))).first()[0] or 0)
        return tree_pairs(members, *a)
    monkeypatch.setattr(jaccard, "written", noted)
    monkeypatch.setattr(jaccard, "_tree_pairs", measured)
    monkeypatch.setattr(jaccard, "frequent", lambda docs: np.empty(0, np.uint64))  # as if most texts were without the passage
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [*range(81), 80, 82, 82, 84, 84]
    assert 0 < max(made["bytes"]) < 600 and max(made["texts"]) <= 12, made
    sets = [jaccard.shingles(t) for t in texts]
    keys = Counter(k for x in sets for k in jaccard.first_shingles(x, np.empty(0, np.uint64), 80).tolist())
    assert 0 < made["shards"][0] < 0.7 * sum(v for v in keys.values() if v > 1)


@pytest.mark.parametrize("held", [200_000, 4])
def test_shards(spark, held, monkeypatch):
    """Members that another one fits, against all pairs; of a shard with too many members every one."""
    monkeypatch.setattr(jaccard, "HELD", held)
    draw = np.random.default_rng(22)
    rows = [(i, int(draw.integers(20, 60)), int(i // 2 if i < 20 else i), [int(k) for k in draw.permutation(12)[: draw.integers(1, 6)]]) for i in range(120)]
    rows = [(i, *rows[i - i % 2][1:]) if i < 20 else rows[i] for i in range(120)]  # the first ones are pairs of equal sets
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    sets = spark.createDataFrame(rows, "doc_id long, n long, sign long, firsts array<long>")
    got = [r.asDict() for r in jaccard._shards(sets, 80).collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    shards = {}
    for doc, n, _, firsts in rows:
        if doc >= 20 or doc % 2 == 0:
            for at, k in enumerate(firsts):
                shards.setdefault(k, {})[doc] = (n, (100 * n - 180 * at) // 80)
    fit = {(k, d) for k, m in shards.items() for d, (n, most) in m.items() if any(e != d and n <= upto and size <= most for e, (size, upto) in m.items())}
    found = [(r["key"], r["doc_id"]) for r in got]
    assert len(set(found)) == len(found) and fit <= set(found) <= {(k, d) for k, m in shards.items() for d in m}
    assert held == 4 or set(found) == fit
    for r in got:
        assert (r["n"], r["most"]) == shards[r["key"]][r["doc_id"]] and (r["center_n"], r["center_most"]) == shards[r["key"]][r["center"]]
        assert (r["key"], r["center"]) in found
    assert len({(r["key"], r["center"]) for r in got}) == len({r["key"] for r in got})


def test_packed_counts():
    rows = [np.zeros(jaccard.GROUPS, np.int64), np.arange(jaccard.GROUPS), np.full(jaccard.GROUPS, 70_000)]
    assert (jaccard.unpacked([jaccard.packed(r) for r in rows]) == np.array(rows)).all() and jaccard.unpacked([]).shape == (0, jaccard.GROUPS)


def test_tree_skips_one_component():
    points = np.repeat(np.random.default_rng(9).poisson(0.2, (1, jaccard.GROUPS)), 2001, axis=0)
    parts = np.r_[np.zeros(2000, int), 1]
    tree, seen = jaccard.CountTree(points, 80, (parts,)), []
    may = tree._may
    tree._may = lambda *a: (seen.append(len(a[0])), may(*a))[1]
    found = tree.pairs()
    assert len(found) == 2000 and (parts[found[:, 0]] != parts[found[:, 1]]).all() and sum(seen) < 10_000
    assert len(jaccard.forest(found[:, 0], found[:, 1], found[:, 2], parts)) == 1


def test_forest_spans():
    draw = np.random.default_rng(10)
    i, j, of = draw.integers(0, 80, 150), draw.integers(0, 80, 150), np.arange(80) // 2
    w = draw.integers(0, 9, 150)
    picked = jaccard.forest(i, j, w, of)
    def joined(edges):
        part = of.copy()
        for e in edges:
            part[part == part[i[e]]] = part[j[e]]
        return [[a == b for b in part] for a in part], len(set(part))
    assert joined(picked) == joined(range(150)) and len(picked) == 40 - joined(picked)[1]


def test_neighbours_recall_on_table(spark):
    """Production parameters on the table itself, against brute force over all its vectors."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    got = {}
    for r in neighbours.search(df, lambda i: i % 10 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = {}
    for at in np.flatnonzero(ids % 10 == 0):
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        d[at] = np.inf
        hits[ids[at]] = len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & got[ids[at]]) / 10
    contract = [h for i, h in hits.items() if i % 100 == 0]
    print("recall", len(contract), np.mean(contract), len(hits), np.mean(list(hits.values())))
    assert np.mean(contract) >= 0.93 and np.mean(list(hits.values())) >= 0.93


def test_kernel():
    """The folded table against the kernel summed over pairs of subsequences."""
    def weights(s):
        out = {}
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i <= toxicity.SPAN:
                out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0) + toxicity.DECAY ** (k - i - 2)
        return out
    words = [toxicity.letters_of(w) for w in ("dufflehead", "duff1exhead", "wombat", "abc", "ab")]
    for a in words:
        for b in words:
            x, y = weights(a), weights(b)
            want = sum(w * y.get(t, 0) for t, w in x.items()) / toxicity._NORM[len(a)] / toxicity._NORM[len(b)]
            assert abs(toxicity.applied(toxicity.weights_of(a), [b])[0] - want) < 1e-9


def test_ridge(spark):
    """Summed products against a direct fit of the same features."""
    draw = np.random.default_rng(14)
    stats = draw.normal(size=(200, len(quality.STATISTICS)))
    y = (stats[:, 0] + stats[:, 1] ** 2 > 1).astype(int)
    rows = spark.createDataFrame([(s.tolist(), int(k), i % 5) for i, (s, k) in enumerate(zip(stats, y))], "stats array<double>, quality int, _part int")
    model = quality.fit(rows, "quality", n_features=40)
    fitted = np.arange(200) % 5 != 0
    z = model.features(stats[fitted])
    want = np.linalg.solve(z.T @ z + 1e-3 * fitted.sum() * np.eye(41) / 40, z.T @ y[fitted])
    assert np.allclose(stats[fitted].mean(0), model.mean) and np.allclose(model.weights, want)
    assert (np.diff(model.levels) >= 0).all()
