"""The automaton and the search for all kinds against plain Python."""

import bisect
import random
import re

import pytest
from pyspark.sql import functions as F

from textsieve.operators import automaton, match

TOKEN = re.compile(r"\w+|\s+|[^\w\s]+")


def fold(s):
    return s.replace("Ё", "Е").replace("ё", "е").lower()


def plain_search(texts, sought, patterns, equal):
    """equal: word -> the words equal to it."""
    out = []
    for d, text in texts:
        toks = TOKEN.findall(text or "")
        at = [i for i, t in enumerate(toks) if re.match(r"\w", t)]
        w, words = [fold(toks[i]) for i in at], set(at)
        same = lambda a, b: a == b or b in equal.get(a, ())
        least = lambda x: min({x, *equal.get(x, ())})
        singles, pairs, i = [], [], 0
        while i < len(toks):
            if i not in words:
                i += 1
            elif i + 2 < len(toks) and toks[i + 1] == "-" and i + 2 in words:
                pairs.append((i, i + 2, fold("".join(toks[i : i + 3]))))
                i += 3
            else:
                singles.append((i, i, fold(toks[i])))
                i += 1
        for o, key, phrase, kind, ordered, forms in sought:
            pw = [fold(x) for x in re.findall(r"\w+", phrase)]
            if kind == "text" and pw:
                k = len(pw)
                for q in range(len(w) - k + 1):
                    run = w[q : q + k]
                    if all(map(same, pw, run)) if ordered else sorted(map(least, run)) == sorted(map(least, pw)):
                        out.append((d, o, phrase, ("phrase" if k > 1 else "word") if ordered else "unordered", at[q], at[q + k - 1]))
            if kind == "surname":
                out += [(d, o, phrase, "surname", i, j) for i, j, x in singles + pairs if x in forms and x[:3] == fold(phrase)[:3]]
            if kind == "full_name":
                out += [(d, o, phrase, "full_name", at[q], at[q + 2]) for q in range(len(w) - 2) if " ".join(w[q : q + 3]) in forms and w[q][:3] == fold(phrase)[:3]]
        low, starts = "".join(t.lower() for t in toks), [0]
        for t in toks:
            starts.append(starts[-1] + len(t))
        of = lambda p: bisect.bisect_right(starts, p, 0, len(toks)) - 1
        hits = {}
        for n, (name, p) in enumerate(patterns.items()):
            for m in re.finditer(p, low):
                if m.group():
                    hits[of(m.start()), of(m.end() - 1)] = (d, len(sought) + n, name, "regex")
        out += [(*h, *at) for at, h in hits.items()]
    return sorted(out)


SOUGHT = [
    (0, "l", "a b", "text", True, None), (1, "l", "b a", "text", False, None), (2, "l", "A, b c!", "text", True, None), (3, "l", "e", "text", True, None), (4, "l", "...", "text", True, None),
    (5, "s", "Abc", "surname", True, ["abc", "abca", "ab", "abcom"]), (6, "s", "Abc-d", "surname", True, ["abc-d", "abca-d"]), (7, "n", "Abc b c", "full_name", True, ["abc b c", "abca b c", "b c abc"]),
    (8, "l", "a a b", "text", False, None), (9, "l", "a", "text", True, None), (10, "l", "a b", "text", True, None), (11, "s", "D", "surname", True, ["d"]), (12, "l", "c", "text", False, None),
]
PATTERNS = {"letters": r"[a-e]+\.[a-e]+", "later": r"a\.b|c\W", "empty": r"z*", "wide": r"b +c"}


def sought_rows(spark, rows=SOUGHT):
    return spark.createDataFrame(rows, "ord long, list_key string, phrase string, type string, ordered boolean, forms array<string>")


def found(df):
    return sorted((r["doc_id"], r["ord"], r["phrase"], r["kind"], r["start_token"], r["end_token"]) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    made = ["".join(draw.choice(["a", "b", "c", "d", "e", "abc", "Abca", "É", "ё"]) + draw.choice([" ", ", ", "-", ".", "\n\n", " - ", "--"]) for _ in range(draw.randint(0, 60))) for _ in range(80)]
    return list(enumerate([*made, "", None, "a", "abc-d-abc-d", "-abc-d", "abc-", "Aİ b", "a b " * 5_000, "...", "a.b"]))


@pytest.mark.parametrize("most", [None, 5])
def test_all_kinds(spark, texts, most):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, _entry int, form string").repartition(3)
    got = found(match.search_all(docs, sought_rows(spark), PATTERNS, most_words=most))
    assert got == plain_search(texts, SOUGHT, PATTERNS, {})
    assert {r[3] for r in got} == {"phrase", "word", "unordered", "surname", "full_name", "regex"}


def test_lexicon(spark, texts):
    lexicon = spark.createDataFrame([("a", "x", "x"), ("e", "x", "x"), ("b", "y", "y"), ("d", "y", "y"), ("c", "", "x")], "word string, lemma string, stem string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    equal = {"a": "ae", "e": "ae", "b": "bd", "d": "bd"}
    assert found(match.search_all(docs, sought_rows(spark), {}, lexicon)) == plain_search(texts, SOUGHT, {}, equal)


def test_flags_and_declined_forms(spark):
    rows = [(0, "l", "Иванов", "surname", None, True), (1, "l", "слово", "text", False, True), (2, "l", "Иванов", "surname", True, False), (3, "l", "Иванов", "text", True, None)]
    sought = spark.createDataFrame(rows, "ord long, list_key string, phrase string, type string, search_text boolean, search_surnames boolean")
    docs = spark.createDataFrame([(1, "С Ивановым и Ивановой слово, ИВАНОВ")], "doc_id long, text string")
    got = match.search_all(docs, sought).orderBy("ord", "start_token").collect()
    assert [(r["ord"], r["form"], r["start"], r["end"]) for r in got] == [(0, "ивановым", 2, 10), (0, "иванов", 29, 35), (3, "иванов", 29, 35)]


def test_nothing_to_look_for(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert match.search_all(docs, sought_rows(spark, [])).collect() == []
    assert match.search_all(docs.limit(0), sought_rows(spark), PATTERNS).collect() == []


def test_one_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/d")
    plan = match.search_all(spark.read.parquet(f"{tmp_path}/d"), sought_rows(spark), PATTERNS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "NestedLoop" not in plan


def test_tokens_tile_texts(spark, texts):
    rows = automaton.token_rows(spark.createDataFrame(texts, "doc_id long, text string")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("token_idx", "token", "start_pos", "type"))).alias("t")).collect()
    got = {r["doc_id"]: [tuple(x) for x in r["t"]] for r in rows}
    for i, t in texts:
        toks, at, want = TOKEN.findall(t or ""), 0, []
        for k, x in enumerate(toks):
            want.append((k, fold(x), at, "word" if re.match(r"\w", x) else "space" if x.isspace() else "punct"))
            at += len(x)
        assert got.get(i, []) == want


def test_windows_of_a_long_text(spark):
    """A million characters; each window looks at its own words only."""
    from textsieve.functions import text

    df = spark.createDataFrame([("ab cd ef gh " * 90_000,), ("ab cd",), ("",), (None,)], "text string").withColumn("g", text.windows(text.words(F.col("text")), 3))
    assert [r["n"] for r in df.select(F.size("g").alias("n")).collect()] == [359_998, 0, 0, 0]
    assert df.select(F.explode("g").alias("x")).count() == 359_998


def test_pattern_inside_a_token(spark):
    """A pattern's match may start and end within a token, also behind letters that get longer in lower case."""
    docs = spark.createDataFrame([(1, "İİ x5d1234ab, AB12"), (2, "ЁİA77İ7")], "doc_id long, text string")
    got = match.search_all(docs, sought_rows(spark, []), {"digits": r"\d{3,}", "ends": r"b1|a7"}).collect()
    assert sorted((r["doc_id"], r["start_token"], r["end_token"], r["start"], r["end"], r["form"]) for r in got) == [(1, 2, 2, 6, 10, "1234"), (1, 5, 5, 15, 17, "b1"), (2, 0, 0, 2, 4, "a7")]


@pytest.mark.parametrize("rows", [SOUGHT, SOUGHT[3:4]])
def test_words_of_one_hash(texts, monkeypatch, rows):
    """Words with the hash of a dictionary's word aren't taken for it, nor words of one hash for each other."""
    from textsieve.operators.automaton import Entry, Scanner, Tokens, compiled

    entries = [Entry(i, "ordered", [[fold(x)] for x in re.findall(r"\w+", r[2])]) for i, r in enumerate(rows) if re.search(r"\w", r[2])]
    some = [t for _, t in texts if not t or len(t) < 5_000]
    hits = lambda: sorted(zip(*(x.tolist() for x in Scanner(compiled(entries)).hits(Tokens(some))), strict=True))
    want = hits()
    monkeypatch.setattr(automaton, "running_sums", lambda codes: automaton.np.zeros(len(codes) + 1, automaton.np.uint64))
    assert hits() == want != []


def test_memory_of_a_scan():
    """What a task holds for texts of two million characters is bounded by a slice, not by words or hits."""
    import tracemalloc

    import pyarrow as pa

    from textsieve.operators.automaton import Entry, Scanner, Tokens, compiled, slices

    scanner = Scanner(compiled([Entry(0, "ordered", [["the"]]), Entry(1, "free", [["of"], ["the"]])]))
    batch = pa.RecordBatch.from_arrays([pa.array(["x the of w%d y, " % i * 1_000 for i in range(130)])], names=["text"])
    tracemalloc.start()
    n = sum(len(scanner.hits(Tokens(b.column(0).to_pylist()))[0]) for b in slices(iter([batch]), 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 260_000 and peak < 100e6
