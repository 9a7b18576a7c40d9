"""Texts that are cut to windows give what they give whole."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from textsieve.operators import automaton
from textsieve.operators.automaton import Entry, Scanner, compiled, windows

ENTRIES = [
    Entry(0, "ordered", [["the"], ["old"], ["the"], ["sea", "seas"]]),
    Entry(1, "ordered", [["the"]]),
    Entry(2, "free", [["of"], ["the"], ["sea"]]),
    Entry(3, "surname", ["sea-old", "sea", "старей"]),
    Entry(4, "name", [["the", "sea", "of"]]),
    Entry(5, "regex", [r"\d+[.@ ]\d+"]),
    Entry(6, "regex", [r"sea\W+old"]),
    Entry(7, "regex", [r"a\b.{0,40}"]),
    Entry(8, "regex", ["σ|ς"]),
    Entry(9, "regex", ["x*"]),
]


def found(scanner, texts, most):
    return sorted((*x, int(d)) for doc, made in scanner.rows(texts, most) for d, x in zip(doc, zip(*(c if isinstance(c, tuple) else c.tolist() for c in made), strict=True), strict=True))


@pytest.mark.parametrize("most", [1, 7, 40])
def test_windows_give_what_the_text_gives(most):
    rng = random.Random(most)
    parts = ["the", "The", "old", "sea", "seas", "of", "СТАРЁЙ", "12", "a", "x_1", "İsea", "ΑΣ", "Σ", "ß"]
    between = [" ", "  ", "\n", "-", "--", ", ", " - ", "'", "@", ".", " \t", "。"]
    texts = [None, ""] + ["".join(rng.choice(parts) + rng.choice(between) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    texts += [" " * 30 + "the", "the" + "-sea" * 30, "sea-old-sea-old sea-old" * 5, "the " * 50, "the old, the seas"]
    scanner = Scanner(compiled(ENTRIES))
    want = found(scanner, texts, 1 << 30)
    assert found(scanner, texts, most) == want
    assert {x[0] for x in want} == set(range(10))


def test_windows_cut_behind_tokens_that_are_no_hyphen():
    text = "a-b-c d, e"
    assert list(windows(text, 1, 1)) == [(0, 6, 7), (6, 9, 10), (9, 10, 10)]
    assert list(windows("abcdef" * 9, 3, 5)) == [(0, 54, 54)]
    assert list(windows("", 3, 5)) == []


def test_a_long_text_takes_little_more_than_a_short_one():
    scanner = Scanner(compiled(ENTRIES[:7]))
    peaks = []
    for n in (1, 8):
        text = "the old man of the harbour, 12,5 " * (n * automaton.SLICE // 33)
        list(scanner.rows([text[:100]], automaton.SLICE))
        tracemalloc.start()
        for _ in scanner.rows([text], automaton.SLICE):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0]


def test_small_tables_need_no_python_workers(spark):
    import datetime

    from textsieve.operators import match

    rows = [(1, "a", ["x", None], True, datetime.date(2020, 1, 2)), (None, None, None, None, None)]
    schema = "n long, s string, a array<string>, b boolean, d date"
    df = match.small(spark, rows, schema)
    assert df.schema == spark.createDataFrame(rows, schema).schema and [tuple(r) for r in df.collect()] == rows
    assert match.small(spark, [], schema).collect() == []
    other = "n long, t timestamp, m map<string,int>"
    kept = [(1, datetime.datetime(2020, 1, 2, 3), {"a": 1})]
    assert [tuple(r) for r in match.small(spark, kept, other).collect()] == kept
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("the sea").alias("text"))
    found = match.phrase_match(docs, match.small(spark, [("the sea", "x")], "phrase string, list_key string"))
    assert found.count() == 3
    # the texts' own workers only
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()


def test_what_is_kept_of_hits_is_bounded():
    """By characters, not by the number of hits: those of a pattern may be long."""
    scanner = Scanner(compiled([Entry(0, "regex", [r"<[^>]*>"])]))
    texts = [f"<{i} {'Ab ' * 1_000}>" for i in range(3_000)] + ["<" + "b " * 3_000 + ">"]
    for at in range(0, len(texts), 50):
        for _, made in scanner.rows(texts[at : at + 50], automaton.SLICE):
            assert all(len(form) == len(t) and form == t.lower() for form, t in zip(made[8], texts[at : at + 50], strict=True))
            assert made[7][0].split()[-1] in "ab"
    held = sum(len(k) + len(a) + len(b) for k, (a, b) in scanner.said.items())
    assert 0 < held <= 3 * automaton.SAID
