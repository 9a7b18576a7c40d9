"""Paradigms with variants, and the finder's places."""

from pyspark.sql import functions as F

from textsieve.functions import names
from textsieve.operators import match


def test_variants(spark):
    rows = [("Топчий", "m", None, None), ("Ли-Шоу", "f", None, None), ("Бродский", "m", None, None), ("Пугачёв", "m", None, None), ("Чаплин", "m", None, True), ("Дикой", "m", "both", None), ("Палий", "m", "noun", None), ("ван дер Вальс", "m", None, None), ("Заяц-Чайка", "m", None, None)]
    index = names.surname_index(spark.createDataFrame(rows, "surname string, gender string, y_declension string, foreign_ov_in boolean"))
    got = {}
    for r in index.collect():
        got.setdefault((r["surname"], r["matched_case"]), []).append(r["form"])
    assert got["Топчий", "ins"] == ["топчим", "топчием"] and got["Ли-Шоу", "dat"] == ["ли-шоу"]
    assert got["Пугачёв", "ins"] == ["пугачевым"] and got["Чаплин", "ins"] == ["чаплином"]
    assert got["Дикой", "gen"] == ["дикого", "дикоя"] and got["Палий", "gen"] == ["палия"]
    assert got["ван дер Вальс", "gen"] == ["ван дер вальса"]
    assert sorted(got["Заяц-Чайка", "gen"]) == ["зайца-чайки", "заяца-чайки"]


def test_places(spark):
    index = names.surname_index(spark.createDataFrame([("Толстой", "m")], "surname string, gender string"))
    text = "О Толстом — у Толстого; толстой!"
    found = match.surnames_found(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), index, 4).collect()
    assert sorted((r["start"], r["matched_case"]) for r in found) == [(2, "pre"), (14, "acc"), (14, "gen"), (24, "nom")]
    for r in found:
        assert text[r["start"] : r["end"]] == r["found"] and text[max(0, r["start"] - 4) : r["end"] + 4] == r["context"]


def test_lexicon(spark):
    docs = spark.createDataFrame([(1, "red cats, ran red; cat ran"), (2, None)], "doc_id long, text string")
    lexicon = spark.createDataFrame([("cats", "cat", "cat"), ("cat", "cat", "cat"), ("ran", "run", "ran"), ("run", "run", "run")], "word string, lemma string, stem string")
    phrases = spark.createDataFrame([("red cat",), ("cat red",), ("run",), ("cat cats",)], "phrase string")
    at = lambda f: sorted((r["phrase"], r["start_word"]) for r in f(docs, phrases, lexicon=lexicon).collect())
    assert at(match.phrase_match) == [("red cat", 0), ("red cat", 3)]
    assert at(match.unordered_match) == [("cat red", 0), ("cat red", 3), ("red cat", 0), ("red cat", 3)]
