"""Column functions row by row, against rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from textsieve.functions import names, registry, text
from textsieve.operators import lists, match, ocr, spans
from textsieve.plans import catalog

SF = "/root/testdata/sf0.001"


def values(spark, said, f):
    """f of each of the texts, in order."""
    rows = spark.createDataFrame(list(enumerate(said)), "i int, v string").select("i", f(F.col("v")).alias("x"))
    return [r["x"] for r in rows.orderBy("i").collect()]


def test_words(spark):
    said = ["abc123", "123", "_x1", "пит-буль", "Ёлка!", " Мир ", "", None]
    assert values(spark, said, text.clean_word) == ["abc", None, "x", "пит-буль", "ёлка", "мир", None, None]
    assert values(spark, said, text.is_cyrillic) == [False, False, False, True, True, True, False, None]
    assert values(spark, said, text.letters_only) == [False, False, False, True, False, True, False, None]


def test_colors_and_dates(spark):
    assert values(spark, ["#AbCdEf", "00ff00", "red", "#12345", None], text.hex_color) == ["#abcdef", "#00ff00", None, None, None]
    days = values(spark, ["01.02.2020", "2021-03-04", "05/06/2022", "31.02.2020", "x", None], lambda c: F.date_format(text.any_date(c), "yyyy-MM-dd"))
    assert days == ["2020-02-01", "2021-03-04", "2022-06-05", None, None, None]


def test_file_values(spark):
    assert values(spark, ["12", " 3.9", "1e2", "-0.5", "x", "", "nan", "1e300", None], registry.whole_number) == [12, 3, 100, 0, None, None, None, None, None]
    labels = {"person": "Физические лица", "media": "СМИ"}
    assert values(spark, [" сми ", "ФИЗИЧЕСКИЕ ЛИЦА", "другое", "", None], lambda c: registry.label_key(c, labels)) == ["media", "person", None, None, None]
    said = ["a.ru", "a.ru; b.ru,c ;", "a.ru, 1.ru", " ; ", "  ", None]
    assert values(spark, said, registry.domains) == [["a.ru"], ["a.ru", "b.ru,c"], ["a.ru", "1.ru"], [";"], None, None]


def test_entries(spark):
    assert values(spark, ["1. ИВАНОВ ИВАН, 01.02.1980 г.р., с. Село", "22.  Apple Inc.", "БЕЗ НОМЕРА", "3. 31.02.1990 г.р."], registry.strip_number) == ["ИВАНОВ ИВАН, 01.02.1980 г.р., с. Село", "Apple Inc.", "БЕЗ НОМЕРА", "31.02.1990 г.р."]
    raw = ["ИВАНОВ ИВАН ИВАНОВИЧ*, (ПЕТРОВ ПЕТР ПЕТРОВИЧ; СИДОР), 01.02.1980 г.р. , г. Город;", "СИДОРОВ СИДОР, 31.12.1990 г.р., с. Село;", "БЕЗ ЗАПЯТОЙ"]
    assert [tuple(x) for x in values(spark, raw, registry.person_name)] == [("ИВАНОВ ИВАН ИВАНОВИЧ", ["ПЕТРОВ ПЕТР ПЕТРОВИЧ", "СИДОР"]), ("СИДОРОВ СИДОР", []), ("БЕЗ ЗАПЯТОЙ", [])]
    assert [str(x) for x in values(spark, raw, registry.birth_date)] == ["1980-02-01", "1990-12-31", "None"]
    assert values(spark, raw, registry.birth_place) == ["г. Город", "с. Село", None]
    orgs = ["Apple Inc. (AI), QDi.289", "Plain Org, no code", "Name only"]
    assert [tuple(x) for x in values(spark, orgs, registry.org_name)] == [("Apple Inc.", "AI"), ("Plain Org", None), ("Name only", None)]
    assert values(spark, orgs, registry.sanction_code) == ["QDi.289", None, None]
    said = ["1. ООО Ромашка;", "2. Союз* (Лига; Круг), г. Город;", "3. Фонд (Мир), с. Село", "4. «Икс»"]
    assert [tuple(x) for x in values(spark, said, registry.org_names_ru)] == [("ООО Ромашка", [], True), ("Союз", ["Лига", "Круг"], False), ("Фонд", ["Мир"], False), ("", [], True)]


def test_terms(spark):
    said = ['Иванов Иван Иванович "Ваня, Иван"', "Петров Пётр Петрович", "нет имени", None]
    got = [[tuple(x) for x in some or []] for some in values(spark, said, registry.full_name_terms)]
    assert got == [[("Иванов Иван Иванович", "full_name"), ("Иванов", "surname"), ("Ваня", "text"), ("Иван", "text")], [("Петров Пётр Петрович", "full_name"), ("Петров", "surname")], [], []]
    both = ["Фонд помощи «Мир»", "«Мир»", 'Иванов Иван Иванович "Мир"', None]
    got = [[tuple(x) for x in some or []] for some in values(spark, both, registry.combined_terms)]
    assert got[:2] == [[("Мир", "text")], []]
    assert got[2] == [("Иванов Иван Иванович", "full_name"), ("Иванов", "surname"), ("Мир", "text")]


# a row for each rule of the cascade; the first variant of each case
FORMS = [
    ("Иванов", "m", "иванов иванова иванову иванова ивановым иванове"),
    ("Иванова", "f", "иванова ивановы иванове иванову ивановой иванове"),
    ("Достоевский", "m", "достоевский достоевского достоевскому достоевского достоевским достоевском"),
    ("Ковальская", "f", "ковальская ковальской ковальской ковальскую ковальской ковальской"),
    ("Зимняя", "f", "зимняя зимней зимней зимнюю зимней зимней"),
    ("Толстой", "m", "толстой толстого толстому толстого толстым толстом"),
    ("Дикий", "m", "дикий дикего дикему дикего диким дикем"),
    ("Белый", "m", "белый белого белому белого белым белом"),
    ("Лебедь", "m", "лебедь лебедя лебедю лебедя лебедем лебеде"),
    ("Лебедь", "f", "лебедь лебедь лебедь лебедь лебедь лебедь"),
    ("Гайдай", "m", "гайдай гайдая гайдаю гайдая гайдаем гайдае"),
    ("Заяц", "m", "заяц заяца заяцу заяца заяцем заяце"),
    ("Дюма", "m", "дюма дюма дюма дюма дюма дюма"),
    ("Чайка", "m", "чайка чайки чайке чайку чайкой чайке"),
    ("Глинка", "f", "глинка глинки глинке глинку глинкой глинке"),
    ("Берия", "m", "берия берии берие берию берией берие"),
    ("Шевченко", "m", "шевченко шевченко шевченко шевченко шевченко шевченко"),
    ("Галуа", "m", "галуа галуа галуа галуа галуа галуа"),
    ("де Голль", "m", "де голль де голля де голлю де голля де голлем де голле"),
    ("Римский-Корсаков", "m", "римский-корсаков римского-корсакова римскому-корсакову римского-корсакова римским-корсаковым римском-корсакове"),
]


@pytest.mark.parametrize("gender", ["m", "f"])
def test_cascade(spark, gender):
    want = [(s, f) for s, g, f in FORMS if g == gender]
    assert values(spark, [s for s, _ in want], lambda c: F.array_join(names.surname_forms(c, gender), " ")) == [f for _, f in want]


PART = "struct<y_declension:string,foreign_ov_in:boolean,indeclinable_final_a:boolean,override_forms:array<array<string>>>"


def test_parts_have_their_own_rules(spark):
    own = [["Икс"], ["Икса", "Иксы"], ["Иксу"], ["Икса"], ["Иксом"], ["Иксе"]]
    rows = [
        ("Палий-Дикой", "noun", None, None, None),  # what holds for the whole doesn't for the parts
        ("Палий-Дикой ", None, None, None, [("noun", None, None, None), (None, None, None, None)]),
        ("Палий-Дикой-Белый", None, None, None, [("noun", None, None, None)]),  # too few
        ("Чаплин-Дарвин", None, True, None, [(None, True, None, None), (None, False, None, None)]),
        ("Окуджава-Шапка", None, None, None, [(None, None, True, None), None]),
        ("Икс", None, None, own, None),
        ("Дюма", None, None, own, None),  # an exception comes first
        ("де Икс", None, None, own, None),
        ("Икс-Белый", None, None, own, [(None, None, None, own), None]),
        ("Белый-Икс", None, None, own, None),
    ]
    kinds = f"surname string, y_declension string, foreign_ov_in boolean, override_forms array<array<string>>, hyphen_parts array<{PART}>"
    index = names.surname_index(spark.createDataFrame(rows, kinds).withColumn("gender", F.lit("m")))
    got = {}
    for r in index.collect():
        got.setdefault((r["surname"], r["matched_case"]), set()).add(r["form"])
    assert got["Палий-Дикой", "gen"] == {"палего-дикого"}
    assert got["Палий-Дикой ", "gen"] == {"палия-дикого"}
    assert got["Палий-Дикой-Белый", "gen"] == {"палего-дикого-белого"}
    assert got["Чаплин-Дарвин", "ins"] == {"чаплином-дарвиным"}
    assert got["Окуджава-Шапка", "gen"] == {"окуджава-шапки"}
    assert got["Икс", "gen"] == {"икса", "иксы"} and got["Дюма", "gen"] == {"дюма"} and got["де Икс", "gen"] == {"де икса", "де иксы"}
    assert got["Икс-Белый", "gen"] == {"икса-белого", "иксы-белого"} and got["Белый-Икс", "gen"] == {"белого-икса"}


def test_gender(spark):
    said = ["Иванов Иван Иванович", "Петрова Анна Сергеевна", "Ким Мария", "Ли", "Каримов Кузьма Кузьмич", "Ян Илья", "Цой Сергей", ""]
    assert values(spark, said, names.gender) == ["m", "f", "f", "m", "m", "f", "m", "m"]


def test_surname_words(spark):
    said = spark.createDataFrame([("С Ивановым и Достоевского видели, а Шевченко нет",)], "text string")
    words = said.select(F.explode(text.words(F.col("text"))).alias("word"))
    found = match.surname_match(words, spark.createDataFrame([("Иванов",), ("Достоевский",), ("Шевченко",)], "surname string"), names.all_surname_forms(F.col("surname")))
    assert sorted((r["surname"], r["word"]) for r in found.collect()) == [("Достоевский", "достоевского"), ("Иванов", "ивановым"), ("Шевченко", "шевченко")]


def test_token_equality(spark):
    rows = [("a", "a", "a", "b", "a", "a"), ("a", None, "a", "b", None, "a"), ("x", "", "", "y", "", ""), ("x", "1", "2", "x", "3", "4"), ("x", "1", "2", "y", "1", "3")]
    v = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, xl string, xs string, y string, yl string, ys string")
    a, b = (F.struct(*(F.col(c).alias(n) for c, n in zip((s, s + "l", s + "s"), ("text", "lemma", "stem"), strict=True)), F.lit("word").alias("type")) for s in "xy")
    got = v.orderBy("i").select(text.token_equal(a, b).alias("e"), text.sequence_equal(F.array(a), F.array(b)).alias("s")).collect()
    assert [(r["e"], r["s"]) for r in got] == [(True, True), (False, True), (False, True), (True, True), (False, True)]


def test_intervals(spark):
    rows = [(1, 10, 0, 2), (1, 10, 9, 11), (1, 10, 0, 11), (1, 10, 3, 5), (1, 10, 11, 12), (1, 10, 0, 0)]
    v = spark.createDataFrame(rows, "a int, b int, c int, d int")
    (s, e), (hs, he) = spans.intersection(*map(F.col, "abcd")), spans.hull(*map(F.col, "abcd"))
    assert [tuple(r) for r in v.select(s, e, hs, he).collect()] == [(1, 2, 0, 10), (9, 10, 1, 11), (1, 10, 0, 11), (3, 5, 1, 10), (None, None, 1, 12), (None, None, 0, 10)]


def test_excluded(spark):
    phrases = spark.createDataFrame([("of the",), ("The",), ("a",), (None,)], "phrase string")
    gone = spark.createDataFrame([("Of The",), ("THE",), (None,)], "phrase string")
    assert sorted(map(str, (r["phrase"] for r in lists.excluded(phrases, gone).collect()))) == ["None", "a"]


def test_ocr_rows(spark):
    rows = [("1", "5", "96", " Word "), ("1", "5", "3", "low"), ("1", "4", "0", "line"), ("x", "5", "90", "odd"), ("2", "5", "-1", "none"), ("2", "5", "50", "  "), ("3", None, "5", "a"), ("3", "1", None, "a")]
    got = ocr.cleaned(spark.createDataFrame(rows, "page string, level string, conf string, word string"), ["page", "level"], {"page": "int", "level": "int", "conf": "double"})
    assert sorted(map(tuple, got.collect())) == [(1, 4, 0.0, "line"), (1, 5, 96.0, "Word")]


#: page, block, par, line, word_num, text, conf, left, width, height
LINES = [(1, 1, 1, 1, 1, "In", 90, 0, 10, 8), (1, 1, 1, 1, 2, "exam-", 80, 12, 30, 9), (1, 1, 1, 2, 1, "ple-", 70, 0, 20, 10), (1, 1, 1, 3, 1, "s", 95, 0, 5, 8), (1, 1, 2, 1, 1, "a-", 60, 0, 9, 8), (1, 2, 1, 1, 1, "b", 99, 0, 9, 8), (1, 2, 1, 1, 2, "-", 99, 10, 3, 8), (1, 2, 1, 2, 1, "c-", 50, 0, 9, 8), (1, 2, 1, 3, 1, "d", 40, 2, 9, 12)]
AFTER = [(1, 1, 1, 1, 1, "In", 90, 10, 8), (1, 1, 1, 1, 2, "example-", 70, 8, 10), (1, 1, 1, 3, 1, "s", 95, 5, 8), (1, 1, 2, 1, 1, "a-", 60, 9, 8), (1, 2, 1, 1, 1, "b", 99, 9, 8), (1, 2, 1, 1, 2, "-", 99, 3, 8), (1, 2, 1, 2, 1, "cd", 40, 11, 12)]


def test_ocr_hyphens(spark):
    v = spark.createDataFrame(LINES, "page int, block int, par int, line int, word_num int, text string, conf int, left int, width int, height int")
    assert sorted(map(tuple, spans.join_hyphenated(v).drop("left").collect())) == sorted(AFTER)


def test_catalog(spark):
    said = ['{"international": {"all": {"namesFL": ["1. Doe, J.", "2.  Roe"], "namesUL": []}, "excluded": {"namesUL": ["3. Org"]}}, "russian": {"all": {"namesFL": null}, "excluded": {"namesFL": ["ИВАНОВ"], "other": 1}}}', "{}", "not json", '{"russian": 5}', '{"russian": {"all": {"namesUL": "x"}}}', None]
    got = [sorted(tuple(x) for x in some or []) for some in values(spark, said, registry.catalog_rows)]
    assert got == [[("Doe, J.", "international", "FL", True), ("Org", "international", "UL", False), ("Roe", "international", "FL", True), ("ИВАНОВ", "russian", "FL", False)], [], [], [], [], []]


def test_term_index(spark):
    terms = spark.createDataFrame([(1, " Red Cats "), (2, "cat red"), (3, "RED CATS"), (4, "cats"), (5, "Cat"), (6, "12 !"), (7, ""), (8, None), (9, "из-за cats")], "o int, term string")
    lexicon = spark.createDataFrame([("cats", "cat", "ca"), ("cat", "cat", "ca"), ("red", "", None)], "word string, lemma string, stem string")
    got = {(r["kind"], r["by"], r["sorted"], r["key"]): (r["info"], r["n"]) for r in lists.term_index(terms, lexicon, F.col("o")).collect()}
    assert got["phrase", "lemma", False, "red cat"] == ("Red Cats", 1) and got["phrase", "lemma", False, "cat red"] == ("cat red", 1)
    assert got["phrase", "lemma", True, "cat red"] == ("Red Cats", 2) and got["phrase", "stem", True, "ca red"] == ("Red Cats", 2)
    assert got["word", "lemma", False, "cat"] == ("cats", 2) and got["word", "stem", False, "ca"] == ("cats", 2)
    assert got["phrase", "lemma", True, "cat из-за"] == ("из-за cats", 1)
    assert len(got) == 12


def test_token_of_a_place(spark):
    """As token_at says, without the tokens of the text."""
    rows = [(t, p) for t in ("ab, c  d𝄞e--\n", "", "İ ё", None, " x") for p in (-1, 0, 1, 3, 5, 7, 50)]
    df = spark.createDataFrame(rows, "t string, p int").select(text.token_of(F.col("t"), F.col("p")).alias("a"), text.token_at(text.tokens(F.col("t")), F.col("p")).alias("b"))
    assert all(r["a"] == r["b"] or r["a"] is None for r in df.collect()) and df.where("a is not null").count() == 28
    plan = catalog.QUERIES["pos_to_token"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan


def test_neighbours(spark):
    df = spark.createDataFrame([("a b c d",), ("a b",), ("",), (None,)], "t string").select("t", text.words(F.col("t")).alias("w"))
    got = {r["t"]: [tuple(x) for x in r["x"] or []] for r in df.select("t", text.neighbours(F.col("w"), 3).alias("x")).collect()}
    assert got == {"a b c d": [("a", "b", "c"), ("b", "c", "d")], "a b": [], "": [], None: []}
    plans = {n: catalog.QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString() for n in ("ngrams", "token_equal")}
    assert "lambda" not in plans["ngrams"] and "SortMergeJoin" not in plans["token_equal"]


def test_only_surnames_leave_the_scan(spark):
    plan = catalog.QUERIES["surname_index_find"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "_parts" not in plan and "_x" not in plan
