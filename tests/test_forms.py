"""Forms, notes, tasks and page ranges with what is missing, blank or odd."""

import datetime as dt

from textsieve.operators import forms

TERM = "array<struct<text:string,type:string>>"


def test_agent_there_and_back(spark):
    day = dt.date(2020, 2, 3)
    records = [(1, "fiz", 7, "Имя", day, None, ["a.ru", "b.ru"], [("x", None), ("y", "surname")]), (2, None, None, None, None, day, None, None), (3, "ur", 0, "", day, day, [], [])]
    shown = forms.agent_to_form(spark.createDataFrame(records, f"id long, agent_type string, registry_number long, full_name string, include_date date, exclude_date date, domain_name array<string>, search_terms {TERM}"), ["id"]).orderBy("id").collect()
    assert [(r["number"], r["status_label"], r["date_included"], r["domain"], [tuple(t) for t in r["search_terms"]]) for r in shown] == [("7", "Числится", "2020-02-03", "a.ru\nb.ru", [("x", "text"), ("y", "surname")]), ("", "—", "", "", []), ("0", "Снят", "2020-02-03", "", [])]
    said = [(1, "old", "ur", " 12 ", " Имя ", "2020-02-03 10:00", "x", " a.ru\n b.ru ", ["x ", "", None, "z"], ["odd", "text", "text"]), (2, "old", "bad", "1.5", "  ", "", None, None, None, None), (3, "old", None, "9" * 30, None, "2020-2-3", "2020-02-30", " ", [], ["text"])]
    made = forms.agent_from_form(spark.createDataFrame(said, "id long, old_agent_type string, agent_type string, number string, full_name string, date_included string, date_excluded string, domain string, terms_text array<string>, terms_type array<string>"), ["id"], ["fiz", "ur"]).orderBy("id").collect()
    assert [(r["agent_type"], r["registry_number"], r["full_name"], r["include_date"], r["exclude_date"], r["domain_name"], [tuple(t) for t in r["search_terms"]]) for r in made] == [("ur", 12, "Имя", day, None, ["a.ru", "b.ru"], [("x", "text")]), ("old", None, None, None, None, None, []), ("old", None, None, None, None, None, [])]


def test_notes(spark):
    agent = ("fiz", "Имя", None, dt.date(2020, 1, 1), None, "закон")
    rows = [("word", "p", "P", None, None), ("word", "p", None, "other", None), ("regex", "mail", "x", "agents", None), ("word", "p", "", "agents", agent), ("word", "p", "", "agents", None)]
    kind = "kind string, phrase string, original string, list_key string, agent struct<agent_type:string,full_name:string,birth_date:date,include_date:date,exclude_date:date,include_reason:string>"
    got = [(r["title"], r["content"], r["shown"]) for r in forms.annotated(spark.createDataFrame(rows, kind), {"agents": "Агенты"}, "agents", "fiz").collect()]
    assert got == [("Список пользователя", "P", "p"), ("", "p", "p"), ("Шаблон", "«mail»", '"mail"'), ("Агенты", "Иноагент (Статус: Числится)\nИмя\nДата рождения: None\n\nДеятельность: нет\nВ реестре с: 2020-01-01\n\nОснование: закон", "p"), ("Агенты", "", "p")]


def test_tasks(spark):
    rows = [("a", {"state": "PROCESSING", "created_at": "2024-01-01T21:30:00Z", "source_file_size_bytes": "2048"}), ("b", {}), ("c", None), ("d", {"state": "odd", "result_data_json": "not json", "created_at": "never"}), ("e", {"result_data_json": '{"processing_time": 1.234, "source_filename": "f", "source_file_size_bytes": 5, "created_at": "2024-01-01T00:00:00+03:00"}', "source_file_size_bytes": "x"})]
    got = {r["task_id"]: (r["state"], r["label"], r["created"], r["expires"], r["took"], r["size_label"]) for r in forms.task_list(spark.createDataFrame(rows, "task_id string, fields map<string,string>"), 3600).collect()}
    none = ("PENDING", "—", "—", "—", "—", "—")
    assert got == {"a": ("PROCESSING", "—", "02.01.2024 00:30 МСК", "02.01.2024 01:30 МСК", "—", "2.0 KB"), "b": none, "c": none, "d": none, "e": ("PENDING", "f", "01.01.2024 00:00 МСК", "01.01.2024 01:00 МСК", "1.23 с", "5 B")}


def test_page_range(spark):
    pages = spark.createDataFrame([(k, p) for k in (1, 2, 3, 4) for p in range(1, 4)], "doc long, page int")
    ranges = spark.createDataFrame([(1, 2, 9), (2, 3, 2), (3, 4, 5), (4, 0, 2), (5, 1, 1)], "doc long, start int, end int")
    got = sorted(map(str, (tuple(r) for r in forms.page_range(pages, ranges, "doc", "page").collect())))
    assert got == sorted(map(str, [(1, 2, None), (1, 3, None), (2, None, "start behind end"), (3, None, "out of range"), (4, None, "below 1"), (5, None, "no pages")]))
