"""Pieces of overlapping matches against a character-by-character sweep."""

import html
import random
import re

from textsieve.operators import highlight


def swept(rows):
    """rows: (doc, start, end, ord, color, title)."""
    out = []
    for doc in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == doc and r[1] is not None and r[1] < r[2]]
        cuts = sorted({x for r in mine for x in r[1:3]})
        for a, b in zip(cuts, cuts[1:]):
            over = [r for r in mine if r[1] <= a and b <= r[2]]
            if over:
                last = max(over, key=lambda r: (r[1], r[3], r[2], r[5]))
                out.append((doc, a, b, last[4], last[5], len(over), sorted({r[5] for r in over})))
    return sorted(map(str, out))


def matches(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, start int, end int, ord long, color string, title string, cluster int, n int")


def test_pieces(spark):
    draw = random.Random(3)
    rows = [(d, a, a + draw.randint(0, 9), draw.randint(0, 3), f"#00000{draw.randint(0, 9)}", "abc"[draw.randint(0, 2)]) for d in range(20) for a in (draw.randint(0, 60) for _ in range(d))]
    rows += [(50, 0, 10, 0, "#1", "x"), (50, 10, 20, 0, "#2", "y"), (51, 0, 5, 0, "#1", "x"), (51, 0, 5, 0, "#1", "x"), (52, None, 5, 0, "#1", "x"), (52, 3, 3, 0, "#1", "x")]
    got = highlight.pieces(matches(spark, [(*r, 1, 1) for r in rows]))
    assert sorted(str(tuple(r)) for r in got.collect()) == swept(rows)
    assert highlight.pieces(matches(spark, [])).collect() == []


def test_runs_and_html(spark):
    text = "Привет <b>мир</b> & \"все\"\n𝄞 конец"
    rows = [(1, 0, 6, 0, "#ff0000", "a\"<"), (1, 4, 13, 1, "#00ff00", "b"), (1, 24, 30, 2, "#0000ff", "c")]
    docs = spark.createDataFrame([(1, text), (2, "a<b"), (3, None), (4, "")], "doc_id long, text string")
    cut = highlight.pieces(matches(spark, [(*r, 1, 1) for r in rows]))
    runs = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 5, 5), (1, 2, 5, 26), (1, 3, 26, 40), (9, 0, 0, 50)], "doc_id long, run int, run_start int, run_end int")
    got = sorted((r["run"], r["from_char"], r["to_char"], r["title"]) for r in highlight.by_runs(cut, runs).collect())
    assert got == [(0, 0, 4, 'a"<'), (0, 4, 5, "b"), (2, 0, 1, "b"), (2, 1, 8, "b"), (2, 19, 21, "c"), (3, 0, 4, "c")]
    made = {r["doc_id"]: r["html"] for r in highlight.marked(docs, cut).collect()}
    assert made[2] == "a&lt;b" and made[3] is None and made[4] == ""
    assert html.unescape(re.sub("</?mark[^>]*>", "", made[1])) == text
    assert [html.unescape(x) for x in re.findall("<mark[^>]*>(.*?)</mark>", made[1], re.S)] == [text[0:4], text[4:6], text[6:13], text[24:30]]


def test_matches_computed_once(spark, tmp_path):
    from pyspark.sql import functions as F

    matches(spark, [(1, 0, 5, 0, "#1", "x", 1, 1)]).write.parquet(f"{tmp_path}/m")
    rows = spark.read.parquet(f"{tmp_path}/m").withColumn("color", F.upper("color"))
    assert highlight.pieces(rows)._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
