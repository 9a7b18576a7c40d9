"""Pages to lines to texts, and places both ways."""

import html
import random

from pyspark.sql import functions as F

from textsieve.sources import pages

PAGE = "<html><head><title>T &amp; t</title><style>p{x}</style></head><body><!-- <p>no</p> --><p>Hel-\nlo  <b>wo</b>rld<br>\n next­ \nline &lt;ok&gt; &#233;&nbsp;</p><script>var t='</p>';x</script><div>-</div> a < b &bogus; <ul><li>one<li> two\r\n</ul>tail"


def test_lines_and_text():
    got = pages.scan_page(PAGE)
    assert [(b, n, t, w) for b, n, _, t, w in got.lines] == [(0, 0, "T & t", False), (1, 0, "Hel", True), (1, 1, "lo  world", False), (1, 2, "next", True), (1, 3, "line <ok> é", False), (2, 0, "", True), (3, 0, "a < b &bogus;", False), (4, 0, "one", False), (5, 0, "two", False), (6, 0, "tail", False)]
    assert got.text == "T & tHello  world nextline <ok> éa < b &bogus;onetwotail"
    assert [got.text[: w + 1][-3:] for w in got.wraps] == ["Hel", "ext", "> é"]
    assert all(got.text[s : s + len(t)] == t for _, _, s, t, _ in got.lines)
    for a, s, n, m in got.pieces:
        assert html.unescape(PAGE[s : s + m]) == got.text[a : a + n]
    assert pages.scan_page("").text == "" and pages.scan_page("<p> \n </p>").lines == []


def test_random_pages(spark):
    draw = random.Random(1)
    bits = ["<p>", "</p>", "<br/>", "<b>", "</b>", "\n", "-\n", "word", " ", "é𝄞", "&amp;", "&nbsp;", "<", "<!-- x -->", "a-b", "&#x41;", "­<br>", "<LI class='x'>"]
    made = [(i, "".join(draw.choice(bits) for _ in range(draw.randint(0, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "<p>x" + " long word" * 50_000)]
    scanned = pages.scan(spark.createDataFrame([(i, h, "x", 1) for i, h in made], "page_id long, html string, text string, lines int")).cache()
    rows = {r["page_id"]: r for r in scanned.collect()}
    assert len(rows) == len(made) and rows[900]["text"] == ""
    asked, back = [], []
    for i, h in made:
        t, n = rows[i]["text"], len(rows[i]["text"])
        if n < 1000:  # what stands in no piece is a space between lines
            inside = {k for p in rows[i]["pieces"] for k in range(p["at"], p["at"] + p["length"])}
            assert {t[k] for k in range(n) if k not in inside} <= {" "}
        for _ in range(5 if n else 0):
            a = draw.randint(0, n - 1)
            asked.append((i, a, min(n, a + draw.randint(0, 9))))
            back.append((i, a, a + draw.randint(1, 9)))
    found = pages.located(scanned, spark.createDataFrame(asked, "page_id long, start int, end int")).collect()
    assert len(found) == len(asked)
    for r in found:
        of = [(p, k) for p in rows[r["page_id"]]["pieces"] for k in range(max(p["at"], r["start"]), min(p["at"] + p["length"], r["end"]))]
        place = lambda p, k: (p["source"] + k - p["at"], p["source"] + k - p["at"] + 1) if p["length"] == p["source_length"] else (p["source"], p["source"] + p["source_length"])
        assert (r["source_start"], r["source_end"]) == ((place(*of[0])[0], place(*of[-1])[1]) if of else (None, None))
    for r in pages.located(scanned, spark.createDataFrame(back, "page_id long, start int, end int"), back=True).collect():
        of = []
        for p in rows[r["page_id"]]["pieces"]:
            if p["length"] == p["source_length"]:
                of += [(p["at"] + k - p["source"], p["at"] + k - p["source"] + 1) for k in range(max(p["source"], r["start"]), min(p["source"] + p["length"], r["end"]))]
            elif p["source"] < r["end"] and r["start"] < p["source"] + p["source_length"]:
                of.append((p["at"], p["at"] + p["length"]))
        assert (r["text_start"], r["text_end"]) == ((of[0][0], of[-1][1]) if of else (None, None))


def test_wraps_cut_spans(spark):
    scanned = pages.scan(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))
    got = pages.split_at_wraps(scanned, spark.createDataFrame([(1, 5, 10), (1, 0, 3), (1, 6, 27)], "page_id long, start int, end int"))
    assert sorted((r["start"], r["part_start"], r["part_end"]) for r in got.collect()) == [(0, 0, 3), (5, 5, 8), (5, 8, 10), (6, 6, 8), (6, 8, 22), (6, 22, 27)]
    assert scanned.select(F.size("wraps").alias("n")).first()["n"] == 3


def test_word_over_tags(spark, tmp_path):
    """Blocks are parted by nothing, so a word may stand over tags or a dropped hyphen in the source."""
    from textsieve.plans import paging

    sources = [(1, "<h1>ornd is t</h1><p><b>He</b> the</p>"), (2, "un-\nd und<!-- x --> &amp; th<i>e</i> de<br>la"), (3, "no"), (4, None)]
    spark.createDataFrame(sources, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in paging.page_matches(spark, str(tmp_path)).select("page_id", "phrase", "n", "same").collect())
    assert got == [(1, "the", 2, 2), (2, "de la", 1, None), (2, "the", 1, 1), (2, "und", 2, 2)]
