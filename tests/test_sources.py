import zipfile

from pyspark.sql import functions as F

from textsieve.operators import highlight, match
from textsieve.sources import documents, registry


def test_docx_and_text(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>яблоко </w:t></w:r><w:r><w:t>зелёное</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "b.txt").write_bytes("﻿one\n\n two ".encode())
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    got = {(r["path"].rsplit("/", 1)[1], r["line"]) for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {("a.docx", "яблоко зелёное"), ("a.docx", "cell"), ("b.txt", "one"), ("b.txt", "two")}


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_segments(spark, tmp_path):
    r = lambda t: f"<w:r><w:rPr><w:b/></w:rPr><w:t>{t}</w:t></w:r>"
    body = f"<w:p>{r('Ива')}{r('нов и ')}<w:hyperlink>{r('ссыл')}{r('ка')}</w:hyperlink>{r('сын')}<w:r><w:tab/><w:t>x</w:t><w:br/></w:r></w:p><w:p/><w:p><w:hyperlink>{r('only')}</w:hyperlink></w:p>"
    cell = lambda t: f"<w:tc><w:p>{r(t)}</w:p></w:tc>"
    body += f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr><w:tc><w:p>{r('c')}</w:p><w:p>{r('d')}</w:p></w:tc></w:tr></w:tbl><w:p>{r('last')}</w:p>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/other.xml", "x")
    segments = documents.scan_segments(spark, str(tmp_path))
    rows = segments.orderBy("segment").collect()
    assert [(x["kind"], x["text"]) for x in rows] == [("paragraph", "Иванов и сын\tx\n"), ("link", "ссылка"), ("link", "only"), ("paragraph", "last"), ("paragraph", "a"), ("paragraph", "b"), ("paragraph", "c"), ("paragraph", "d")]
    assert [tuple(x) for x in rows[0]["runs"]] == [(0, 0, 3), (1, 3, 9), (2, 9, 12), (3, 12, 15)]
    sought = spark.createDataFrame([(0, "l", "иванов и"), (1, "l", "ссылка"), (2, "l", "сын")], "ord long, list_key string, phrase string")
    found = match.search_all(segments.withColumnRenamed("segment_id", "doc_id"), sought).withColumnsRenamed({"doc_id": "segment_id", "phrase": "title"}).withColumn("color", F.lit("#ff0000"))
    got = documents.run_pieces(segments, highlight.pieces(found, "segment_id")).collect()
    assert sorted((x["segment_id"].rsplit("#")[1], x["run"], x["from_char"], x["to_char"], x["title"]) for x in got) == [("0", 0, 0, 3, "иванов и"), ("0", 1, 0, 5, "иванов и"), ("0", 2, 0, 3, "сын"), ("1", 0, 0, 4, "ссылка"), ("1", 1, 0, 2, "ссылка")]


def test_registry_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text('x\ny\nA; B ;;C;\n1;2;3;"4;5";6\n;; ;\n4\n')
    (tmp_path / "s.csv").write_text("t\n\nB;D\nb;d\n")
    (tmp_path / "t.csv").write_text("only\ntwo lines")
    got = registry.read_csv(spark, str(tmp_path))
    assert got.columns == ["path", "A", "B", "C", "D"]
    assert sorted(map(str, (tuple(r)[1:] for r in got.collect()))) == sorted(map(str, [("1", "2", "4;5", None), ("4", None, None, None), (None, "b", None, "d")]))
    some = registry.read_csv(spark, str(tmp_path), {" B": "second", "D": "fourth", "none": "x"})
    assert sorted(map(str, (tuple(r)[1:] for r in some.collect()))) == sorted(map(str, [("2", None), ("b", "d")])) and some.columns == ["path", "second", "fourth"]
    assert registry.read_csv(spark, str(tmp_path / "t.csv")).collect() == []


def test_registry_csv_of_many_blocks(spark, tmp_path):
    lines = ["title", "", "N;name"] + [f"{i};name {i}" for i in range(20_000)]
    (tmp_path / "big.csv").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = registry.read_csv(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 1
        assert sorted(int(r["N"]) for r in got.collect()) == list(range(20_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_registry_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f"""<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>title</t></is></c></row>
    <row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3" t="s"><v>1</v></c><c r="D3"/></row>
    <row r="4"><c r="A4"><v>7</v></c><c r="B4"><v>9</v></c><c r="C4" t="s"><v>2</v></c></row><row r="5"><c r="B5"><v>1</v></c></row><row r="6"><c r="AB6"><v>1</v></c><c r="AC6"/></row><row r="7"><c r="C7" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c></row></sheetData></worksheet>"""
    with zipfile.ZipFile(tmp_path / "r.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>No</t></si><si><r><t>Na</t></r><r><t>me </t></r></si><si><t> x </t></si></sst>")
    (tmp_path / "bad.xlsx").write_bytes(b"no")
    got = registry.read_xlsx(spark, str(tmp_path))
    assert got.columns == ["path", "No", "Name"] and sorted(map(str, (tuple(r)[1:] for r in got.collect()))) == sorted(map(str, [("7", "x"), (None, "inline")]))
    assert [tuple(r)[1:] for r in registry.read_xlsx(spark, str(tmp_path), {"No": "number"}).collect()] == [("7",)]
