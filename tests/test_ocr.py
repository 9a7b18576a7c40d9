"""Words to mark against a loop over all boxes."""

import random

import pytest

from textsieve.operators import ocr

WORD = "page long, level int, text string, lemma string, conf double, left double, top double, width double, height double, _id int"
PAGE = "page long, a double, b double, c double, d double, e double, f double, px0 double, py0 double, px1 double, py1 double"


def plain(words, lemmas, pages, taken):
    out = []
    for page, level, text, lemma, conf, left, top, w, h, _ in words:
        if level != 5 or lemma not in lemmas or w is None or w <= 0 or h <= 0 or page not in pages:
            continue
        a, b, c, d, e, f, px0, py0, px1, py1 = pages[page]
        det = a * d - b * c
        if abs(det) < 1e-6:
            continue
        at = [((d * (x - e) - c * (y - f)) / det, (a * (y - f) - b * (x - e)) / det) for x in (left, left + w) for y in (top, top + h)]
        x0, y0, x1, y1 = min(p[0] for p in at), min(p[1] for p in at), max(p[0] for p in at), max(p[1] for p in at)
        if px0 < px1 and py0 < py1:
            x0, y0, x1, y1 = max(x0, px0), max(y0, py0), min(x1, px1), min(y1, py1)
        if x1 - x0 < 1e-3 or y1 - y0 < 1e-3:
            continue
        gx, gy = max(1.0, (x1 - x0) * 0.05), max(1.0, (y1 - y0) * 0.1)
        near = [t for t in taken if t[0] == page and t[1] < t[3] and t[2] < t[4] and min(x1 + gx, t[3]) - max(x0 - gx, t[1]) > 1e-3 and min(y1 + gy, t[4]) - max(y0 - gy, t[2]) > 1e-3]
        if not near:
            out.append((page, text, lemma, conf, x0, y0, x1, y1))
    return sorted(out)


@pytest.mark.parametrize("size", [7.0, 200.0])
def test_candidates(spark, size):
    draw = random.Random(9)
    pages = {1: (1, 0, 0, 1, 0, 0, 0, 0, 300, 300), 2: (2, 0, 0, 2, 10, -5, -50, -50, 400, 400), 3: (0, 1, -1, 0, 0, 0, -900, -900, 900, 900), 4: (1, 2, 2, 4, 0, 0, 0, 0, 9, 9), 5: (1, 0.5, 0, -1, 3, 3, 5, 5, 5, 5)}
    words = [(draw.randint(1, 6), draw.choice([5, 5, 5, 4]), f"w{i}", draw.choice(["x", "y", "z", None]), 9.0, draw.uniform(-40, 350), draw.uniform(-40, 350), draw.choice([0, 3, 20, 90]), draw.choice([-1, 2, 12, 40]), 0) for i in range(400)]
    words += [(1, 5, "null", "x", None, 1.0, 1.0, None, 3.0, 0), words[0], words[0], (1, 5, "edge", "x", 1.0, 299.9995, 10.0, 5.0, 5.0, 0)]
    taken = [(draw.randint(1, 5), x, y, x + draw.choice([-1, 0, 5, 60]), y + draw.choice([1, 30])) for x, y in ((draw.uniform(-50, 300), draw.uniform(-50, 300)) for _ in range(60))]
    words = [(*w[:5], *(None if v is None else float(v) for v in w[5:9]), w[9]) for w in words]
    frames = spark.createDataFrame(words, WORD), spark.createDataFrame([("x",), ("y",), ("x",)], "lemma string"), spark.createDataFrame([(p, *map(float, m)) for p, m in pages.items()], PAGE), spark.createDataFrame([(t[0], *map(float, t[1:])) for t in taken], "page long, x0 double, y0 double, x1 double, y1 double")
    made = ocr.candidates(*frames, size=size)
    got = sorted(map(tuple, made.collect()), key=str)
    want = sorted(plain(words, {"x", "y"}, pages, taken), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want] and len(got) > 20
    for g, w in zip(got, want, strict=True):
        assert g[4:] == pytest.approx(w[4:])
    plan = made._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_candidates_of_nothing(spark):
    frames = spark.createDataFrame([], WORD), spark.createDataFrame([], "lemma string"), spark.createDataFrame([], PAGE), spark.createDataFrame([], "page long, x0 double, y0 double, x1 double, y1 double")
    assert ocr.candidates(*frames).collect() == []
