"""Recognised words and their boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cleaned(rows: DataFrame, needed: list[str], numbers: dict[str, str], word: str = "word") -> DataFrame:
    """Rows with their numbers read and the word stripped, without those that lack a needed number, whose conf is negative, or
    under 10 for words (level 5), or whose word is blank."""
    read = rows.withColumns({c: F.col(c).try_cast(kind) for c, kind in numbers.items()}).withColumn(word, F.trim(word))
    return read.dropna(subset=needed).where("conf >= 0 and (level <> 5 or conf >= 10)").where(F.col(word) != "")


def _grid(rows: DataFrame, page: str, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """A row for each cell, size wide and high, that a box touches."""
    side = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor(b / size)))
    return rows.withColumn("_gx", side(x0, x1)).withColumn("_gy", side(y0, y1))


def candidates(words: DataFrame, lemmas: DataFrame, pages: DataFrame, taken: DataFrame, page: str = "page", size: float = 200.0, eps: float = 1e-3) -> DataFrame:
    """page, text, lemma, conf, x0, y0, x1, y1 of the words to mark: level 5, of a sought lemma, and apart from all boxes that
    are marked already.

    words has page, level, text, lemma, conf, left, top, width, height, in the picture's places; pages has a row for each page
    with a, b, c, d, e, f, by which its places become the picture's (x' = a x + c y + e, y' = b x + d y + f), and its bounds
    px0, py0, px1, py1; taken has page, x0, y0, x1, y1. A word's box goes back through that matrix, is cut to the page, and
    grown at each side by 5 % of its width and 10 % of its height, by 1 at least; it is apart from a box if they share less
    than eps in width or height. Words of no width or height, boxes that leave less than eps on the page, and pages whose
    matrix can't be turned back give nothing; empty bounds of a page don't cut.

    Boxes are dealt to the cells of a grid that they touch, so pairs meet on page and cell and a page is never one task's."""
    sought = words.where("level = 5 and width > 0 and height > 0 and lemma is not null").join(lemmas.select("lemma").distinct(), "lemma", "left_semi")
    det = F.col("a") * F.col("d") - F.col("b") * F.col("c")
    rows = sought.join(pages, page).withColumn("_det", det).where(F.abs("_det") >= 1e-6)
    back = lambda x, y: ((F.col("d") * (x - F.col("e")) - F.col("c") * (y - F.col("f"))) / F.col("_det"), (F.col("a") * (y - F.col("f")) - F.col("b") * (x - F.col("e"))) / F.col("_det"))
    left, top = F.col("left").cast("double"), F.col("top").cast("double")
    corners = [back(x, y) for x in (left, left + F.col("width")) for y in (top, top + F.col("height"))]
    bounds = {"x0": (F.least, 0), "y0": (F.least, 1), "x1": (F.greatest, 0), "y1": (F.greatest, 1)}
    boxed = rows.withColumns({k: f(*(c[i] for c in corners)) for k, (f, i) in bounds.items()})
    whole = (F.col("px0") < F.col("px1")) & (F.col("py0") < F.col("py1"))
    boxed = boxed.withColumns({k: F.when(whole, (F.greatest if k in ("x0", "y0") else F.least)(k, f"p{k}")).otherwise(F.col(k)) for k in bounds})
    boxed = boxed.where((F.col("x1") - F.col("x0") >= eps) & (F.col("y1") - F.col("y0") >= eps)).select(page, "text", "lemma", "conf", *bounds)
    gx, gy = F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) * 0.05), F.greatest(F.lit(1.0), (F.col("y1") - F.col("y0")) * 0.1)
    # whether a box is apart hangs on the page and itself alone
    mine = _grid(boxed.select(page, *bounds).distinct().withColumns({"_x0": F.col("x0") - gx, "_y0": F.col("y0") - gy, "_x1": F.col("x1") + gx, "_y1": F.col("y1") + gy}), page, F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"), size)
    other = taken.where("x0 < x1 and y0 < y1").select(page, *(F.col(k).alias(f"t{k}") for k in bounds)).distinct()
    other = _grid(other, page, F.col("tx0"), F.col("ty0"), F.col("tx1"), F.col("ty1"), size)
    shared = (F.least("_x1", "tx1") - F.greatest("_x0", "tx0") > eps) & (F.least("_y1", "ty1") - F.greatest("_y0", "ty0") > eps)
    met = mine.join(other, [page, "_gx", "_gy"]).where(shared).select(page, *bounds).distinct()
    return boxed.join(met, [page, *bounds], "left_anti").select(page, "text", "lemma", "conf", *bounds)
