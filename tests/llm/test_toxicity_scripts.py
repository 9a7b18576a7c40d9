"""Toxicity of texts in other scripts, and of texts without words."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textsieve.llm import queries, toxicity

SCRIPTS = {
    "cyrillic": ("абвгдежзиклмнопрстуфхцчшщыэюя", ["дурак", "тупица", "мерзавец"]),
    "greek": ("αβγδεζηθικλμνξοπρστυφχψω", ["βλακας", "ηλιθιος", "γουρουνι"]),
    "hebrew": ("אבגדהוזחטיכלמנסעפצקרשת", ["מטומטם", "אידיוט", "מגעילה"]),
    "devanagari": ("कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसहािीुूेैोौं", ["मूर्ख", "बेवकूफ", "कमीना"]),
}


def texts(letters, insults, n, seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(3, 9))) for _ in range(400)]
    out = []
    for i in range(n):
        said = [draw.choice(words) for _ in range(30)]
        if i % 3 == 0:
            said[draw.randrange(30)] = draw.choice(insults)
        out.append((" ".join(said), int(i % 3 == 0)))
    return out


@pytest.mark.parametrize("script", SCRIPTS)
def test_other_scripts(spark, script):
    letters, insults = SCRIPTS[script]
    said = [(toxicity.tokens_of(t), label) for t, label in texts(letters, insults, 240, 1)]
    model = toxicity.fit([(list(dict.fromkeys(w)), len(w), label) for w, label in said])
    new = texts(letters, insults, 90, 2)
    new += [(new[1][0] + " " + "".join(x + sign for x in insults[0]), 1) for sign in (".", "-", "*")] + [(new[1][0] + " " + insults[0][:2] + insults[0][1] * 4 + insults[0][2:], 1)]
    got = toxicity.scored(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(new)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    score, label = np.array([r["score"] for r in got]), np.array([x for _, x in new])
    above = (score[label == 1][:, None] > score[label == 0][None]).mean()
    assert above > 0.95 and score[-1] > np.median(score[label == 0])


def test_words_differ_in_any_script():
    assert toxicity.letters_of("дурак") != toxicity.letters_of("домик") and len(toxicity.letters_of("дурак")) == 5
    assert len({toxicity.letters_of(c * 2) for c in "абвгдежзийклмнопрстуфхцчшщъыьэюя"}) == 32
    assert toxicity.letters_of("jjjjj") == toxicity.letters_of("jj")
    assert toxicity.letters_of("$$!!##") == b"" and toxicity.letters_of("") == b""


@pytest.mark.parametrize("text", ["$$ !! ## 1234", "", "a bc d", None])
def test_tables_without_words(spark, tmp_path, text):
    spark.createDataFrame([(i, text, "x") for i in range(60)], "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["op1_toxicity"](spark, str(tmp_path))
    rows = got.collect()
    assert len(rows) == 60 and all(0 <= r["score"] <= 1 for r in rows)
    assert got.select(F.countDistinct("score")).first()[0] == 1
