"""The next document, whatever ids look like."""

import random

import pytest
from pyspark.sql import functions as F

from textsieve.llm import fingerprint

DRAW = random.Random(6)
IDS = {
    "dense": list(range(3000)),
    "hashed": [DRAW.randrange(-(1 << 63), 1 << 63) for _ in range(3000)],
    "far apart": [*range(1500), *(1 << 50 | i for i in range(1000)), (1 << 63) - 1, -(1 << 63), 7 << 40],
    "one": [5],
    "two": [-1, 1],
    "edges": [-(1 << 63), 0, (1 << 63) - 1],
}


@pytest.mark.parametrize("kind", IDS)
def test_each_row_is_followed_by_its_next(spark, kind):
    ids = IDS[kind]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(3)
    rows = fingerprint.with_next(docs, span=64).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["_span"], []).append((not r["_own"], -r["doc_id"]))
    order = sorted(ids, reverse=True)
    want = dict(zip(order, [*order[1:], order[0]], strict=True))
    for some in by.values():
        some.sort()
        for (copy, a), (_, b) in zip(some, some[1:]):
            assert copy or want[-a] == -b
        assert some[-1][0]  # the last of a span has its next behind it
    assert sorted(r["doc_id"] for r in rows if r["_own"]) == sorted(ids)
    if kind in ("dense", "hashed"):
        assert 20 <= len(by) <= 120 and max(map(len, by.values())) < 200


def test_same_results_with_hashed_ids(spark):
    said = ["".join(DRAW.choice("abcdef ") for _ in range(DRAW.randint(0, 300))) for _ in range(300)]
    plain = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    far = sorted({DRAW.randrange(-(1 << 63), 1 << 63) for _ in range(300)})
    spread = spark.createDataFrame(list(zip(far, said, strict=True)), "doc_id long, text string")
    result = lambda df: [tuple(r)[1:] for r in fingerprint.edited_and_next(df).orderBy("doc_id").collect()]
    assert result(plain) == result(spread)
    assert fingerprint.with_next(plain.limit(0)).select(F.count(F.lit(1))).first()[0] == 0
