"""Kept tables: batches that come twice, runs that fail midway, and a stream."""

import pytest

from textsieve.streaming import sinks


def phrases(spark, *said):
    return spark.createDataFrame([(p,) for p in said], "phrase string")


def said(table):
    return sorted(r["phrase"] for r in table.read().collect())


def changes(table):
    return sorted((r["batch"], r["change"], r["phrase"]) for r in table.log().collect())


def test_list_is_saved_once(spark, tmp_path):
    table = sinks.KeptTable(spark, str(tmp_path / "t"), "phrase string")
    merge = table.merge(sinks.saved_list)
    assert said(table) == [] and changes(table) == []
    merge(phrases(spark, "a", "b", "b", None), 0)
    merge(phrases(spark, "b", "c"), 1)
    want = [(0, "added", "a"), (0, "added", "b"), (1, "added", "c"), (1, "deleted", "a")]
    assert said(table) == ["b", "c"] and changes(table) == want
    merge(phrases(spark, "x"), 1)  # comes again
    merge(phrases(spark, "a", "b"), 0)
    assert said(table) == ["b", "c"] and changes(table) == want
    assert len(list((tmp_path / "t").glob("table-*"))) == 1


def test_a_failed_run_leaves_nothing(spark, tmp_path, monkeypatch):
    table = sinks.KeptTable(spark, str(tmp_path / "t"), "phrase string")
    merge = table.merge(sinks.saved_list)
    merge(phrases(spark, "a"), 0)
    swap = table._swap
    monkeypatch.setattr(table, "_swap", lambda told: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        merge(phrases(spark, "b", "half"), 1)
    assert said(table) == ["a"] and changes(table) == [(0, "added", "a")]
    monkeypatch.setattr(table, "_swap", swap)
    merge(phrases(spark, "b"), 1)
    assert said(table) == ["b"] and changes(table) == [(0, "added", "a"), (1, "added", "b"), (1, "deleted", "a")]


def test_upsert_stream(spark, tmp_path):
    table = sinks.KeptTable(spark, str(tmp_path / "t"), "id long, name string, terms string")
    merge = table.merge(sinks.upserted("id", ["name", "terms"], ("terms",)))

    def run():
        read = spark.readStream.schema("id long, name string, terms string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        read.writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    def put(n, rows):
        spark.createDataFrame(rows, "id long, name string, terms string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))

    put(0, [(1, "one", "t"), (2, "two", None), (None, "lost", None)])
    run()
    put(1, [(2, "two", "u"), (3, "three", None), (1, "One", "v"), (1, "Two", "w")])
    run()
    run()
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "One", "t"), (2, "two", "u"), (3, "three", None)]
    assert sorted((r["batch"], r["change"], r["phrase"]) for r in table.log().collect()) == [(0, "added", "1"), (0, "added", "2"), (1, "added", "3"), (1, "changed", "1"), (1, "changed", "2")]
