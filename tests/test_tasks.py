"""Tasks as a stream against the same events in one batch: any order, expiry, and a restart from the checkpoint."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from textsieve.streaming import tasks

KIND = "task_id long, ts timestamp, state string, message string, step double, most double"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def event(task, seconds, state=None, message=None, step=None, most=None):
    return task, START + dt.timedelta(seconds=seconds), state, message, step, most


def write(spark, rows, path, n):
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{path}/in/part{n}")


def run(spark, path, ttl, late):
    """One file a batch, to the end of what is there; what came out goes to a folder of its batch, so that a batch that is run
    again replaces it."""
    read = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    save = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
    q = tasks.life_stream(read, ttl, late).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    q.awaitTermination()


FIELDS = ["task_id", "created_at", "last_at", "expires_at", "state", "message", "progress", "percent", "n_events"]


def rows_of(df):
    return sorted(str(tuple(r[f] for f in FIELDS)) for r in df.collect())


def test_lives_in_one_batch(spark):
    rows = [event(1, 50, "COMPLETED", "done", 40.0), event(1, 0, "PENDING", "new", None, 80.0), event(1, 10, "PROCESSING", "at it", 40.0), event(1, 50, "PROCESSING", "late")]
    rows += [event(1, 151, "PENDING", "again"), event(1, 252, "odd", "other"), event(2, 5, None, None, 7.0, 0.0), (None, START, "PENDING", None, None, None), (3, None, "PENDING", None, None, None)]
    found = tasks.lives(spark.createDataFrame(rows, KIND), 100)
    got = {(r["task_id"], r["at"]): r for r in found.withColumn("at", F.unix_timestamp("created_at") - int(START.timestamp())).collect()}
    assert sorted(got) == [("1", 0), ("1", 151), ("1", 252), ("2", 5)]
    first = got["1", 0]
    assert (first["state"], first["message"], first["progress"], first["percent"], first["n_events"]) == ("COMPLETED", "done", 80.0, 100.0, 4)
    assert got["1", 151]["state"] == "PENDING" and got["1", 252]["message"] == "other" and got["1", 252]["state"] == "PENDING"
    assert (got["2", 5]["percent"], got["2", 5]["progress"]) == (0.0, 7.0)
    assert tasks.lives(spark.createDataFrame([], KIND), 100).collect() == []


def test_stream_is_the_batch(spark, store, tmp_path):
    draw = random.Random(2)
    made = [event(t, at + draw.randint(0, 40), draw.choice(tasks.STATES), f"m{at}", float(draw.randint(0, 9)), draw.choice([None, 50.0])) for t in range(12) for at in draw.sample(range(0, 3000, 50), 14)]
    made.sort(key=lambda e: e[1])
    files = [made[i : i + 40] for i in range(0, len(made), 40)]
    for a, b in zip(files, files[1:]):  # neighbours' events come the wrong way round
        a[-8:], b[:8] = b[:8], a[-8:]
    ttl, late = 200, 2000
    for n, some in enumerate(files[:2]):
        write(spark, draw.sample(some, len(some)), tmp_path, n)
    run(spark, tmp_path, ttl, late)
    for n, some in enumerate(files[2:], 2):
        write(spark, draw.sample(some, len(some)), tmp_path, n)
    run(spark, tmp_path, ttl, late)  # goes on from the checkpoint
    write(spark, [event(99, 50_000, "PENDING")], tmp_path, 98)  # the watermark passes all ends
    write(spark, [event(99, 50_001, "PENDING")], tmp_path, 99)
    run(spark, tmp_path, ttl, late)
    out = spark.read.parquet(f"{tmp_path}/out")
    whole = tasks.lives(spark.createDataFrame(made, KIND), ttl)
    assert rows_of(out.where("expired")) == rows_of(whole)
    # while a life lasts, what came out of it last is what came out at its end
    live = out.where("not expired and task_id <> '99'").groupBy("task_id", "last_at").agg(F.max("n_events").alias("n_events"))
    assert live.join(whole.select("task_id", "last_at", "n_events"), ["task_id", "last_at", "n_events"]).count() == whole.count()
    before = rows_of(out)
    run(spark, tmp_path, ttl, late)  # nothing new
    assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == before


def test_events_between_lives_join_them(spark, store, tmp_path):
    write(spark, [event(1, 0, "PENDING", "a", 1.0), event(1, 150, "PROCESSING", "c", 4.0)], tmp_path, 0)
    run(spark, tmp_path, 100, 1000)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    write(spark, [event(1, 80, "COMPLETED", "b", 2.0)], tmp_path, 1)
    run(spark, tmp_path, 100, 1000)
    last = spark.read.parquet(f"{tmp_path}/out").where("n_events = 3").first()
    assert (last["state"], last["message"], last["progress"]) == ("PROCESSING", "c", 7.0)
    assert spark.read.parquet(f"{tmp_path}/out").where("expired").count() == 0
