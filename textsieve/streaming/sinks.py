"""Tables that streams keep up to date: each batch is merged once, and table and change log change in one swap."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lists


class KeptTable:
    """A table and its change log under a folder that driver and executors share. `current` names the batch that was merged last
    and the folder of the table then; it is replaced by one rename, after table and log are written. Whatever a run that
    failed has left is not named there and counts for nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: str, log_schema: str = "change string, phrase string") -> None:
        self.spark, self.path, self.schema, self.log_schema = spark, path, schema, log_schema
        jvm = spark.sparkContext._jvm
        self._of = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        self._fs = self._of("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def state(self) -> tuple[int, str | None]:
        """The last batch, -1 at first, and the folder of the table."""
        if not self._fs.exists(self._of("current")):
            return -1, None
        told = json.loads(self.spark.read.text(f"{self.path}/current").first()["value"])
        return told["batch"], told["table"]

    def read(self) -> DataFrame:
        table = self.state()[1]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{table}") if table else self.spark.createDataFrame([], self.schema)

    def log(self) -> DataFrame:
        """All changes with the batch that made them."""
        upto = self.state()[0]
        if upto < 0:
            return self.spark.createDataFrame([], f"{self.log_schema}, batch long")
        return self.spark.read.schema(f"{self.log_schema}, batch long").parquet(f"{self.path}/log").where(F.col("batch") <= upto)

    def merge(self, made: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: made(table, batch) gives the new table and the changes. A batch that was merged before, as one is
        that comes again after a restart, changes nothing."""

        def run(batch: DataFrame, batch_id: int) -> None:
            last, before = self.state()
            if batch_id <= last:
                return
            table, changes = made(self.read(), batch)
            name = f"table-{batch_id}-{uuid.uuid4().hex}"
            table.write.parquet(f"{self.path}/{name}")
            changes.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}")
            self._swap(json.dumps({"batch": batch_id, "table": name}))
            if before:
                self._fs.delete(self._of(before), True)

        return run

    def _swap(self, told: str) -> None:
        jvm = self.spark.sparkContext._jvm
        new = self._of(f"new-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(told.encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, self._of("current"), options)


def saved_list(old: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For KeptTable.merge: a list of phrases becomes what the batch (phrase) holds, each phrase once; the changes are those
    added and those deleted."""
    new = batch.select("phrase").where("phrase is not null").distinct()
    return new, lists.diff(old.select("phrase"), new)


def upserted(key: str, columns: list[str], keep_if_set: tuple[str, ...] = ()) -> Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """For KeptTable.merge: lists.upsert by the key; of rows of a batch with equal keys the least stands. The changes are the
    keys that were added and those whose row is another now."""

    def made(old: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        one = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_r")).select(key, "_r.*")
        new = lists.upsert(old, one, key, columns, keep_if_set)
        rows = lambda df, name: df.select(key, F.struct(*columns).alias(name))
        met = rows(new, "_new").join(rows(old, "_old").withColumn("_was", F.lit(True)), key, "left")
        change = F.when(F.col("_was").isNull(), "added").when(~F.col("_new").eqNullSafe(F.col("_old")), "changed")
        return new, met.select(change.alias("change"), F.col(key).cast("string").alias("phrase")).where("change is not null")

    return made
