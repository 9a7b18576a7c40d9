"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session takes a new
    folder of its machine and keeps to it; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _local_dirs.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dirs[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="textsieve-")
    return base


_local_dirs: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage ends there, so a lost executor costs no recomputation
    of what came before, and the shuffle files that made it go at once. forget() frees the table, or else the end of the
    driver's process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textsieve-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._textsieve_path = path
    atexit.register(_remove, spark, path)
    return table


def forget(*tables: DataFrame) -> None:
    """Remove tables that written() made, once all that is made of them is written."""
    for t in tables:
        _remove(t.sparkSession, t._textsieve_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where.getParent(), True)
    except Exception:  # the session may be gone already
        pass


def mod_of_id(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % F.lit(n)


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the texts of one slice have about most_bytes: the bound on a task's working memory
    does not depend on how long the texts are (one text is never cut)."""
    for b in batches:
        ends = b.column(column).cast(pa.large_string()) if pa.types.is_string(b.column(column).type) else b.column(column)
        sizes = pc.binary_length(ends).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < b.num_rows:
            yield b.slice(start)


_BASE = 0x9E3779B97F4A7C15
#: A random odd number for each byte, and the powers of an odd base and of its inverse, as far as they have been asked for.
BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse. The sum of BYTE[byte] * base**place over a string's bytes, times
    inverse**start, is the same wherever the string starts."""
    if not _powers or len(_powers[0]) < n:
        more = 1 << max(12, (n - 1).bit_length())
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(more, base, np.uint64)
            out[0] = 1
            _powers.append(np.cumprod(out, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def byte_sums(data: np.ndarray) -> np.ndarray:
    """The running sums of BYTE[byte] * base**place, one more than bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums
