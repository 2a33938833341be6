"""What the operators of this subpackage share: table reads, shared folders, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F




def give_memory_back(least: int = 1 << 20) -> None:
    """Lets the C library return freed memory from blocks of `least` bytes on at once, so that a worker that waits for its next
    task holds little more than its modules. Where there is no such library, nothing changes."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        for option, value in ((-3, least), (-1, least), (-8, 2)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
            libc.mallopt(option, value)
        pa.set_memory_pool(pa.system_memory_pool())


give_memory_back()

#: Rows and bytes of a batch that goes to a Python worker, at most: long texts add up.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 2_000,
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
}


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once. Plans are lazy, so the setting stays for the rest of the session; one
    that is smaller already is left alone. It changes no result."""
    for key, most in BATCH.items():
        now = int(re.sub(r"[^-\d]", "", spark.conf.get(key)))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only where the session names none (tests on one machine), a temporary one."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder, so that later reads survive lost executors."""
    checkpoint_dir(df.sparkSession)
    small_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as Parquet in a folder of their own in the shared folder, and that folder, for `removed` when no one reads it
    any more. Smaller than `cut` where columns compress well."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that `written` made, by the file system that it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, base: str, *others: str) -> str:
    """A column name that df doesn't have yet, in any case of its letters, nor `others`."""
    taken = {c.lower() for c in [*df.columns, *others]}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(docs: DataFrame, key: str, id_col: str = "doc_id") -> tuple[DataFrame, bool]:
    """docs with a bigint column `key` that names each row, and whether that is the id itself. It is where no id is null or
    repeated; else the rows are numbered and written once, so that each row keeps its number."""
    ids = docs.select(F.col(id_col).cast("bigint").alias("i"))
    odd = ids.groupBy("i").agg(F.count("*").alias("n")).where("n > 1 OR i IS NULL").limit(1).count()
    if not odd:
        return docs.withColumn(key, F.col(id_col).cast("bigint")), True
    return cut(docs.withColumn(key, F.monotonically_increasing_id())), False


def text_column(name: str = "text"):
    """Null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and the n + 1 offsets of its rows in it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, at_most: int) -> list[tuple[int, int]]:
    """Ranges of rows of about at_most bytes each; a longer row has a range of its own."""
    out, first = [], 0
    n = len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + at_most, "right")) - 1)
        out.append((first, min(last, n)))
        first = min(last, n)
    return out
