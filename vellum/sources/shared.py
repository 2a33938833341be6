"""Rows written once to the folder that all executors share, so that later plans start from them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file at most. A task that makes many rows of one row group would else leave one file, and so one task to later steps.
FILE_ROWS = 25_000
#: Folders of tables that this application has written, by application, name and input folder.
_made: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only for a session on one machine that names none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The rows, written now."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def once(spark: SparkSession, name: str, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table as Parquet, written the first time that this application asks for it, so that filters and columns reach
    the files; its folder goes when the application ends."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _made:
        folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        build().write.option("maxRecordsPerFile", FILE_ROWS).parquet(folder)
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        _made[key] = folder
    return spark.read.parquet(_made[key])
