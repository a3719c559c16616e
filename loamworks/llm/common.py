"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loamworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run herein give their shuffle files back when they end, not when the driver happens to collect garbage. For tables
    that are written once: a frame that is run again would have to shuffle again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def batches_of(spark: SparkSession, rows: int) -> None:
    """From now on at most so many rows of this session go to Python at once: whole texts are long, and a batch is held several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns that an operator is about to add, whatever their case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that no column of the table has, whatever its case."""
    low, mark = {c.lower() for c in df.columns}, "_own"
    while any(c.startswith(mark) for c in low):
        mark += "_"
    return [f"{mark}_{n}" for n in names]
