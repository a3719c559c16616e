"""Record tables and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not among them."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` with a key that ``old`` lacks, one for each key."""
    return new.join(old.select(key), key, "left_anti").dropDuplicates([key])


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A log of JSON lines: wrong lines are errors, or left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def to_yaml(df: DataFrame) -> DataFrame:
    """One text for each row: ``name: value`` lines, strings quoted as JSON."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    line = lambda c: F.concat(F.lit(f"{c}: "), F.when(F.col(c).isNull(), F.lit("null")).otherwise(quoted(c)))
    return df.select(F.array_join(F.array(*[line(c) for c in df.columns]), "\n").alias("value"))
