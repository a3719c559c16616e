"""Observations from a stream of files: each micro-batch adds what is not there yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def observation(df: DataFrame) -> DataFrame:
    """id and body of a text with its origin; equal texts of one origin have one id."""
    return df.select(F.concat(F.lit("obs:"), "origin", F.lit(":"), F.sha2("text", 256)).alias("id"), "origin", F.col("text").alias("body"))


def stream_into(source: DataFrame, out: str, checkpoint: str):
    """Runs through all there is. A batch writes its own folder, over what an earlier try of it left, so a restart adds nothing
    twice; batches before are read for the ids that are there."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = observation(batch).dropDuplicates(["id", "origin"])  # a text that is null has no id: one row for each origin
        for earlier in [spark.read.parquet(out).filter(F.col("batch") < number)] if number else []:
            there = earlier.select(F.col("id").alias("there"), F.col("origin").alias("of"))
            new = new.join(there, F.col("id").eqNullSafe(F.col("there")) & (F.col("origin") == F.col("of")), "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(source: DataFrame, minutes: int = 60, late: int = 120) -> DataFrame:
    """Events by type and window; state is dropped when the watermark has passed it."""
    return source.withWatermark("ts", f"{late} minutes").groupBy(F.window("ts", f"{minutes} minutes"), "event_type").count()


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of its files, be it one file or a folder of them. A pattern, as a stream's plain path has to be a folder."""
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    files = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/[c]onversations.parquet")
    return files.withColumn("origin", F.coalesce("role", F.lit("unknown")))
