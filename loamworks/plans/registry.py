"""All registered queries with their oracle SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.atomic import with_atomic_parts
from . import builds, cards, dialect, documents, generate, history, judging, lifecycle, material, mining, ordered, passes, ranking, records, stores, streams, terms, upkeep

SHARED = {**mining.QUERIES, **generate.QUERIES, **ranking.QUERIES, **lifecycle.QUERIES, **upkeep.QUERIES, **material.QUERIES, **terms.QUERIES, **cards.QUERIES, **judging.QUERIES, **stores.QUERIES}


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of all sentences of the corpus, numbered within their text."""
    rows = dialect.run(spark, sf_dir, generate.sentence_arrays)
    return with_atomic_parts(rows, "parts").select("id", "conv_id", "turn", "origin", F.posexplode("parts").alias("place", "text"))


def run(spark: SparkSession, sf_dir: str, made) -> DataFrame:
    more = {"atoms": atoms(spark, sf_dir)} if "<atoms>" in made(dialect.Spark) else {}
    return dialect.run(spark, sf_dir, made, **more)


def _run(made, spark, sf_dir):
    return run(spark, sf_dir, made)


def queries() -> dict:
    return {name: partial(_run, made) for name, made in SHARED.items()} | ordered.queries(run) | history.queries() | documents.QUERIES | {name: partial(made, run) for name, made in (builds.QUERIES | passes.QUERIES | records.QUERIES | streams.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return {name: dialect.oracle(made) for name, made in SHARED.items()} | ordered.ORACLE | history.ORACLE | documents.ORACLE | builds.ORACLE | records.ORACLE | streams.ORACLE
