"""Queries that SQL does not express: order-dependent choices, parsing, streams."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.atomic import atomic_parts
from ..operators.balanced import balanced_topk
from ..operators.cosine import cosine_top
from ..operators.dedupe import batch_dedupe, greedy_dedupe
from ..sources.logs import messages
from ..sources.shared import new_dir
from ..streaming import observations
from . import flagship, generate, mining
from .corpus import corpus
from .ranking import cluster


def _chunks(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, lambda d: f"{corpus(d)} SELECT * FROM chunk")


def _candidates(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, lambda d: f"{generate.candidates(d)} SELECT *, {cluster(d)} AS cluster FROM cand")


def split_atomic(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, lambda d: f"{mining._sentence_rows(d)} SELECT id, sentence FROM sent")
    return rows.select("id", F.posexplode(atomic_parts(F.col("sentence"))).alias("part", "text"))


def greedy(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(run, spark, sf_dir).select(F.col("id").alias("seq"), F.concat_ws(":", "memory_tier", F.when(F.col("template").isin("project-improvement", "high-value-prompt"), F.lower("title")).otherwise(F.lower("body"))).alias("key"), "title", "body", "template", "confidence", "kind", "scope")
    return greedy_dedupe(rows).select("seq", "kind", "scope", "title")


def batches(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(run, spark, sf_dir).select(F.col("id").alias("seq"), F.col("conv_id").alias("run"), "body")
    return batch_dedupe(rows).select("run", "seq")


def balanced(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(run, spark, sf_dir).select(F.col("conv_id").alias("run"), F.col("id").alias("seq"), F.col("confidence").cast("double").alias("confidence"), "cluster", F.col("memory_tier").alias("tier"))
    return balanced_topk(rows).select("run", "place", "seq", "tier")


def cosine(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every row."""
    return cosine_top(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def ingest(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as log lines of several shapes, and read back as messages."""
    rows = _chunks(run, spark, sf_dir)
    block = F.struct(F.when(F.col("turn") % 3 == 0, "tool_result").otherwise("text").alias("type"), F.col("text"))
    flat = F.to_json(F.struct(F.col("origin").alias("role"), F.col("text").alias("content")))
    nested = F.to_json(F.struct(F.col("origin").alias("type"), F.struct(F.array(block).alias("content")).alias("message")))
    meta = F.to_json(F.struct(F.lit(True).alias("isMeta"), F.col("origin").alias("role"), F.col("text").alias("content")))
    line = F.when(F.col("id") % 5 == 0, nested).when(F.col("id") % 7 == 0, meta).when(F.col("id") % 11 == 0, F.lit("{broken")).otherwise(flat)
    return messages(rows.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line_no"), line.alias("line")))


def stream(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_dir(spark)
    observations.stream_into(observations.conversations(spark, sf_dir), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id", "origin", "body")


COSINE_SQL = """WITH c AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings), v AS (SELECT vec_id, i, CAST(x AS DOUBLE) AS x FROM c),
norm AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY vec_id),
dot AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x) AS d FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id GROUP BY q.vec_id, c.vec_id),
s AS (SELECT query_id, dot.vec_id, CASE WHEN a.n = 0 OR b.n = 0 THEN 0 ELSE d / (a.n * b.n) END AS similarity FROM dot JOIN norm a ON a.vec_id = query_id JOIN norm b ON b.vec_id = dot.vec_id)
SELECT query_id, vec_id, rk, round(similarity, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rk FROM s) x WHERE rk <= 5"""


def queries(run) -> dict:
    """``run`` runs a query text over the tables of a folder."""
    return {name: partial(made, run) for name, made in QUERIES.items()}


QUERIES = {
    "split_atomic": split_atomic,
    "greedy_dedupe": greedy,
    "batch_dedupe": batches,
    "balanced_topk": balanced,
    "extract_local": flagship.extract_local,
    "extract_outcomes": flagship.extract_outcomes,
    "cosine_top5": cosine,
    "ingest_jsonl_messages": ingest,
    "stream_observation_upsert": stream,
}

ORACLE = {
    "cosine_top5": COSINE_SQL,
    "stream_observation_upsert": "SELECT DISTINCT 'obs:' || coalesce(role, 'unknown') || ':' || sha256(text) AS id, coalesce(role, 'unknown') AS origin, text AS body FROM conversations",
}
