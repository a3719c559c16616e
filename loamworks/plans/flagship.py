"""Extraction as one chain: candidates of all texts, greedy removal, recurrence, cards, feedback, batch removal, both gates, scores and
the balanced choice of each run. A run is a conversation.

What takes the order of candidates into account works in blocks of similar rows or runs; all else is SQL over written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.balanced import balanced_topk
from ..operators.dedupe import batch_dedupe, greedy_dedupe
from ..sources.shared import written
from . import dialect, generate
from .corpus import corpus
from .lifecycle import _memory_text, _rejected, feedback_signature, memory_flag, quality_flag, selection, signature, value_columns
from .mining import once
from .ranking import cluster, matched

#: Templates whose candidates need no score.
PRIORITY = ("atomic-exception", "project-improvement", "high-value-prompt", "principle-signal")
LIMIT = 10


def _candidates(d) -> str:
    """Candidates with what later steps ask for; ``key`` is equal for exact copies."""
    key = "concat(CAST(conv_id AS STRING), ':', memory_tier, ':', CASE WHEN template IN ('project-improvement', 'high-value-prompt') THEN lower(title) ELSE lower(body) END)"
    return f"""{generate.candidates(d)} SELECT id AS seq, conv_id AS run, origin, text, title, body, kind, scope, memory_tier, template, nullif(reason, '') AS reason, confidence, disposition,
  artifact_kind, {generate.candidate_id(d)} AS candidate_id, {key} AS key, {cluster(d)} AS cluster, {signature(d)} AS signature, {feedback_signature(d, 'body')} AS told FROM cand"""


def _judged(d) -> str:
    """Of the rows of <kept>: confidence and reason after recurrence and feedback, the card they repeat, and what both gates say."""
    real = lambda x: f"CAST({x} AS FLOAT)"
    told = "concat('feedback-rejected: ', CAST(rejections AS STRING), ' repeated rejections (', told_reason, ')')"
    again = "concat('Recurring across ', CAST(n AS STRING), ' observations.')"
    return f"""WITH b0 AS (SELECT k.*, coalesce(c.n, 0) AS n, p.rejections, p.reason AS told_reason, p.delta, d.card_id, d.similarity
  FROM <kept> k LEFT JOIN <counts> c ON c.signature = k.signature LEFT JOIN <penalties> p ON p.signature = k.told LEFT JOIN <duplicates> d ON d.seq = k.seq),
b1 AS (SELECT *, CASE WHEN n >= 3 THEN least({real('confidence + ' + real('0.1'))}, {real('0.95')}) ELSE confidence END AS c1,
  CASE WHEN n < 3 THEN reason WHEN trim(coalesce(reason, '')) = '' THEN {again} ELSE concat(reason, ' ', {again}) END AS r1 FROM b0),
b2 AS (SELECT *, CASE WHEN rejections IS NULL THEN c1 ELSE {real('greatest(least(c1 + ' + real('delta') + ', ' + real('1') + '), ' + real('0') + ')')} END AS c2,
  CASE WHEN rejections IS NULL THEN r1 WHEN r1 IS NULL THEN {told} ELSE concat(r1, '; ', {told}) END AS r2, CASE WHEN card_id IS NULL THEN 'add' ELSE 'merge_into_existing' END AS action FROM b1),
b3 AS (SELECT *, lower(concat(title, chr(10), body, chr(10), text, chr(10), coalesce(r2, ''))) AS whole, lower(concat(title, chr(10), body)) AS named, {_memory_text()} AS l FROM b2),
b4 AS (SELECT *, {once(d, quality_flag(d))} AS quality, {memory_flag(d)} AS memory, contains(coalesce(r2, ''), 'Recurring across') AS recurs FROM b3),
b5 AS (SELECT *, {value_columns(d, 'recurs')} FROM b4)
SELECT seq, run, candidate_id, title, body, kind, scope, memory_tier, template, c2 AS confidence, r2 AS reason, coalesce(rejections, 0) AS rejections, action, card_id, quality, memory, cluster, artifact_kind,
  disposition = 'candidate' OR coalesce(template, '') IN ({', '.join(f"'{t}'" for t in PRIORITY)}) OR coalesce(template, '') LIKE 'methodology-%' AS scored, CAST({selection(d, 'c2')} AS DOUBLE) AS selection FROM b5"""


def chain(spark: SparkSession, sf_dir: str, run) -> dict[str, DataFrame]:
    """The tables of each step, written: candidates, kept (by greedy removal), judged, batch (kept of those that feedback leaves) and
    chosen. ``run`` runs a query text over the tables of a folder."""
    found = written(run(spark, sf_dir, _candidates))
    kept = written(greedy_dedupe(found, ("run", "kind", "scope")))
    counts = found.groupBy("signature").agg(F.count("*").alias("n"))
    penalties = run(spark, sf_dir, lambda d: f"{corpus(d)}, {_rejected(d)} SELECT signature, reason, rejections, delta FROM pen")
    base = lambda d: f"{corpus(d)}, cand AS (SELECT seq AS id, scope, body FROM <kept>)"
    near = lambda d: f"{matched(d, base(d))} SELECT id AS seq, card_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY card_id) AS rk FROM sim WHERE similarity > 0.75e0) x WHERE rk = 1"
    duplicates = written(dialect.run(spark, sf_dir, near, kept=kept))
    judged = written(dialect.run(spark, sf_dir, _judged, kept=kept, counts=counts, penalties=penalties, duplicates=duplicates))
    batch = written(batch_dedupe(judged.filter("rejections < 3")))
    passed = batch.filter("quality = '' AND memory IN ('', 'reference-pointer') AND scored")
    chosen = balanced_topk(passed.select("run", "seq", F.col("selection").alias("confidence"), "cluster", F.col("memory_tier").alias("tier")), LIMIT)
    return {"candidates": found, "kept": kept, "judged": judged, "batch": batch, "passed": passed, "chosen": written(chosen.select("run", "seq", "place"))}


def extract_local(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen candidates of each run, best first, with what is to be done with them and where they go."""
    steps = chain(spark, sf_dir, run)
    rows = steps["passed"].join(steps["chosen"], ["run", "seq"])
    tier = F.when(F.col("artifact_kind") != "reject", F.col("artifact_kind")).when(F.col("memory_tier") == "cross_project_principle", "always_on_rule").when(F.col("memory_tier") == "collaboration_preference", "workflow_skill").otherwise(F.col("artifact_kind"))
    route = F.when(F.col("memory") == "reference-pointer", "review_only").otherwise(tier)
    return rows.select("run", "place", "seq", "candidate_id", "kind", "scope", "memory_tier", "template", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), F.round("selection", 4).alias("selection"), "action", F.col("card_id").alias("duplicate_of"), route.alias("route"), "body", "reason")


def extract_outcomes(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the candidates: how many of each tier each step took out, and why."""
    steps = chain(spark, sf_dir, run)
    rows = steps["candidates"].select("seq", "memory_tier")
    for name in ("kept", "batch", "chosen"):
        rows = rows.join(steps[name].select("seq", F.lit(True).alias(f"in_{name}")), "seq", "left")
    rows = rows.join(steps["judged"].select("seq", "rejections", "quality", "memory", "scored"), "seq", "left")
    fate = (
        F.when(F.col("in_kept").isNull(), "similar")
        .when(F.col("rejections") >= 3, "feedback")
        .when(F.col("in_batch").isNull(), "batch")
        .when(F.col("quality") != "", F.concat(F.lit("quality:"), "quality"))
        .when(~F.col("memory").isin("", "reference-pointer"), F.concat(F.lit("memory:"), "memory"))
        .when(~F.col("scored"), "score")
        .when(F.col("in_chosen").isNull(), "limit")
        .otherwise("chosen")
    )
    return rows.groupBy("memory_tier", fate.alias("fate")).agg(F.count("*").alias("n"))
