"""Streams as queries: tables that come in by waves, each run through with state from the checkpoint of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import new_dir
from ..streaming import jobs
from . import dialect
from .lifecycle import _signed

WAVES = 3


def job_events(d) -> str:
    """CTE ``ev``: a user's events as steps of their job."""
    whole = "CAST(floor(value) AS INT)"
    return f"""WITH ev AS (SELECT user_id AS job, event_id AS seq, CASE event_type WHEN 'view' THEN 'begin' WHEN 'click' THEN 'step' WHEN 'error' THEN 'cancel' ELSE 'finish' END AS kind, event_type AS stage, {whole} AS percent,
  CASE WHEN value < 20 THEN {d.text('任务' + jobs.FAILED)} ELSE 'done' END AS message, ts FROM <events>)"""


def _through(spark: SparkSession, rows: DataFrame, order: str, states, key: tuple[str, ...]) -> DataFrame:
    return jobs.in_waves(rows, order, WAVES, states, new_dir(spark), key)


def q_jobs(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialect.run(spark, sf_dir, lambda d: f"{job_events(d)} SELECT * FROM ev")
    found = _through(spark, rows.withColumn("percent", rows["percent"].cast("int")), "seq", jobs.job_states, ("job",))
    return found.withColumns({c: found[c].cast("long") for c in ("percent", "steps", "log_lines")})


def q_recurrences(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, lambda d: f"{_signed(d)} SELECT signature, id, origin FROM sg")
    return _through(spark, rows, "id", jobs.recurrence_states, ("signature",))


def q_windows(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type")
    rows = rows.withColumn("ts", rows["ts"].cast("timestamp"))
    found = _through(spark, rows, "ts", jobs.window_counts, ("start", "event_type"))
    return found.select(found["start"].cast("long").alias("start"), "event_type", "n")


QUERIES = {"stream_jobs": q_jobs, "stream_recurrences": q_recurrences, "stream_event_counts": q_windows}

ORACLE = {
    "stream_jobs": dialect.oracle(lambda d: f"""{job_events(d)},
b AS (SELECT *, max(CASE WHEN kind = 'begin' THEN seq END) OVER (PARTITION BY job) AS begun FROM ev),
l AS (SELECT *, least(percent, 100) AS p, row_number() OVER (PARTITION BY job, kind = 'cancel' ORDER BY seq DESC) AS nth, max(seq) OVER (PARTITION BY job) AS last FROM b WHERE seq >= begun)
SELECT job, CASE arg_max(kind, seq) WHEN 'cancel' THEN 'cancelling' WHEN 'finish' THEN CASE WHEN bool_or(kind = 'cancel') THEN 'cancelled' WHEN contains(arg_max(message, seq), '{jobs.FAILED}') THEN 'failed' ELSE 'completed' END ELSE 'running' END AS lifecycle,
  arg_max(kind, seq) FILTER (kind <> 'cancel') <> 'finish' AS running, bool_or(kind = 'cancel') AS cancel_requested, CAST(arg_max(CASE WHEN kind = 'finish' THEN 100 ELSE p END, seq) FILTER (kind <> 'cancel') AS BIGINT) AS percent, count(*) AS steps,
  string_agg(CASE WHEN kind = 'finish' THEN concat('finish:', message) ELSE concat(stage, ':', p) END, '|' ORDER BY seq) FILTER (kind <> 'cancel' AND nth <= {jobs.DETAILS}) AS details, least(count(*), {jobs.LOGS}) AS log_lines, max(seq) AS seq FROM l GROUP BY job"""),
    "stream_recurrences": dialect.oracle(lambda d: f"{_signed(d)} SELECT signature, count(*) AS occurrences, count(DISTINCT origin) AS origins, max(id) AS last_id FROM sg GROUP BY signature"),
    "stream_event_counts": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
