"""Records folded out of ordered operations: cards that events add, change, aim and delete, and cards that candidates become."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import replay
from ..sources.shared import written
from . import dialect, generate

AGENT = "CASE WHEN value < 20 THEN 'agent-a' WHEN value < 50 THEN 'agent-b' ELSE 'agent-c' END"


def event_ops(d) -> str:
    """CTE ``op``: a user's events as operations on the cards that they name; bodies are the texts of documents of the same number."""
    return f"""WITH ev AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR(20)) AS project, event_type, value, concat('card:', {dialect.json_text(d, 'props', '$.k')}) AS id FROM <events>),
op AS (SELECT seq, project, CASE event_type WHEN 'signup' THEN 'add' WHEN 'purchase' THEN 'add' WHEN 'view' THEN 'update' WHEN 'click' THEN 'targets' ELSE CASE WHEN value >= 50 THEN 'delete' ELSE 'clear' END END AS op, id,
  concat(event_type, ' ', CAST(seq AS VARCHAR(20))) AS title, doc.text AS body, CASE event_type WHEN 'signup' THEN 'preference' WHEN 'purchase' THEN 'constraint' END AS kind, 'project' AS scope,
  CASE event_type WHEN 'click' THEN {d.array(AGENT)} WHEN 'error' THEN NULL ELSE {d.array("'agent-a'", AGENT)} END AS targets, {AGENT} AS agent FROM ev LEFT JOIN <documents> doc ON doc.doc_id = ev.seq)"""


def q_state(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = run(spark, sf_dir, lambda d: f"{event_ops(d)} SELECT * FROM op").withColumn("sources", F.lit(None).cast("array<string>"))
    return _shown(replay.replay(ops))


def _shown(states: DataFrame) -> DataFrame:
    return states.select("project", "id", "title", F.sha2("body", 256).alias("body_sha256"), "kind", "scope", F.array_join("targets", ",").alias("targets"), "created", "updated")


def _candidates(d) -> str:
    return f"""{generate.candidates(d)}, drafted AS (SELECT id AS n, CAST(conv_id AS VARCHAR(20)) AS project, {generate.candidate_id(d)} AS id, title, body, kind, scope FROM cand)
SELECT *, lag(id) OVER (PARTITION BY project, kind ORDER BY n) AS before FROM drafted"""


def card_ops(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate is approved; a global one is promoted then; a procedure that follows another one is merged with it."""
    rows = written(run(spark, sf_dir, _candidates))  # generators are dear, and each kind of operation reads them
    nothing = F.lit(None).cast("array<string>")
    base = lambda nth, op, card, **more: rows.select(
        (F.col("n") * 3 + nth).alias("seq"), "project", F.lit(op).alias("op"), card.alias("id"), "title", "body", "kind", "scope", more.get("targets", nothing).alias("targets"), F.lit(None).cast("string").alias("agent"), more.get("sources", nothing).alias("sources"), "before",
    )
    approved = base(0, "approve", F.col("id"))
    promoted = base(1, "promote", F.col("id")).filter("scope = 'global'")
    merged = base(2, "merge", F.concat(F.lit("project:merged-"), F.col("n").cast("string")), targets=F.array(F.col("kind")), sources=F.array(replay.global_id(F.col("before")), replay.global_id(F.col("id"))))
    merged = merged.filter("kind = 'procedure' AND scope = 'global' AND before IS NOT NULL")
    return approved.unionByName(promoted).unionByName(merged).drop("before")


def q_replay(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(replay.replay(card_ops(run, spark, sf_dir)))


QUERIES = {"card_state": q_state, "card_replay": q_replay}

ORACLE = {
    "card_state": dialect.oracle(lambda d: f"""{event_ops(d)},
gone AS (SELECT project, id, max(seq) AS at FROM op WHERE op = 'delete' GROUP BY ALL),
live AS (SELECT op.*, min(CASE WHEN op = 'add' THEN seq END) OVER (PARTITION BY op.project, op.id) AS created FROM op LEFT JOIN gone ON gone.project = op.project AND gone.id = op.id WHERE op.op IN ('add', 'update', 'targets') AND (gone.at IS NULL OR op.seq > gone.at)),
said AS (SELECT *, CASE WHEN op = 'add' THEN coalesce(body, '') WHEN op = 'update' THEN body END AS b, CASE WHEN op = 'add' THEN coalesce(kind, '') WHEN op = 'update' THEN kind END AS k FROM live WHERE seq >= created),
st AS (SELECT project, id, arg_max(title, seq) FILTER (op IN ('add', 'update')) AS title, arg_max(b, seq) FILTER (b IS NOT NULL) AS body, arg_max(k, seq) FILTER (k IS NOT NULL) AS kind, arg_max(targets, seq) FILTER (op IN ('add', 'targets')) AS targets,
  min(created) AS created, max(seq) FILTER (op IN ('add', 'update')) AS updated, max(seq) FILTER (op IN ('add', 'targets')) AS set_at FROM said GROUP BY project, id),
aim AS (SELECT project, id, set_at, unnest(targets) AS t, unnest(range(len(targets))) AS place FROM st),
kept AS (SELECT a.project, a.id, string_agg(t, ',' ORDER BY place) AS targets FROM aim a WHERE NOT EXISTS (SELECT 1 FROM op c WHERE c.op = 'clear' AND c.project = a.project AND c.agent = a.t AND c.seq > a.set_at) GROUP BY ALL)
SELECT st.project, st.id, title, sha256(body) AS body_sha256, kind, 'project' AS scope, coalesce(kept.targets, '') AS targets, created, updated FROM st LEFT JOIN kept ON kept.project = st.project AND kept.id = st.id"""),
}
