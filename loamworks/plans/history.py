"""Histories as queries: log lines made of pages and conversations, probed for projects, matched with roots and imported."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import history, ranges
from ..sources.shared import new_dir
from . import dialect
from .mining import SPACES, redacted

AGENT = "claude-code"
KIND = "claude-code-session"


def page_lines(d) -> str:
    """CTE ``line`` (path, place, line): pages as lines of a log of their host. Those with a query name their folder deep inside,
    those with a fragment a project in front; the rest name none."""
    member = (lambda *kv: f"to_json(named_struct({', '.join(kv)}))") if d is dialect.Spark else (lambda *kv: f"CAST(json_object({', '.join(kv)}) AS VARCHAR)")
    folder = dialect.found(d, "url", "//[^/]*(/[a-z]+/[0-9]+)")
    deep = f"""concat('{{"message":{{"content":', t, '}},"payload":{{"items":[{{"cwd":', page_id, '}},[{{"cwd":"/srv', folder, '"}}],{{"project":"/late"}}]}}}}')"""
    front = """concat('{"cwd":["', folder, '"],"payload":{"cwd":"/never"},"project":"/home', folder, '","z":', t, '}')"""
    return f"""WITH page AS (SELECT page_id, url, {dialect.found(d, 'url', '//([^/]*)')} AS host, {folder} AS folder, {member("'text'", 'html')} AS t FROM <pages>),
line AS (SELECT concat('/logs/', host, '.jsonl') AS path, page_id AS place, CASE WHEN contains(url, '?') THEN {deep} WHEN contains(url, '#') THEN {front} WHEN contains(url, '.html') THEN concat('{{broken', t) ELSE t END AS line FROM page)"""


def page_paths(d) -> str:
    """CTEs ``file`` (path, project) and ``root`` (root): pages by the folder of their URL, and folders that hold three pages or more."""
    inner = dialect.found(d, "url", "^[a-z]+://([^?#]*)")
    part = lambda n: "regexp_extract(inner_, " + d.text("^([^/]*" + "/[^/]*" * n + ")") + ", 1)"
    union = " UNION ALL ".join(f"SELECT concat('/', {part(n)}) AS root FROM page" for n in range(3))
    return f"""WITH page AS (SELECT page_id, url, {inner} AS inner_ FROM <pages>),
file AS (SELECT CAST(page_id AS BIGINT) AS path, CASE WHEN contains(url, '#') THEN NULL ELSE concat('/', inner_) END AS project FROM page),
root AS (SELECT root FROM ({union}) x GROUP BY root HAVING count(*) >= 3)"""


def q_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.probe(dialect.run(spark, sf_dir, lambda d: f"{page_lines(d)} SELECT path, place, line FROM line"))


def q_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialect.run(spark, sf_dir, lambda d: f"{page_lines(d)} SELECT CASE WHEN place % 2 = 0 THEN 'codex' ELSE '{AGENT}' END AS agent, path, place, line FROM line")
    return history.harvest(rows).withColumn("agents", F.array_join("agents", ","))


def _paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made = lambda what: dialect.run(spark, sf_dir, lambda d: f"{page_paths(d)} SELECT * FROM {what}")
    return made("file"), made("root")


def q_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, roots = _paths(spark, sf_dir)
    return history.nearest_root(files, roots).select("path", "project", "root")


def q_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.replay_counts(*_paths(spark, sf_dir))


def q_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as log files in two waves, each read by ranges from where the last one ended, and imported. A session's
    first turns and those that came later are observations of their own."""
    base = new_dir(spark)
    home, index, store = f"{base}/home", f"{base}/index", f"{base}/store"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    block = F.struct(F.lit("text").alias("type"), F.col("text"))
    message = F.struct(F.col("role"), F.array(block).alias("content"))
    line = F.to_json(F.struct(F.col("conv_id").cast("string").alias("sessionId"), "turn", F.col("role").alias("type"), message.alias("message")))
    for wave in (0, 1):
        now = rows.filter((F.col("turn") >= 4) == F.lit(bool(wave)))
        now.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select(line.alias("value")).write.mode("append").text(home)
        reading = ranges.begin(spark, home, index, suffix=".txt")
        about = F.from_json("line", "sessionId string, turn int")
        lines = reading.lines.select(about["sessionId"].alias("source"), F.lit(AGENT).alias("agent"), F.lit(KIND).alias("kind"), about["turn"].alias("place"), "line")
        history.insert(store, history.observations(lines))
        reading.commit()
    found = history.load(spark, store)
    return found.select("id", "source", F.sha2("body", 256).alias("body_sha256"), F.length("body").cast("long").alias("chars"), "redacted")


def _node_sql(first: bool) -> str:
    """For the oracle: all nodes of the lines, members by name. A node with a key of its own ends a search for the first."""
    hit = lambda k: f"json_type(node, '$.\"{k}\"') = 'VARCHAR'"
    stop = f" AND NOT ({' OR '.join(f'coalesce({hit(k)}, FALSE)' for k in history.PROJECT_KEYS)})" if first else ""
    return f"""node AS (SELECT path, agent, n, CAST([] AS VARCHAR[]) AS way, CAST(line AS JSON) AS node FROM head WHERE json_valid(line)
  UNION ALL
  SELECT path, agent, n, list_append(way, CASE WHEN json_type(node) = 'ARRAY' THEN lpad(e.key, 9, '0') ELSE e.key END), e.value FROM node, LATERAL (SELECT key, value FROM json_each(node.node)) AS e(key, value)
  WHERE json_type(node) IN ('OBJECT', 'ARRAY'){stop}),
hit AS ({' UNION ALL '.join(f"SELECT path, agent, n, way, {i} AS nth, json_extract_string(node, '$.{k}') AS value FROM node WHERE json_type(node) = 'OBJECT' AND {hit(k)}" for i, k in enumerate(history.PROJECT_KEYS))})"""


def _probe_sql() -> str:
    lines = page_lines(dialect.Duck).replace("WITH page", "WITH RECURSIVE page", 1)
    return dialect.oracle(lambda d: f"""{lines},
l0 AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY place) AS n FROM line),
head AS (SELECT path, '' AS agent, n, line FROM (SELECT *, sum(strlen(line)) OVER (PARTITION BY path ORDER BY place) AS so_far FROM l0 WHERE n <= {history.PROBE_LINES}) x WHERE so_far <= {history.PROBE_BYTES}),
{_node_sql(True)}
SELECT path, value AS project FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n, way, nth) AS rk FROM hit) y WHERE rk = 1""")


def _harvest_sql() -> str:
    lines = page_lines(dialect.Duck).replace("WITH page", "WITH RECURSIVE page", 1)
    return dialect.oracle(lambda d: f"""{lines},
head AS (SELECT path, CASE WHEN place % 2 = 0 THEN 'codex' ELSE '{AGENT}' END AS agent, place AS n, line FROM line),
{_node_sql(False)}
SELECT value AS project, string_agg(DISTINCT agent, ',' ORDER BY agent) AS agents, count(DISTINCT path) AS files, count(*) AS mentions FROM hit WHERE strlen(trim(value)) >= 3 AND substr(trim(value), 1, 1) = '/' GROUP BY value""")


_NEAREST = "met AS (SELECT f.path, f.project, (SELECT max_by(r.root, length(r.root)) FROM root r WHERE f.project = r.root OR starts_with(f.project, concat(r.root, '/'))) AS root FROM file f)"


def _import_sql() -> str:
    d = dialect.Duck
    trim = lambda x: f"regexp_replace({x}, '^{SPACES}+|{SPACES}+$', '', 'g')"
    return dialect.oracle(lambda _: f"""WITH u AS (SELECT conv_id, turn >= 4 AS late, turn, {trim('text')} AS t FROM <conversations> WHERE role = 'user' AND {trim('text')} <> ''),
b AS (SELECT *, lag(t) OVER (PARTITION BY conv_id, late ORDER BY turn) AS before FROM u),
w AS (SELECT conv_id, late, list_transform(string_split(string_agg(t, chr(10) ORDER BY turn), chr(10)), lambda e: {trim('e')}) AS lines FROM b WHERE before IS NULL OR before <> t GROUP BY conv_id, late),
s AS (SELECT conv_id, late, {trim("array_to_string(list_transform(list_filter(list_transform(range(len(lines)), lambda i: {'e': lines[i + 1], 'f': CASE WHEN i = 0 THEN 'x' ELSE lines[i] END}), lambda p: p.e <> '' OR p.f <> ''), lambda p: p.e), chr(10))")} AS body FROM w),
r AS (SELECT CAST(conv_id AS VARCHAR) AS source, body AS raw, {redacted(d, 'body')} AS body FROM s WHERE body <> '')
SELECT DISTINCT concat('obs:{AGENT}:', substr(sha256(concat('{KIND}:', source, ':', body)), 1, 12)) AS id, source, sha256(body) AS body_sha256, CAST(length(body) AS BIGINT) AS chars, body <> raw AS redacted FROM r""")


QUERIES = {"project_probe": q_probe, "project_harvest": q_harvest, "nearest_root": q_nearest, "replay_counts": q_replay, "history_import": q_import}

ORACLE = {
    "project_probe": _probe_sql(),
    "project_harvest": _harvest_sql(),
    "nearest_root": dialect.oracle(lambda d: f"{page_paths(d)}, {_NEAREST} SELECT path, project, root FROM met"),
    "replay_counts": dialect.oracle(lambda d: f"{page_paths(d)}, {_NEAREST} SELECT root, CASE WHEN project IS NULL THEN 'unknown' WHEN root IS NULL THEN 'other' ELSE 'match' END AS match, count(*) AS files FROM met GROUP BY ALL"),
    "history_import": _import_sql(),
}


def queries() -> dict:
    return {name: partial(made) for name, made in QUERIES.items()}
