"""Candidates of a run's material in three passes, of which a later one sees only what the earlier ones leave.

1. The run's best lines on methods, each a text of its own that gives three candidates at most.
2. Its snippets: the best lines of all together, then those of each observation, the richest observations first.
3. Its entries in chunks of bounded size and sum: only for runs that passes 1 and 2 left short of candidates or without a project rule.

Of one id the first candidate stays. What is rejected by classification does not count; noise goes, and of equal bodies the surest stays
before the run's previews are cut to size, tiers kept in balance. A run is a conversation. Texts of a pass meet the generators once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions.rules import Rules, any_of
from ..operators import asking
from ..operators.atomic import with_atomic_parts
from ..sources.shared import written
from . import dialect, generate
from .corpus import corpus
from .material import _compact, _rich_lines, line_score, noise, q_chunks
from .mining import sentences, trimmed

LINES, BEST, OF_LINE, WANTED = 12, 64, 3, 8
#: Texts are numbered within their run below the first, and within a pass below the second.
TEXTS, OF_PASS = 1000, 300


def _lines(d) -> str:
    """CTE ``gold``: a run's different lines on methods, bare, the best first."""
    bare = trimmed(d, d.replaced(d.replaced("line", "^[-* ]+"), "^[\"“”'`]+|[\"“”'`]+$"))
    return f"""{_rich_lines(d)},
gold0 AS (SELECT DISTINCT conv_id AS run, {bare} AS line FROM rich WHERE NOT {any_of('l', M.METHOD_ARTIFACT, d)} AND length(line) <= 180),
gold AS (SELECT run, line, row_number() OVER (PARTITION BY run ORDER BY {line_score(d, 'lower(line)')} DESC, length(line), line) AS rk FROM gold0 WHERE line <> '')"""


def first_texts(d) -> str:
    return f"{_lines(d)} SELECT run, rk AS nth, line AS text FROM gold WHERE rk <= {LINES}"


def second_texts(d) -> str:
    """One text a run: its best lines, then those of its richest observations, each under its name."""
    r = Rules(d, "l")
    rich = f"4 * {r.count(M.METHOD_MARKS)} + {r.count(M.DURABLE_MARKS)}"
    nl = chr(10)
    return f"""{_lines(d)},
sn0 AS (SELECT id, line, {line_score(d, 'l')} AS score FROM rich), sn1 AS (SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY score DESC, length(line), line) AS rk FROM sn0),
snip AS (SELECT id, {d.listed('line', 'rk')} AS snippets FROM sn1 WHERE rk <= 8 GROUP BY id),
best AS (SELECT run, {d.listed('line', 'rk')} AS snippets FROM gold WHERE rk <= {BEST} GROUP BY run),
obs AS (SELECT chunk.conv_id AS run, chunk.id, snippets, row_number() OVER (PARTITION BY chunk.conv_id ORDER BY {rich} DESC, turn DESC, chunk.id) AS rk FROM chunk JOIN snip ON snip.id = chunk.id),
part AS (SELECT run, CAST(0 AS BIGINT) AS rk, concat({d.text('source: gold-methodology-snippets' + nl)}, snippets) AS t FROM best
  UNION ALL SELECT obs.run, CAST(obs.rk AS BIGINT), concat('source: ', CAST(obs.id AS VARCHAR(20)), {d.text(nl)}, obs.snippets) FROM obs LEFT JOIN best ON best.run = obs.run WHERE obs.rk <= {LINES} - CASE WHEN best.run IS NULL THEN 0 ELSE 1 END)
SELECT run, CAST(0 AS BIGINT) AS nth, {d.listed('t', 'rk', nl + '---' + nl)} AS text FROM part GROUP BY run"""


def entries(d) -> str:
    return f"{_compact(d)} SELECT id, turn, entry FROM ce"


def third_texts(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = run(spark, sf_dir, q_chunks).join(run(spark, sf_dir, entries), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("late"), "id", "entry"))), lambda x: x["entry"]), "")
    return packed.groupBy("run", F.col("chunk").alias("nth")).agg(text.alias("text"))


def _found(d) -> str:
    """What a text gives, in order: strong candidates, then weak ones by body that occur twice in it or are marked to be remembered."""
    r = Rules(d)
    return f"""{generate.candidates(d, weak=True)},
pw AS (SELECT *, lower(body) AS body_key, count(*) OVER (PARTITION BY conv_id, how = 'rule', lower(body)) AS copies, row_number() OVER (PARTITION BY conv_id, how = 'rule', lower(body) ORDER BY id) AS again FROM cand),
pk AS (SELECT *, how = 'rule' AS is_weak FROM pw WHERE how <> 'rule' OR (again = 1 AND (copies >= 2 OR {r.explicit()})))
SELECT conv_id AS text_id, id, {generate.candidate_id(d)} AS cid, title, body, kind, scope, memory_tier, template, confidence, artifact_kind = 'reject' AND memory_tier = 'project_rule' AS rejected,
  row_number() OVER (PARTITION BY conv_id ORDER BY is_weak, CASE WHEN is_weak THEN body_key ELSE '' END, id) AS place FROM pk"""


def of_texts(spark: SparkSession, sf_dir: str, texts: DataFrame) -> DataFrame:
    """The candidates of texts (run, nth_pass, nth, text) that classification lets through; a line gives OF_LINE at most, other texts
    WANTED. Texts of several passes go through the generators together."""
    rows = texts.select((F.col("run") * TEXTS + F.col("nth_pass") * OF_PASS + F.col("nth")).alias("text_id"), F.expr(sentences(dialect.Spark, "text")).alias("parts"))
    atoms = with_atomic_parts(rows, "parts").select(F.col("text_id").alias("id"), F.col("text_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("origin"), F.posexplode("parts").alias("place", "text"))
    found = dialect.run(spark, sf_dir, _found, atoms=atoms)
    found = found.withColumns({"run": F.floor(F.col("text_id") / TEXTS).cast("long"), "nth_pass": F.floor(F.col("text_id") % TEXTS / OF_PASS).cast("int")})
    most = F.when(F.col("nth_pass") == 1, OF_LINE).otherwise(WANTED)
    return found.filter((F.col("place") <= most) & ~F.col("rejected")).drop("rejected")


def merged(found: DataFrame) -> DataFrame:
    """Of each run and id the first candidate, by pass, text and place."""
    first = Window.partitionBy("run", "cid").orderBy("nth_pass", "text_id", "place")
    return found.withColumn("again", F.row_number().over(first)).filter("again = 1").drop("again")


def shown(d) -> str:
    """The previews of <merged>: without noise, of equal bodies the surest, and of each run the first eight, tiers in balance."""
    other = "memory_tier <> 'project_rule'"
    return f"""WITH v0 AS (SELECT * FROM <merged> WHERE NOT {noise(d)}),
v1 AS (SELECT *, row_number() OVER (PARTITION BY run, memory_tier, scope, lower({trimmed(d, 'body')}) ORDER BY confidence DESC, cid) AS copy FROM v0),
v2 AS (SELECT *, row_number() OVER (PARTITION BY run, {other} ORDER BY confidence DESC, cid) AS rk, max(CASE WHEN {other} THEN 0 ELSE 1 END) OVER (PARTITION BY run) AS has_rule FROM v1 WHERE copy = 1),
v3 AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN {other} AND rk <= least(7, {WANTED} - has_rule) THEN 0 ELSE 1 END, confidence DESC, cid) AS picked FROM v2)
SELECT run, cid AS candidate_id, nth_pass, kind, scope, memory_tier, template, round(CAST(confidence AS DOUBLE), 4) AS confidence, body, row_number() OVER (PARTITION BY run ORDER BY confidence DESC, cid) AS place FROM v3 WHERE picked <= {WANTED}"""


def three_passes(spark: SparkSession, sf_dir: str, run) -> dict[str, DataFrame]:
    """Tables of each step: first and second (candidates of these passes), left (runs for the third), third, and merged."""
    texts = [run(spark, sf_dir, made).withColumn("nth_pass", F.lit(i)).select("run", "nth_pass", "nth", "text") for i, made in enumerate((first_texts, second_texts), 1)]
    early = written(of_texts(spark, sf_dir, written(texts[0].unionByName(texts[1]))))
    so_far = merged(early)
    enough = so_far.groupBy("run").agg(F.count("*").alias("n"), F.max((F.col("memory_tier") == "project_rule").cast("int")).alias("rule")).filter((F.col("n") >= WANTED) & (F.col("rule") == 1))
    texts = third_texts(run, spark, sf_dir).join(enough.select("run"), "run", "left_anti")
    left = written(texts.select("run", F.lit(3).alias("nth_pass"), "nth", "text"))
    third = written(of_texts(spark, sf_dir, left))
    return {"first": early.filter("nth_pass = 1"), "second": early.filter("nth_pass = 2"), "left": left, "third": third, "merged": written(merged(early.unionByName(third)))}


def q_passes(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.run(spark, sf_dir, shown, merged=three_passes(spark, sf_dir, run)["merged"])


def paragraphs(d) -> str:
    parts = d.kept(d.each(d.pieces("text", "\n\n"), trimmed(d, "e")), "e <> ''")
    return f"{corpus(d)}, pp AS (SELECT conv_id AS run, id, {d.placed(parts)} FROM chunk) SELECT run, id * 1000 + place AS seq, e AS text FROM pp"


def q_provider(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a provider extracts of a run's paragraphs, judged and rewritten; here one that answers by rules."""
    found, _ = asking.extract(run(spark, sf_dir, paragraphs), asking.rule_provider)
    items = asking.usable(found).select("run", F.col("place").cast("long").alias("seq"), "title", "body", "kind", F.lit("project").alias("scope"), F.lit("project_rule").alias("memory_tier"), F.lit("llm").alias("template"), "confidence", F.col("rationale").alias("reason"), F.col("evidence_quote").alias("evidence"))
    judged = asking.judge(items, asking.rule_provider).filter("judged").drop("judged", "verdict_reason")
    return asking.refine(written(judged), asking.rule_provider).select("run", "seq", "title", "body", "kind", "template", F.round("confidence", 4).alias("confidence"), "reason", F.col("votes").cast("long").alias("votes"), "refined")


QUERIES = {"evolve_passes": q_passes, "provider_extract": q_provider}
