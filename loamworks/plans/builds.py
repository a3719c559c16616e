"""Artifacts as queries: cards of candidates rendered and written, and folders compared with their mirrors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import artifacts, scan
from ..sources.shared import new_dir, written
from . import dialect
from .cards import activation, file_stem, kebab
from .generate import candidate_id, candidates
from .mining import trimmed

#: The agents of a project and where they read.
AGENTS = (("claude-code", "CLAUDE.md", ".claude/rules", ".claude/skills"), ("codex", "AGENTS.md", None, ".agents/skills"))


def cards(d) -> str:
    """CTE ``included``: cards of each conversation's candidates (of one id the first), for the agents that they are for: those of one
    agent's scope for the first agent only."""
    agents = " UNION ALL ".join(f"SELECT '{a[0]}' AS agent, {i} AS nth" for i, a in enumerate(AGENTS))
    skill = "a.activation = 'skill' OR a.artifact_kind = 'workflow_skill'"
    return f"""{candidates(d)},
cards0 AS (SELECT CAST(conv_id AS VARCHAR(20)) AS project, {candidate_id(d)} AS cid, id AS n, title, body, kind, scope, artifact_kind, {activation()} AS activation FROM cand),
cards1 AS (SELECT *, row_number() OVER (PARTITION BY project, cid ORDER BY n) AS copy FROM cards0),
agent AS ({agents}),
included AS (SELECT a.project, agent.agent, a.cid AS id, a.title, a.body, CASE WHEN {skill} THEN 'skill' WHEN a.activation = 'always-on' THEN 'instructions' ELSE 'none' END AS route,
  CASE WHEN {kebab(d, 'a.title')} = '' THEN {file_stem(d, 'a.cid')} ELSE {kebab(d, 'a.title')} END AS skill0, {file_stem(d, 'a.cid')} AS stem FROM cards1 a CROSS JOIN agent WHERE copy = 1 AND (scope <> 'agent' OR nth = 0)),
named AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY project, agent, skill0 ORDER BY id) = 1 THEN skill0 ELSE concat(skill0, '-', stem) END AS skill FROM included)"""


def q_build(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all projects, written twice (the second time over what the first one wrote) and compared with the lock."""
    rows = run(spark, sf_dir, lambda d: f"{cards(d)} SELECT project, agent, id, title, body, route, skill, stem FROM named")
    made = written(artifacts.render(written(rows), spark.createDataFrame(list(AGENTS), "agent string, instructions string, rules_dir string, skills_dir string")))
    root = new_dir(spark)
    artifacts.write(made, root)
    artifacts.write(made, root)
    # sized by the lock's shards, not by the files: without the hint it may go to the driver
    states = artifacts.artifact_states(spark, root).select("path", "state").hint("merge")
    sums = made.select("path", "kind", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"), "over_budget")
    return sums.join(states, "path").select(*sums.columns, "state")


def _build_sql() -> str:
    d = dialect.Duck
    note = d.text(artifacts.NOTE)
    agents = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in a) + ")" for a in AGENTS)
    section = lambda level: f"concat('{level} ', title, chr(10), chr(10), body, chr(10), chr(10))"
    many = lambda x, test="TRUE": f"coalesce(string_agg({x}, '' ORDER BY id) FILTER ({test}), '')"
    other = lambda x, text: f"CASE WHEN {x} = '' THEN {d.text(text)} ELSE {x} END"
    none = "- No cards are declared for this agent yet.\n"
    text = lambda s: d.text(s)
    return dialect.oracle(lambda _: f"""{cards(d)},
config AS (SELECT * FROM (VALUES {agents}) AS v(agent, instructions, rules_dir, skills_dir)),
nn AS (SELECT named.*, instructions, rules_dir, skills_dir FROM named JOIN config ON config.agent = named.agent),
gg AS (SELECT project, agent, instructions, rules_dir, skills_dir, {many(section('###'), "route = 'instructions'")} AS c, {many(section('##'), "route = 'instructions'")} AS r,
  {many("concat('- `', skill, '`', chr(10))", "route = 'skill'")} AS s, {many("concat('- ', id, ' (', route, '): ', title, chr(10))")} AS o FROM nn GROUP BY ALL),
ff AS (SELECT concat(project, '/', instructions) AS path, concat(agent, ':instructions') AS kind, concat({note}, {text('# Instructions' + chr(10) * 2 + '## Skills' + chr(10) * 2)}, {other('s', '- No skills are declared for this agent yet.' + chr(10))}, {text(chr(10) + '## Cards' + chr(10) * 2)}, {other('c', none)}) AS content FROM gg
  UNION ALL SELECT concat(project, '/', rules_dir, '/cards.md'), concat(agent, ':rules'), concat({note}, {text('# Rules' + chr(10) * 2)}, {other('r', none)}) FROM gg WHERE rules_dir IS NOT NULL
  UNION ALL SELECT concat(project, '/', skills_dir, '/cards/references/cards.md'), concat(agent, ':overview'), concat({note}, {text('# Cards' + chr(10) * 2)}, o) FROM gg
  UNION ALL SELECT concat(project, '/', skills_dir, '/', skill, '/SKILL.md'), concat(agent, ':skill'), concat('---', chr(10), 'name: ', skill, chr(10), 'description: ', CAST(json_array(title) AS VARCHAR), chr(10), '---', chr(10), chr(10), {note}, {section('#')}, 'Read `references/', stem, '.md` first.', chr(10)) FROM nn WHERE route = 'skill'
  UNION ALL SELECT concat(project, '/', skills_dir, '/', skill, '/references/', stem, '.md'), concat(agent, ':reference'), concat({note}, {section('#')}) FROM nn WHERE route = 'skill')
SELECT path, kind, sha256(content) AS sha256, CAST(strlen(content) AS BIGINT) AS bytes, kind LIKE '%:instructions' AND strlen(content) > {artifacts.BUDGET} AS over_budget, 'synced' AS state FROM ff""")


def versions(d) -> str:
    """CTE ``file`` (folder, path, source, target, mirrored): documents as files of folders of equal language, source and length, with
    the contents that a file has now, has in the mirror, and had when it was mirrored; null where it is not there.

    Events of a document's number tell what became of it since: a click changed it and a purchase removed it; an event of its number
    and a thousand more tells the same of the mirror (an error changed it, a purchase removed it), and that a signup made it unmarked."""
    return """WITH file AS (SELECT concat(coalesce(d.lang, ''), '/', coalesce(d.source, ''), '/', CAST(d.n_chars AS VARCHAR(20))) AS folder, concat(CAST(d.doc_id AS VARCHAR(20)), '.md') AS path,
  CASE a.event_type WHEN 'purchase' THEN NULL WHEN 'click' THEN concat(coalesce(d.text, ''), ' changed') ELSE coalesce(d.text, '') END AS source,
  CASE b.event_type WHEN 'purchase' THEN NULL WHEN 'error' THEN concat(coalesce(d.text, ''), ' drifted') ELSE coalesce(d.text, '') END AS target,
  CASE WHEN b.event_type = 'signup' THEN NULL ELSE coalesce(d.text, '') END AS mirrored
  FROM <documents> d LEFT JOIN <events> a ON a.event_id = d.doc_id LEFT JOIN <events> b ON b.event_id = d.doc_id + 1000)"""


def q_mirrors(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, lambda d: f"{versions(d)} SELECT * FROM file")
    side = lambda c: artifacts.tree_hashes(rows.filter(F.col(c).isNotNull()).select("folder", "path", F.col(c).alias("content")))
    return artifacts.mirror_states(side("source"), side("target"), side("mirrored"))


def _mirrors_sql() -> str:
    side = lambda c: f"{c}s AS (SELECT folder, string_agg(concat(path, ' ', sha256({c})), '|' ORDER BY path) AS h FROM file WHERE {c} IS NOT NULL GROUP BY folder)"
    return dialect.oracle(lambda d: f"""{versions(d)}, {side('source')}, {side('target')}, {side('mirrored')},
a AS (SELECT f.folder, sources.h AS s, targets.h AS t, mirroreds.h AS m FROM (SELECT DISTINCT folder FROM file) f LEFT JOIN sources ON sources.folder = f.folder LEFT JOIN targets ON targets.folder = f.folder LEFT JOIN mirroreds ON mirroreds.folder = f.folder)
SELECT folder, CASE WHEN t IS NULL THEN 'missing' WHEN t = s THEN 'synced' WHEN m IS NULL THEN 'unmanaged target exists' WHEN m IS DISTINCT FROM s AND m <> t THEN 'source updated + target drifted' WHEN m IS DISTINCT FROM s THEN 'source updated' WHEN m <> t THEN 'target drifted' ELSE 'synced' END AS state
FROM a WHERE s IS NOT NULL OR t IS NOT NULL OR m IS NOT NULL""")


def hosts(d) -> str:
    """CTE ``skill``: a host as a skill, described by the title of its first page, with the titles of all of them."""
    title = dialect.found(d, "html", "<title>([^<]*)")
    return f"""WITH pt AS (SELECT page_id, {dialect.found(d, 'url', '//([^/?#]*)')} AS host, {trimmed(d, title)} AS title FROM <pages>),
skill AS (SELECT host, {d.listed('title', 'page_id')} AS titles, min_by(title, page_id) AS about FROM pt GROUP BY host)"""


def q_scan(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills written as files and found by a scan."""
    rows = run(spark, sf_dir, lambda d: f"{hosts(d)} SELECT * FROM skill")
    root = new_dir(spark)
    text = F.concat(F.lit("---\nname: "), "host", F.lit('\ndescription: "'), "about", F.lit('"\n---\n'), "titles")
    artifacts.write(rows.select(F.concat(F.lit(".claude/skills/"), "host", F.lit("/SKILL.md")).alias("path"), text.alias("content"), F.lit("skill").alias("kind")), root)
    found = scan.skills(scan.scan(spark, [root]))
    return found.select("id", "name", "description", "source_kind", F.size("warnings").cast("long").alias("warnings"))


def _scan_sql() -> str:
    return dialect.oracle(lambda d: f"""{hosts(d)} SELECT concat('project:', regexp_replace(lower(host), '[^a-z0-9_-]+', '-', 'g')) AS id, host AS name, about AS description, 'project' AS source_kind, CAST(CASE WHEN strlen(about) < {scan.SHORT} THEN 1 ELSE 0 END AS BIGINT) AS warnings FROM skill""")


QUERIES = {"skill_scan": q_scan, "artifact_build": q_build, "mirror_states": q_mirrors}

ORACLE = {"skill_scan": _scan_sql(), "artifact_build": _build_sql(), "mirror_states": _mirrors_sql()}
