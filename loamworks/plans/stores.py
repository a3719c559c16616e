"""Stores of records: hashes of folders, registries and catalogs with what is wrong in them, configuration, drifts, filled-in defaults.

Tables hold no such records: pages stand for preferences and skills, documents for packages and files, events for changes of the
configuration, each over all rows.
"""

from __future__ import annotations

from ..functions import markers as M
from ..functions.rules import quoted
from .lifecycle import inferred_tags, values
from .mining import trimmed
from .ranking import matched

AGENTS = ("click", "error", "view")


def q_folder_hashes(d):
    """Hash of a folder: its files in order of their paths, path and content with a zero sign between; lock files are left out.
    A folder holds the 16 documents that follow each other by id."""
    return f"""WITH f AS (SELECT CAST(floor(doc_id / 16e0) AS BIGINT) AS folder, concat(CASE WHEN doc_id % 3 = 0 THEN 'a/' ELSE '' END, CAST(doc_id AS VARCHAR(20)), '.md') AS path, CASE WHEN doc_id % 13 = 0 THEN 'lock.yml' ELSE 'file' END AS name, coalesce(text, '') AS text FROM <documents>)
SELECT folder, count(*) AS n, concat('sha256:', {d.sha(d.listed('concat(path, chr(0), text)', 'path', ''))}) AS hash FROM f WHERE name <> 'lock.yml' GROUP BY folder"""


def _preferences() -> str:
    """CTE ``pref``: preferences as a project writes them down; pages give bodies, ids all else."""
    return """WITH pref AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '  ' WHEN page_id % 2 = 0 THEN concat('USE ', CAST(page_id % 200 AS VARCHAR(20))) ELSE concat('Use ', CAST(page_id % 150 AS VARCHAR(20))) END AS title,
  CASE WHEN page_id % 10 = 0 THEN ' ' ELSE coalesce(html, '') END AS body, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'Axios' END AS required, CASE WHEN page_id % 7 = 0 THEN '' ELSE 'HTTP,Request' END AS context FROM <pages>)"""


def q_preference_registry(d):
    """Known preferences: those of the project with a title and a body, markers in lower case, then the built-in ones."""
    built_in = [(i, t, ",".join(need), ",".join(ctx)) for i, (t, need, ctx) in enumerate(M.PREFERENCES)]
    return f"""{_preferences()}, {values('own', 'place, title, required, context', built_in)}
SELECT 1 AS priority, page_id AS place, 'project' AS source, title, lower(required) AS required, lower(context) AS context FROM pref WHERE {trimmed(d, 'title')} <> '' AND {trimmed(d, 'body')} <> ''
UNION ALL SELECT 2, place, 'built-in', title, required, context FROM own"""


def _messages(d) -> str:
    """CTE ``msg``: what is wrong with preferences. Of equal titles, whatever their case, the first is right."""
    number = "CAST(p.page_id AS VARCHAR(20))"
    bare = trimmed(d, "p.title")
    named = lambda level, rest: f"concat('{level}: preference #', {number}, {rest})"
    cases = (
        f"CASE WHEN {bare} = '' THEN {named('error', quoted(' has an empty title'))} WHEN p.page_id <> o.page_id THEN {named('error', f'{quoted(" has duplicate title `")}, {bare}, {quoted("`")}')} END",
        f"CASE WHEN {trimmed(d, 'p.body')} = '' THEN {named('error', quoted(' has an empty body'))} END",
        f"CASE WHEN p.required = '' THEN {named('error', quoted(' has no required markers'))} END",
        f"CASE WHEN p.context = '' THEN {named('warning', quoted(' has no context markers and may match too broadly'))} END",
    )
    return f"""{_preferences()}, o AS (SELECT lower({trimmed(d, 'title')}) AS t, min(page_id) AS page_id FROM pref GROUP BY 1),
msg0 AS (SELECT p.page_id, {d.explode}({d.kept(d.array(*cases), 'e IS NOT NULL')}) AS message FROM pref p JOIN o ON o.t = lower({bare})),
msg AS (SELECT page_id, message, CASE WHEN substr(message, 1, 5) = 'error' THEN 'error' ELSE 'warning' END AS level FROM msg0)"""


def q_preference_messages(d):
    return f"{_messages(d)} SELECT page_id, level, message FROM msg"


def q_preference_report(d):
    return f"{_messages(d)} SELECT CAST(sum(CASE WHEN level = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN level = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS warnings FROM msg"


def q_catalog_report(d):
    """Packages of a catalog by what they lack; of each id all but the first are duplicates. Documents stand for packages."""
    cases = (
        ("error", "duplicate-id", "p.doc_id <> o.doc_id"),
        ("error", "missing-version", f"{trimmed(d, 'p.version')} = ''"),
        ("error", "missing-source", f"{trimmed(d, 'p.source_url')} = ''"),
        ("error", "empty-body", f"{trimmed(d, 'p.body')} = ''"),
        ("warning", "missing-tags", "p.tags = ''"),
    )
    named = d.array(*[f"CASE WHEN {test} THEN '{level}:{code}' END" for level, code, test in cases])
    return f"""WITH p AS (SELECT doc_id, concat(coalesce(source, ''), ':', CAST(doc_id % 900 AS VARCHAR(20))) AS id, CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE '1.0' END AS version, CASE WHEN doc_id % 8 = 0 THEN '' ELSE concat('https://', source) END AS source_url, CASE WHEN doc_id % 12 = 0 THEN '' ELSE coalesce(text, '') END AS body, CASE WHEN doc_id % 10 = 0 THEN '' ELSE lang END AS tags FROM <documents>),
o AS (SELECT id, min(doc_id) AS doc_id FROM p GROUP BY id),
r AS (SELECT {d.explode}({d.kept(named, 'e IS NOT NULL')}) AS found FROM p JOIN o ON o.id = p.id)
SELECT substr(found, 1, instr(found, ':') - 1) AS level, substr(found, instr(found, ':') + 1) AS code, count(*) AS n FROM r GROUP BY found"""


def q_agent_switches(d):
    """Whether agents are enabled: the last switch decides, and what is not configured cannot be switched."""
    known = ", ".join(quoted(a) for a in AGENTS)
    return f"SELECT event_type AS agent, event_type IN ({known}) AS configured, CASE WHEN event_type IN ({known}) THEN max_by(event_id % 3 <> 0, event_id) END AS enabled, count(*) AS switches FROM <events> GROUP BY event_type"


def q_mirror_targets(d):
    """Skills with the sorted agents they are mirrored to: skills that there are, agents that are configured, each once."""
    known = ", ".join(quoted(a) for a in AGENTS)
    return f"""WITH m AS (SELECT DISTINCT user_id AS skill, event_type AS agent FROM <events> WHERE event_type IN ({known})),
s AS (SELECT m.skill, m.agent FROM m WHERE EXISTS (SELECT 1 FROM <pages> p WHERE p.page_id = m.skill))
SELECT skill, replace({d.listed('agent', 'agent')}, chr(10), ',') AS targets FROM s GROUP BY skill"""


def lines(d, x: str) -> str:
    """Lines of a text; a line feed at its end opens no further one."""
    return d.pieces(d.replaced(x, "\r?\n\\z"), "\r?\n")


def q_drift_drafts(d):
    """Drafts out of artifacts that were changed by hand: the lines that the expected text has not (every copy counts), in order, or
    the whole text if there are none. Missing, equal and blank artifacts give none."""
    found = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 3 = 0 THEN concat('own note ', CAST(doc_id % 10 AS VARCHAR(20)), chr(10), wanted, chr(10), 'own end', chr(10)) WHEN doc_id % 11 = 0 THEN concat(split_part(wanted, chr(10), 1), chr(13), chr(10)) ELSE wanted END"
    path, body = "concat('/', coalesce(source, ''), '/', CAST(doc_id AS VARCHAR(20)), '.md')", f"CASE WHEN coalesce(added, '') = '' THEN {trimmed(d, 'found')} ELSE added END"
    return f"""WITH w0 AS (SELECT doc_id, source, coalesce(text, '') AS wanted FROM <documents>), w AS (SELECT doc_id, source, wanted, {found} AS found FROM w0),
g AS (SELECT * FROM w WHERE found <> wanted),
want AS (SELECT doc_id, {d.explode}({lines(d, 'wanted')}) AS line FROM g), wn AS (SELECT doc_id, line, count(*) AS n FROM want GROUP BY doc_id, line),
have AS (SELECT doc_id, {d.placed(lines(d, 'found'))} FROM g), hn AS (SELECT doc_id, place, e AS line, row_number() OVER (PARTITION BY doc_id, e ORDER BY place) AS nth FROM have),
ad AS (SELECT hn.doc_id, {trimmed(d, d.listed('hn.line', 'hn.place'))} AS added FROM hn LEFT JOIN wn ON wn.doc_id = hn.doc_id AND wn.line = hn.line WHERE nth > coalesce(n, 0) GROUP BY hn.doc_id),
b AS (SELECT w.doc_id, {path} AS path, CASE WHEN w.doc_id % 2 = 0 THEN 'codex' ELSE 'claude' END AS agent, found, found = wanted AS same, {body} AS body FROM (SELECT w.*, ad.added FROM w LEFT JOIN ad ON ad.doc_id = w.doc_id) w),
r AS (SELECT *, CASE WHEN found IS NULL THEN 'missing' WHEN same THEN 'synced' WHEN body = '' THEN 'blank' ELSE 'created' END AS outcome FROM b)
SELECT doc_id, outcome, CASE WHEN outcome = 'created' THEN concat('artifact:', agent, ':', substr(concat('sha256:', {d.sha("concat(path, ':', body)")}), 1, 12)) END AS draft_id, CASE WHEN outcome = 'created' THEN {d.sha('body')} END AS body_sha256 FROM r"""


def q_candidate_defaults(d):
    """Records of candidates as they are loaded: what they lack is filled in. One with a brief and tags of its own keeps all else as it
    is, even without a language; any other operation than the default stays."""
    low = "lower(concat(title, chr(10), body, chr(10), kind, chr(10), coalesce(template, ''), chr(10), reason))"
    return f"""{matched(d)},
near AS (SELECT id, min(card_id) AS card_id FROM sim WHERE similarity > 0.75e0 GROUP BY id),
cd0 AS (SELECT cand.id, title, body, {low} AS low, near.card_id, CASE WHEN cand.id % 7 = 0 THEN 'delete' ELSE 'add' END AS operation, CASE WHEN cand.id % 4 = 0 THEN -1 END AS duplicate_of, cand.id % 3 = 0 AS has_brief, CASE WHEN cand.id % 2 = 0 THEN 'own' ELSE '' END AS tags, CASE WHEN cand.id % 5 = 0 THEN 'fr' ELSE '' END AS language FROM cand LEFT JOIN near ON near.id = cand.id),
cd AS (SELECT *, {inferred_tags(d, 'low')} AS more FROM cd0)
SELECT id, CASE WHEN operation = 'add' AND card_id IS NOT NULL THEN 'update' ELSE operation END AS operation, coalesce(duplicate_of, card_id) AS duplicate_of, CASE WHEN tags <> '' THEN tags ELSE more END AS tags,
  CASE WHEN language <> '' OR (has_brief AND tags <> '') THEN language WHEN {d.matches('concat(title, body)', '[一-鿿]')} THEN 'zh' ELSE 'en' END AS language FROM cd"""


QUERIES = {
    "folder_hashes": q_folder_hashes,
    "preference_registry": q_preference_registry,
    "preference_messages": q_preference_messages,
    "preference_report": q_preference_report,
    "catalog_report": q_catalog_report,
    "agent_switches": q_agent_switches,
    "mirror_targets": q_mirror_targets,
    "drift_drafts": q_drift_drafts,
    "candidate_defaults": q_candidate_defaults,
}
