"""Cards and drafts: names, validity, tags, where they compile to, merging and fusing; jobs, mirrors and sessions.

Tables hold no cards: candidates stand for them, and events and pages for the records around them, each over all rows.
"""

from __future__ import annotations

from ..functions import markers as M
from ..functions.rules import Rules, quoted
from .dialect import json_text
from .generate import candidate_id, candidates
from .material import head_bytes
from .mining import trimmed


def one_of(x: str, words) -> str:
    return f"{x} IN ({', '.join(quoted(w) for w in words)})"


def kebab(d, x: str) -> str:
    """Lower-case letters and digits of ASCII, dashes between; 64 signs at most."""
    dashed = d.replaced(d.replaced(f"lower({x})", "[^a-z0-9]+", "-"), "^-")
    return d.replaced(f"substr({dashed}, 1, 64)", "-$")


def file_stem(d, x: str) -> str:
    """A name for a file: a short hash where the text has too little of ASCII."""
    k = kebab(d, x)
    return f"CASE WHEN {k} = '' OR ({d.bytes_of}({x}) <> length({x}) AND length({k}) <= 16) THEN concat('memory-card-', substr({d.sha(x)}, 1, 12)) ELSE {k} END"


def q_names(d):
    """Names of skills and files of cards, and whether a name is a valid one."""
    good = f"(length(skill_name) BETWEEN 1 AND 64 AND {d.matches('skill_name', '^[a-z0-9]+(-[a-z0-9]+)*$')})"
    return f"""{candidates(d)}, nm0 AS (SELECT id, title, {candidate_id(d)} AS cid FROM cand),
nm AS (SELECT id, {file_stem(d, 'cid')} AS stem, CASE WHEN {kebab(d, 'title')} = '' THEN {file_stem(d, 'cid')} ELSE {kebab(d, 'title')} END AS skill_name FROM nm0)
SELECT id, stem, skill_name, {good} AS valid FROM nm"""


def card_error(d, x: str, longest: int, drive: bool) -> str:
    """What is wrong with an id, or an empty text."""
    named = f" WHEN {d.matches(x, '^[A-Za-z]:')} THEN 'drive'" if drive else ""
    return f"CASE WHEN {trimmed(d, x)} = '' THEN 'empty' WHEN {d.bytes_of}({x}) > {longest} THEN 'long' WHEN contains({x}, '..') THEN 'dots' WHEN contains({x}, '/') OR contains({x}, {d.text(chr(92))}) THEN 'separator'{named} ELSE '' END"


def q_validity(d):
    """Ids and fields of cards and drafts, checked; pages give ids of all sorts, events kinds and scopes."""
    made = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN replace(url, '/', '-') WHEN 2 THEN concat('..', replace(url, '/', '')) WHEN 3 THEN concat('C:', replace(url, '/', '')) WHEN 4 THEN concat(replace(url, '/', ''), repeat('x', 120)) ELSE ' ' END"
    kind = f"CASE page_id % 7 {' '.join(f'WHEN {i} THEN {quoted(k)}' for i, k in enumerate(('rule', 'memory-card', 'memory_card', 'template', 'note', 'workflow')))} ELSE 'procedure' END"
    scope = "CASE page_id % 4 WHEN 0 THEN 'project' WHEN 1 THEN 'directory' WHEN 2 THEN 'world' ELSE 'agent-specific' END"
    return f"""WITH v AS (SELECT page_id, {made} AS cid, {kind} AS kind, {scope} AS scope FROM <pages>)
SELECT page_id, {card_error(d, 'cid', 128, True)} AS card_error, {card_error(d, trimmed(d, 'cid'), 160, False)} AS draft_error, {one_of('kind', M.CARD_KINDS)} AS card_kind_ok, {one_of('kind', M.DRAFT_KINDS)} AS draft_kind_ok, {one_of('scope', M.CARD_SCOPES)} AS scope_ok,
  CASE WHEN {one_of('kind', M.APPROVABLE_KINDS)} THEN kind ELSE 'procedure' END AS approvable, CASE WHEN {one_of('kind', M.AGENT_KINDS)} THEN kind ELSE 'procedure' END AS agent_kind, CASE WHEN {one_of('scope', ('global', 'project', 'agent'))} THEN scope ELSE 'project' END AS agent_scope FROM v"""


def activation(x: str = "kind") -> str:
    return f"CASE WHEN {one_of(x, ('preference', 'constraint'))} THEN 'always-on' WHEN {one_of(x, ('procedure', 'template', 'workflow'))} THEN 'skill' ELSE 'model-decision' END"


def q_card_tags(d):
    """Tags of cards by words of title, body and kind (the kind itself if there are none), and how a card of its kind is activated."""
    r = Rules(d, "low")
    tags = d.kept(d.array(*[f"CASE WHEN {r.any(w)} THEN '{t}' END" for t, w in M.CARD_TAGS]), "e IS NOT NULL")
    return f"""{candidates(d)}, ct0 AS (SELECT id, kind, lower(concat(title, chr(10), body, chr(10), kind)) AS low FROM cand), ct AS (SELECT id, kind, {tags} AS tags FROM ct0)
SELECT id, CASE WHEN {d.size}(tags) = 0 THEN kind ELSE {d.join}({d.sort}(tags), ' ') END AS tags, {activation()} AS activation FROM ct"""


def q_compile(d):
    """Where cards are written to: the instructions that are always read, a skill of its own, or nowhere."""
    return f"""{candidates(d)}, to0 AS (SELECT id, kind, artifact_kind AS route, CASE WHEN id % 5 = 0 THEN 'model-decision' WHEN id % 5 = 1 THEN 'manual' ELSE {activation()} END AS activation FROM cand),
to1 AS (SELECT *, activation = 'skill' OR (activation IN ('model-decision', 'always-on') AND (kind IN ('procedure', 'template', 'workflow') OR route = 'workflow_skill')) AS to_skill FROM to0)
SELECT id, activation, to_skill, NOT to_skill AND (activation = 'always-on' OR (activation = 'model-decision' AND route = 'always_on_rule')) AS to_instructions FROM to1"""


def _drafts(d) -> str:
    """CTE ``draft``: candidates of one text stand for the drafts that a user merges, so a merge is never larger than its text."""
    return f"{candidates(d)}, draft AS (SELECT conv_id * 1000 + turn AS merge_id, id, title, body, confidence, {candidate_id(d)} AS cid FROM cand)"


def q_merge(d):
    """Merged drafts: bodies under titles, the least confidence (none counts as zero), and whether the new id is one of the merged,
    which deletes the result with its sources. Two sources or more are needed."""
    part = f"concat('## ', title, {d.text(chr(10) * 2)}, body)"
    new = "CASE WHEN merge_id % 3 = 0 THEN min(cid) ELSE concat('merged:', CAST(merge_id AS VARCHAR(20))) END"
    return f"""{_drafts(d)}, md AS (SELECT merge_id, count(*) AS n, {d.listed(part + ' || ' + d.text(chr(10)), 'id')} AS body, round(CAST(min(CASE WHEN id % 11 = 0 THEN CAST(0 AS FLOAT) ELSE confidence END) AS DOUBLE), 4) AS confidence, {new} AS new_id, min(cid) AS least FROM draft GROUP BY merge_id HAVING count(*) >= 2)
SELECT merge_id, new_id, n, confidence, {d.sha(trimmed(d, 'body'))} AS body_sha256, concat('Merged ', CAST(n AS VARCHAR(20)), ' drafts into one review candidate.') AS reason, new_id = least AS lost FROM md"""


def q_fuse(d):
    """Cards fused into one draft by the fixed wording; bodies without their full stops, empty ones left out."""
    bare = d.replaced(trimmed(d, "body"), "[.。]+$")
    head, mid, tail = (d.text(t) for t in M.FUSED_BODY)
    low = "lower(body)"
    return f"""{_drafts(d)}, fc0 AS (SELECT merge_id, id, title, {bare} AS body FROM draft),
fc1 AS (SELECT merge_id, min(title) AS title, replace({d.listed('body', 'id')}, chr(10), '；') AS bodies FROM fc0 WHERE body <> '' GROUP BY merge_id HAVING count(*) >= 2),
fc AS (SELECT merge_id, concat({head}, {trimmed(d, 'title')}, {mid}, bodies, {tail}) AS body FROM fc1)
SELECT merge_id, body, (length(body) BETWEEN 24 AND 1000 AND NOT contains({low}, 'source memory_card') AND NOT contains({low}, '源 memory_card')) AS valid FROM fc"""


def q_refs(d):
    """References to cards: the first of each id stays."""
    return "SELECT user_id AS card_id, min(event_id) AS first_ref, count(*) AS n FROM <events> GROUP BY user_id"


def q_global_ids(d):
    """Ids that cards get when they are made global; 128 bytes at most."""
    rest = "CASE WHEN contains(cid, ':') AND trim(substr(cid, instr(cid, ':') + 1)) <> '' THEN substr(cid, instr(cid, ':') + 1) ELSE trim(title) END"
    return f"{candidates(d)}, gi0 AS (SELECT id, title, {candidate_id(d)} AS cid FROM cand), gi AS (SELECT id, CASE WHEN substr(cid, 1, 7) = 'global:' THEN cid ELSE concat('global:', trim({rest})) END AS made FROM gi0) SELECT id, {head_bytes(d, 'made', 128)} AS global_id FROM gi"


def q_mirrors(d):
    """Skills mirrored to agents: what is done, or why not. Pages stand for skills, events for the mirrors that are asked for."""
    return """WITH skill AS (SELECT page_id AS skill FROM <pages> WHERE page_id % 8 <> 0),
agent AS (SELECT * FROM (VALUES ('click', TRUE, 'a/skills'), ('error', FALSE, 'b/skills'), ('signup', TRUE, NULL), ('view', TRUE, 'd/skills')) AS v(agent, enabled, folder)),
m AS (SELECT event_id, user_id AS skill, event_type AS target FROM <events>)
SELECT event_id, CASE WHEN skill.skill IS NULL THEN 'mirror references unknown skill' WHEN agent.agent IS NULL THEN 'mirror target is not configured' WHEN NOT enabled THEN 'mirror target is disabled' WHEN folder IS NULL THEN 'mirror target does not have a skills_dir export'
  ELSE concat('mirror -> ', folder, '/', CAST(m.skill AS VARCHAR(20))) END AS outcome FROM m LEFT JOIN skill ON skill.skill = m.skill LEFT JOIN agent ON agent.agent = m.target"""


def q_jobs_state(d):
    """Life of jobs out of their steps (view: begin, click: step, error: request to cancel, others: finish, which fails below a value
    of 20). The last step decides; a job that finishes after a request since its last beginning is cancelled."""
    return """WITH j AS (SELECT user_id AS job, event_id, event_type, value FROM <events>),
g AS (SELECT job, max(CASE WHEN event_type = 'view' THEN event_id END) AS begun, max(CASE WHEN event_type = 'error' THEN event_id END) AS asked, max_by(event_type, event_id) AS last_step, max_by(value, event_id) AS last_value, count(*) AS steps FROM j GROUP BY job),
c AS (SELECT *, asked IS NOT NULL AND asked > coalesce(begun, -1) AS cancel_requested FROM g)
SELECT job, steps, cancel_requested, CASE WHEN last_step IN ('view', 'click') THEN 'running' WHEN last_step = 'error' THEN 'cancelling' WHEN cancel_requested THEN 'cancelled' WHEN last_value < 20 THEN 'failed' ELSE 'completed' END AS lifecycle, last_step IN ('view', 'click', 'error') AS running FROM c"""


def q_project_dirs(d):
    """Paths that names of folders stand for: a dash for each separator, so dashes of the path itself are lost."""
    name = "CASE WHEN page_id % 5 = 0 THEN '--' ELSE concat(CASE WHEN page_id % 3 = 0 THEN '' ELSE '-' END, replace(replace(substr(url, 9), '/', '-'), '.', '--')) END"
    bare = d.replaced(d.replaced("name", "-+", "/"), "^/|/$")
    return f"WITH n AS (SELECT page_id, {name} AS name FROM <pages>), b AS (SELECT page_id, name, {bare} AS bare FROM n) SELECT page_id, CASE WHEN bare = '' THEN NULL WHEN substr(name, 1, 1) = '-' THEN concat('/', bare) ELSE bare END AS path FROM b"


def q_sessions(d):
    """Session ids out of the three shapes of an index: a member ``sessions``, a map of objects, a list of objects."""
    a, b = "concat('\"s', CAST(event_id AS VARCHAR(20)), '\"')", "concat('\"t', CAST(user_id AS VARCHAR(20)), '\"')"
    made = f"""CASE event_id % 5 WHEN 0 THEN concat('{{"sessions":{{', {a}, ':{{}},', {b}, ':{{}}}}}}') WHEN 1 THEN concat('{{', {a}, ':{{"n":1}},', {b}, ':{{}}}}') WHEN 2 THEN concat('[{{"sessionId":', {a}, '}},{{"session_id":', {b}, '}},{{"n":1}}]') WHEN 3 THEN concat('{{', {a}, ':1,', {b}, ':{{}}}}') ELSE '3' END"""
    if d.__name__ == "Spark":
        inner = "get_json_object(j, '$.sessions')"
        flat = "forall(map_values(from_json(j, 'map<string,string>')), v -> substr(v, 1, 1) = '{')"
        ids = f"""CASE WHEN substr(j, 1, 1) = '[' THEN filter(transform(from_json(j, 'array<struct<sessionId:string,session_id:string>>'), e -> coalesce(e.sessionId, e.session_id)), e -> e IS NOT NULL)
  WHEN substr({inner}, 1, 1) = '{{' THEN json_object_keys({inner}) WHEN substr(j, 1, 1) = '{{' AND {flat} THEN json_object_keys(j) END"""
    else:
        ids = """CASE json_type(j) WHEN 'ARRAY' THEN list_filter(list_transform(json_extract(j, '$[*]'), lambda e: coalesce(e ->> 'sessionId', e ->> 'session_id')), lambda e: e IS NOT NULL)
  WHEN 'OBJECT' THEN CASE WHEN json_type(j, '$.sessions') = 'OBJECT' THEN json_keys(j, '$.sessions') WHEN len(list_filter(json_keys(j), lambda k: json_type(j, '$."' || k || '"') <> 'OBJECT')) = 0 THEN json_keys(j) END END"""
    return f"WITH s AS (SELECT event_id, {made} AS j FROM <events>), k AS (SELECT event_id, {d.explode}({ids}) AS session_id FROM s) SELECT event_id, session_id FROM k"


def q_review(d):
    """What a review finds: drafts that wait, tests that fail, artifacts that have drifted; one row."""
    k = json_text(d, "props", "$.k")
    return f"""{candidates(d)} SELECT (SELECT count(*) FROM cand WHERE confidence < CAST(0.9 AS FLOAT)) AS drafts_pending, (SELECT count(*) FROM <events> WHERE event_type = 'error') AS rule_tests_failed, (SELECT count(*) FROM <events> WHERE CAST({k} AS BIGINT) % 9 = 0 AND event_type <> 'error') AS artifact_drifts"""


QUERIES = {
    "skill_names": q_names,
    "record_validity": q_validity,
    "card_tags": q_card_tags,
    "compile_targets": q_compile,
    "merge_drafts": q_merge,
    "fuse_cards": q_fuse,
    "refs_dedupe": q_refs,
    "global_card_ids": q_global_ids,
    "mirror_plan": q_mirrors,
    "job_lifecycle": q_jobs_state,
    "project_dirs": q_project_dirs,
    "session_ids": q_sessions,
    "review_summary": q_review,
}
