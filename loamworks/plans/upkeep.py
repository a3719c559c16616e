"""Registries, skills, locks, migrations and insights as queries."""

from __future__ import annotations

from ..functions import markers as M
from ..functions.rules import Rules
from .builds import cards
from .corpus import corpus
from .dialect import found, json_text
from .lifecycle import N
from .generate import candidates
from .mining import _cards, slug, trimmed


def q_frontmatter(d):
    """Name and description between the marks in front of a skill's text, and what is wrong with it."""
    about = found(d, "html", "<title>([^<]*)")
    text = f"concat('---', chr(10), CASE WHEN page_id % 4 = 0 THEN '' ELSE concat('name: ', substr(url, 9), chr(10)) END, CASE WHEN page_id % 6 = 0 THEN '' ELSE concat('description: \"', {about}, '\"', chr(10)) END, '---', chr(10), html)"
    name = trimmed(d, found(d, "head", "(?:^|\n)name:([^\n]*)"))
    about = d.replaced(trimmed(d, found(d, "head", "(?:^|\n)description:([^\n]*)")), "^\"|\"$")
    return f"""WITH s AS (SELECT page_id, {text} AS text FROM <pages>), h AS (SELECT page_id, text, {found(d, 'text', '^---\n((?:[^\n]*\n)*?)---')} AS head FROM s),
f AS (SELECT page_id, {name} AS name, {about} AS description, length(text) AS chars FROM h)
SELECT page_id, name, description, concat(CASE WHEN name = '' THEN 'no-name ' ELSE '' END, CASE WHEN description = '' THEN 'no-description ' ELSE '' END, CASE WHEN chars < 40 THEN 'short ' ELSE '' END) AS warnings FROM f"""


def q_hooks(d):
    """Hook events and matchers out of tags."""
    tags = "concat('hook:event:', event_type, ' hook:matcher:', CAST(user_id AS VARCHAR(20)), CASE WHEN event_id % 3 = 0 THEN '' ELSE ' plain' END)"
    return f"WITH t AS (SELECT event_id, {tags} AS tags FROM <events>) SELECT {found(d, 'tags', 'hook:event:([a-z]+)')} AS hook_event, {found(d, 'tags', 'hook:matcher:([0-9]+)')} AS matcher, count(*) AS n FROM t GROUP BY 1, 2"


def q_recurrence_match(d):
    """The first known signal of equal tokens, or that shares at least half of them."""
    return f"{_cards(d)} SELECT id, min(card_id) AS signal, CAST(max(CASE WHEN similarity = 1 THEN 1 ELSE 0 END) AS BIGINT) AS exact FROM sim WHERE similarity >= 0.5e0 GROUP BY id"


def q_discovery(d):
    """Projects out of JSON members of log lines: where they were seen and by what."""
    return f"SELECT {json_text(d, 'props', '$.k')} AS project, count(*) AS n, count(DISTINCT event_type) AS markers, min(event_id) AS first_event FROM <events> WHERE {json_text(d, 'props', '$.k')} IS NOT NULL GROUP BY 1"


def q_registry(d):
    """Registered and discovered projects; of equal paths the last entry wins."""
    return """WITH r AS (SELECT source AS path, doc_id AS seq, 'registered' AS origin FROM <documents> UNION ALL SELECT concat('src', CAST(user_id % 40 AS VARCHAR(20))), 1000000 + event_id, 'discovered' FROM <events>)
SELECT path, seq, origin FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS rk FROM r) x WHERE rk = 1"""


def q_consecutive(d):
    """Lines without those that repeat the line before."""
    pos = f"SELECT doc_id, posexplode({d.pieces('text', chr(10))}) AS (place, line) FROM <documents>" if d.__name__ == "Spark" else f"SELECT doc_id, unnest(range(len({d.pieces('text', chr(10))}))) AS place, unnest({d.pieces('text', chr(10))}) AS line FROM <documents>"
    return f"WITH l AS ({pos}), t AS (SELECT doc_id, place, trim(line) AS line FROM l WHERE trim(line) <> ''), b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM t) SELECT doc_id, count(*) AS kept, {d.sha(d.listed('line', 'place'))} AS lines_sha256 FROM b WHERE before IS NULL OR before <> line GROUP BY doc_id"


def q_locks(d):
    """Whether an artifact may be written: nothing is there, or what is there is what was last written."""
    return f"""WITH lock AS (SELECT doc_id AS path, {d.sha('text')} AS h FROM <documents> WHERE doc_id % 4 <> 0), disk AS (SELECT doc_id AS path, {d.sha("CASE WHEN doc_id % 9 = 0 THEN concat(text, '!') ELSE text END")} AS h FROM <documents> WHERE doc_id % 7 <> 0)
SELECT w.doc_id AS path, disk.path IS NULL OR coalesce(disk.h = lock.h, FALSE) AS safe, {d.sha('w.text')} AS new_hash FROM <documents> w LEFT JOIN lock ON lock.path = w.doc_id LEFT JOIN disk ON disk.path = w.doc_id"""


def q_migrations(d):
    """Records of older versions: the version is put in, old kinds get their new names."""
    return "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE 1 + event_id % 2 END, 1) AS schema_version, CASE event_type WHEN 'view' THEN 'preference' WHEN 'click' THEN 'workflow' ELSE event_type END AS kind, event_id % 3 = 0 AS migrated FROM <events>"


def q_usable(d):
    """Items that are usable: no noise, sure enough, not empty, not too long."""
    r = Rules(d)
    return f"{candidates(d)} SELECT id, {d.bytes_of}(body) <= 320 AND confidence >= CAST(0.78 AS FLOAT) AS agent_usable, NOT {r.any(M.NOISE)} AND confidence >= CAST(0.7 AS FLOAT) AND {d.bytes_of}(body) BETWEEN 1 AND 400 AS llm_usable FROM cand"


def q_routes(d):
    """Action and route by the nearest card, and the operation they come to."""
    return f"""{_cards(d)}, best AS (SELECT id, max(similarity) AS s FROM sim GROUP BY id), a AS (SELECT item.id, coalesce(s, 0e0) AS s, CASE WHEN s >= 0.95e0 THEN 'noop' WHEN s > 0.75e0 THEN 'merge_into_existing' WHEN s >= 0.5e0 THEN 'supersede' ELSE 'add' END AS action FROM item LEFT JOIN best ON best.id = item.id)
SELECT id, action, CASE action WHEN 'merge_into_existing' THEN 'update' ELSE action END AS operation, CASE WHEN action IN ('noop', 'supersede') THEN 'review_only' ELSE 'always_on_rule' END AS route, action = 'add' AS compile_enabled FROM a"""


def q_insight(d):
    """How sure and stable a card is, whether it is in use, in how many ways it is disputed, and whether all projects should have it: by
    the agents that it is for and the drafts of its conversation."""
    return f"""{cards(d)},
ag AS (SELECT project, id, count(*) AS agents FROM named WHERE route <> 'none' GROUP BY project, id),
dr AS (SELECT CAST(conv_id AS VARCHAR(20)) AS project, sum(CASE WHEN how = 'rule' THEN 1 ELSE 0 END) AS drafts FROM cand GROUP BY conv_id),
ev0 AS (SELECT c.project, c.cid AS id, c.kind, c.scope, coalesce(ag.agents, 0) AS agents, dr.drafts FROM cards1 c LEFT JOIN ag ON ag.project = c.project AND ag.id = c.cid JOIN dr ON dr.project = c.project WHERE c.copy = 1),
ev1 AS (SELECT *, round(least(0.95e0, 0.48e0 + 0.07e0 * drafts + 0.08e0 * agents), 2) AS confidence,
  round(least(0.98e0, 0.42e0 + CASE scope WHEN 'global' THEN 0.22e0 WHEN 'project' THEN 0.14e0 ELSE 0.04e0 END + 0.06e0 * agents), 2) AS stability FROM ev0)
SELECT project, id, CAST(agents AS BIGINT) AS agents, CAST(drafts AS BIGINT) AS drafts, confidence, stability, CASE WHEN drafts > 0 OR agents >= 2 THEN 'active' ELSE 'dormant' END AS activity,
  CAST(CASE WHEN agents >= 2 AND scope = 'project' THEN 1 ELSE 0 END + CASE WHEN kind = 'constraint' AND agents <= 1 THEN 1 ELSE 0 END + CASE WHEN kind = 'procedure' AND scope = 'agent' THEN 1 ELSE 0 END AS BIGINT) AS conflicts,
  scope = 'project' AND agents >= 2 AND confidence > 0.6e0 AS promote FROM ev1"""


def q_briefs(d):
    """Short forms: Chinese texts up to 120 signs, others up to 120 bytes."""
    zh = d.matches("text", "[一-鿿]")
    return f"{corpus(d)} SELECT id, CASE WHEN {zh} THEN substr(text, 1, 120) WHEN {d.bytes_of}(text) <= 120 THEN text ELSE concat(substr({d.replaced('text', '[^ -~]', '?')}, 1, 117), '...') END AS brief, {slug(d, 'substr(text, 1, 30)')} AS slug FROM chunk"


QUERIES = {
    "frontmatter_parse": q_frontmatter,
    "hooks_compile": q_hooks,
    "recurrence_match": q_recurrence_match,
    "project_discovery": q_discovery,
    "registry_dedupe": q_registry,
    "consecutive_dedupe": q_consecutive,
    "lock_safe_writes": q_locks,
    "record_migrations": q_migrations,
    "usable_items": q_usable,
    "action_routes": q_routes,
    "evolution_insight": q_insight,
    "record_briefs": q_briefs,
}
