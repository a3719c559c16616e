"""What other minds say about candidates: an agent's candidates through the local gate, judges, update decisions, given scores.

No model is called. Events stand for what a model answers: each event is one judgment or decision, and all of them are read.
"""

from __future__ import annotations

from ..functions import markers as M
from ..functions.rules import any_of, quoted
from .corpus import corpus
from .generate import candidates, title
from .dialect import found
from .lifecycle import selection, valued
from .mining import scored_rows
from .ranking import matched


def q_agent_gate(d):
    """An agent's candidates that stay: usable, not a text of generated cards, scored as a candidate by title and body; merged into the
    first card that is near enough, on the route of their class."""
    noise = any_of("l", M.GENERATED_CARDS, d)
    near = "SELECT id, card_id, similarity, row_number() OVER (PARTITION BY id ORDER BY card_id) AS rk FROM sim WHERE similarity > 0.75e0"
    item = f"""WITH given AS ({matched(d)}, near AS ({near})
  SELECT cand.id, concat(title, chr(10), body) AS text, lower(concat(title, chr(10), body)) AS l, near.card_id, near.similarity FROM cand LEFT JOIN near ON near.id = cand.id AND rk = 1
  WHERE {d.bytes_of}(body) <= 320 AND confidence >= CAST(0.78 AS FLOAT))"""
    return f"""{scored_rows(d, item, f"(SELECT * FROM given WHERE NOT {noise}) kept")}
SELECT id, CASE WHEN card_id IS NULL THEN 'new_candidate' ELSE 'merge_into_existing' END AS action, card_id AS target, round(similarity, 6) AS similarity, artifact_kind AS route, round(CAST(score AS DOUBLE), 4) AS score FROM s WHERE disposition = 'candidate'"""


def q_judge_gate(d):
    """Judgments of an item, scores in tenths: the majority, ties keep; reasons in their order; means of the scores there are. An item goes if it is
    voted out, too noisy (over 0.35) or, outside project rules, not grounded (under 0.7). Reasons are different texts, so few."""
    return f"""WITH j AS (SELECT user_id AS item, event_id, event_type = 'error' AS rejects, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 11 END AS grounded, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 8 END AS noise FROM <events>),
a AS (SELECT item, sum(CASE WHEN rejects THEN 1 ELSE 0 END) AS against, count(*) AS votes, CAST(sum(grounded) AS DOUBLE) / nullif(10 * count(grounded), 0) AS grounded, CAST(sum(noise) AS DOUBLE) / nullif(10 * count(noise), 0) AS noise, CASE item % 3 WHEN 0 THEN 'project_rule' ELSE 'collaboration_preference' END AS memory_tier FROM j GROUP BY item),
why AS (SELECT user_id AS item, event_type, min(event_id) AS first_at FROM <events> GROUP BY user_id, event_type),
w AS (SELECT item, replace({d.listed('event_type', 'first_at')}, chr(10), '; ') AS reasons FROM why GROUP BY item)
SELECT a.item, votes, reasons, grounded, noise, CASE WHEN 2 * against > votes THEN 'voted out' WHEN memory_tier <> 'project_rule' AND coalesce(grounded, 1e0) < 0.7e0 THEN 'weak grounding' WHEN coalesce(noise, 0e0) > 0.35e0 THEN 'noise' ELSE 'kept' END AS outcome FROM a JOIN w ON w.item = a.item"""


def q_update_actions(d):
    """Decisions about known records as actions. An update without a target falls back to the action there was."""
    return """WITH u AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'update' WHEN 'purchase' THEN 'supersede' WHEN 'error' THEN 'conflict' ELSE 'noop' END AS operation, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END AS target, CASE event_id % 3 WHEN 0 THEN 'workflow_skill' ELSE 'review_only' END AS route FROM <events>)
SELECT event_id, CASE WHEN operation = 'add' OR (operation = 'update' AND target IS NULL) THEN 'new_candidate' WHEN operation = 'update' THEN 'merge_into_existing' ELSE operation END AS action,
  CASE WHEN operation = 'add' THEN 'always_on_rule' ELSE route END AS route, CASE WHEN operation = 'add' THEN NULL ELSE target END AS target, CASE WHEN operation = 'update' AND target IS NOT NULL THEN 0.85e0 END AS similarity FROM u"""


def q_given_scores(d):
    """Value scores with those that a model gives in their place, and the score to select by: with any given, the confidence and the
    mean of the given ones; else that of the rules."""
    given = lambda n, v: f"CASE WHEN id % {n} = 0 THEN CAST({v} AS DOUBLE) END"
    parts = ("g_durability", "g_reusability", "g_specificity", "g_source_trust")
    total = " + ".join(f"coalesce({p}, 0e0)" for p in parts)
    n = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE 1 END" for p in parts)
    shown = ", ".join(f"coalesce({p}, round(CAST({p[2:]} AS DOUBLE), 4)) AS {p[2:]}" for p in parts)
    return f"""{valued(d)},
gs AS (SELECT *, round(CAST({selection(d)} AS DOUBLE), 4) AS by_rules, {given(2, '0.9')} AS g_durability, {given(3, '0.8')} AS g_reusability, {given(4, '0.6')} AS g_specificity, {given(5, '0.7')} AS g_source_trust FROM v),
gm AS (SELECT *, {total} AS total, {n} AS n FROM gs)
SELECT id, {shown}, CASE WHEN n = 0 THEN by_rules ELSE round(CAST(confidence AS DOUBLE) + total / n, 4) END AS selection FROM gm"""


def q_template_flags(d):
    """Candidates of templates that go first, and of those that the quality gate knows."""
    known = " OR ".join(f"template = {quoted(t)}" for t in M.KNOWN_TEMPLATES)
    first = "coalesce(template IN ('atomic-exception', 'project-improvement', 'high-value-prompt', 'principle-signal') OR template LIKE 'methodology-%', FALSE)"
    return f"{candidates(d)} SELECT id, template, {first} AS priority, coalesce({known}, FALSE) AS known FROM cand"


def q_supplements(d):
    """Bodies of cards put beside a mirrored skill: of its first declaration, cards that there are. A page declares three."""
    part = f"concat('## ', statement_title, {d.text(chr(10) * 2)}, body, {d.text(chr(10))})"
    cards = d.array("page_id % 30", "(page_id * 7 + 1) % 30", "(page_id * 11 + 5) % 30")
    return f"""{corpus(d)}, decl AS (SELECT {found(d, 'url', '//([^/?#]*)')} AS skill, min(page_id) AS page_id FROM <pages> GROUP BY 1),
item AS (SELECT skill, page_id, {d.placed(cards)} FROM decl),
card AS (SELECT k, body, {title(d, 'body')} AS statement_title FROM statement)
SELECT skill, count(*) AS n, {d.sha(d.listed(part, 'place'))} AS body_sha256 FROM item JOIN card ON card.k = item.e GROUP BY skill"""


def q_overview(d):
    """Counts of a project's records in one row: candidates that wait, drafts, cards, observations, skills that are installed."""
    return f"{candidates(d)} SELECT (SELECT count(*) FROM cand WHERE how <> 'rule') AS candidates, (SELECT count(*) FROM cand WHERE how = 'rule') AS drafts, (SELECT count(*) FROM statement) AS cards, (SELECT count(*) FROM chunk) AS observations, (SELECT count(*) FROM <pages>) AS installed"


QUERIES = {
    "agent_gate": q_agent_gate,
    "judge_gate": q_judge_gate,
    "update_actions": q_update_actions,
    "given_scores": q_given_scores,
    "template_flags": q_template_flags,
    "supplement_bodies": q_supplements,
    "project_overview": q_overview,
}
