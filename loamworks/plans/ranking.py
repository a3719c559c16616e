"""Duplicates, orders, limits and top-k of candidates. A run is a conversation."""

from __future__ import annotations

from ..functions import markers as M
from ..functions.rules import Rules, any_of
from .corpus import corpus
from .generate import candidates
from .mining import tokens, trimmed


def domain(d, x: str = "l") -> str:
    return "CASE " + " ".join(f"WHEN {any_of(x, w, d)} THEN '{n}'" for n, w in M.DOMAINS) + " ELSE 'general' END"


def cluster(d) -> str:
    return f"concat(memory_tier, ':', kind, ':', {domain(d, 'lower(body)')})"


def matched(d, base: str = "") -> str:
    """Candidates (those of ``base``, if it is given), cards and CTE ``sim``: similarity of candidates and cards that share a token, where scopes go together."""
    low = Rules(d, "lower(body)")
    return f"""{base or candidates(d)},
card AS (SELECT k AS card_id, body, CASE WHEN {low.any(M.SCOPE_GLOBAL)} THEN 'global' WHEN {low.any(M.SCOPE_AGENT)} THEN 'agent' ELSE 'project' END AS card_scope, {tokens(d, 'body')} AS tok FROM statement),
item AS (SELECT id, scope, {tokens(d, 'body')} AS tok FROM cand),
ct AS (SELECT card_id, card_scope, {d.size}(tok) AS n_card, {d.explode}(tok) AS t FROM card),
it AS (SELECT id, scope, {d.size}(tok) AS n_item, {d.explode}(tok) AS t FROM item),
shared AS (SELECT it.id, ct.card_id, max(n_item) AS n_item, max(n_card) AS n_card, count(*) AS n FROM it JOIN ct ON it.t = ct.t
  WHERE CASE it.scope WHEN 'global' THEN card_scope = 'global' WHEN 'agent' THEN card_scope = 'agent' ELSE card_scope <> 'global' END GROUP BY it.id, ct.card_id),
sim AS (SELECT id, card_id, CAST(n AS DOUBLE) / (n_item + n_card - n) AS similarity FROM shared)"""


def q_first_duplicate(d):
    """The first card, in the order of ids, that is near enough, and how near it is."""
    return f"{matched(d)} SELECT id, card_id AS duplicate_of, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY card_id) AS rk FROM sim WHERE similarity > 0.75e0) x WHERE rk = 1"


def q_tier_mix(d):
    return f"{candidates(d)} SELECT memory_tier, artifact_kind, kind, scope, count(*) AS n, round(min(CAST(confidence AS DOUBLE)), 4) AS least FROM cand GROUP BY memory_tier, artifact_kind, kind, scope"


def q_domains(d):
    return f"{candidates(d)}, cl AS (SELECT {cluster(d)} AS cluster FROM cand) SELECT cluster, count(*) AS n FROM cl GROUP BY cluster"


def q_inbox(d):
    """The inbox of each conversation: surest first, then those with a template, then the latest turn."""
    return f"{candidates(d)} SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id ORDER BY confidence DESC, CASE WHEN template IS NOT NULL THEN 0 ELSE 1 END, turn DESC, id) AS place FROM cand"


def q_diverse_topk(d):
    """Of each conversation the ten best: first one of each cluster in key order, then by score."""
    return f"""{candidates(d)},
r AS (SELECT id, conv_id AS run, {cluster(d)} AS cluster, confidence FROM cand),
f AS (SELECT *, row_number() OVER (PARTITION BY run, cluster ORDER BY confidence DESC, id) AS in_cluster FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN in_cluster = 1 THEN 0 ELSE 1 END, CASE WHEN in_cluster = 1 THEN cluster ELSE '' END, confidence DESC, id) AS picked FROM f)
SELECT run, id, cluster, row_number() OVER (PARTITION BY run ORDER BY confidence DESC, id) AS place FROM o WHERE picked <= 10"""


def q_preview_truncate(d):
    """At most seven that are no project rules (six if there is a project rule and eight are shown), filled with project rules up
    to eight, for each conversation; of equal bodies the surest."""
    return f"""{candidates(d)},
u AS (SELECT *, conv_id AS run, row_number() OVER (PARTITION BY conv_id, memory_tier, scope, lower({trimmed(d, 'body')}) ORDER BY confidence DESC, id) AS copy FROM cand),
r AS (SELECT *, memory_tier <> 'project_rule' AS other, row_number() OVER (PARTITION BY run, memory_tier = 'project_rule' ORDER BY confidence DESC, id) AS rk, max(CASE WHEN memory_tier = 'project_rule' THEN 1 ELSE 0 END) OVER (PARTITION BY run) AS has_rule FROM u WHERE copy = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN other AND rk <= 7 THEN 0 ELSE 1 END, confidence DESC, id) AS picked FROM r)
SELECT run, id, memory_tier, picked FROM k WHERE picked <= 8"""


def q_prefilter(d):
    """Material within 24,000 bytes of each conversation: the 40 best texts, until the first that does not fit."""
    r = Rules(d)
    return f"""{corpus(d)}, w AS (SELECT id, conv_id AS run, turn, {d.bytes_of}(text) AS bytes, 4 * {r.count(M.METHOD_MARKS)} + {r.count(M.DURABLE_MARKS)} AS score FROM chunk),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, turn DESC, id) AS rk FROM w) x WHERE rk <= 40),
u AS (SELECT *, sum(bytes) OVER (PARTITION BY run ORDER BY rk ROWS UNBOUNDED PRECEDING) AS upto FROM o)
SELECT run, id, rk, CAST(score AS BIGINT) AS score, CAST(upto AS BIGINT) AS upto FROM u WHERE rk = 1 OR upto <= 24000"""


def q_line_scores(d):
    """Value of the lines of texts for methods: marker counts, weighted; examples count one less, but never below zero."""
    r = Rules(d)
    return f"""{corpus(d)}, l0 AS (SELECT id, {d.placed(d.pieces('text', chr(10)))} FROM chunk), l1 AS (SELECT id, place, lower(e) AS l FROM l0),
l2 AS (SELECT id, place, {r.count(M.METHOD_MARKS)} AS methods, {r.count(M.DURABLE_MARKS)} AS durable, {r.count(M.METHOD_LINE_MARKS)} AS lines, CASE WHEN {r.any(M.EXAMPLE_MARKS)} THEN 1 ELSE 0 END AS example FROM l1)
SELECT id, CAST(place AS BIGINT) AS place, CAST(methods AS BIGINT) AS methods, CAST(durable AS BIGINT) AS durable, CAST(greatest(2 * methods + durable + 6 * lines - example, 0) AS BIGINT) AS score FROM l2"""


QUERIES = {
    "existing_dup_match": q_first_duplicate,
    "tier_mix": q_tier_mix,
    "body_domain_mix": q_domains,
    "candidate_inbox_sort": q_inbox,
    "diverse_topk": q_diverse_topk,
    "preview_truncate": q_preview_truncate,
    "prefilter_top40": q_prefilter,
    "methodology_line_scores": q_line_scores,
}
