"""Generators of candidates: the first one that a part of a sentence satisfies makes it, over whole texts.

Parts come from ``operators.atomic`` in Spark; the oracle splits by a recursive query of its own.
"""

from __future__ import annotations

from ..functions import markers as M
from ..functions.rules import Rules, any_of, count_of, quoted
from .corpus import corpus
from .mining import SPACES, classified_rows, once, scored_rows, sentences, slug, trimmed


def every(d, lists, x: str = "l") -> str:
    """Whether each of the lists has a marker in the text."""
    return "(" + " AND ".join(any_of(x, words, d) for words in lists) + ")"


def swapped(d, x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {d.text(old)}, {d.text(new)})"
    return x


def stripped(d, x: str) -> str:
    return trimmed(d, d.replaced(x, "^[，, ]+|[，, ]+$"))


def normal_body(d, x: str) -> str:
    """All but the last step, which takes one semicolon off the end."""
    return stripped(d, swapped(d, trimmed(d, x), M.BODY_DROPS))


def without_semicolon(x: str) -> str:
    return f"CASE WHEN substr({x}, -1, 1) = ';' THEN substr({x}, 1, length({x}) - 1) ELSE {x} END"


def title(d, x: str) -> str:
    words = d.all_of(x, f"[^{SPACES[1:-1]}]+")
    return f"CASE WHEN {d.size}({words}) >= 3 THEN {d.join}({d.first_of(words, 6)}, ' ') ELSE substr({x}, 1, 24) END"


def by_rules(d, rules, x: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {every(d, lists, f'lower({x})')} THEN {d.text(text)}" for lists, text in rules) + f" ELSE {other} END"


def sentence_arrays(d) -> str:
    return f"{corpus(d)} SELECT id, conv_id, turn, origin, {sentences(d, 'text')} AS parts FROM chunk"


def _first_cut(d) -> str:
    """For the oracle: left and right side of the first connector with two long enough sides, or null."""
    edge = lambda x: trimmed(d, d.replaced(x, "^[，, 。.]+|[，, 。.]+$"))
    cuts = []
    for c in M.CONNECTORS:
        pattern = f"(?is)^((?:.*?[^a-z0-9])??){c}((?:[^a-z0-9].*)?)$" if c.isascii() else f"(?s)^(.*?){c}(.*)$"
        free = "TRUE" if c not in M.EXCEPTIONS else "FALSE"
        cuts.append(f"struct_pack(a := {edge(f'regexp_extract(rest, {d.text(pattern)}, 1)')}, b := {edge(f'regexp_extract(rest, {d.text(pattern)}, 2)')}, free := {free})")
    return f"list_filter([{', '.join(cuts)}], lambda e: strlen(e.a) >= 8 AND strlen(e.b) >= 8)[1]"


def atoms(d) -> str:
    """The corpus and CTE ``atom``: parts of sentences. An id is the text's id and six digits of place, twice."""
    if d.__name__ == "Spark":
        return f"""{corpus(d)},
atom AS (SELECT id * 1000000 + place AS id, conv_id, turn, origin, text, lower(text) AS l FROM <atoms>)"""
    clause = lambda x: f"CASE WHEN m.free OR {any_of(f'lower({x})', M.EXCEPTION_FREE, d)} THEN {x} ELSE '保留例外：' || {x} END"
    return f"""{corpus(d)},
a0 AS (SELECT id, conv_id, turn, origin, {sentences(d, 'text')} AS parts FROM chunk),
a1 AS (SELECT id, conv_id, turn, origin, {d.placed('parts')} FROM a0),
cut AS (SELECT id, conv_id, turn, origin, place, 0 AS part, CAST(NULL AS VARCHAR) AS text, {trimmed(d, 'e')} AS rest FROM a1
  UNION ALL
  SELECT id, conv_id, turn, origin, place, part + 1, CASE WHEN m IS NULL THEN rest ELSE {clause('m.a')} END, CASE WHEN m IS NULL THEN '' ELSE {trimmed(d, clause('m.b'))} END
  FROM (SELECT *, {_first_cut(d)} AS m FROM cut WHERE rest <> '') x),
atom AS (SELECT id * 1000000 + row_number() OVER (PARTITION BY id ORDER BY place, part) - 1 AS id, conv_id, turn, origin, text, lower(text) AS l FROM cut WHERE part > 0)"""


def generated(d, weak: bool = False) -> str:
    """CTE ``g``: parts with the generator that takes them (``how``), their normalised bodies and scores. With ``weak``, rule-like
    parts of no other generator are those of the high-value way."""
    r = Rules(d)
    signal = dict(r.signals())
    size = lambda x: f"{d.bytes_of}({x})"
    method = d.replaced("nb", f"^(?i:global:{SPACES}*)?(?i:project:{SPACES}*)?(?i:agent:{SPACES}*)?")
    prompt = f"(NOT {r.low_value()} AND NOT ({r.unresolved()} AND NOT {r.explicit()}) AND {r.count(M.PROMPT_MARKS)} >= 2 AND {r.any(M.PROMPT_DOMAIN)} AND {r.any(M.PROMPT_OUTCOME)})"
    exception = f"({r.any(M.EXCEPTION_MARKS)} AND {r.any(M.EXCEPTION_REASONS)})"
    card = f"(NOT {r.low_value()} AND NOT ({r.unresolved()} AND NOT {r.strong()}) AND {r.any(M.CARD_DURABLE)} AND {r.any(M.CARD_DOMAIN)})"
    rule = f"{r.any(M.RULE_LIKE)} AND {card} AND {size('nb')} BETWEEN 18 AND 220" if weak else f"{r.any(M.RULE_LIKE)} AND {size('nb')} >= 12"
    smooth = "contains(text, '卡顿') OR contains(text, '不丝滑')"
    known = " ".join(f"WHEN {' AND '.join(f'contains(l, {quoted(w)})' for w in need)} AND {r.any(ctx)} THEN 'known:{k}'" for k, (_, need, ctx) in enumerate(M.PREFERENCES))
    return f"""{scored_rows(d, atoms(d), 'atom')},
n0 AS (SELECT id, conv_id, turn, origin, text, l, signal, artifact_kind, hardness, matched_signal, score, disposition, {once(d, normal_body(d, 'text'))} AS nb0 FROM s),
n1 AS (SELECT *, {once(d, without_semicolon('nb0'))} AS nb FROM n0),
n2 AS (SELECT *, {once(d, trimmed(d, method))} AS mb0,
  CASE WHEN {r.any(('卡顿', '不丝滑', 'not smooth'))} THEN {d.text(M.SMOOTH_BODY)} ELSE {stripped(d, swapped(d, 'nb', M.IMPROVEMENT_WORDS))} END AS ib,
  {stripped(d, swapped(d, 'nb', M.PROMPT_WORDS))} AS pb FROM n1),
n3 AS (SELECT *, {once(d, by_rules(d, M.METHODS, 'mb0', 'mb0'))} AS mb, CASE WHEN {smooth} THEN ib ELSE nb END AS sb,
  concat(CASE WHEN {signal['principle']} THEN 'p' ELSE '' END, CASE WHEN {signal['planning_heuristic']} THEN 'l' ELSE '' END, CASE WHEN {signal['collaboration_preference']} THEN 'c' ELSE '' END) AS signs FROM n2),
g AS (SELECT *, {once(d, f'''CASE WHEN {r.count(M.SELF_CHECK)} >= 2 THEN 'self'
  WHEN signs <> '' AND {size('mb')} BETWEEN 16 AND 360 THEN CASE WHEN NOT contains(signs, 'p') THEN 'together' WHEN contains(signs, 'l') OR (contains(signs, 'c') AND {r.any(M.TOGETHER_TOO)}) THEN 'both' ELSE 'principle' END
  WHEN {prompt} AND {size('pb')} BETWEEN 28 AND 360 THEN 'prompt'
  WHEN {signal['project_improvement']} THEN CASE WHEN {size('ib')} BETWEEN 28 AND 360 THEN 'improvement' ELSE '' END
  {known}
  WHEN {exception} AND {size('nb')} BETWEEN 12 AND 260 THEN 'exception'
  WHEN disposition = 'candidate' AND {size('sb')} BETWEEN 12 AND 400 THEN 'scored'
  WHEN {rule} THEN 'rule' ELSE '' END''')} AS how FROM n3)"""


def candidates(d, weak: bool = False) -> str:
    """CTE ``cand``: candidates with id, origin, text (the evidence), l (lower case of it), title, body, kind, scope, memory_tier,
    template, reason and 32-bit confidence."""
    r = Rules(d)
    real = lambda x: f"CAST({x} AS FLOAT)"
    scope = f"CASE WHEN {r.any(M.SCOPE_GLOBAL)} THEN 'global' WHEN {r.any(M.SCOPE_AGENT)} THEN 'agent' ELSE 'project' END"
    kind = f"CASE WHEN {r.any(M.KIND_CONSTRAINT)} THEN 'constraint' ELSE 'preference' END"
    many = lambda *names: "how IN (" + ", ".join(quoted(n) for n in names) + ")"
    methods = ("principle", "together", "together_too")
    reasons = " ".join(f"WHEN how = {quoted(n)} THEN {d.text(t)}" for n, t in M.REASONS)
    known_body = " ".join(f"WHEN how = 'known:{k}' THEN {quoted(b)}" for k, b in enumerate(M.PREFERENCE_BODIES))
    known_title = " ".join(f"WHEN how = 'known:{k}' THEN {quoted(t)}" for k, (t, _, _) in enumerate(M.PREFERENCES))
    known_template = " ".join(f"WHEN how = 'known:{k}' THEN {quoted(f'built-in:{t}')}" for k, (t, _, _) in enumerate(M.PREFERENCES))
    weak_scope = scope if weak else "'project'"
    return f"""{generated(d, weak)},
cand0 AS (SELECT *, {d.explode}(CASE WHEN how = 'both' THEN {d.array("'principle'", "'together_too'")} ELSE {d.array('how')} END) AS which FROM g WHERE how <> ''),
cand1 AS (SELECT id * 2 + CASE WHEN which = 'together_too' THEN 1 ELSE 0 END AS id, id AS part_id, conv_id, turn, origin, text, l, matched_signal, artifact_kind, hardness, score, disposition, which AS how, nb, ib, pb, mb, sb FROM cand0),
cand2 AS (SELECT *, {once(d, f"CASE WHEN how = 'self' THEN {d.text(M.SELF_CHECK_BODY)} WHEN {many(*methods)} THEN mb WHEN how = 'prompt' THEN pb WHEN how = 'improvement' THEN ib {known_body} WHEN how = 'scored' THEN sb ELSE nb END")} AS body FROM cand1),
cand3 AS (SELECT id, part_id, conv_id, turn, origin, text, l, matched_signal, artifact_kind, hardness, score, disposition, how, body,
    CASE WHEN {many('self', 'prompt', 'improvement', *methods)} THEN 'procedure' WHEN how LIKE 'known:%' THEN 'preference' WHEN how = 'exception' THEN 'constraint'
      WHEN how = 'scored' THEN CASE WHEN matched_signal = 'constraint' THEN 'constraint' WHEN matched_signal IN ('procedure', 'correction', 'decision', 'ai_project_improvement') THEN 'procedure' ELSE 'preference' END ELSE {kind} END AS kind,
    CASE WHEN {many('self', *methods)} THEN 'global' WHEN how LIKE 'known:%' THEN 'project' WHEN how = 'rule' THEN {weak_scope} ELSE {scope} END AS scope,
    CASE WHEN {many('self', 'together', 'together_too')} THEN 'collaboration_preference' WHEN how = 'principle' THEN 'cross_project_principle' ELSE 'project_rule' END AS memory_tier,
    CASE WHEN how = 'self' THEN 'self-verification-signal' WHEN {many(*methods)} THEN 'principle-signal' WHEN how = 'prompt' THEN 'high-value-prompt' WHEN how = 'improvement' THEN 'project-improvement' {known_template} WHEN how = 'exception' THEN 'atomic-exception' WHEN how = 'scored' THEN concat('score:', matched_signal) END AS template,
    CASE {reasons} WHEN how = 'together_too' THEN {d.text(M.REASONS[2][1])} ELSE '' END AS reason,
    CASE how WHEN 'self' THEN {real(0.98)} WHEN 'principle' THEN {real(0.8)} WHEN 'together_too' THEN {real(0.79)} WHEN 'together' THEN {real(0.78)} WHEN 'prompt' THEN {real(0.84)} WHEN 'improvement' THEN {real(0.82)} WHEN 'exception' THEN {real(0.82)}
      WHEN 'scored' THEN greatest(least({d.real('score / CAST(5 AS FLOAT)')}, {real(0.94)}), {real(0.7)}) WHEN 'rule' THEN {real(0.78 if weak else 0.62)} ELSE {real(0.92)} END AS confidence FROM cand2),
cand AS (SELECT *, {once(d, f'''CASE {known_title} WHEN how = 'improvement' THEN {by_rules(d, M.IMPROVEMENT_TITLES, 'body', title(d, 'body'))} WHEN how = 'prompt' THEN {by_rules(d, M.PROMPT_TITLES, 'body', title(d, 'body'))}
    WHEN how = 'scored' AND matched_signal = 'ai_project_improvement' THEN 'Review AI-Origin Project Improvement' WHEN how = 'scored' AND matched_signal = 'constraint' AND contains(body, 'AGENTS.md') THEN 'Protect AGENTS.md Drift Review' ELSE {title(d, 'body')} END''')} AS title FROM cand3)"""


def candidate_id(d) -> str:
    return f"concat(scope, ':', {slug(d, 'title')})"


def q_candidates(d):
    return f"{candidates(d)} SELECT id, {candidate_id(d)} AS candidate_id, title, kind, scope, memory_tier, template, round(CAST(confidence AS DOUBLE), 4) AS confidence, body, text AS evidence FROM cand"


def q_generators(d):
    return f"{candidates(d)} SELECT how, kind, scope, memory_tier, count(*) AS n FROM cand GROUP BY how, kind, scope, memory_tier"


def q_high_value(d):
    """Strong candidates, and weak ones whose body occurs twice in a conversation or that are marked to be remembered; the first
    of equal weak bodies stays. In the order in which a conversation gives them: strong ones, then weak ones by body."""
    r = Rules(d)
    return f"""{candidates(d, weak=True)},
w AS (SELECT *, lower(body) AS body_key, count(*) OVER (PARTITION BY conv_id, how = 'rule', lower(body)) AS copies, row_number() OVER (PARTITION BY conv_id, how = 'rule', lower(body) ORDER BY id) AS nth FROM cand),
k AS (SELECT *, how = 'rule' AS is_weak FROM w WHERE how <> 'rule' OR (nth = 1 AND (copies >= 2 OR {r.explicit()})))
SELECT conv_id, id, {candidate_id(d)} AS candidate_id, is_weak, kind, scope, memory_tier, template, round(CAST(confidence AS DOUBLE), 4) AS confidence, body,
  row_number() OVER (PARTITION BY conv_id ORDER BY is_weak, CASE WHEN is_weak THEN body_key ELSE '' END, id) AS place FROM k"""


def q_method_pairs(d):
    """A project's wording of a method, and the principles that it comes to."""
    r = Rules(d)
    named = d.array(*[f"CASE WHEN {every(d, lists)} THEN '{k}' END" for k, (_, lists, _, _, _) in enumerate(M.MENTIONS)])
    fixed = ", ".join(f"('{k}', {quoted(t)}, {quoted(b)}, {quoted(tier)})" for k, (_, _, t, b, tier) in enumerate(M.MENTIONS))
    scope = f"CASE WHEN {r.any(M.SCOPE_GLOBAL)} THEN 'global' WHEN {r.any(M.SCOPE_AGENT)} THEN 'agent' ELSE 'project' END"
    return f"""{atoms(d)},
m0 AS (SELECT id, text, l, {once(d, normal_body(d, 'text'))} AS nb0, {d.kept(named, 'e IS NOT NULL')} AS found FROM atom),
m1 AS (SELECT id, text, l, {once(d, without_semicolon('nb0'))} AS nb, found FROM m0 WHERE {d.size}(found) > 0),
m AS (SELECT id, l, nb, {title(d, 'nb')} AS title, found FROM m1 WHERE {d.bytes_of}(nb) BETWEEN 8 AND 320),
spec AS (SELECT * FROM (VALUES {fixed}) AS v(k, title, body, tier)),
one AS (SELECT id, {d.explode}(found) AS k, concat('project:', {slug(d, 'title')}) AS project_id FROM m),
first_one AS (SELECT id, min(k) AS k FROM one GROUP BY id)
SELECT m.id, 'project' AS role, m.title, m.nb AS body, CASE WHEN {r.any(M.KIND_CONSTRAINT)} THEN 'constraint' ELSE 'preference' END AS kind, {scope} AS scope, 'project_rule' AS memory_tier, 0.83e0 AS confidence, concat('global:', {slug(d, 'spec.title')}) AS other FROM m JOIN first_one ON first_one.id = m.id JOIN spec ON spec.k = first_one.k
UNION ALL SELECT one.id, 'principle', spec.title, spec.body, 'procedure', 'global', spec.tier, 0.9e0, one.project_id FROM one JOIN spec ON spec.k = one.k"""


def tier_guess(d, x: str = "l") -> str:
    """A tier by what a text mentions."""
    lists = {name: every(d, l, x) for name, l, *_ in M.MENTIONS}
    either = lambda *names: " OR ".join(lists[n] for n in names)
    return f"CASE WHEN {either('design_planning', 'real_history', 'review_boundary', 'test_strategy')} THEN 'collaboration_preference' WHEN {either('user_experience', 'core_functionality')} THEN 'cross_project_principle' ELSE 'project_rule' END"


def q_tier_guess(d):
    return f"{candidates(d)} SELECT id, memory_tier, {tier_guess(d, 'lower(body)')} AS guess FROM cand"


def _rewrite(d, part: int) -> str:
    """Tier, kind or body (1, 2, 3) of the first rewrite; null without one."""
    low = "lower(body)"
    return "CASE " + " ".join(f"WHEN {every(d, w[0], low)} THEN {d.text(w[part])}" for w in M.REWRITES) + " END"


def q_refine(d):
    """Candidates rewritten into condition and action; leftovers of low quality go, others stay as they are."""
    low = "lower(body)"
    left = f"{any_of(low, M.LEFTOVERS, d)} OR substr({low}, -2, 2) = '-质'"
    return f"""{candidates(d)},
r0 AS (SELECT id, title, body, kind, scope, memory_tier, template, confidence, {once(d, _rewrite(d, 3))} AS made, {_rewrite(d, 1)} AS tier, {_rewrite(d, 2)} AS new_kind, {left} AS is_left FROM cand),
r AS (SELECT * FROM r0 WHERE (made IS NOT NULL AND length(made) BETWEEN 16 AND 320) OR (made IS NULL AND NOT is_left))
SELECT id, coalesce(made, body) AS body, coalesce(new_kind, kind) AS kind, coalesce(tier, memory_tier) AS memory_tier,
  CASE WHEN made IS NULL THEN scope WHEN tier = 'project_rule' THEN 'project' ELSE 'global' END AS scope,
  CASE WHEN made IS NULL THEN template ELSE 'deterministic-memory-refine' END AS template,
  round(CAST(CASE WHEN made IS NULL THEN confidence ELSE greatest(confidence, CAST(0.82 AS FLOAT)) END AS DOUBLE), 4) AS confidence FROM r"""


def q_placement(d):
    """Where candidates go, with the fallback by tier where the evidence itself is not classified."""
    tier = lambda a, b, other: f"CASE WHEN artifact_kind <> 'reject' THEN {other} WHEN memory_tier = 'cross_project_principle' THEN '{a}' WHEN memory_tier = 'collaboration_preference' THEN '{b}' ELSE {other} END"
    return f"""{candidates(d)}, p AS (SELECT {tier('always_on_rule', 'workflow_skill', 'artifact_kind')} AS artifact, {tier('medium', 'medium', 'hardness')} AS hardness, artifact_kind = 'reject' AND memory_tier <> 'project_rule' AS fell_back FROM cand)
SELECT artifact, hardness, count(*) AS n, CAST(sum(CASE WHEN fell_back THEN 1 ELSE 0 END) AS BIGINT) AS fallbacks FROM p GROUP BY artifact, hardness"""


QUERIES = {
    "candidates_local": q_candidates,
    "generator_mix": q_generators,
    "candidates_high_value": q_high_value,
    "methodology_pairs": q_method_pairs,
    "tier_guess": q_tier_guess,
    "refine_candidates": q_refine,
    "placement_mix": q_placement,
}
