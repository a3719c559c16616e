"""Gates, feedback, review state, artifacts and reports as queries.

Event-shaped inputs (feedback, jobs, transitions, tokens) are read off ``events``; artifacts and lines off ``documents``.
"""

from __future__ import annotations

from ..functions import markers as M
from ..functions.rules import Rules, quoted
from .corpus import STATEMENTS, corpus
from .dialect import found
from .generate import candidate_id, candidates, swapped, title
from .mining import _units, once, redacted, sentences, slug, tokens, trimmed
from .ranking import matched

N = len(STATEMENTS)


def values(name: str, columns: str, rows) -> str:
    text = ", ".join("(" + ", ".join(quoted(v) if isinstance(v, str) else "NULL" if v is None else str(v) for v in r) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {text}) AS v({columns}))"


# -- gates


def memory_flag(d, x: str = "l") -> str:
    """The first rule of the memory gate that a lower-case text breaks, or an empty text."""
    r = Rules(d, x)
    has = lambda w: f"contains({x}, {quoted(w)})"
    durable = r.any(M.MEMORY_DURABLE)
    cases = (
        ("secret", r.any(M.MEMORY_SECRET)),
        ("generated-or-internal-artifact", r.any(M.MEMORY_INTERNAL)),
        ("memory-pipeline-meta", f"{_pipeline_rule(d, x)} OR ({r.any(M.PIPELINE_TERMS)} AND {has('候选')}) OR {_planning_rule(x)}"),
        ("current-task-state", r.any(M.MEMORY_TASK)),
        ("one-off-write-scope", f"NOT {durable} AND {r.any(M.MEMORY_WRITE_SCOPE)}"),
        ("rebuildable-code-fact", f"NOT {durable} AND {r.any(M.MEMORY_PATH)} AND {r.any(M.MEMORY_PLACE)}"),
        ("ephemeral-reference", f"NOT {durable} AND {r.any(M.MEMORY_EPHEMERAL)}"),
        ("reference-pointer", r.any(M.MEMORY_POINTER)),
    )
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in cases) + " ELSE '' END"


def _pipeline_rule(d, x: str) -> str:
    """A rule about how candidates are made, not about the user's work."""
    r = Rules(d, x)
    has = lambda w: f"contains({x}, {quoted(w)})"
    return f"(({r.any(M.PIPELINE_CANDIDATE)} OR ({has('候选质量')} AND {has('候选数量')}) OR ({has('生成')} AND {has('筛选')} AND {has('候选')})) AND {r.any(M.PIPELINE_KEEP)})"


def _planning_rule(x: str) -> str:
    has = lambda w: f"contains({x}, {quoted(w)})"
    return f"(({has('当规划或评估开发工作时')} OR ({has('核心功能链路')} AND {has('周边功能')})) AND NOT {has('所有项目')} AND NOT {has('每次')})"


def _memory_text() -> str:
    return "lower(concat(title, chr(10), body, chr(10), text, chr(10), kind, chr(10), scope))"


def q_memory_gate(d):
    return f"""{candidates(d)}, mt AS (SELECT id, scope, {once(d, _memory_text())} AS l FROM cand), mf AS (SELECT id, {memory_flag(d)} AS flag FROM mt)
SELECT id, flag, CASE WHEN flag = '' THEN 'accept' WHEN flag = 'reference-pointer' THEN 'review_only' ELSE 'reject' END AS disposition, CASE WHEN flag = '' THEN 'always_on_rule' ELSE 'review_only' END AS route FROM mf"""


def quality_flag(d) -> str:
    """The first rule of the quality gate that a candidate breaks, or an empty text. Columns: ``whole`` (title, body, evidence and
    reason) and ``named`` (title and body) in lower case, body, template, action, similarity."""
    w, n = Rules(d, "whole"), Rules(d, "named")
    b = Rules(d, "lower(trim(body))")
    has = lambda *words: " AND ".join(f"contains(whole, {quoted(x)})" for x in words)
    talk = f"NOT ({has('不要只依赖固定规则词', '真实高价值表达')}) AND NOT ({w.any(('提交最终代码', '复杂任务结果前'))} AND {w.any(('自检', 'dry-run', '真实输入'))})"
    meta = f"({w.any(M.QUALITY_QUESTION)} AND {w.any(M.QUALITY_PIPELINE)}) OR ({w.any(M.QUALITY_SYSTEM)} AND {w.any(M.QUALITY_ANALYSIS)}) OR {_pipeline_rule(d, 'whole')} OR {_planning_rule('whole')} OR ({w.any(M.PRODUCT_FEEDBACK)} AND {w.any(M.PRODUCT_WISH)})"
    task = f"({w.any(M.TASK_PATHS)} AND {w.any(M.TASK_SCOPE)}) OR {w.any(M.QUALITY_ONE_OFF)} OR {w.any(M.TASK_REVIEW)} OR {w.any(M.TASK_BRIEFS)}"
    whole_rule = f"{d.bytes_of}(trim(body)) >= 10 AND substr(trim(body), -1, 1) NOT IN ('?', '？') AND ({b.any(M.SELF_CONTAINED)} OR ({b.any(M.RULE_TOOLS)} AND {b.any(M.RULE_DURABLE)}))"
    known = "coalesce(template, '') IN (" + ", ".join(quoted(t) for t in M.KNOWN_TEMPLATES) + ")"
    cases = (
        ("internal-leak", n.any(M.QUALITY_LEAK)),
        ("generated-instruction-artifact", w.any(M.QUALITY_GENERATED)),
        ("meta-discussion", f"{talk} AND ({meta})"),
        ("temporary-task-constraint", f"NOT {w.any(M.QUALITY_DURABLE)} AND ({task})"),
        ("package-manager-preference", f"{w.any(M.PACKAGE_TOOLS)} AND {w.any(M.PACKAGE_CONTEXT)}"),
        ("duplicate-existing", "action = 'merge_into_existing' AND coalesce(similarity, 0e0) >= 0.95e0"),
        ("llm-noop", "action = 'noop'"),
        ("not-self-contained-rule", f"NOT {known} AND NOT ({whole_rule})"),
    )
    return "CASE " + " ".join(f"WHEN {c} THEN '{name}'" for name, c in cases) + " ELSE '' END"


def gated(d) -> str:
    """Candidates matched with cards, and CTE ``gate``: their flags of both gates."""
    return f"""{matched(d)},
dup AS (SELECT id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY card_id) AS rk FROM sim WHERE similarity > 0.75e0) x WHERE rk = 1),
q0 AS (SELECT c.id, c.conv_id, c.scope, c.kind, c.memory_tier, c.template, c.title, c.body, c.text, c.confidence, dup.similarity, CASE WHEN dup.id IS NULL THEN 'add' ELSE 'merge_into_existing' END AS action,
  lower(concat(title, chr(10), body, chr(10), text, chr(10), reason)) AS whole, lower(concat(title, chr(10), body)) AS named, {_memory_text()} AS l FROM cand c LEFT JOIN dup ON dup.id = c.id),
gate AS (SELECT id, conv_id, scope, kind, memory_tier, template, title, body, confidence, action, {once(d, quality_flag(d))} AS quality, {memory_flag(d)} AS memory FROM q0)"""


def q_quality_gate(d):
    return f"{gated(d)} SELECT id, quality AS flag, quality = '' AS kept, action FROM gate"


def q_gc(d):
    """Candidates that the memory gate rejects are hidden, and feedback says so."""
    return f"{candidates(d)}, mt AS (SELECT id, scope, {once(d, _memory_text())} AS l FROM cand), mf AS (SELECT id, scope, {memory_flag(d)} AS flag FROM mt) SELECT id, scope, CASE WHEN flag IN ('', 'reference-pointer') THEN 'candidate' ELSE 'hidden' END AS status, CASE WHEN flag IN ('', 'reference-pointer') THEN NULL ELSE 'memory-gc' END AS feedback FROM mf"


def q_visible(d):
    """What both gates let through."""
    return f"{gated(d)} SELECT id, {candidate_id(d)} AS candidate_id, kind, scope, memory_tier, action FROM gate WHERE quality = '' AND memory IN ('', 'reference-pointer')"


def kernel_tags(d, x: str = "l") -> str:
    """All tags of a lower-case text, by name."""
    r = Rules(d, x)
    return d.sort + "(" + d.kept(d.array(*[f"CASE WHEN {r.any(w)} THEN '{t}' END" for t, w in M.KERNEL_TAGS]), "e IS NOT NULL") + ")"


def kernel_assessed(d, table: str) -> str:
    """CTE ``ka``: value, risk, tags and reason of the texts of a table (id, l); two tags make a text worth as much as a marker does."""
    r = Rules(d)
    value = f"CASE WHEN {r.any(M.KERNEL_RULE)} OR {r.any(M.KERNEL_HIGH)} OR {d.size}(tags) >= 2 THEN 'high' WHEN {r.any(M.KERNEL_NOISE)} AND length(l) <= 32 THEN 'noise' ELSE 'candidate' END"
    reason = "CASE value " + " ".join(f"WHEN '{v}' THEN {quoted(t)}" for v, t in M.KERNEL_REASONS) + " END"
    noted = f"CASE WHEN value = 'noise' THEN {d.sort}({d.array("'noise'")} || tags) ELSE tags END" if d.__name__ != "Spark" else "CASE WHEN value = 'noise' THEN array_sort(concat(array('noise'), tags)) ELSE tags END"
    return f"""ka0 AS (SELECT id, l, {once(d, kernel_tags(d))} AS tags FROM {table}), ka1 AS (SELECT id, tags, {value} AS value FROM ka0),
ka AS (SELECT id, value, CASE value WHEN 'noise' THEN 'low' ELSE 'medium' END AS risk, {d.join}({noted}, ',') AS tags, {reason} AS reason FROM ka1)"""


def q_kernel_assess(d):
    return f"{corpus(d)}, {kernel_assessed(d, 'chunk')} SELECT * FROM ka"


def inferred_tags(d, x: str = "l") -> str:
    """The first six tags, by name, of a lower-case text; one without any is a rule."""
    r = Rules(d, x)
    tags = d.array(*[f"CASE WHEN {r.any(w)} THEN '{t}' END" for t, w in M.CANDIDATE_TAGS], f"CASE WHEN {r.any(('axios',))} THEN '生态偏好' END")
    found = f"{d.sort}({d.distinct}({d.kept(tags, 'e IS NOT NULL')}))"
    return f"CASE WHEN {d.size}({found}) = 0 THEN 'rule' ELSE {d.join}({d.first_of(found, 6)}, ',') END"


def q_candidate_tags(d):
    return f"{corpus(d)} SELECT id, {inferred_tags(d)} AS tags, CASE WHEN {d.matches('text', '[一-鿿]')} THEN 'zh' ELSE 'en' END AS language, substr({trimmed(d, 'text')}, 1, 72) AS brief FROM chunk"


def value_columns(d, recurs: str) -> str:
    """32-bit value scores of a candidate; ``recurs`` tells whether its reason says that it came up again and again."""
    r = Rules(d, "lower(body)")
    f = lambda c, a, b: f"CAST(CASE WHEN {c} THEN {a} ELSE {b} END AS FLOAT)"
    durability = f(r.any(("always", "以后", "默认", "每次", "prefer", "must", "should")), 0.92, 0.72)
    wide = r.any(("all projects", "所有项目", "用户视角", "core functionality", "核心功能"))
    reuse = f"CAST(CASE memory_tier WHEN 'cross_project_principle' THEN 0.94 WHEN 'collaboration_preference' THEN 0.88 ELSE CASE WHEN {wide} THEN 0.82 ELSE 0.42 END END AS FLOAT)"
    trust = "CAST(CASE origin WHEN 'user' THEN 1.0 WHEN 'assistant' THEN 0.60 WHEN 'artifact' THEN 0.70 ELSE 0.80 END AS FLOAT)"
    place = "CAST(CASE memory_tier WHEN 'cross_project_principle' THEN 0.94 WHEN 'collaboration_preference' THEN 0.86 ELSE 0.28 END AS FLOAT)"
    return f"""{durability} AS durability, {place} AS locality, {f(recurs, 0.92, 0.40)} AS recurrence, {reuse} AS reusability, {trust} AS source_trust, {f(f"{d.bytes_of}(body) BETWEEN 24 AND 220", 0.82, 0.58)} AS specificity"""


def selection(d, confidence: str = "confidence") -> str:
    """32-bit score by which candidates are chosen: confidence and the mean of the value scores, added in the order of their names.
    It trusts every source."""
    whole = "durability + locality + recurrence + reusability + CAST(1 AS FLOAT) + specificity"
    return f"({confidence} + {d.real(f'({whole}) / CAST(6 AS FLOAT)')})"


def valued(d) -> str:
    """CTE ``v``: value scores of candidates with their confidence; candidates of three and more of one signature recur."""
    return f"""{_signed(d)}, sn AS (SELECT signature, count(*) AS n FROM sg GROUP BY signature),
v AS (SELECT id, confidence, {value_columns(d, 'n >= 3')} FROM sg JOIN sn ON sn.signature = sg.signature)"""


def q_value_scores(d):
    shown = ", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in ("durability", "locality", "recurrence", "reusability", "source_trust", "specificity"))
    return f"{valued(d)} SELECT id, {shown}, round(CAST({selection(d)} AS DOUBLE), 4) AS selection FROM v"


def q_preferences(d):
    """The first known preference of each sentence that looks like a rule, and the markers that it was known by."""
    r = Rules(d)
    fits = lambda need, ctx: f"{' AND '.join(f'contains(l, {quoted(w)})' for w in need)} AND {r.any(ctx)}"
    case = lambda made: "CASE " + " ".join(f"WHEN {fits(need, ctx)} THEN {made(t, need, ctx)}" for t, need, ctx in M.PREFERENCES) + " END"
    known = lambda words: f"{d.join}({d.kept(d.array(*[f'CASE WHEN contains(l, {quoted(w)}) THEN {quoted(w)} END' for w in words]), 'e IS NOT NULL')}, ',')"
    return f"""{_units(d)}, kp AS (SELECT id, l, {case(lambda t, *_: quoted(t))} AS preference, {case(lambda _, need, __: known(need))} AS required, {case(lambda _, __, ctx: known(ctx))} AS context FROM unit WHERE {r.any(M.RULE_LIKE)})
SELECT id, preference, required, context, 'built-in' AS source FROM kp WHERE preference IS NOT NULL"""


# -- feedback and recurrence


def _feedback():
    """Feedback on the user's statement, of every event: errors are rejections; the event type is the reason."""
    return f"fb AS (SELECT event_id, user_id % {N} AS k, CASE event_type WHEN 'error' THEN 'rejected' ELSE 'accepted' END AS decision, event_type AS reason, ts FROM <events>)"


def q_feedback_penalty(d):
    return f"""WITH {_feedback()}, n AS (SELECT k, reason, count(*) AS c FROM fb WHERE decision = 'rejected' GROUP BY k, reason),
m AS (SELECT k, reason, c, row_number() OVER (PARTITION BY k ORDER BY c DESC, reason DESC) AS rk, sum(c) OVER (PARTITION BY k) AS rejections FROM n)
SELECT k, CAST(rejections AS BIGINT) AS rejections, reason, greatest(-0.08e0 * rejections, -0.25e0) AS delta FROM m WHERE rk = 1 AND rejections >= 2"""


def q_reflexion(d):
    return f"WITH {_feedback()}, n AS (SELECT k, count(*) AS c FROM fb WHERE decision = 'rejected' GROUP BY k) SELECT k, c, place FROM (SELECT k, c, row_number() OVER (ORDER BY c DESC, k) AS place FROM n WHERE c >= 3) x WHERE place <= 10"


def feedback_signature(d, body: str, context: str = "'candidate:'") -> str:
    return f"concat('sig:sha256-', substr({d.sha(f"concat({context}, {d.join}({tokens(d, swapped(d, f'lower({body})', M.FEEDBACK_SAME))}, ' '))")}, 1, 9))"


def _rejected(d, context: str = "'candidate:'") -> str:
    """CTE ``pen``: rejections, most frequent reason and penalty by signature. Feedback is on the sentences of the statements."""
    return f"""{_feedback()},
sb0 AS (SELECT k, {d.explode}({sentences(d, 'body')}) AS body FROM statement),
sb AS (SELECT k, {feedback_signature(d, 'body', context)} AS signature FROM sb0),
rn AS (SELECT signature, reason, count(DISTINCT event_id) AS c FROM fb JOIN sb ON sb.k = fb.k WHERE decision = 'rejected' GROUP BY signature, reason),
rm AS (SELECT signature, reason, row_number() OVER (PARTITION BY signature ORDER BY c DESC, reason DESC) AS rk, sum(c) OVER (PARTITION BY signature) AS rejections FROM rn),
pen AS (SELECT signature, reason, rejections, greatest(-0.08e0 * rejections, -0.25e0) AS delta FROM rm WHERE rk = 1 AND rejections >= 2)"""


def q_feedback_gate(d):
    """Candidates after feedback on bodies of their tokens: three rejections drop one, two lower its confidence."""
    return f"""{candidates(d)}, {_rejected(d)},
fc AS (SELECT id, confidence, {feedback_signature(d, 'body')} AS signature FROM cand)
SELECT id, CAST(coalesce(rejections, 0) AS BIGINT) AS rejections, coalesce(reason, '') AS reason, coalesce(rejections, 0) < 3 AS kept, round(greatest(least(CAST(confidence AS DOUBLE) + coalesce(delta, 0e0), 1e0), 0e0), 4) AS confidence FROM fc LEFT JOIN pen ON pen.signature = fc.signature"""


def q_contextual_penalty(d):
    """Penalties of bodies within their scope and tier: the feedback is on project rules of projects."""
    context = "'candidate:project:project_rule:'"
    return f"""{candidates(d)}, {_rejected(d, context)},
fc AS (SELECT id, {feedback_signature(d, 'body', "concat('candidate:', scope, ':', memory_tier, ':')")} AS signature FROM cand)
SELECT id, fc.signature, CAST(rejections AS BIGINT) AS rejections, reason, delta FROM fc JOIN pen ON pen.signature = fc.signature"""


def signature(d) -> str:
    """Of a candidate: its kind and whole body in normalised words."""
    text = "concat(kind, ' ', lower(body))"
    for old, new in M.SIGNED:
        text = f"replace({text}, {quoted(old)}, {quoted(new)})"
    return f"""concat('sig:', substr(replace(concat('sha256:', {d.sha(f"{d.join}({tokens(d, text)}, ' ')")}), ':', '-'), 1, 16))"""


def _signed(d):
    """Candidates with their signatures."""
    return f"""{candidates(d)}, sg AS (SELECT id, origin, confidence, turn, memory_tier, body, {signature(d)} AS signature FROM cand)"""


def q_recurrence(d):
    return f"{_signed(d)} SELECT signature, count(*) AS occurrences, count(DISTINCT origin) AS origins, max(id) AS last_id FROM sg GROUP BY signature"


def q_recurrence_boost(d):
    return f"""{_signed(d)}, n AS (SELECT signature, count(*) AS n FROM sg GROUP BY signature)
SELECT id, sg.signature, n, round(CASE WHEN n >= 3 THEN least(CAST(confidence AS DOUBLE) + 0.1e0, 0.95e0) ELSE CAST(confidence AS DOUBLE) END, 4) AS confidence FROM sg JOIN n ON n.signature = sg.signature"""


# -- review state


def q_candidate_status(d):
    """The first transition decides: only a candidate can be hidden, rejected or promoted; without any it stays one."""
    return """WITH e AS (SELECT user_id AS candidate, ts, event_id, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'promoted' WHEN 'view' THEN 'hidden' ELSE 'candidate' END AS status FROM <events>),
t AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY CASE WHEN status = 'candidate' THEN 1 ELSE 0 END, ts, event_id) AS rk FROM e)
SELECT candidate, status, CASE WHEN status <> 'candidate' THEN event_id END AS by_event FROM t WHERE rk = 1"""


def q_token_use(d):
    """A decision token works once: for its first use, if the payload is the one it was made for."""
    return """WITH u AS (SELECT event_id, user_id AS token, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS made_for FROM <events>),
v AS (SELECT *, min(CASE WHEN nth > 1 AND event_type = made_for THEN nth END) OVER (PARTITION BY token) AS used FROM u)
SELECT event_id, token, CASE WHEN nth = 1 THEN 'created' WHEN nth > used THEN 'consumed' WHEN event_type <> made_for THEN 'mismatch' ELSE 'accepted' END AS outcome FROM v"""


def review_slug(d, x: str) -> str:
    """A slug without one of the marks of fused records at its end."""
    return slug(d, trimmed(d, d.replaced(trimmed(d, x), "( Fusion| fusion|-fusion| 融合|融合)$")))


def _cards_and_drafts(d) -> str:
    """CTEs ``card`` (every second statement) and ``draft`` (candidates) with ids, titles, slugs, tokens and compact bodies."""
    low = Rules(d, "lower(body)")
    compact = lambda x: d.replaced(f"lower({x})", "[^a-z0-9一-鿿]+")
    scope = f"CASE WHEN {low.any(M.SCOPE_GLOBAL)} THEN 'global' WHEN {low.any(M.SCOPE_AGENT)} THEN 'agent' ELSE 'project' END"
    return f"""card0 AS (SELECT k, body, {scope} AS scope, {title(d, 'body')} AS title FROM statement WHERE k % 2 = 0),
card AS (SELECT k, body, title, {candidate_id(d)} AS cid, {review_slug(d, 'title')} AS s, {tokens(d, 'body')} AS tok, {compact('body')} AS compact FROM card0),
draft AS (SELECT id, conv_id, title, body, {candidate_id(d)} AS cid, {review_slug(d, 'title')} AS s, {tokens(d, 'body')} AS tok, {compact('body')} AS compact FROM cand)"""


def q_reviewable(d):
    """Drafts that no card covers: by id (project and global count alike), by slug of id or title, by tokens, or by one's body
    holding the other's."""
    rest = lambda x: d.replaced(x, "^(global|project):")
    return f"""{candidates(d)}, {_cards_and_drafts(d)},
ct AS (SELECT k, {d.size}(tok) AS n_card, {d.explode}(tok) AS t FROM card), dt AS (SELECT id, {d.size}(tok) AS n_draft, {d.explode}(tok) AS t FROM draft),
near AS (SELECT id FROM (SELECT dt.id, ct.k, count(*) AS n, max(n_card) AS n_card, max(n_draft) AS n_draft FROM dt JOIN ct ON dt.t = ct.t GROUP BY dt.id, ct.k) x WHERE CAST(n AS DOUBLE) / (n_card + n_draft - n) >= 0.72e0),
held AS (SELECT draft.id FROM draft JOIN card ON length(card.compact) >= 24 AND length(draft.compact) >= 24 AND (contains(card.compact, draft.compact) OR contains(draft.compact, card.compact)))
SELECT id, cid AS draft_id, s AS slug FROM draft WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.id = draft.id) AND NOT EXISTS (SELECT 1 FROM held WHERE held.id = draft.id)
  AND NOT EXISTS (SELECT 1 FROM card WHERE card.s = draft.s) AND NOT EXISTS (SELECT 1 FROM card WHERE {rest('card.cid')} = {rest('draft.cid')})"""


def q_approval(d):
    """Approving a draft: a card of its id absorbs it by similarity, is updated by an equal title or likeness, else conflicts; a new
    id inserts."""
    both = f"{d.size}({d.intersect}(draft.tok, card.tok))"
    return f"""{candidates(d)}, {_cards_and_drafts(d)},
one AS (SELECT cid, min(k) AS k FROM card GROUP BY cid),
j AS (SELECT draft.id, card.k, trim(card.title) = trim(draft.title) AS same_title, CASE WHEN card.k IS NULL THEN 0e0 ELSE CAST({both} AS DOUBLE) / greatest(1, {d.size}(draft.tok) + {d.size}(card.tok) - {both}) END AS similarity FROM draft LEFT JOIN one ON one.cid = draft.cid LEFT JOIN card ON card.k = one.k)
SELECT id, k AS card, round(similarity, 6) AS similarity, CASE WHEN k IS NULL THEN 'insert' WHEN similarity >= 0.75e0 THEN 'absorb' WHEN same_title OR similarity >= 0.45e0 THEN 'update' ELSE 'conflict' END AS outcome FROM j"""


def q_policy(d):
    """Commands by mode and by two settings: whether high risks go to review, and whether files may be written."""
    rows = [(c, risk, mode, high, files) for risk, names in M.COMMANDS for c in names for mode in ("manual", "assisted", "guarded-auto", "agent-managed") for high in (0, 1) for files in (0, 1)]
    return f"""WITH {values('m', 'command, risk, automation, review_high, allow_writes', rows)}
SELECT command, risk, automation, CAST(review_high AS BIGINT) AS review_high, CAST(allow_writes AS BIGINT) AS allow_writes, CASE WHEN automation IN ('manual', 'assisted') THEN CASE WHEN risk = 'read-only' THEN 'execute' ELSE 'review-required' END
  WHEN automation = 'guarded-auto' AND risk = 'high' AND review_high = 1 THEN 'review-required' WHEN risk <> 'read-only' AND allow_writes = 0 THEN 'review-required' ELSE 'execute' END AS disposition FROM m"""


def q_jobs(d):
    return """WITH last_one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM <events>) x WHERE rk = 1),
top AS (SELECT * FROM last_one ORDER BY ts DESC, event_id DESC LIMIT 30)
SELECT user_id AS job, event_type, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM top"""


def q_dashboard(d):
    return f"{candidates(d)} SELECT (SELECT count(*) FROM chunk) AS observations, (SELECT count(*) FROM cand) AS candidates, (SELECT count(*) FROM cand WHERE confidence >= CAST(0.72 AS FLOAT)) AS high, (SELECT count(*) FROM statement) AS cards"


# -- artifacts


AGENTS = (("codex", 1), ("claude", 1), ("cursor", 0))


def _matrix():
    return values("agent", "agent, enabled", AGENTS) + f""",
ref AS (SELECT k, 'cursor' AS agent FROM statement WHERE k % 5 = 0),
pair AS (SELECT agent.agent, agent.enabled, statement.k, statement.body FROM agent CROSS JOIN statement),
listed AS (SELECT DISTINCT k FROM ref),
target AS (SELECT pair.agent, pair.k, pair.body, CASE WHEN listed.k IS NOT NULL THEN ref.k IS NOT NULL ELSE pair.enabled = 1 END AS targeted FROM pair LEFT JOIN listed ON listed.k = pair.k LEFT JOIN ref ON ref.k = pair.k AND ref.agent = pair.agent)"""


def q_targets(d):
    return f"{corpus(d)}, {_matrix()} SELECT agent, k, targeted FROM target"


def q_render(d):
    return f"{corpus(d)}, {_matrix()}, doc AS (SELECT agent, {d.listed('body', 'k')} AS content FROM target WHERE targeted GROUP BY agent) SELECT agent, content, {d.bytes_of}(content) > 32768 AS over_budget FROM doc"


def q_artifact_status(d):
    """Artifacts of the lock against the disk."""
    return f"""WITH lock AS (SELECT doc_id AS path, {d.sha('text')} AS h FROM <documents>),
disk AS (SELECT doc_id AS path, {d.sha("CASE WHEN doc_id % 3 = 0 THEN concat(text, '!') ELSE text END")} AS h FROM <documents> WHERE doc_id % 7 <> 0)
SELECT lock.path, CASE WHEN disk.path IS NULL THEN 'missing' WHEN disk.h = lock.h THEN 'synced' ELSE 'artifact drifted' END AS status FROM lock LEFT JOIN disk ON disk.path = lock.path"""


def q_line_diff(d):
    """Lines of a text that its rendered version lacks, as a multiset: every copy counts."""
    lines = d.pieces("text", "\n")
    return f"""WITH act AS (SELECT doc_id, {d.explode}({lines}) AS line FROM <documents>),
a AS (SELECT doc_id, line, count(*) AS n FROM act GROUP BY doc_id, line),
b AS (SELECT doc_id, line, n - CASE WHEN (doc_id + length(line)) % 7 = 0 THEN 1 ELSE 0 END AS n FROM a)
SELECT a.doc_id, a.line, a.n - coalesce(b.n, 0) AS missing FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.line = b.line WHERE a.n > coalesce(b.n, 0)"""


def q_rule_ci(d):
    tests = [("rules", "codex", "cargo test", 1), ("rules", "codex", "npm", 1), ("rules", "claude", "secret", 0), ("style", "claude", "Keep", 1), ("style", "cursor", "bearer", 0), ("style", "cursor", "zzz", 1)]
    return f"{corpus(d)}, {_matrix()}, {values('test', 'name, agent, needle, wanted', tests)}, doc AS (SELECT agent, {d.listed('body', 'k')} AS content FROM target WHERE targeted GROUP BY agent) SELECT name, test.agent, CAST(sum(CASE WHEN contains(content, needle) = (wanted = 1) THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN contains(content, needle) = (wanted = 1) THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM test JOIN doc ON doc.agent = test.agent GROUP BY name, test.agent"


def q_skill_ids(d):
    return f"WITH s AS (SELECT page_id, {slug(d, found(d, 'url', '//([^/?#]*)'))} AS base FROM <pages>), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS nth FROM s) SELECT page_id, CASE WHEN nth = 1 THEN base ELSE concat(base, '-', CAST(nth AS VARCHAR(20))) END AS skill_id FROM n"


def q_catalog(d):
    return f"{corpus(d)}, installed AS (SELECT DISTINCT conv_id % {N} AS k FROM chunk WHERE origin = 'artifact') SELECT statement.k, installed.k IS NOT NULL AS installed FROM statement LEFT JOIN installed ON installed.k = statement.k"


def q_projects(d):
    """Files of conversations by project: within its root, of another project, or unknown."""
    return """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE concat('/home/', source, '/', lang) END AS path FROM <documents>),
p AS (SELECT DISTINCT concat('/home/', source) AS root FROM <documents>)
SELECT CASE WHEN path IS NULL THEN 'unknown' WHEN root IS NOT NULL THEN root ELSE 'other' END AS project, count(*) AS n FROM f LEFT JOIN p ON regexp_replace(path, '/[a-z]+$', '') = root GROUP BY 1"""


def q_attribution(d):
    """A fact's observation: the first of its conversation that holds the fact, else its first one. Facts are what each text says last."""
    last = f"{d.first_of(d.each(d.kept(d.pieces('text', chr(10)), "trim(e) <> ''"), 'trim(e)'), 1)}"
    return f"""{corpus(d)}, fact0 AS (SELECT id, conv_id, {d.explode}({last}) AS quote FROM (SELECT id, conv_id, {d.replaced('text', '(?s)^.*' + chr(10))} AS text FROM chunk) x), fact AS (SELECT * FROM fact0 WHERE quote <> ''),
m AS (SELECT f.id, min(c.id) AS found FROM fact f JOIN chunk c ON c.conv_id = f.conv_id AND contains(c.text, f.quote) GROUP BY f.id),
o AS (SELECT conv_id, min(id) AS first_id FROM chunk GROUP BY conv_id)
SELECT f.id, coalesce(found, first_id) AS observation, found IS NOT NULL AS quoted FROM fact f LEFT JOIN m ON m.id = f.id JOIN o ON o.conv_id = f.conv_id"""


def q_observations(d):
    """Observations by content: the first of each id stays; the short id is the one of older files."""
    return f"""{corpus(d)}, b AS (SELECT id, origin, {redacted(d, 'text')} AS body FROM chunk), h AS (SELECT id, origin, body, {d.sha('body')} AS h FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY origin, h ORDER BY id) AS rk FROM h)
SELECT id, concat('obs:', origin, ':', h) AS observation_id, concat('obs:', origin, ':', substr(concat('sha256:', h), 1, 12)) AS compat_id FROM r WHERE rk = 1"""


# -- reports


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 1e0 ELSE CAST({a} AS DOUBLE) / {b} END"


def q_quality(d):
    """Expected quality against a length rule, by language: confusion counts, precision, recall, F1, kappa."""
    return f"""WITH x AS (SELECT lang, l.quality = 1 AS e, n_chars > 300 AS p FROM <labels> l JOIN <documents> USING (doc_id)),
n AS (SELECT lang, sum(CASE WHEN e AND p THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN NOT e AND p THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN e AND NOT p THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN NOT e AND NOT p THEN 1 ELSE 0 END) AS tn FROM x GROUP BY lang),
q AS (SELECT *, {_ratio('tp', '(tp + fp)')} AS precision_, {_ratio('tp', '(tp + fn)')} AS recall_, CAST(tp + fp + fn + tn AS DOUBLE) AS n FROM n),
k AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n) AS pe FROM q)
SELECT lang, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(precision_, 6) AS precision_, round(recall_, 6) AS recall_, round(CASE WHEN precision_ + recall_ = 0 THEN 0e0 ELSE 2 * precision_ * recall_ / (precision_ + recall_) END, 6) AS f1, round(CASE WHEN 1 - pe < 1e-9 THEN 1e0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM k"""


def q_votes(d):
    """Every vote on an item: the majority, ties keep; the mean of the scores there are."""
    return """WITH v AS (SELECT user_id AS item, event_id % 3 AS vote, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 10 AS DOUBLE) / 10 END AS score FROM <events>)
SELECT item, CAST(sum(CASE WHEN vote = 2 THEN 1 ELSE 0 END) AS BIGINT) AS rejects, count(*) AS votes, CASE WHEN 2 * sum(CASE WHEN vote = 2 THEN 1 ELSE 0 END) > count(*) THEN 'reject' ELSE 'keep' END AS decision, round(avg(score), 6) AS mean_score FROM v GROUP BY item"""


QUERIES = {
    "memory_gate": q_memory_gate,
    "quality_gate": q_quality_gate,
    "gc_candidates": q_gc,
    "kernel_assess": q_kernel_assess,
    "visible_candidates": q_visible,
    "contextual_penalty": q_contextual_penalty,
    "candidate_metadata": q_candidate_tags,
    "value_scores": q_value_scores,
    "preference_match": q_preferences,
    "feedback_penalty": q_feedback_penalty,
    "reflexion_patterns": q_reflexion,
    "feedback_gate": q_feedback_gate,
    "recurrence_counts": q_recurrence,
    "recurrence_boost": q_recurrence_boost,
    "candidate_status": q_candidate_status,
    "decision_tokens": q_token_use,
    "reviewable_drafts": q_reviewable,
    "approval_ladder": q_approval,
    "policy_matrix": q_policy,
    "job_latest_status": q_jobs,
    "dashboard_counts": q_dashboard,
    "target_matrix": q_targets,
    "instructions_render": q_render,
    "artifact_status": q_artifact_status,
    "line_multiset_diff": q_line_diff,
    "rule_ci": q_rule_ci,
    "skill_dedupe": q_skill_ids,
    "catalog_status": q_catalog,
    "project_match_replay": q_projects,
    "evidence_attribution": q_attribution,
    "observation_ids": q_observations,
    "quality_report": q_quality,
    "judge_vote": q_votes,
}
