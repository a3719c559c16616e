"""Terms that tie a text to one project, what texts mention, and tiers of the quality suite."""

from __future__ import annotations

from ..functions import markers as M
from ..functions.rules import Rules, any_of, quoted
from .corpus import corpus
from .generate import candidates, every, title
from .lifecycle import _ratio
from .mining import SPACES, _units, scored_rows

PUNCTUATION = "!-/:-@\\[-`{-~。，；：（）"


def specific(d, x: str) -> str:
    """Whether a trimmed token is a version, a name in capitals or one in camel case, of three bytes or more."""
    return f"({d.bytes_of}({x}) >= 3 AND {d.matches(x, '^([vV][0-9.]*[0-9][0-9.]*|[A-Z0-9_]*[A-Z][A-Z0-9_]*)$|[a-z][^a-z]*[A-Z]')})"


def specific_tokens(d, x: str) -> str:
    """An array of the tokens of a text that are specific for a project."""
    bare = d.replaced("e", f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$")
    return d.kept(d.each(d.all_of(x, f"[^{SPACES[1:-1]}]+"), bare), specific(d, "e"))


def forbidden(d, body: str, found: str) -> str:
    return f"({any_of(f'lower({body})', M.FORBIDDEN_TERMS, d)} OR {d.size}({found}) > 0)"


def q_specific_tokens(d):
    """Of each text the project's own terms, and whether they keep it from being a principle."""
    return f"{corpus(d)}, t AS (SELECT id, text, {specific_tokens(d, 'text')} AS found FROM chunk) SELECT id, {d.size}(found) AS n_specific, {d.join}(found, ' ') AS specific, {forbidden(d, 'text', 'found')} AS forbidden FROM t"


def _dynamic(d) -> str:
    """The corpus and CTE ``term``: the first 64, by name, of the specific terms that occur five times or more."""
    plain = ", ".join(quoted(t) for t in M.PLAIN_TERMS)
    bare = d.replaced("t", f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$")
    return f"""dt0 AS (SELECT {d.explode}({d.all_of('text', '[A-Za-z0-9_-]+')}) AS t FROM chunk),
dt1 AS (SELECT t, {bare} AS bare FROM dt0),
term AS (SELECT t AS term, count(*) AS n FROM dt1 WHERE {specific(d, 'bare')} AND lower(t) NOT IN ({plain}) GROUP BY t HAVING count(*) >= 5 ORDER BY t LIMIT 64)"""


def q_dynamic_terms(d):
    return f"{corpus(d)}, {_dynamic(d)} SELECT term, n FROM term"


def q_dynamic_filter(d):
    """Candidates without a term that the project uses often. The terms are one array of 64 at most."""
    return f"{candidates(d)}, {_dynamic(d)}, one AS (SELECT id, lower(body) AS low, (SELECT array_agg(lower(term)) FROM term) AS terms FROM cand) SELECT id FROM one WHERE coalesce({d.size}({d.kept('terms', 'contains(low, e)')}), 0) <= 0"


def q_mentions(d):
    """What sentences mention, and whether they speak of methods at all."""
    r = Rules(d)
    signal = dict(r.signals())
    named = ", ".join(f"{every(d, lists)} AS {name}" for name, lists, *_ in M.MENTIONS)
    either = " OR ".join(name for name, *_ in M.MENTIONS)
    three = " OR ".join(signal[s] for s in ("principle", "planning_heuristic", "collaboration_preference"))
    return f"{_units(d)}, m AS (SELECT id, {named}, {three} AS signalled FROM unit) SELECT *, (signalled OR {either}) AS has_method FROM m"


def suite_tier(d, x: str = "l") -> str:
    """The tier that the quality suite expects of a text; empty for task scopes."""
    r = Rules(d, x)
    return f"CASE WHEN {r.any(M.SUITE_NONE)} THEN '' WHEN {r.any(M.SUITE_TOGETHER)} THEN 'collaboration_preference' WHEN {r.any(M.SUITE_PRINCIPLE)} THEN 'cross_project_principle' ELSE 'project_rule' END"


def q_suite_tiers(d):
    return f"{corpus(d)} SELECT id, {suite_tier(d)} AS tier FROM chunk"


def q_quality_by_tier(d):
    """Sentences as cases of the quality suite: those that ask to be remembered are expected, those that score as candidates
    predicted. By tier the predicted ones, and precision among the ten best of all."""
    r = Rules(d)
    return f"""{scored_rows(d, _units(d), 'unit')},
q AS (SELECT id, score, {suite_tier(d)} AS tier, {r.strong()} AS expected, disposition = 'candidate' AS predicted FROM s),
top AS (SELECT * FROM q WHERE predicted ORDER BY score DESC, id LIMIT 10),
best AS (SELECT tier, count(*) AS shown, sum(CASE WHEN expected THEN 1 ELSE 0 END) AS hits FROM top GROUP BY tier),
mix AS (SELECT tier, sum(CASE WHEN predicted THEN 1 ELSE 0 END) AS predicted, sum(CASE WHEN expected THEN 1 ELSE 0 END) AS expected, sum(CASE WHEN predicted AND expected THEN 1 ELSE 0 END) AS hits FROM q GROUP BY tier)
SELECT mix.tier, CAST(mix.predicted AS BIGINT) AS predicted, CAST(mix.expected AS BIGINT) AS expected, round({_ratio('mix.hits', 'mix.expected')}, 6) AS recall_, coalesce(shown, 0) AS shown_in_10, CASE WHEN shown IS NULL THEN NULL ELSE round({_ratio('best.hits', 'shown')}, 6) END AS precision_at_10 FROM mix LEFT JOIN best ON best.tier = mix.tier"""


def q_abstracted(d):
    """Principles that texts of a project come to: the fixed wording of what a candidate mentions, where it is free of project terms.
    Confidence is at least 0.86; scores of durability, reusability and specificity are fixed."""
    named = d.array(*[f"CASE WHEN {every(d, lists, 'low')} THEN '{k}' END" for k, (_, lists, *_) in enumerate(M.MENTIONS)])
    fixed = ", ".join(f"('{k}', {quoted(t)}, {quoted(b)}, {quoted(tier)})" for k, (_, _, t, b, tier) in enumerate(M.MENTIONS))
    return f"""{candidates(d)}, spec AS (SELECT * FROM (VALUES {fixed}) AS v(k, title, body, tier)),
sp AS (SELECT k, title, body, tier, {forbidden(d, 'body', specific_tokens(d, 'body'))} AS tied FROM spec),
ab0 AS (SELECT id, confidence, lower(body) AS low FROM cand),
ab AS (SELECT id, confidence, {d.explode}({d.kept(named, 'e IS NOT NULL')}) AS k FROM ab0)
SELECT ab.id, {title(d, 'sp.body')} AS title, sp.body, sp.tier, round(CAST(greatest(confidence, CAST(0.86 AS FLOAT)) AS DOUBLE), 4) AS confidence, 0.86e0 AS durability, 0.92e0 AS reusability, 0.8e0 AS specificity FROM ab JOIN sp ON sp.k = ab.k WHERE NOT tied"""


QUERIES = {
    "specific_tokens": q_specific_tokens,
    "dynamic_terms": q_dynamic_terms,
    "dynamic_term_filter": q_dynamic_filter,
    "mentions": q_mentions,
    "suite_tiers": q_suite_tiers,
    "quality_by_tier": q_quality_by_tier,
    "abstracted_principles": q_abstracted,
}
