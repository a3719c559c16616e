"""Text functions, signals, gates, classification and scoring as queries."""

from __future__ import annotations

from ..functions import markers as M
from ..functions.rules import Rules
from .corpus import corpus

CJK = "一-鿿"
SPACES = "[ \t\n\r\x0b\x0c  -   　]"


def trimmed(d, x: str) -> str:
    return d.replaced(x, f"^{SPACES}+|{SPACES}+$")


def redacted(d, x: str) -> str:
    for p in M.REDACTIONS:
        x = d.replaced(x, p, "[REDACTED]")
    return x


def slug(d, x: str) -> str:
    dashed = d.replaced(d.replaced(f"lower({x})", f"[^a-z0-9{CJK}]+", "-"), "^-+|-+$")
    return f"coalesce(nullif(substr({dashed}, 1, 48), ''), 'draft')"


def tokens(d, x: str) -> str:
    """The sorted set of tokens: runs of at least two ASCII letters or digits, runs of CJK signs."""
    return f"{d.sort}({d.distinct}({d.all_of(f'lower({x})', f'([a-z0-9]{{2,}}|[{CJK}]+)', 1)}))"


def sentences(d, x: str) -> str:
    """Sentences, trimmed and not empty; dots between letters or digits do not end one."""
    safe = d.replaced(d.replaced(x, f"([A-Za-z0-9]{SPACES}*)[.]([A-Za-z0-9])", "$1\x01$2" if d.__name__ == "Spark" else "\\1\x01\\2"), f"([A-Za-z0-9]{SPACES}*)[.]([A-Za-z0-9])", "$1\x01$2" if d.__name__ == "Spark" else "\\1\x01\\2")
    parts = d.each(d.pieces(safe, "[\n。！？!?.]"), trimmed(d, f"replace(e, {d.text(chr(1))}, '.')"))
    return d.kept(parts, "e <> ''")


def jaccard(d, a: str, b: str) -> str:
    """Over two token arrays."""
    shared = f"{d.size}({d.intersect}({a}, {b}))"
    return f"CASE WHEN {d.size}({a}) = 0 AND {d.size}({b}) = 0 THEN CAST(1 AS DOUBLE) WHEN {d.size}({a}) = 0 OR {d.size}({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({shared} AS DOUBLE) / ({d.size}({a}) + {d.size}({b}) - {shared}) END"


def once(d, x: str) -> str:
    """A value that is computed in its own step: as rows of a one-element array. Later steps use it several times, and merged
    into them its long expression would be copied again and again."""
    return f"{d.explode}({d.array(x)})"


def _units(d) -> str:
    """The corpus and CTE ``unit``: its sentences. An id is the text's id and six digits of place."""
    return f"""{corpus(d)},
u0 AS (SELECT id, conv_id, turn, origin, {sentences(d, 'text')} AS parts FROM chunk),
u1 AS (SELECT id, conv_id, turn, origin, {d.placed('parts')} FROM u0),
unit AS (SELECT id * 1000000 + place AS id, conv_id, turn, origin, e AS text, lower(e) AS l FROM u1)"""


def classified(d) -> str:
    """The corpus and CTE ``c``: classification and the gate's reason of its texts."""
    return classified_rows(d, corpus(d), "chunk")


def classified_rows(d, source: str, rows: str) -> str:
    """CTE ``c`` over the rows that ``source`` defines."""
    r = Rules(d)
    return f"""{source},
c1 AS (SELECT *, {once(d, r.signal())} AS signal, {r.gate()} AS gate FROM {rows}),
c2 AS (SELECT *, {r.artifact('signal')} AS artifact_kind FROM c1),
c3 AS (SELECT *, {once(d, r.hardness('signal', 'artifact_kind'))} AS hardness, {r.activation('artifact_kind')} AS activation FROM c2),
c AS (SELECT *, {r.control('signal', 'hardness')} AS control FROM c3)"""


def scored(d) -> str:
    return scored_rows(d, corpus(d), "chunk")


def scored_rows(d, source: str, rows: str) -> str:
    """Classified rows and CTE ``s``: terms, score and disposition. Floats are added in the order of the terms' names."""
    terms = Rules(d).terms()
    total = terms[0][0]
    for name, _ in terms[1:]:
        total = f"({total} + {name})"
    out = "gate IS NOT NULL OR signal = ''"
    return f"""{classified_rows(d, source, rows)},
t AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in terms)} FROM c),
s0 AS (SELECT *, {once(d, f'CASE WHEN {out} THEN CAST(0 AS FLOAT) ELSE {total} END')} AS score FROM t),
s AS (SELECT *, CASE WHEN {out} THEN 'reject' WHEN score >= CAST(3.2 AS FLOAT) THEN 'candidate' WHEN score >= CAST(2.4 AS FLOAT) THEN 'borderline' ELSE 'reject' END AS disposition,
  CASE WHEN gate IS NOT NULL THEN '' ELSE signal END AS matched_signal FROM s0)"""


def q_redact_documents(d):
    return f"SELECT doc_id, {d.sha('body')} AS body_sha, body <> text AS redacted FROM (SELECT doc_id, text, {redacted(d, 'text')} AS body FROM <documents>) x"


def q_redact_pages(d):
    return f"SELECT page_id, {d.sha('body')} AS body_sha, body <> html AS redacted FROM (SELECT page_id, html, {redacted(d, 'html')} AS body FROM <pages>) x"


def q_redact_corpus(d):
    return f"{corpus(d)} SELECT id, {redacted(d, 'text')} AS body, {redacted(d, 'text')} <> text AS redacted FROM chunk"


def q_slugs(d):
    return f"{corpus(d)} SELECT id, {slug(d, 'text')} AS slug, concat('project:', {slug(d, 'text')}) AS candidate_id FROM chunk"


def q_tokens(d):
    return f"{corpus(d)} SELECT id, {d.join}({tokens(d, 'text')}, ' ') AS tokens, {d.size}({tokens(d, 'text')}) AS n FROM chunk"


def q_lists(d):
    pieces = d.each(d.pieces("text", "[,;，；]"), trimmed(d, "e"))
    kept = d.kept(pieces, "e <> ''")
    return f"{corpus(d)} SELECT id, {d.join}({d.sort}({d.distinct}({kept})), '|') AS items FROM chunk"


def q_paragraphs(d):
    parts = d.kept(d.each(d.pieces("text", "\n\n"), trimmed(d, "e")), "e <> ''")
    return f"{corpus(d)} SELECT id, {d.size}({parts}) AS n, {d.join}({parts}, '¶') AS paragraphs FROM chunk"


def q_sentences(d):
    return f"{corpus(d)} SELECT id, {d.size}({sentences(d, 'text')}) AS n, {d.join}({sentences(d, 'text')}, '¶') AS sentences FROM chunk"


def _sentence_rows(d):
    return f"{corpus(d)}, sent0 AS (SELECT id, {d.explode}({sentences(d, 'text')}) AS sentence FROM chunk), sent AS (SELECT id, sentence, lower(sentence) AS l FROM sent0)"


def q_signals(d):
    r = Rules(d)
    named = d.array(*[f"CASE WHEN {c} THEN '{n}' END" for n, c in r.signals()])
    return f"{_sentence_rows(d)} SELECT id, sentence, {d.join}({d.kept(named, 'e IS NOT NULL')}, ',') AS signals FROM sent"


def q_paragraph_signals(d):
    """Signals of whole paragraphs, which may hold several sentences, and whether a paragraph is of low value."""
    r = Rules(d)
    named = d.array(*[f"CASE WHEN {c} THEN '{n}' END" for n, c in r.signals()])
    parts = d.kept(d.each(d.pieces("text", "\n\n"), trimmed(d, "e")), "e <> ''")
    return f"{corpus(d)}, para0 AS (SELECT id, {d.placed(parts)} FROM chunk), para AS (SELECT id, place, lower(e) AS l FROM para0) SELECT id, CAST(place AS BIGINT) AS place, {d.join}({d.kept(named, 'e IS NOT NULL')}, ',') AS signals, {r.low_value()} AS low_value FROM para"


def q_signal_counts(d):
    r = Rules(d)
    sums = ", ".join(f"CAST(sum(CASE WHEN f_{n} THEN 1 ELSE 0 END) AS BIGINT) AS n_{n}" for n, _ in r.signals())
    flags = ", ".join(f"{c} AS f_{n}" for n, c in r.signals())
    return f"{_sentence_rows(d)}, f AS (SELECT {r.low_value()} AS low_value, {flags} FROM sent) SELECT low_value, count(*) AS n, {sums} FROM f GROUP BY low_value"


def q_low_value(d):
    r = Rules(d)
    return f"{_sentence_rows(d)} SELECT id, sentence, {r.any(M.NOISE)} AS noise, {r.monologue()} AS monologue, {r.one_off()} AS one_off, {r.unresolved()} AS unresolved, {r.explicit()} AS explicit_memory, {r.strong()} AS strong_memory, {r.low_value()} AS low_value FROM sent"


def q_code_blocks(d):
    r = Rules(d)
    return f"{corpus(d)} SELECT id, CAST({d.size}({r.lines()}) AS BIGINT) AS lines, CAST({r.code_lines()} AS BIGINT) AS code, {r.code_block()} AS is_code FROM chunk"


def q_gate(d):
    return f"{corpus(d)} SELECT id, coalesce({Rules(d).gate()}, 'future-value-gate-passed') AS reason, {Rules(d).gate()} IS NULL AS passed FROM chunk"


def q_classify(d):
    rationale = "CASE WHEN signal = '' THEN 'rejected' ELSE concat('Classified as ', signal, ' for ', artifact_kind, ' with ', hardness, ' hardness.') END"
    return f"{classified(d)} SELECT id, signal, artifact_kind, hardness, activation, control, {rationale} AS rationale FROM c"


def _tags(d):
    return f"CASE WHEN signal = '' THEN {d.kept(d.array(chr(39) * 2), 'e <> ' + chr(39) * 2)} ELSE {d.sort}({d.distinct}({d.kept(Rules(d).tags(), 'e IS NOT NULL')})) END"


def q_tags(d):
    return f"{classified(d)} SELECT id, {d.join}({_tags(d)}, ',') AS tags FROM c"


def q_tag_counts(d):
    return f"{classified(d)}, g AS (SELECT id, {d.explode}({_tags(d)}) AS tag FROM c) SELECT tag, count(*) AS n FROM g GROUP BY tag"


def q_score_terms(d):
    names = [n for n, _ in Rules(d).terms()]
    return f"{scored(d)} SELECT id, {', '.join(f'round(CAST({n} AS DOUBLE), 4) AS {n}' for n in names)} FROM s WHERE gate IS NULL AND signal <> ''"


def q_scores(d):
    return f"{scored(d)} SELECT id, round(CAST(score AS DOUBLE), 4) AS score, disposition, matched_signal, gate FROM s"


def q_disposition_mix(d):
    return f"{scored(d)} SELECT origin, disposition, matched_signal, count(*) AS n, round(avg(CAST(score AS DOUBLE)), 6) AS mean_score FROM s GROUP BY origin, disposition, matched_signal"


def q_weak_rules(d):
    return f"{_sentence_rows(d)}, w AS (SELECT l AS body_key, min(id) AS first_id, count(*) AS n, max(CASE WHEN {Rules(d).explicit()} THEN 1 ELSE 0 END) AS marked FROM sent WHERE {d.bytes_of}(sentence) BETWEEN 18 AND 220 AND NOT {Rules(d).low_value()} GROUP BY l) SELECT body_key, first_id, n, marked = 1 AS marked FROM w WHERE n >= 2 OR marked = 1"


# -- similarity


def _cards(d):
    """Cards: the statements; items: all sentences. Both with the tokens of their whole texts; ``sim`` has the pairs that share one."""
    return f"""{_units(d)},
card AS (SELECT k AS card_id, body, {tokens(d, 'body')} AS tok FROM statement),
item AS (SELECT id, text, {tokens(d, 'text')} AS tok FROM unit),
ct AS (SELECT card_id, {d.explode}(tok) AS t FROM card),
it AS (SELECT id, {d.explode}(tok) AS t FROM item),
shared AS (SELECT it.id, ct.card_id, count(*) AS n FROM it JOIN ct ON it.t = ct.t GROUP BY it.id, ct.card_id),
sim AS (SELECT s.id, s.card_id, CAST(s.n AS DOUBLE) / ({d.size}(i.tok) + {d.size}(c.tok) - s.n) AS similarity FROM shared s JOIN item i ON i.id = s.id JOIN card c ON c.card_id = s.card_id)"""


def q_similar_top5(d):
    return f"{_cards(d)} SELECT id, card_id, rk, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, card_id) AS rk FROM sim WHERE similarity >= 0.35) x WHERE rk <= 5"


def q_jaccard_pairs(d):
    """Similarity of every sentence and card that share a token; all other pairs have none."""
    return f"{_cards(d)} SELECT id, card_id, round(similarity, 6) AS similarity FROM sim"


QUERIES = {
    "redact_secrets_documents": q_redact_documents,
    "redact_secrets_pages": q_redact_pages,
    "redact_secrets_corpus": q_redact_corpus,
    "slug_titles": q_slugs,
    "tokenize_sets": q_tokens,
    "normalize_lists": q_lists,
    "split_paragraphs": q_paragraphs,
    "split_sentences": q_sentences,
    "sentence_signals": q_signals,
    "paragraph_signals": q_paragraph_signals,
    "signal_counts": q_signal_counts,
    "low_value_filter": q_low_value,
    "code_block_filter": q_code_blocks,
    "future_value_gate": q_gate,
    "classify_chunks": q_classify,
    "classification_tags": q_tags,
    "tag_domain_counts": q_tag_counts,
    "score_breakdown": q_score_terms,
    "score_disposition": q_scores,
    "disposition_mix": q_disposition_mix,
    "weak_rule_recurrence": q_weak_rules,
    "top5_similar": q_similar_top5,
    "jaccard_pairs": q_jaccard_pairs,
}
