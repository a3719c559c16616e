"""Material of observations: lines worth keeping, entries cut in the middle, chunks of bounded size, previews without noise.

A run is a conversation, an observation one of its texts.
"""

from __future__ import annotations

from ..functions import markers as M
from ..functions.rules import Rules, any_of, starts
from .corpus import corpus
from .generate import candidate_id, candidates, every
from .mining import trimmed

CHUNK, TOTAL = 12_000, 48_000


def line_score(d, x: str) -> str:
    r = Rules(d, x)
    return f"greatest(2 * {r.count(M.METHOD_MARKS)} + {r.count(M.DURABLE_MARKS)} + 6 * {r.count(M.METHOD_LINE_MARKS)} - CASE WHEN {r.any(M.EXAMPLE_MARKS)} THEN 1 ELSE 0 END, 0)"


def _rich_lines(d) -> str:
    """The corpus and CTE ``rich``: trimmed lines of at least eight signs that speak of methods."""
    return f"""{corpus(d)},
ln0 AS (SELECT id, conv_id, turn, {d.explode}({d.pieces('text', chr(10))}) AS e FROM chunk),
ln1 AS (SELECT id, conv_id, turn, {trimmed(d, 'e')} AS line FROM ln0 WHERE {any_of('lower(e)', M.METHOD_RICH, d)}),
rich AS (SELECT *, lower(line) AS l FROM ln1 WHERE length(line) >= 8)"""


def _snippets(d) -> str:
    """``rich`` and CTE ``snip``: of each observation its eight best lines, joined."""
    return f"""{_rich_lines(d)},
sn0 AS (SELECT id, line, {line_score(d, 'l')} AS score FROM rich),
sn1 AS (SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY score DESC, length(line), line) AS rk FROM sn0),
snip AS (SELECT id, count(*) AS n_lines, {d.listed('line', 'rk')} AS snippets FROM sn1 WHERE rk <= 8 GROUP BY id)"""


def q_snippets(d):
    return f"{_snippets(d)} SELECT id, n_lines, snippets FROM snip"


def q_global_lines(d):
    """The 64 best different lines of all observations, without output of the tool itself."""
    bare = trimmed(d, d.replaced(d.replaced("line", "^[-* ]+"), "^[\"“”'`]+|[\"“”'`]+$"))
    return f"""{_rich_lines(d)},
gl0 AS (SELECT DISTINCT {bare} AS line FROM rich WHERE NOT {any_of('l', M.METHOD_ARTIFACT, d)} AND length(line) <= 180),
gl1 AS (SELECT line, CAST({line_score(d, 'lower(line)')} AS BIGINT) AS score FROM gl0 WHERE line <> ''),
gl2 AS (SELECT * FROM gl1 ORDER BY score DESC, length(line), line LIMIT 64)
SELECT line, score, row_number() OVER (ORDER BY score DESC, length(line), line) AS place FROM gl2"""


def _cuts(d, x: str):
    """SQL for a part of a text by bytes, and for a test whether the byte at a place (from 1) continues a sign."""
    if d.__name__ == "Spark":
        raw = f"CAST({x} AS BINARY)"
        part = lambda at, n: f"decode(substring({raw}, {at}, {n}), 'UTF-8')"
        byte = lambda at: f"hex(substring({raw}, {at}, 1))"
    else:
        raw = f"encode({x})"
        part = lambda at, n: f"decode({raw}[CAST({at} AS BIGINT):CAST({at} AS BIGINT) + {n} - 1])"
        byte = lambda at: f"hex({raw}[{at}:{at}])"
    return part, lambda at: f"{byte(at)} BETWEEN '80' AND 'BF'"


def _head(d, x: str, n: int) -> str:
    """The whole signs within the first n bytes of a longer text."""
    part, inside = _cuts(d, x)
    return "CASE " + " ".join(f"WHEN NOT ({inside(n + 1 - k)}) THEN {part(1, n - k)}" for k in range(4)) + " END"


def head_bytes(d, x: str, n: int) -> str:
    return f"CASE WHEN {d.bytes_of}({x}) <= {n} THEN {x} ELSE {_head(d, x, n)} END"


def middle_cut(d, x: str, head: int, tail: int) -> str:
    """A text of more than head + tail + 32 bytes as its first and last bytes at whole signs; others as they are."""
    part, inside = _cuts(d, x)
    size = f"{d.bytes_of}({x})"
    at = [f"({size} - {tail - k - 1})" for k in range(4)]
    last = "CASE " + " ".join(f"WHEN NOT ({inside(p)}) THEN {part(p, tail - k)}" for k, p in enumerate(at)) + " END"
    return f"CASE WHEN {size} <= {head + tail + 32} THEN {x} ELSE concat({_head(d, x, head)}, {d.text(chr(10) + '...' + chr(10))}, {last}, {d.text(chr(10))}) END"


def entry(d, source: str, agent: str, evidence: str, body: str) -> str:
    nl = lambda s: d.text(s)
    return f"concat({nl(chr(10) + '---' + chr(10) + 'source: ')}, {source}, {nl(chr(10) + 'agent: ')}, coalesce({agent}, 'unknown'), {nl(chr(10) + 'evidence: ')}, {evidence}, {nl(chr(10) + 'text:' + chr(10))}, {body}, {nl(chr(10))})"


def q_entries(d):
    """Documents as entries of material: more than 4,000 bytes keep the first and the last 2,000."""
    body = f"CASE WHEN {d.bytes_of}(body) > 4000 THEN {middle_cut(d, 'body', 2000, 2000)} ELSE body END"
    made = entry(d, "coalesce(source, '')", "lang", "CAST(doc_id AS VARCHAR(20))", body)
    return f"""WITH b AS (SELECT doc_id, source, lang, replace(coalesce(text, ''), chr(0), '') AS body FROM <documents>),
e AS (SELECT doc_id, {made} AS entry FROM b)
SELECT doc_id, {d.bytes_of}(entry) AS bytes, {d.sha('entry')} AS entry_sha256 FROM e"""


def _compact(d) -> str:
    """``snip`` and CTE ``ce``: short entries of observations, of their best lines if they have any."""
    body = f"CASE WHEN {d.bytes_of}(body) > 1200 THEN {middle_cut(d, 'body', 700, 500)} ELSE body END"
    return f"""{_snippets(d)},
cb AS (SELECT chunk.id, conv_id, turn, origin, coalesce(snippets, replace(text, chr(0), '')) AS body FROM chunk LEFT JOIN snip ON snip.id = chunk.id),
ce AS (SELECT id, conv_id, turn, {entry(d, 'origin', 'NULL', 'CAST(id AS VARCHAR(20))', body)} AS entry FROM cb)"""


def q_compact(d):
    return f"{_compact(d)} SELECT id, {d.bytes_of}(entry) AS bytes, {d.sha('entry')} AS entry_sha256 FROM ce"


def q_chunks(d):
    """Entries of a run, latest first, packed into chunks of 12,000 bytes until 48,000 are full.

    An entry has at most some 1,400 bytes, so no entry after the first 70,000 bytes can be packed: a running sum over the run cuts
    there, and the array that is folded stays short however long the run is.
    """
    upto = f"""{_compact(d)},
pk0 AS (SELECT id, conv_id AS run, {d.bytes_of}(entry) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, id) AS rk FROM ce),
pk1 AS (SELECT *, sum(bytes) OVER (PARTITION BY run ORDER BY rk ROWS UNBOUNDED PRECEDING) AS upto FROM pk0),
pk AS (SELECT run, id, rk, bytes FROM pk1 WHERE upto - bytes < 70000)"""
    if d.__name__ == "Spark":
        state = "named_struct('size', 0L, 'total', 0L, 'chunk', 0L, 'out', CAST(array() AS array<struct<id:bigint,chunk:bigint>>))"
        full = f"a.size > 0 AND a.size + e.bytes > {CHUNK}"
        total = f"CASE WHEN {full} THEN a.total + a.size ELSE a.total END"
        nth = f"CASE WHEN {full} THEN a.chunk + 1 ELSE a.chunk END"
        size = f"CASE WHEN {full} THEN e.bytes ELSE a.size + e.bytes END"
        step = f"CASE WHEN {total} >= {TOTAL} THEN named_struct('size', 0L, 'total', {total}, 'chunk', a.chunk, 'out', a.out) ELSE named_struct('size', {size}, 'total', {total}, 'chunk', {nth}, 'out', array_append(a.out, named_struct('id', e.id, 'chunk', {nth}))) END"
        fold = f"aggregate(array_sort(collect_list(struct(rk, id, CAST(bytes AS BIGINT) AS bytes))), {state}, (a, e) -> {step}, a -> a.out)"
        return f"{upto}, f AS (SELECT run, {fold} AS packed FROM pk GROUP BY run), x AS (SELECT run, explode(packed) AS p FROM f) SELECT run, p.id AS id, p.chunk AS chunk FROM x"
    full = f"s.size > 0 AND s.size + pk.bytes > {CHUNK}"
    return f"""{upto},
walk AS (SELECT run, rk, id, bytes AS size, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS chunk FROM pk WHERE rk = 1
  UNION ALL SELECT pk.run, pk.rk, pk.id, CASE WHEN {full} THEN pk.bytes ELSE s.size + pk.bytes END, CASE WHEN {full} THEN s.total + s.size ELSE s.total END, CASE WHEN {full} THEN s.chunk + 1 ELSE s.chunk END
  FROM walk s JOIN pk ON pk.run = s.run AND pk.rk = s.rk + 1 WHERE CASE WHEN {full} THEN s.total + s.size ELSE s.total END < {TOTAL})
SELECT run, id, chunk FROM walk"""


def noise(d) -> str:
    """Over columns cid (the candidate's id), title and body."""
    low = "lower(concat(cid, chr(10), title, chr(10), body))"
    return f"({starts('cid', M.PREVIEW_IDS)} OR {' OR '.join(every(d, lists, low) for lists in M.PREVIEW_NOISE)})"


def q_preview_noise(d):
    """Previews of candidates: which are noise, and which repeat texts of generated cards."""
    card = any_of("lower(concat(title, chr(10), body, chr(10), reason))", M.GENERATED_CARDS, d)
    return f"{candidates(d)}, p AS (SELECT id, title, body, reason, {candidate_id(d)} AS cid FROM cand) SELECT id, {noise(d)} AS noise, {card} AS generated FROM p"


def q_preview_order(d):
    """Previews of a run without noise, surest first; and the five that an agent is shown, by title among equals."""
    return f"""{candidates(d)}, p0 AS (SELECT id, conv_id AS run, title, body, confidence, {candidate_id(d)} AS cid FROM cand), p AS (SELECT * FROM p0 WHERE NOT {noise(d)}),
r AS (SELECT run, id, cid, row_number() OVER (PARTITION BY run ORDER BY confidence DESC, cid, id) AS place, row_number() OVER (PARTITION BY run ORDER BY confidence DESC, lower(title), id) AS shown FROM p)
SELECT run, id, cid AS candidate_id, place, shown <= 5 AS for_agent FROM r"""


def q_file_prompts(d):
    """Texts that are briefs for work on named files."""
    r = Rules(d)
    return f"{corpus(d)}, p AS (SELECT id, {r.any(M.FILE_SCOPE)} AS scoped, {r.any(M.FILE_ACTION)} AS acts FROM chunk) SELECT id, scoped, scoped AND acts AS file_scoped FROM p"


QUERIES = {
    "methodology_snippets": q_snippets,
    "methodology_lines_top64": q_global_lines,
    "material_entries": q_entries,
    "compact_entries": q_compact,
    "material_chunks": q_chunks,
    "preview_noise": q_preview_noise,
    "preview_order": q_preview_order,
    "file_scoped_prompts": q_file_prompts,
}
