"""Queries see whole inputs, compared with what plain Python finds."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from loamworks.functions import markers
from loamworks.operators import dedupe
from loamworks.operators.cosine import cosine_top
from loamworks.plans import registry
from loamworks.plans.corpus import STATEMENTS

RULE = "Never push to main without a review because a broken build blocks everyone"


@pytest.fixture(scope="module")
def long_rows(spark, tmp_path_factory):
    """Conversations whose rule stands behind 900 characters of other text."""
    folder = tmp_path_factory.mktemp("long")
    filler = "plain words of no weight. " * 35
    rows = [(i, 0, "user", f"{filler}{RULE} {i}. Last words.") for i in range(24)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder), rows


def test_whole_texts(spark, long_rows):
    folder, rows = long_rows
    got = {r["id"]: r["tokens"].split() for r in registry.queries()["tokenize_sets"](spark, folder).collect()}
    assert all({"review", "blocks", "last"} <= set(got[i * 1000]) for i, *_ in rows)
    paragraphs = registry.queries()["split_paragraphs"](spark, folder).collect()
    assert all(r["paragraphs"].endswith("Last words.") for r in paragraphs)


def test_candidates_by_sentence(spark, long_rows):
    folder, rows = long_rows
    got = {r["body"] for r in registry.queries()["candidates_local"](spark, folder).collect()}
    assert {f"{RULE} {i}" for i, *_ in rows} <= got
    assert all("\n" not in b for b in got)


def test_every_row_is_a_cosine_query(spark):
    rnd = np.random.default_rng(3)
    x = rnd.integers(-2, 3, (60, 4)).astype(float)  # many ties, and vectors of zeros
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    long = np.linalg.norm(x, axis=1)
    sims = np.where(np.outer(long, long) > 0, x @ x.T / np.maximum(np.outer(long, long), 1e-300), 0)
    want = {(q, c, rk) for q in range(60) for rk, c in enumerate(sorted((c for c in range(60) if c != q), key=lambda c: (-round(sims[q, c], 9), c))[:5], 1)}
    for block_rows in (2048, 13):
        assert {(r["query_id"], r["vec_id"], r["rk"]) for r in cosine_top(df, block_rows=block_rows).collect()} == want
    assert cosine_top(df.filter("false")).count() == 0


def test_every_event_counts(spark):
    """Sums over results against the table itself."""
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").collect()
    run = lambda name: registry.queries()[name](spark, sf).collect()
    assert sum(r["votes"] for r in run("judge_vote")) == sum(r["n"] for r in run("hooks_compile")) == len(events)
    rejections = Counter(e["user_id"] % 24 for e in events if e["event_type"] == "error")
    assert {r["k"]: r["rejections"] for r in run("feedback_penalty")} == {k: n for k, n in rejections.items() if n >= 2}
    assert [(r["k"], r["c"]) for r in sorted(run("reflexion_patterns"), key=lambda r: r["place"])] == sorted(((k, n) for k, n in rejections.items() if n >= 3), key=lambda x: (-x[1], x[0]))[:10]
    status, kinds = {e["user_id"]: ("candidate", None) for e in events}, {"error": "rejected", "purchase": "promoted", "view": "hidden"}
    for e in events:
        if status[e["user_id"]][0] == "candidate" and e["event_type"] in kinds:
            status[e["user_id"]] = (kinds[e["event_type"]], e["event_id"])
    assert {r["candidate"]: (r["status"], r["by_event"]) for r in run("candidate_status")} == status
    insight = run("evolution_insight")
    assert insight and all(r["confidence"] == min(0.95, round(0.48 + 0.07 * r["drafts"] + 0.08 * r["agents"] + 1e-9, 2)) for r in insight)
    assert all((r["activity"] == "active") == (r["drafts"] > 0 or r["agents"] >= 2) for r in insight)
    sources = {r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    last = {f"src{e['user_id'] % 40}": e["event_id"] for e in sorted(events, key=lambda e: e["event_id"])}
    found = {r["path"]: r["seq"] - 1000000 for r in run("registry_dedupe") if r["origin"] == "discovered"}
    assert found == last and {r["path"] for r in run("registry_dedupe")} == set(last) | sources


def test_signatures_of_whole_bodies(spark, tmp_path):
    start = "Never push to main without a review because"
    texts = [f"{start} a broken build blocks everyone", f"{start} a broken build annoys customers", f"{start} a broken  build blocks everyone"]
    spark.createDataFrame([(24, t, "user", x) for t, x in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    ids = {r["id"] // 2000000: r["id"] for r in registry.queries()["candidates_local"](spark, str(tmp_path)).collect() if r["body"].startswith(start)}
    got = {r["id"]: r["signature"] for r in registry.queries()["recurrence_boost"](spark, str(tmp_path)).collect()}
    one, other, copy = (got[ids[24000 + t]] for t in range(3))
    assert one == copy != other
    # the same signature by hand: 24 replacements, tokens, hash
    signed = set()
    for kind in ("constraint",):
        text = f"{kind} {texts[0].lower()}"
        for old, new in markers.SIGNED:
            text = text.replace(old, new)
        signed.add("sig:sha256-" + hashlib.sha256(" ".join(sorted(dedupe.tokens(text))).encode()).hexdigest()[:9])
    assert one in signed


def test_cards_meet_whole_sentences(spark, long_rows):
    folder, rows = long_rows
    pairs = {(r["id"], r["card_id"]): r["similarity"] for r in registry.queries()["jaccard_pairs"](spark, folder).collect()}
    assert len({i // 1000000 for i, _ in pairs}) == len(rows)
    want = dedupe.jaccard(dedupe.tokens(f"{RULE} 13"), dedupe.tokens(STATEMENTS[8]))
    assert any(i // 1000000 == 13000 and c == 8 and abs(s - want) < 1e-6 for (i, c), s in pairs.items())


def test_vectors_of_other_widths_are_not_similar(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0])]
    got = {(r.query_id, r.vec_id): r.similarity for r in cosine_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1, 3] == 1.0 and got[1, 2] == got[2, 3] == got[1, 4] == 0.0
