import json
import random
import sys

import pytest
from loamworks.operators import asking as A
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # providers of this file go to the tasks

ROWS = "run long, seq long, text string"
CANDIDATES = "run long, seq long, title string, body string, kind string, scope string, memory_tier string, template string, confidence double, reason string"


def item(text, **more):
    return {"title": "t", "body": text, "kind": "preference", "confidence": 0.9, "is_noise": False} | more


@pytest.mark.parametrize(("text", "want"), [("[1, 2]", [1, 2]), ('so: [{"a": [1]}] done', [{"a": [1]}]), ('{"items": [1]}', [1])])
def test_salvage(text, want):
    assert A.salvage(text) == want


@pytest.mark.parametrize("text", ["", None, "no array", "] [", "[1, 2", '{"a": 1}'])
def test_salvage_gives_up(text):
    with pytest.raises(ValueError):
        A.salvage(text)


def test_items_need_their_fields():
    assert A.read_items(json.dumps([item("b", confidence=1)]))[0]["confidence"] == 1.0
    for wrong in ({"title": None}, {"confidence": "high"}, {"is_noise": 0}, {"kind": 3}):
        with pytest.raises(ValueError, match="item 0 lacks"):
            A.read_items(json.dumps([item("b") | wrong]))


def test_batches_keep_order_and_fail_as_a_whole(spark):
    def provider(role, items):
        assert role == "extract" and len(items) <= 20 and [x["index"] for x in items] == list(range(len(items)))
        if any(x["text"] == "break" for x in items):
            raise RuntimeError("unavailable")
        if any(x["text"] == "garble" for x in items):
            return "no array here"
        return json.dumps([item(x["text"]) for x in items for _ in range(2 if x["text"].endswith("0") else 1)])

    rows = [(run, i * 7, f"text {run} {i}") for run in (1, 2, 3) for i in range(45)]
    rows[45 + 30] = (2, 30 * 7, "break")
    rows[90 + 2] = (3, 2 * 7, "garble")
    rnd = random.Random(1)
    rnd.shuffle(rows)
    items, failed = A.extract(spark.createDataFrame(rows, ROWS).repartition(5), provider)
    got = [r.body for r in items.orderBy("run", "place").collect()]
    assert got == [f"text 1 {i}" for i in range(45) for _ in range(2 if i % 10 == 0 else 1)]
    errors = {r.run: r.error for r in failed.collect()}
    assert set(errors) == {2, 3} and "unavailable" in errors[2] and "array" in errors[3]


def test_usable(spark):
    rows = [item("good"), item("x" * 401), item(" "), item("a", title=" "), item("b", confidence=0.5), item("c", is_noise=True), item("é" * 200)]
    df = spark.createDataFrame([(r["title"], r["body"], r["kind"], r["confidence"], r["is_noise"]) for r in rows], "title string, body string, kind string, confidence double, is_noise boolean")
    assert sorted(r.body for r in A.usable(df).collect()) == sorted(["good", "é" * 200])


def test_votes(spark):
    answers = {
        "clear": [{"decision": "keep", "reason": "r", "noise_risk": 0.1}],
        "split": [{"decision": "reject", "reason": "a", "noise_risk": 0.5}, {"decision": "keep", "reason": "", "noise_risk": 0.3}, {"decision": "keep", "reason": "c", "noise_risk": 0.1}],
        "lost": [{"decision": "keep", "reason": "a", "evidence_grounded": 0.6}, {"decision": "reject", "reason": "b"}, {"decision": "reject", "reason": "c"}],
        "noisy": [{"decision": "keep", "reason": "a", "noise_risk": 0.9}],
        "bare": [{"decision": "keep", "reason": "a", "evidence_grounded": 0.3}],
        "own": [{"decision": "keep", "reason": "a", "evidence_grounded": 0.3}],
        "wrong": [{"decision": "maybe"}],
    }
    rows = [(1, i, k, "e", "project_rule" if k == "own" else "collaboration_preference") for i, k in enumerate(answers)]
    provider = lambda role, items: json.dumps(answers[items[0]["body"]][items[0]["vote"]])
    got = {r.body: (r.votes, r.judged, r.verdict_reason) for r in A.judge(spark.createDataFrame(rows, "run long, place int, body string, evidence string, memory_tier string"), provider).collect()}
    assert {k: v[:2] for k, v in got.items()} == {"clear": (1, True), "split": (3, True), "lost": (3, False), "noisy": (1, False), "bare": (1, False), "own": (1, True), "wrong": (0, True)}
    assert got["split"][2] == "a; c" and got["lost"][2] == "a; b; c"
    assert abs(A.combined(answers["split"])["noise_risk"] - 0.3) < 1e-9 and A.combined(answers["lost"])["evidence_grounded"] == 0.6


def test_patches_go_by_index(spark):
    rows = [(run, i, f"title {i}", f"body of number {i} that is long", "preference", "project", "project_rule", "t", 0.7, "r") for run in (1, 2) for i in range(25)]

    def provider(role, items):
        if any("number 24 " in x["body"] for x in items):
            raise RuntimeError("gone")
        assert len(items) == 20
        patch = lambda i, **more: {"index": i, "decision": "keep", "reason": "", "title": None, "body": None} | more
        return json.dumps({"items": [patch(7, body="When seven, do the long thing"), patch(3, decision="reject"), patch(5, kind="odd", memory_tier="cross_project_principle", confidence=7, reason="why"), patch(9, body="short"), patch(4, title="first"), patch(4, title="last"), patch(99)]})

    df = spark.createDataFrame(rows, CANDIDATES).repartition(4)
    got = {(r.run, r.seq): r for r in A.refine(df, provider).collect()}
    assert len(got) == 48 and (1, 3) not in got
    assert got[2, 7].body == "When seven, do the long thing" and got[2, 7].title == "When seven, do the long thing" and got[2, 7].template == "llm-memory-refine"
    r = got[1, 5]
    assert (r.kind, r.memory_tier, r.scope, r.confidence, r.reason, r.refined) == ("preference", "cross_project_principle", "global", 1.0, "why", True)
    assert got[1, 9].body == "body of number 9 that is long" and got[1, 4].title == "last"
    assert got[1, 0].title == "title 0" and not got[1, 0].refined and not got[1, 24].refined
    assert A.refine(df, provider, required=True).agg(F.count("*")).first()[0] == 38
