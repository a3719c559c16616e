import json
import random

import pytest
from loamworks.functions import settings as S
from pyspark.sql import functions as F


def is_managed(group):
    if not isinstance(group, dict):
        return False
    if group.get(S.MARKER) is True:
        return True
    handlers = group.get("hooks")
    return isinstance(handlers, list) and any(isinstance(h, dict) and isinstance(h.get("command"), str) and S.COMMAND in h["command"] for h in handlers)


def install(doc, hooks):
    doc = dict(doc) if isinstance(doc, dict) else {}
    held = dict(doc["hooks"]) if isinstance(doc.get("hooks"), dict) else {}
    for event in dict.fromkeys(e for e, *_ in hooks):
        groups = held.get(event, [])
        if isinstance(groups, list):
            new = [{S.MARKER: True} | ({"matcher": m} if (m or "").strip() else {}) | {"hooks": [{"type": "command", "command": c}]} for e, m, c in hooks if e == event]
            held[event] = [g for g in groups if not is_managed(g)] + new
    return doc | {"hooks": held}


def uninstall(doc):
    if not isinstance(doc, dict):
        return {}, 0
    if not isinstance(doc.get("hooks"), dict):
        return doc, 0
    lists = {k: v for k, v in doc["hooks"].items() if isinstance(v, list)}
    gone = sum(len(g["hooks"]) for v in lists.values() for g in v if is_managed(g) and isinstance(g.get("hooks"), list))
    left = {k: [g for g in v if not is_managed(g)] for k, v in lists.items()}
    return doc | {"hooks": {k: v for k, v in left.items() if v}}, gone


DOCS = [
    {}, {"hooks": 5, "a": "1", "n": 1, "f": 1.5, "z": None, "t": [True, {"x": "é"}]}, {"hooks": {"Stop": [{"hooks": [{"type": "command", "command": "make"}]}], "Other": [1, "x"]}},
    {"hooks": {"Stop": "odd", "PreCompact": [], "SessionEnd": {"a": 1}}}, {"hooks": {"Stop": [{S.MARKER: True, "hooks": [{"command": "x"}, {"command": "y"}]}, {S.MARKER: "true"}, {"hooks": [{"command": S.COMMAND + " --x"}, 3]}, {"hooks": "no"}]}},
    [1], "text", {"a\"b": 1, "c'd": {"e": []}, "hooks": {"Stop": [{"matcher": "own"}]}},
]
HOOKS = [("Stop", None, S.COMMAND), ("SessionEnd", " ", "b"), ("Stop", "Edit|Write", S.COMMAND + " --target x")]


def test_merge_merge_again_and_remove(spark):
    rows = [(i, json.dumps(d)) for i, d in enumerate(DOCS)] + [(90, None), (91, "{broken")]
    df = spark.createDataFrame([(*r, HOOKS) for r in rows], "i int, text string, hooks array<struct<event string, matcher string, command string>>")
    df = df.withColumn("one", S.install(F.col("text"), F.col("hooks"))).withColumn("two", S.install(F.col("one"), F.col("hooks")))
    df = df.withColumn("gone", S.removed_handlers(F.col("two"))).withColumn("back", S.uninstall(F.col("two"))).withColumn("bare", S.uninstall(F.col("text")))
    for r in df.collect():
        doc = DOCS[r.i] if r.i < 90 else None
        assert json.loads(r.one) == install(doc, HOOKS), r.i
        assert r.two == r.one
        want, gone = uninstall(install(doc, HOOKS))
        assert (json.loads(r.back), r.gone) == (want, gone)
        assert json.loads(r.bare) == uninstall(doc)[0]


def test_own_hooks_come_back_as_they_were(spark):
    rnd = random.Random(2)
    own = lambda: {"hooks": [{"type": "command", "command": rnd.choice(["make", "lint"])} for _ in range(rnd.randint(0, 2))]}
    docs = [{"k": i, "hooks": {e: [own() for _ in range(rnd.randint(1, 3))] for e in ("Stop", "PreCompact", "SessionEnd") if rnd.random() < 0.6}} for i in range(40)]
    df = spark.createDataFrame([(json.dumps(d), HOOKS) for d in docs], "text string, hooks array<struct<event string, matcher string, command string>>")
    for r in df.select("text", S.uninstall(S.install(F.col("text"), F.col("hooks"))).alias("back")).collect():
        assert json.loads(r.back) == json.loads(r.text)


@pytest.mark.parametrize(
    ("doc", "want"),
    [({"old": [1], "b": 2}, {"new": [1], "b": 2}), ({"old": 1, "new": 2}, {"old": 1, "new": 2}), ({"b": 2}, {"b": 2}), ([1], [1]), ({"old": None}, {"new": None})],
)
def test_renamed_keys(spark, doc, want):
    df = spark.createDataFrame([(json.dumps(doc),)], "text string").select(S.renamed(F.col("text"), "old", "new").alias("t"))
    df = df.withColumn("again", S.renamed(F.col("t"), "old", "new"))
    r = df.first()
    assert json.loads(r.t) == want and r.again == r.t


def test_moved_export(spark):
    docs = [{"agents": {"c": {"exports": {"instructions": ".rules", "x": 1}, "on": True}, "d": {}}, "v": 1}, {"agents": {"c": {"exports": {"instructions": ".rules", "rules_dir": "r"}}}}, {"agents": {"c": {"exports": {"instructions": "A.md"}}}}, {"agents": {}}, {"agents": {"c": {"exports": {"instructions": ".rules", "rules_dir": None}}}}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, text string").select("i", S.moved_export(F.col("text"), "c", ".rules").alias("t"))
    got = {r.i: json.loads(r.t) for r in df.collect()}
    assert got[0] == {"agents": {"c": {"exports": {"rules_dir": ".rules", "x": 1}, "on": True}, "d": {}}, "v": 1}
    assert got[1] == docs[1] and got[2] == docs[2] and got[3] == docs[3]
    assert got[4] == {"agents": {"c": {"exports": {"rules_dir": ".rules"}}}}
