import json
import os
import random

import pytest
from loamworks.sources import history as H
from loamworks.sources import logs
from pyspark.sql import functions as F


def put(path, text, when=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if when:
        os.utime(path, (when, when))


def first_string(node, keys):
    if isinstance(node, dict):
        for k in keys:
            if isinstance(node.get(k), str):
                return node[k]
        nodes = [node[k] for k in sorted(node)]
    else:
        nodes = node if isinstance(node, list) else []
    return next((x for x in (first_string(n, keys) for n in nodes) if x is not None), None)


def probe_loop(lines, most_lines=200, most_bytes=256 * 1024):
    size = 0
    for line in lines[:most_lines]:
        size += len(line.encode())
        if size > most_bytes:
            return None
        try:
            found = first_string(json.loads(line.strip()), ("cwd", "project"))
        except ValueError:
            continue
        if found is not None:
            return found
    return None


def some_json(rnd, depth=0):
    kind = rnd.random()
    if depth > 4 or kind < 0.3:
        return rnd.choice(["/a/b", "x", 5, None, True, 1.5])
    if kind < 0.5:
        return [some_json(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    return {rnd.choice(["cwd", "project", "a", "b", "zed", "payload"]): some_json(rnd, depth + 1) for _ in range(rnd.randint(0, 4))}


def test_probe_against_a_loop(spark):
    rnd = random.Random(5)
    files = {f"f{i}": [json.dumps(some_json(rnd)) if rnd.random() < 0.8 else rnd.choice(["", "{no", "  ", "12"]) for _ in range(rnd.randint(1, 6))] for i in range(60)}
    files["late"] = ["{}"] * 200 + ['{"cwd": "/x"}']
    files["last"] = ["{}"] * 199 + ['{"cwd": "/x"}']
    files["long"] = [json.dumps({"t": "é" * 131_080}), '{"cwd": "/x"}']
    files["short"] = [json.dumps({"t": "é" * 40_000}), '{"cwd": "/x"}']
    rows = spark.createDataFrame([(f, i, x) for f, lines in files.items() for i, x in enumerate(lines)], "path string, place long, line string")
    got = {r.path: r.project for r in H.probe(rows).collect()}
    want = {f: probe_loop(lines) for f, lines in files.items()}
    assert got == {f: p for f, p in want.items() if p is not None}
    assert "last" in got and "late" not in got and "long" not in got
    assert H.probe(rows.filter("false")).count() == 0


def test_harvest(spark):
    lines = [("codex", "a", '{"cwd":"/p/a","x":[{"project":" /p/a "},{"cwd":"nope"}]}'), ("claude", "b", '{"y":{"project":"/p/a","cwd":"C:\\\\w"}}'), ("codex", "b", "{bad"), ("codex", "c", '{"cwd":"~/z"}')]
    rows = spark.createDataFrame([(*x[:2], i, x[2]) for i, x in enumerate(lines)], "agent string, path string, place long, line string")
    got = {r.project: (r.agents, r.files, r.mentions) for r in H.harvest(rows).collect()}
    assert got == {"/p/a": (["claude", "codex"], 2, 2), " /p/a ": (["codex"], 1, 1), "C:\\w": (["claude"], 1, 1), "~/z": (["codex"], 1, 1)}


def test_nearest_root_by_whole_parts(spark):
    roots = ["/a/b", "/a/b/c/", "/x", "rel", "/a//b/./c", "C:\\work"]
    cases = {"/a/b": "/a/b", "/a/bc": None, "/a/b/c/d.txt": "/a/b/c", "/a/b/cd": "/a/b", "/x/y/z": "/x", "/": None, "": None, "rel/q": "rel", "/rel": None, None: None, "C:/work/p": "C:/work", "/a/b//c": "/a/b/c"}
    files = spark.createDataFrame([(str(i), p) for i, p in enumerate(cases)], "path string, project string")
    met = H.nearest_root(files, spark.createDataFrame([(r,) for r in roots], "root string"))
    assert {r.project: r.root for r in met.collect()} == cases
    plan = met._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    counts = H.replay_counts(files, spark.createDataFrame([("/",), ("/a/b",)], "root string"))
    assert {(r.root, r.match): r.files for r in counts.collect()} == {("/a/b", "match"): 4, ("/", "match"): 4, (None, "other"): 3, (None, "unknown"): 1}


@pytest.mark.parametrize(
    ("index", "ids"),
    [({"sessions": {"b": {}, "a": 1}}, ["a", "b"]), ({"x": {}, "y": {}}, ["x", "y"]), ({"x": {}, "y": 1}, []), ([{"sessionId": "p"}, {"session_id": "q"}, {"id": "r"}, 5], ["p", "q"]), ("s", []), ({}, [])],
)
def test_session_ids(index, ids):
    assert H.session_ids(index) == ids


def test_folder_names():
    assert [H.project_of_folder(x) for x in ("-a-b", "a-b", "---", "", "-a--b")] == ["/a/b", "a/b", None, None, "/a/b"]


def user(text, **more):
    return json.dumps({"type": "user", "message": {"role": "user", "content": text}} | more) + "\n"


def test_import_of_a_home(spark, tmp_path):
    home = tmp_path / "home"
    put(home / ".claude/projects/-w-app/sessions-index.json", json.dumps({"sessions": {"s1": {}, "gone": {}}}))
    put(home / ".claude/projects/-w-app/s1.jsonl", user("Use bun. api_key = 'abcd1234efgh5678'"), 1000)
    put(home / ".claude/projects/-w-app/s2.jsonl", user("Use npm.", cwd="/w/app/deep"), 1000)
    put(home / ".claude/projects/-w-app/subagents/s3.jsonl", user("never", cwd="/w/app"), 1000)
    put(home / ".codex/sessions/2026/x.jsonl", user("Other.", payload={"cwd": "/w/application"}), 1000)
    put(home / ".codex/history.jsonl", user("Who knows."), 1000)
    found = H.discover(str(home))
    assert [(os.path.basename(c.path), c.agent, c.kind, c.project) for c in found] == [
        ("s1.jsonl", "claude-code", "claude-code-session", "/w/app"), ("s2.jsonl", "claude-code", "claude-code-session", None),
        ("history.jsonl", "codex", "codex-history", None), ("x.jsonl", "codex", "codex-session", None),
    ]
    place = str(tmp_path / "index"), str(tmp_path / "store")
    assert H.import_home(spark, str(home), ["/w/app"], *place) == {"files": 4, "match": 2, "other": 1, "unknown": 1, "created": 2}
    rows = H.load(spark, place[1]).collect()
    assert sorted(r.body for r in rows if not r.redacted) == ["Use npm."] and all(r.id.startswith("obs:claude-code:") for r in rows)
    assert any(r.redacted and "[REDACTED]" in r.body for r in rows)
    assert H.import_home(spark, str(home), ["/w/app"], *place)["created"] == 0
    with open(home / ".claude/projects/-w-app/s2.jsonl", "a") as f:
        f.write(user("Use deno.") + '{"half')
    os.utime(home / ".claude/projects/-w-app/s2.jsonl", (1010, 1010))
    assert H.import_home(spark, str(home), ["/w/app"], *place)["created"] == 1
    assert "Use deno." in [r.body for r in H.load(spark, place[1]).collect()]
    assert H.import_home(spark, str(home), None, *place, unknown=True) == {"files": 4, "match": 4, "other": 0, "unknown": 0, "created": 2}
    assert H.import_home(spark, str(tmp_path / "empty"), None, *place)["files"] == 0


BLOBS = [
    ("[Assistant Rules - You MUST follow]\n[Available Skills]\nTeam Mode", True), ("[Available Skills] only", False), ("You are the UI agent.\n\nScope: edit only a.\nReturn done", True),
    ("Requirements: a. Scope: b.", True), ("要求：快。只修改前端", True), ("你是 代理。请只做分析，不修改文件", True), ("You are kind.", False), ("Ran out of context. Primary Request and Intent: x", True),
    ("This session is being continued from a previous conversation. Summary: x", True), ("This session is being continued from a previous conversation.", False), ("You are not alone in the codebase. Read these files first: a", True),
    ("Review the current uncommitted changes in src/a.rs", True), ("run cargo fmt", False), ("Use bun for scripts.", False),
]


def test_blobs(spark):
    rows = spark.createDataFrame(list(enumerate(x for x, _ in BLOBS)), "i int, text string")
    got = {r.i: r.b for r in rows.select("i", logs.is_blob(F.col("text")).alias("b")).collect()}
    assert [got[i] for i in range(len(BLOBS))] == [b for _, b in BLOBS]


def test_lines_that_go():
    text = "keep\n12\tcode\n1\tcode\n9\tstays\n\n\n\nDo not edit directly\n<app-context>\ninside\n\n</app-context>\nlast\n"
    assert logs.sanitize(text) == "keep\n9\tstays\n\nlast"
