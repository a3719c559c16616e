import json
import os
import random

from loamworks.operators import atomic, balanced, dedupe
from loamworks.sources import logs, records
from loamworks.streaming import observations
from pyspark.sql import functions as F


def test_atomic_parts():
    split = atomic.split_atomic
    assert split(None) == split("  ") == []
    assert split("short but whole") == ["short but whole"]
    assert split("Use Bun for scripts, however the legacy folder stays npm") == ["Use Bun for scripts", "保留例外：the legacy folder stays npm"]
    # no word within a word, and both sides long enough
    assert split("the gift shop is open today") == ["the gift shop is open today"]
    assert split("go if it is ready for all") == ["go if it is ready for all"]
    assert split("统一使用请求封装同时保留旧接口的兼容") == ["统一使用请求封装", "保留旧接口的兼容"]
    # the first connector by precedence, and only its right side goes on
    assert split("first do the long part then check the result also write it down") == ["first do the long part then check the result", "write it down"]
    assert split("check the result also write it down then send it out") == ["check the result", "write it down", "send it out"]


def greedy(rows):
    """By comparing with all kept rows."""
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["seq"]):
        if r["key"] in seen:
            continue
        seen.add(r["key"])
        like = lambda o: (o["kind"], o["scope"]) == (r["kind"], r["scope"]) and (dedupe.jaccard(dedupe.tokens(o["body"]), dedupe.tokens(r["body"])) >= 0.5 or dedupe.jaccard(dedupe.tokens(o["title"]), dedupe.tokens(r["title"])) >= 0.8)
        at = next((i for i, o in enumerate(out) if like(o)), None)
        rank = lambda o: (o["template"] is not None, round((o["confidence"] or 0) * 1000))
        if at is None:
            out.append(r)
        elif rank(r) > rank(out[at]):
            out[at] = r
    return sorted(r["seq"] for r in out)


def test_greedy_equals_all_pairs(spark):
    rnd = random.Random(1)
    words = ["use", "bun", "tests", "先", "规则", "", "a"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [{"seq": i, "key": f"k{rnd.randrange(90)}", "title": text(2), "body": text(rnd.randint(0, 5)), "template": rnd.choice([None, "t"]), "confidence": rnd.choice([None, 0.5, 0.7, 0.9]), "kind": rnd.choice("xy"), "scope": "s"} for i in range(120)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "seq long, key string, title string, body string, template string, confidence double, kind string, scope string")
    assert sorted(r.seq for r in dedupe.greedy_dedupe(df).collect()) == greedy(rows)
    assert dedupe.greedy_dedupe(df.filter("false")).count() == 0


def test_batch_dedupe(spark):
    df = spark.createDataFrame([(1, 0, "one two three"), (2, 0, "one two three"), (3, 0, "one two four five"), (4, 0, ""), (5, 0, ""), (1, 1, "one two three")], "seq long, run int, body string")
    assert sorted((r.run, r.seq) for r in dedupe.batch_dedupe(df).collect()) == [(0, 1), (0, 3), (0, 4), (1, 1)]


def test_balanced(spark):
    p, c, t = balanced.PROJECT, balanced.CROSS, balanced.TOGETHER
    rows = [(i, 0.9 - i / 100, f"c{i}", p) for i in range(12)] + [(20, 0.3, "x", c), (21, 0.2, "y", t), (22, 0.25, "y", t)]
    chosen = [rows[i] for i in balanced.choose(rows, 10)]
    tiers = [r[3] for r in chosen]
    assert len(chosen) == 10 and tiers.count(p) == 7 and {20, 21, 22} <= {r[0] for r in chosen}
    many = [(i, 0.9, f"c{i}", c) for i in range(12)] + [(20, 0.1, "z", p)]
    assert sum(r[3] == c for r in (many[i] for i in balanced.choose(many, 10))) <= 9
    df = spark.createDataFrame([(r, *x) for r in (0, 1) for x in rows], "run int, seq long, confidence double, cluster string, tier string")
    got = balanced.balanced_topk(df).collect()
    assert sorted((r.run, r.place, r.seq) for r in got) == sorted((run, i + 1, r[0]) for run in (0, 1) for i, r in enumerate(chosen))


def test_messages(spark):
    lines = [
        {"role": "user", "content": "hello"},
        {"role": "user", "content": "hello"},
        {"type": "user", "message": {"content": [{"type": "text", "text": "blocks"}, {"type": "tool_result", "text": "no"}]}},
        {"role": "assistant", "content": "not mine"},
        {"isMeta": True, "role": "user", "content": "meta"},
        {"payload": {"role": "user", "content": [{"type": "input_text", "text": "<INSTRUCTIONS>\nhidden\n</INSTRUCTIONS>\nshown\n\n\nTest result: ok"}]}},
        {"role": "user", "content": "requirements: a scope: b"},
    ]
    df = spark.createDataFrame([("p", i, json.dumps(x)) for i, x in enumerate(lines)] + [("p", 90, "{broken"), ("q", 0, None)], "path string, line_no int, line string")
    assert [tuple(r) for r in logs.messages(df).collect()] == [("p", "hello\nblocks\nshown")]


def test_read_new(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"a": 1}\n{"b"', encoding="utf-8")
    none = spark.createDataFrame([], "path string, processed_bytes long, size long, modified timestamp")
    lines, offsets = logs.read_new(spark, str(tmp_path), none)
    assert [r.line for r in lines.collect()] == ['{"a": 1}']
    offsets = spark.createDataFrame(offsets.collect(), offsets.schema)
    assert logs.read_new(spark, str(tmp_path), offsets)[0].count() == 0
    f.write_text('{"a": 1}\n{"b": "é"}\n', encoding="utf-8")
    os.utime(f, (2_000_000_000, 2_000_000_000))
    lines, offsets = logs.read_new(spark, str(tmp_path), offsets)
    assert [r.line for r in lines.collect()] == ['{"b": "é"}']
    assert offsets.first().processed_bytes == f.stat().st_size
    assert [r.line for r in logs.read_lines(spark, str(tmp_path)).filter("line != ''").orderBy("line_no").collect()] == ['{"a": 1}', '{"b": "é"}']


def test_records(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, n int")
    assert sorted(map(tuple, records.upsert(old, new).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, records.insert_absent(old, new).collect())) == [("c", 4)]
    records.append_log(old, f"{tmp_path}/log")
    records.append_log(new, f"{tmp_path}/log")
    assert records.read_log(spark, f"{tmp_path}/log", "id string, n int").count() == 4
    assert sorted(r.value for r in records.to_yaml(spark.createDataFrame([('x"y', 1), (None, None)], "id string, n int")).collect()) == ['id: "x\\"y"\nn: 1', "id: null\nn: null"]


def test_stream_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "user", "one"), (1, 1, None, "two"), (2, 0, "user", "one")], "conv_id long, turn long, role string, text string")
    rows.write.parquet(f"{tmp_path}/in/conversations.parquet")
    os.makedirs(f"{tmp_path}/flat")
    for i, part in enumerate(p for p in os.listdir(f"{tmp_path}/in/conversations.parquet") if p.startswith("part")):
        os.link(f"{tmp_path}/in/conversations.parquet/{part}", f"{tmp_path}/flat/conversations{i}.parquet")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/flat").withColumn("origin", F.coalesce("role", F.lit("unknown")))
    for _ in range(2):
        observations.stream_into(source, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted((r.origin, r.body) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("unknown", "two"), ("user", "one")]


def test_only_statements_with_connectors_are_split(spark):
    texts = ["short but whole", "Use Bun for scripts, however the legacy folder stays npm", "the gift shop is open today", "统一使用请求封装同时保留旧接口的兼容", "no connector here", "check the result also write it down then send it out", "HOWEVER long the first part is however the second goes on"]
    df = spark.createDataFrame([(texts,), ([],), (None,), (["plain", "plain"],)], "parts array<string>")
    got = [r.parts for r in atomic.with_atomic_parts(df, "parts").collect()]
    assert got == [[p for s in texts for p in atomic.split_atomic(s)], [], [], ["plain", "plain"]]
