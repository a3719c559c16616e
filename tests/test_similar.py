import random

from loamworks.operators import components, dedupe, similar
from pyspark.sql import functions as F


def loop(rows):
    """Sequential removal: every row against all kept ones."""
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["seq"]):
        if r["key"] in seen:
            continue
        seen.add(r["key"])
        body, title = dedupe.tokens(r["body"]), dedupe.tokens(r["title"])
        like = lambda o: (o["kind"], o["scope"]) == (r["kind"], r["scope"]) and (dedupe.jaccard(dedupe.tokens(o["body"]), body) >= 0.5 or dedupe.jaccard(dedupe.tokens(o["title"]), title) >= 0.8)
        rank = lambda o: (o["template"] is not None, o["reason"] is not None, round((o["confidence"] or 0) * 1000))
        at = next((i for i, o in enumerate(out) if like(o)), None)
        if at is None:
            out.append(r)
        elif rank(r) > rank(out[at]):
            out[at] = r
    return sorted(r["seq"] for r in out)


SCHEMA = "seq long, key string, title string, body string, template string, reason string, confidence double, kind string, scope string"


def rows_of(rnd, n, kinds, words):
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    return [{"seq": i * 3, "key": f"k{rnd.randrange(n)}", "title": text(rnd.randint(0, 3)), "body": text(rnd.randint(0, 12)), "template": rnd.choice([None, "t"]), "reason": rnd.choice([None, "r"]), "confidence": rnd.choice([None, 0.5, 0.7, 0.9]), "kind": rnd.choice(kinds), "scope": "s"} for i in range(n)]


def test_greedy_of_one_kind_and_scope(spark):
    for seed, vocabulary in ((1, 400), (2, 60)):
        rnd = random.Random(seed)
        rows = rows_of(rnd, 400, "k", [f"w{i}" for i in range(vocabulary)] + ["", "规则"])
        df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
        assert sorted(r.seq for r in dedupe.greedy_dedupe(df).collect()) == loop(rows)
    # no task gets the group: blocks are components of similarity
    rnd = random.Random(1)
    rows = rows_of(rnd, 400, "k", [f"w{i}" for i in range(400)])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    found = similar.blocks(df, (similar.Measure("body", 0.5), similar.Measure("title", 0.8)), ("kind", "scope"))
    assert found.groupBy("block").count().agg(F.max("count")).first()[0] < 200


def test_long_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(similar, "PART", 5)
    rnd = random.Random(3)
    rows = rows_of(rnd, 150, "xy", ["a1", "b1", "c1", "d1", "e1", "f1"])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    assert sorted(r.seq for r in dedupe.greedy_dedupe(df).collect()) == loop(rows)


def test_blocks_hold_all_similar_rows(spark):
    rnd = random.Random(4)
    rows = rows_of(rnd, 200, "xyz", [f"w{i}" for i in range(40)])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    for m in (similar.Measure("body", 0.65, above=True), similar.Measure("body", 0.35), similar.Measure("title", 1.0)):
        got = {r.seq: r.block for r in similar.blocks(df, (m,), ("kind",)).collect()}
        up = {r["seq"]: r["seq"] for r in rows}

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, x in enumerate(rows):
            for y in rows[:i]:
                a, b = dedupe.tokens(x[m.column]), dedupe.tokens(y[m.column])
                if x["kind"] == y["kind"] and m.holds(len(a & b), len(a | b)):
                    a, b = sorted((find(x["seq"]), find(y["seq"])))
                    up[b] = a
        want = {i: find(i) for i in up}
        assert {i: got.get(i, i) for i in up} == want


def test_batch_skips_noise(spark):
    df = spark.createDataFrame([(1, 0, "one two three", True), (2, 0, "one two three", False), (3, 0, "one two three", None), (4, 0, "", False), (5, 0, "", False)], "seq long, run int, body string, noise boolean")
    assert sorted(r.seq for r in dedupe.batch_dedupe(df).collect()) == [2, 4]


def test_components(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(30)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}
