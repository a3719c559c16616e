import random

from loamworks.operators import replay as R
from loamworks.operators.dedupe import jaccard, tokens

OPS = "seq long, project string, op string, id string, title string, body string, kind string, scope string, targets array<string>, agent string, sources array<string>"


def sequential(ops):
    """All projects, one operation after the other, written out by itself."""
    cards = {}
    for seq, project, op, card, title, body, kind, scope, targets, agent, sources in sorted(ops):
        at = project, card
        fields = dict(zip(R.FIELDS, (title, body, kind, scope)))
        if op == "add" or (op == "approve" and at not in cards):
            old = cards.get(at, {})
            cards[at] = {f: v or "" for f, v in fields.items()} | {"targets": list(targets or []) if op == "add" else [], "created": old.get("created", seq), "from": old.get("from"), "updated": seq}
        elif op == "approve":
            s = jaccard(tokens(body), tokens(cards[at]["body"]))
            if s < 0.75 and (s >= 0.45 or (title or "").strip() == cards[at]["title"].strip()):
                cards[at].update({f: v for f, v in fields.items() if v is not None}, updated=seq)
        elif op == "update" and at in cards:
            cards[at].update({f: v for f, v in fields.items() if v is not None}, updated=seq)
        elif op == "targets" and at in cards:
            cards[at]["targets"] = list(targets or [])
        elif op == "delete":
            cards.pop(at, None)
        elif op == "clear":
            for (p, _), c in cards.items():
                if p == project:
                    c["targets"] = [] if agent is None else [t for t in c["targets"] if t != agent]
        elif op == "promote" and at in cards:
            c = cards.pop(at)
            cards[project, "global:" + card.split(":", 1)[-1]] = c | {"scope": "global", "from": project, "updated": seq}
        elif op == "merge" and sources and all((project, s) in cards for s in sources):
            text = "".join(f"## {cards[project, s]['title']}\n\n{cards[project, s]['body']}\n\n" for s in sources).strip()
            old = cards.get(at, {})
            cards[at] = {"title": title or "", "body": text, "kind": "procedure", "scope": "project", "targets": list(targets or []), "created": old.get("created", seq), "from": old.get("from"), "updated": seq}
            for s in sources:
                cards.pop((project, s), None)
    return sorted((p, i, c["title"], c["body"], c["kind"], c["scope"], tuple(c["targets"]), c["from"] or "", c["created"], c["updated"]) for (p, i), c in cards.items())


def got(df):
    return sorted((r.project, r.id, r.title, r.body, r.kind, r.scope, tuple(r.targets), r.source_project or "", r.created, r.updated) for r in df.collect())


def some(rnd, n, kinds, ids):
    word = lambda k: " ".join(rnd.choice(["use", "bun", "tests", "always", "规则", "npm"]) for _ in range(k))
    out = []
    for seq in rnd.sample(range(10 * n), n):
        names = rnd.sample(ids, 2)
        out.append((seq, rnd.choice("pq"), rnd.choice(kinds), rnd.choice(ids), rnd.choice([None, word(2), " same "]), rnd.choice([None, word(4), word(3)]), rnd.choice([None, "rule"]), "project", rnd.choice([None, [], ["a"], ["a", "b"]]), rnd.choice([None, "a", "b"]), rnd.choice([None, [], names[:1], names])))
    return out


def test_replay_equals_a_sequential_one(spark):
    for seed in (1, 2, 3):
        rnd = random.Random(seed)
        ids = [f"project:c{i}" for i in range(9)] + ["global:c1", "bare"]
        ops = some(rnd, 200, ["add", "add", "update", "targets", "delete", "clear", "approve", "approve", "promote", "merge"], ids)
        ops += some(rnd, 150, ["add", "update", "targets", "delete", "clear"], [f"plain:{i}" for i in range(12)])
        ops = [(i, *o[1:]) for i, o in enumerate(sorted(ops))]
        assert got(R.replay(spark.createDataFrame(ops, OPS).repartition(3))) == sequential(ops)
    assert got(R.replay(spark.createDataFrame([], OPS))) == []


def test_many_operations_on_one_record(spark):
    rnd = random.Random(5)
    ops = [(i, *o[1:]) for i, o in enumerate(some(rnd, 1500, ["add", "update", "update", "targets", "delete"], ["one:a", "one:b"]))]
    assert got(R.replay(spark.createDataFrame(ops, OPS))) == sequential(ops)


def test_cards_of_candidates(spark):
    from loamworks.plans import records, registry

    for sf in ("sf0.001", "sf0.01"):
        folder = f"/root/testdata/{sf}"
        ops = records.card_ops(registry.run, spark, folder)
        rows = [tuple(r) for r in ops.select(*[c.split()[0] for c in OPS.split(", ")]).collect()]
        assert {"approve", "promote"} <= {r[2] for r in rows}
        want = sequential(rows)
        assert got(R.replay(ops)) == want and len(records.q_replay(registry.run, spark, folder).collect()) == len(want)


def test_sets_go_on_over_batches():
    import pyarrow as pa

    names = [c.split()[0] for c in OPS.split(", ")] + ["block"]
    ops = [("x", "approve", "T", "one"), ("x", "approve", "T", "two"), ("y", "approve", "U", "three"), ("z", "approve", "V", "four"), ("z", "promote", None, None)]
    rows = [dict(zip(names, (n, "p", op, f"project:{b}", title, body, "rule", "project", None, None, None, b))) for n, (b, op, title, body) in enumerate(ops)]
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 1], pa.Table.from_pylist(rows).schema) for i in range(5)]
    found = [r for b in R._replayed(iter(batches)) for r in b.to_pylist()]
    assert [(r["id"], r["body"], r["scope"], r["created"], r["updated"]) for r in found] == [("project:x", "two", "project", 0, 1), ("project:y", "three", "project", 2, 2), ("global:z", "four", "global", 3, 4)]
    assert [r for b in R._replayed(iter([])) for r in b.to_pylist()] == []


def test_candidates_are_made_once(spark, monkeypatch):
    from loamworks.plans import records

    made, sf = [], "/root/testdata/sf0.001"
    from loamworks.plans import registry

    written = records.written
    monkeypatch.setattr(records, "written", lambda df: (made.append(df), written(df))[1])
    found = registry.queries()["card_replay"](spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(made) == 1 and "ArrowEvalPython" not in plan and "FlatMapGroups" not in plan and found.count() > 0
