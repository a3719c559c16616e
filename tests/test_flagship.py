"""The chain against one loop over the candidates of each run, in order."""

import pytest
from loamworks.operators import balanced, dedupe
from loamworks.plans import flagship, registry
from loamworks.plans.corpus import STATEMENTS
from loamworks.plans.dialect import run as run_text
from pyspark.sql import functions as F


def similar(a, b):
    return dedupe.jaccard(dedupe.tokens(a), dedupe.tokens(b))


def f32(x):
    import numpy as np

    return np.float32(x)


def loop(found, penalties, judged, scope_of):
    """seq of what stays after greedy removal, after batch removal, and (run, place, seq) of what is chosen; and actions."""
    counts = {}
    for r in found:
        counts[r.signature] = counts.get(r.signature, 0) + 1
    runs = {}
    for r in sorted(found, key=lambda r: r.seq):
        runs.setdefault(r.run, []).append(r)
    kept, batch, chosen, about = [], [], [], {}
    for run, rows in runs.items():
        seen, out = set(), []
        for r in rows:
            if r.key in seen:
                continue
            seen.add(r.key)
            rank = lambda o: (o.template is not None, o.reason is not None, round(o.confidence * 1000))
            at = next((i for i, o in enumerate(out) if (o.kind, o.scope) == (r.kind, r.scope) and (similar(o.body, r.body) >= 0.5 or similar(o.title, r.title) >= 0.8)), None)
            if at is None:
                out.append(r)
            elif rank(r) > rank(out[at]):
                out[at] = r
        kept += [r.seq for r in out]
        told = []
        for r in out:
            confidence = f32(r.confidence)
            if counts[r.signature] >= 3:
                confidence = min(confidence + f32(0.1), f32(0.95))
            fits = [k for k in range(len(STATEMENTS)) if (scope_of[k] == r.scope if r.scope in ("global", "agent") else scope_of[k] != "global")]
            card = next((k for k in fits if similar(r.body, STATEMENTS[k]) > 0.75), None)
            rejections, delta = penalties.get(r.told, (0, 0.0))
            if rejections:
                confidence = f32(min(max(confidence + f32(delta), 0), 1))
            about[r.seq] = (rejections, card, round(float(confidence), 5))
            if rejections < 3:
                told.append(r)
        left = []
        for r in sorted(told, key=lambda r: r.seq):
            if not any(similar(r.body, o.body) > 0.65 for o in left):
                left.append(r)
        batch += [r.seq for r in left]
        passed = [judged[r.seq] for r in left if judged[r.seq].quality == "" and judged[r.seq].memory in ("", "reference-pointer") and judged[r.seq].scored]
        rows = [(r.seq, r.selection, r.cluster, r.memory_tier) for r in passed]
        chosen += [(run, place, rows[i][0]) for place, i in enumerate(balanced.choose(rows, flagship.LIMIT), 1)]
    return sorted(kept), sorted(batch), sorted(chosen), about


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_chain_equals_a_loop(spark, sf):
    folder = f"/root/testdata/{sf}"
    steps = flagship.chain(spark, folder, registry.run)
    found, judged = steps["candidates"].collect(), {r.seq: r for r in steps["judged"].collect()}
    penalties = {r.signature: (r.rejections, r.delta) for r in registry.run(spark, folder, lambda d: f"{flagship.corpus(d)}, {flagship._rejected(d)} SELECT signature, rejections, delta FROM pen").collect()}
    scopes = run_text(spark, folder, lambda d: f"{flagship.matched(d, flagship.corpus(d) + ', cand AS (SELECT 1 AS id, body, body AS scope FROM statement)')} SELECT card_id, card_scope FROM card")
    kept, batch, chosen, about = loop(found, penalties, judged, {r.card_id: r.card_scope for r in scopes.collect()})
    assert sorted(r.seq for r in steps["kept"].collect()) == kept
    assert {s: (r.rejections, r.card_id, round(float(r.confidence), 5)) for s, r in judged.items()} == about
    assert sorted(r.seq for r in steps["batch"].collect()) == batch
    assert sorted((r.run, r.place, r.seq) for r in steps["chosen"].collect()) == chosen
    fates = flagship.extract_outcomes(registry.run, spark, folder).groupBy("fate").agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in fates) == len(found) and {r.fate: r.n for r in fates}["chosen"] == len(chosen)


def test_extract_local(spark):
    rows = flagship.extract_local(registry.run, spark, "/root/testdata/sf0.001").collect()
    places = {}
    for r in rows:
        places.setdefault(r.run, []).append(r.place)
    assert rows and all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    assert all(r.action == ("add" if r.duplicate_of is None else "merge_into_existing") for r in rows)
