import math
import random
import re
from collections import defaultdict

from loamworks.llm import mixing as M
from pyspark.sql import functions as F


def want_targets(sizes, weights=(5, 2, 1), most=3):
    """By repeated resharing of what is above the limits."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_w = sum(w[s] for s in names if s not in full)
        t = {s: most * sizes[s] if s in full else rest * w[s] / open_w for s in names}
        over = {s for s in names if s not in full and t[s] >= most * sizes[s]}
        if not over:
            return t
        full |= over


def want_copies(docs, target, most=3, near=M.NEAR):
    """Copies by draw of one source's documents (draw, size): bisection for c, then the ranked sample, unit by unit."""
    units = defaultdict(int)
    for draw, size in docs:
        units[draw, size] += 1
    total = sum(n * s for (_, s), n in units.items())
    low, high = 0.0, 1e9
    expect = lambda c, s: min(most, c * math.log(s + 2.0))
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(expect(c, s) * n * s for (_, s), n in units.items()) < target else (low, c)
    if target >= most * total:
        return {d: most for d, _ in units}
    out, pool, gap = {}, [], target
    for (d, s), n in units.items():
        e = expect(high, s)
        out[d] = math.floor(e)
        gap -= out[d] * n * s
        p, u = e - math.floor(e), (((d & (1 << 64) - 1) >> 11) + 0.5) / (1 << 53)
        if p > 0 and n * s > 0:
            pool.append((u * (1 - p) / (u * (1 - p) + (1 - u) * p), d, n * s))
    pool.sort()
    while gap > near * target and any(w <= gap for _, _, w in pool):
        most_here, rest, over = gap, [], False
        for k, d, w in pool:
            over = over or (w <= most_here and w > gap)
            if over or w > most_here:
                rest.append((k, d, w))
            else:
                out[d] += 1
                gap -= w
        pool = rest
    close = min(((abs(w - gap), k, d) for k, d, w in pool), default=None)
    if close and close[0] < gap:
        out[close[2]] += 1
    return out


def test_mix(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(3000):
        s = rnd.choice(["a", "a", "a", "a", "b", "c", "d", None, "É"])
        n = rnd.choice([0, 1, 5, 30, 30, 60, 400 if s != "d" else 2])
        rows.append((i, s, rnd.choice([" ", "\n", "\t "]).join(["wörd"] * n) if i % 97 else None, "x"))
    rows += rows[:5] + [(None, "a", "one two", "y")] * 300
    own = dict.fromkeys(("p", "key", "draw", "whole", "edge", "_own_draw", "gap", "words", "n", "rounds"), "mine")
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, SIZE string").withColumns({k: F.lit(v) for k, v in own.items()})
    got = M.mix(df).withColumn("d", M.draw_of("doc_id", "source", "text")).collect()
    assert all(r[k] == v for r in got for k, v in own.items())
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, s, t, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = want_targets(sizes), defaultdict(int)
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.size == n and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * n <= 3 * n
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.001 * t), (s, taken[s], t)
        copies = want_copies([(r.d, r.size) for r in got if r.source == s], t)
        assert all(r.copies == copies[r.d] for r in got if r.source == s), s
    # longer documents are likelier
    a = [r for r in got if r.source == "a" and r.doc_id is not None]
    rate = lambda n: sum(r.copies for r in a if r.size == n) / max(1, sum(r.size == n for r in a))
    assert rate(1) < rate(30) < rate(400)
    again = M.mix(df.repartition(7), keep=["doc_id", "source"]).collect()
    assert sorted((str(r.doc_id), str(r.source), r.copies, r.size) for r in got) == sorted((str(r.doc_id), str(r.source), r.copies, r.size) for r in again)


def test_fills_past_a_long_document(spark):
    """One document of 20,000 words drawn anywhere in the order does not leave the words that short ones can fill."""
    rows = [(i, "small", "w " * 100) for i in range(150)] + [(150, "small", "w " * 20_000), (151, "big", "w " * 30_000), (152, "huge", "w " * 60_000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(3, 2, 1)).collect()
    for s in ("big", "huge", "small"):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= (100 if s == "small" else mine[0].source_size / 2), s


def test_edges(spark):
    schema = "doc_id long, source string, text string"
    assert M.mix(spark.createDataFrame([], schema)).count() == 0
    none = M.mix(spark.createDataFrame([(1, "a", None), (2, None, "")], schema)).collect()
    assert [(r.size, r.taken, r.target) for r in none] == [(0, 0, 0.0)] * 2
    one = M.mix(spark.createDataFrame([(1, "a", "x " * 100_000)], schema)).collect()
    assert one[0].taken == 100_000


def test_nulls_are_told_apart_and_no_row_is_multiplied(spark, monkeypatch):
    rows = [(1, None, "x"), (1, None, "x"), (1, "x", None), (1, "x", None), (2, "x", "a b c"), (None, "x", "1"), (None, "1", "x"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = M.mix(df).collect()
    assert sorted(map(str, ((r.doc_id, r.source, r.text) for r in got))) == sorted(map(str, rows))
    real = F.xxhash64
    monkeypatch.setattr(M.F, "xxhash64", lambda *c: real(F.lit(7)))  # all draws collide: units still differ by source and size
    assert len(M.mix(df).collect()) == len(rows)
