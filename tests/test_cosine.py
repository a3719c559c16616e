"""Nearest rows by cosine: the search in blocks against all pairs, and how often rows are copied."""

import numpy as np
import pytest
from loamworks.operators import cosine as C


def block(ids, rows):
    return C._Block(np.array(ids), np.array([len(r) for r in rows]), np.array([v or 0.0 for r in rows for v in r]))


def brute(ids, rows, to_ids, to_rows, k):
    want = []
    for i, x in zip(ids, rows):
        keys = []
        for j, y in zip(to_ids, to_rows):
            if i != j:
                a, b = (np.array([v or 0.0 for v in r]) for r in (x, y))
                long = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
                s = 0.0 if len(a) != len(b) or long == 0 else float(a @ b / long)
                keys.append((-np.inf if s != s else -round(s, 9), j))
        want += [(i, j) for _, j in sorted(keys)[:k]]
    return want


@pytest.mark.parametrize("kind", ["plain", "copies", "close", "odd", "widths"])
def test_blocks_find_what_all_pairs_do(monkeypatch, kind):
    monkeypatch.setattr(C, "QUERIES", 16)
    monkeypatch.setattr(C, "OTHERS", 32)
    monkeypatch.setattr(C, "DENSE", 8)
    monkeypatch.setattr(C, "FEW", 6)
    rnd = np.random.default_rng(len(kind))
    rows = [r.tolist() for r in rnd.normal(size=(150, 6))]
    if kind == "copies":
        rows = [rows[0] if i % 2 else r for i, r in enumerate(rows)]
    elif kind == "close":  # closer to each other than 32-bit floats tell
        rows = [[1.0, *(1e-7 * v for v in r[1:])] for r in rows]
    elif kind == "odd":
        rows[5], rows[80], rows[90], rows[33][2], rows[7][1] = [0.0] * 6, [1e-200] * 6, [1e-150, *[0.0] * 5], float("nan"), None
    elif kind == "widths":
        rows = [r[: 3 + i % 3] for i, r in enumerate(rows)]
    ids = rnd.permutation(1000)[:150].tolist()
    with np.errstate(all="ignore"):
        search = C._Search(block(ids, rows), 5)
        search.meet(block(ids[40:90], rows[40:90]))
        search.meet(block(ids[90:], rows[90:]))
        q, c, _ = search.best()
        want = brute(ids, rows, ids[40:], rows[40:], 5)
    assert sorted(zip(q.tolist(), c.tolist())) == sorted(want)


def test_rows_are_not_copied(spark):
    """Disk: what is exchanged is the rows once, not once for each block."""
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 11)]) for i in range(600)] + [(None, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    found = C.cosine_top(rows, block_rows=20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "CoGroups" not in plan
    assert found.count() == 3000
    assert C.rows_for(51_282, 64) == 2137 and C.rows_for(600_000, 64) == 4096 and C.rows_for(100, 64) == 256 and C.rows_for(600_000, 1536) == 170
