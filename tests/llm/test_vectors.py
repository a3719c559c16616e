import numpy as np
from loamworks.llm import hilbert as H
from loamworks.llm import kdtree as K
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def rows(n=700, width=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype("float32")
    x[100:200] = x[0] + 0.05 * rng.normal(size=(100, width))
    x[300:320] = x[299]
    out = [(i, [float(a) for a in v], 0, 1) for i, v in enumerate(x)]
    bad = [(5000, None, 0, 1), (5100, [None] * width, 0, 1), (5200, [float("nan")] * width, 0, 1), (5300, [float("inf")] * width, 0, 1)]
    return out, [*bad, (5400, [0.0] * width, 0, 1)]


def test_hilbert_is_a_curve():
    p = np.array([(a, b) for a in range(16) for b in range(16)])
    walk = p[np.argsort(H.hilbert_keys(p, 4))]
    assert len(set(H.hilbert_keys(p, 4))) == 256
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_neighbours(spark):
    good, bad = rows()
    got = H.neighbours(spark.createDataFrame(good + bad, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    x = np.array([g[1] for g in good])
    found, hits = {}, 0
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in range(700) if i % 20 == 0}
    for q, f in found.items():
        f.sort()
        assert [r for r, _, _ in f] == list(range(1, 21))
        assert all(abs(s - x[q] @ x[v]) < 1e-9 and v != q for _, v, s in f)
        assert f == sorted(f, key=lambda t: (-t[2], t[1]))
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({v for _, v, _ in f} & set(np.argsort(-s, kind="stable")[:20]))
    assert hits / (20 * len(found)) >= 0.9


def test_few(spark):
    got = H.neighbours(spark.createDataFrame([(0, [1.0, 0.0], 0, 0), (1, [1.0], 0, 0), (20, [0.0, 2.0], 0, 0)], SCHEMA), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0)]
    assert H.neighbours(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_exact(spark):
    good, bad = rows()
    df = spark.createDataFrame(good + bad + [good[100]], SCHEMA)
    got = {}
    for r in K.exact_top(df, F.col("vec_id") % 100 == 0, block=200).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    kept = good + [bad[-1], good[100]]
    x = np.floor(np.array([k[1] for k in kept]) * 1024).astype(np.int64)
    ids = np.array([k[0] for k in kept])
    assert len(got[100]) == 20 and set(got) == {i for i in ids if i % 100 == 0}
    for i, q in enumerate(ids):
        if q % 100 == 0 and q != 100:
            s = x @ x[i]
            order = [j for j in np.lexsort((ids, -s)) if j != i][:10]
            assert sorted(got[q]) == [(n + 1, ids[j], s[j]) for n, j in enumerate(order)]
    assert K.exact_top(df.filter("false"), F.lit(True)).count() == 0


def test_tree_prunes():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 2000
    p = np.floor(np.concatenate([c + rng.normal(size=(200, 8)) * 20 for c in centres]))
    tree = K.Tree(p)
    top, leaves = tree.search(p[5], tree.bounds(p[5:6])[0], 10, np.arange(len(p)), 5, -np.inf)
    assert leaves < 12
    s = p @ p[5]
    s[5] = -np.inf
    assert [t[0] for t in top] == sorted(s, reverse=True)[:10]


def brute(rows, k, queries):
    """(query row, rank, candidate row, score) by comparing all, in whole numbers of any size."""
    import math

    v = [[math.floor(x * 1024) for x in r[1]] for r in rows]
    order = lambda i: (1 << 63) - 1 if rows[i][0] is None else rows[i][0]
    out = []
    for q in queries:
        s = {i: sum(a * b for a, b in zip(v[q], v[i])) for i in range(len(rows)) if i != q}
        out += [(rows[q][0], n + 1, rows[i][0], s[i]) for n, i in enumerate(sorted(s, key=lambda i: (-s[i], order(i)))[:k])]
    return sorted(out, key=str)


def test_large_numbers_and_null_ids(spark):
    big = float(1 << 17) + 1 / 1024
    rows = [((1 << 60) + i, [big + i, 1.0, -3.0], 0, 0) for i in range(40)] + [(None, [big, 2.0, 5.0], 0, 0), (-5, [-big, 0.0, 0.0], 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rid int, region string")
    got = K.exact_top(df, F.col("vec_id").isNull() | (F.col("vec_id") % 10 == 0), k=5, block=8)
    asked = [i for i, r in enumerate(rows) if r[0] is None or r[0] % 10 == 0]
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()), key=str) == brute(rows, 5, asked)
    near = H.neighbours(df, F.col("vec_id").isNull(), k=3).collect()
    assert len(near) == 3 and {r.query_id for r in near} == {None} and all(r.vec_id >= 1 << 60 for r in near)


def test_a_hot_vector_and_clusters(spark):
    """A third of all rows are one vector; regions of clusters far off are not searched, and nothing is lost."""
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 2.0, -1.0, 0.5], 0, 0) for i in range(300)]
    centres = rng.normal(size=(6, 4)) * 50
    rows += [(300 + i, (centres[i % 6] + rng.normal(size=4)).tolist(), 0, 0) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank int")
    got = K.exact_top(df, F.col("vec_id") % 100 == 0, k=10, block=50)
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()), key=str) == brute(rows, 10, [i for i in range(900) if i % 100 == 0])


def test_cuts():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(1000, 3))
    region = K.region_of(p, K.median_cuts(p, 8))
    assert sorted(np.bincount(region)) == [125] * 8
    assert K.median_cuts(np.ones((9, 2)), 4) == [] and (K.region_of(np.ones((9, 2)), []) == 0).all()
