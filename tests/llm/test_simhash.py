import random
import re

import numpy as np
import xxhash
from loamworks.llm import simhash as S


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps):
    ids = list(range(len(fps)))

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                ids[b] = a
    return [find(i) for i in range(len(fps))]


def test_code():
    words = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    index = S.nearest(words)
    codes = np.array([i << 11 for i in range(4096)])
    codes = codes ^ S._syndromes(codes)
    assert all((int(a) ^ int(codes[i])).bit_count() <= 3 for a, i in zip(words, index))
    rows, _ = S.neighbours(words)
    assert set(np.bincount(rows)) <= {1, 6}


def test_keys_meet():
    rnd = random.Random(3)
    for _ in range(400):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, 4)):
            b ^= 1 << bit
        r, k, s = S.keys(np.array([a, b], np.uint64).view(np.int64))
        x, y = [{(int(kk), int(ss)) for kk, ss, rr in zip(k, s, r) if rr == i} for i in (0, 1)]
        assert any(k1 == k2 and (s1 != s2 or s1 == 3) for k1, s1 in x for k2, s2 in y)


def test_components(spark):
    rnd = random.Random(7)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(400):  # chains and dense groups
        f = rnd.choice(fps)
        for bit in rnd.sample(range(64), rnd.randint(1, 5)):
            f ^= 1 << bit
        fps.append(f)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in fps], "fp long")
    got = {r.fp % (1 << 64): r.component for r in S.fingerprint_components(df).collect()}
    want = brute_components(fps)
    groups = {}
    for f, c in zip(fps, want):
        groups.setdefault(c, set()).add(got.get(f, f"own{f}"))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_operator(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5)))
    base = [[word() for _ in range(200)] for _ in range(6)]
    texts = [None, "", " \t", "One", "one two  THREE", "Ünï x"]
    for b in base:
        for _ in range(5):
            c = list(b)
            c[rnd.randrange(len(c))] = word()
            texts.append(" ".join(c).title() if rnd.random() < 0.3 else " ".join(c))
    texts += [texts[-1], "w " * 100_000]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: r for r in S.near_duplicates(df).collect()}
    fps = [brute_fp(x) for x in texts]
    for i, (f, c) in enumerate(zip(fps, brute_components(fps))):
        assert got[i].fp % (1 << 64) == f
        assert got[i].component_id == c
    assert S.near_duplicates(df.filter("false")).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.component_id) for r in S.near_duplicates(twice).collect()) == [(False, 4), (False, 4), (True, 4)]


def test_no_side_of_a_join_goes_to_the_driver(spark, monkeypatch):
    plans, stash = [], S.stash
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(S, "stash", lambda df: (plans.append(plan(df)), stash(df))[1])
    texts = [" ".join(f"w{j % 7}" for j in range(i % 5 * 9)) for i in range(40)]
    found = S.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plans.append(plan(found))  # as planned: by sizes that Spark guesses
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)
    assert found.count() == 40
