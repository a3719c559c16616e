import random
import re

import numpy as np
import pytest
from loamworks.llm import jaccard as J
from loamworks.llm import sigtree


def brute(rows, num=85, den=100):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(x & sets[j])
            if x and sets[j] and den * shared >= num * (len(x) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def got(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, n int").repartition(parts)
    return sorted(map(tuple, J.near_duplicates(df, **more).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def corpus(seed, bases=8, copies=14, size=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 3)))
    passage = [word() for _ in range(25)]
    texts = [None, "", " \t\n", "One", "one", "one two THREE", "ONE two three", "a b c d", "a b c d e", "w " * 3000, " ".join(word() for _ in range(3000))]
    for _ in range(bases):
        base = [word() for _ in range(size + rnd.randint(0, 80))]
        for _ in range(copies):  # around the threshold: each change costs up to four shingles on each side
            c = list(base)
            for _ in range(rnd.randint(0, 4)):
                at = rnd.randrange(len(c))
                c[at : at + rnd.randint(0, 2)] = [word() for _ in range(rnd.randint(0, 2))]
            if rnd.random() < 0.3:
                c = passage + c
            texts.append(" ".join(c).title() if rnd.random() < 0.3 else "\n".join(c))
    texts += [texts[-1], texts[20]]
    texts += [" ".join(passage + [f"own{i}"]) for i in range(12)]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return [(None if i in (3, 9) else i // 2 if i % 9 == 0 else i, t) for i, t in zip(ids, texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert len({c for *_, c in want}) < len(rows) - 40
    assert got(spark, rows) == want


def test_parts_of_lists_and_of_components(spark, monkeypatch):
    monkeypatch.setattr(J, "PART", 3)
    monkeypatch.setattr(J, "SHINGLES", 300)
    for seed in (3, 4):
        rows = corpus(seed, bases=5, copies=20)
        assert got(spark, rows) == brute(rows)


def test_other_thresholds_and_orders(spark, monkeypatch):
    rows = corpus(5, bases=4)
    monkeypatch.setattr(J, "SAMPLE", 5)
    monkeypatch.setattr(J, "FREQUENT", 3)
    assert got(spark, rows, num=6, den=10) == brute(rows, 6, 10)
    assert got(spark, rows, num=1, den=1) == brute(rows, 1, 1)
    with pytest.raises(ValueError):
        got(spark, rows, num=1, den=2)


def test_no_rows_and_no_links(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, None), (1, ""), (2, "a"), (1, "b")]) == brute([(None, None), (1, ""), (2, "a"), (1, "b")])


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    # a weak hash: many shingles share one, so prefixes, signatures and sets of hashes collide
    import xxhash

    real = xxhash.xxh64_intdigest
    links = J.verify(sigtree.Threshold(85, 100))
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x, s: real(x, s) % 7)
    import pyarrow as pa

    rows = [b"a b c d e f g", b"h i j k l m n", b"a b c d e f g h", b"x", b"y"]
    batch = pa.RecordBatch.from_pylist([{"block": 1, "part": 0, "turn": 0, "side": 0, "id": i, "label": i, "words": w} for i, w in enumerate(rows)])
    found = [tuple(r.values()) for b in links(iter([batch])) for r in b.to_pylist()]
    assert found == []


def test_bounds_never_cut_a_link():
    rnd = random.Random(9)
    rule = sigtree.Threshold(85, 100)
    tokens = [rnd.getrandbits(64) for _ in range(400)]
    docs = []
    for _ in range(120):
        base = rnd.choice(docs) if docs and rnd.random() < 0.7 else rnd.sample(tokens, rnd.randint(1, 130))
        own = set(base)
        for _ in range(rnd.randint(0, 6)):
            own.add(rnd.choice(tokens)) if rnd.random() < 0.5 else own.discard(rnd.choice(list(own))) if len(own) > 1 else None
        docs.append(sorted(own))
    items = []
    for d in docs:
        w = sigtree.width(len(d))
        items.append((len(d), int.from_bytes(sigtree.signature(np.array(d, np.uint64), w), "little"), w))
    near = lambda i, j: rule.links(len(set(docs[i]) & set(docs[j])), len(docs[i]) + len(docs[j]))

    def groups(pairs):
        s = sigtree.Sets(len(docs))
        for i, j in pairs:
            s.union(i, j)
        return [s.find(i) for i in range(len(docs))]

    want = groups([(i, j) for i in range(len(docs)) for j in range(i) if near(i, j)])
    assert groups(sigtree.join(items, None, None, rule, sigtree.Sets(len(docs)), near)) == want
    half = set(range(0, len(docs), 2))
    across = sigtree.join(items, sorted(half), sorted(set(range(len(docs))) - half), rule, sigtree.Sets(len(docs)), near)
    assert groups(across) == groups([(i, j) for i in half for j in range(len(docs)) if j not in half and near(i, j)])


def test_prefixes_of_sets_that_link_meet():
    rnd = random.Random(4)
    rule = sigtree.Threshold(85, 100)
    often = np.array(sorted(range(0, 60, 7)), np.uint64), np.arange(1, 10)
    for _ in range(300):
        a = rnd.sample(range(60), rnd.randint(1, 40))
        b = set(a)
        for _ in range(rnd.randint(0, 5)):
            b.symmetric_difference_update({rnd.randrange(60)})
        if b and rule.links(len(set(a) & b), len(a) + len(b)):
            x, y = (set(J.prefix_of(np.array(list(s), np.uint64), often, rule).tolist()) for s in (a, b))
            assert x & y
