import random
from collections import Counter

import numpy as np
import pytest
from loamworks.llm import toxicity as X

BAD = ["idiot", "moron", "stupid"]


def corpus(spark, n=600):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(["an", "ther", "on", "ing", "es", "ti", "ou", "re"]) for _ in range(rnd.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(40)], i % 6 == 0
        if toxic:
            words.insert(rnd.randrange(40), rnd.choice(BAD))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic)))
    hidden = ["an 1d10t on", "ther i d i o t ing", "on m0rrron, es", "re s.t.u.p.i.d ou", "the IDIOT!"]
    docs += [(1000 + i, x, "x") for i, x in enumerate(hidden)]
    docs += [(2000, None, "x"), (2001, "", "x"), (2002, "an " * 50_000, "x"), (2002, "an ther", "x"), (None, "on idiot", "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels + labels[:3], "doc_id long, quality int, toxic int")


def test_scores(spark):
    docs, labels = corpus(spark)
    got = X.score(docs, docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r.score)
    held = [i for i in range(600) if X.crc_held_out(i)]
    assert sum((by[i] >= 0.5) == (i % 6 == 0) for i in held) / len(held) > 0.95
    assert all(by[1000 + i] >= 0.5 for i in range(5))
    assert by[2000] == by[2001] < 0.5 and by[2002] < 0.5 and by[None] >= 0.5
    none = X.score(docs, docs, labels.filter("false")).collect()
    assert all(r.score < 0.5 for r in none)
    assert X.score(docs.filter("false"), docs, labels).count() == 0


def test_held_out_rows_do_not_teach(spark):
    docs, labels = corpus(spark)
    ids = {r.doc_id for r in X.training_rows(labels).collect()}
    assert ids and not any(X.crc_held_out(i) for i in ids)
    assert len({r.doc_id for r in X.training_rows(labels, 100).collect()}) < 200


def test_viterbi_equals_all_paths(spark):
    docs, _ = corpus(spark, 100)
    costs = X.language_model(X.count_trigrams(docs))
    number = {c: i for i, c in enumerate(X.LETTERS, 1)}

    def paths(arcs, at=0):
        if at == len(arcs):
            yield "", 0.0
            return
        for to, text, cost in arcs[at]:
            for rest, more in paths(arcs, to):
                yield text + rest, cost + more

    def total(text, cost):
        z = [0, 0, *[number.get(c, X.OTHER) for c in text], 0]
        return cost + sum(costs[a, b, c] for a, b, c in zip(z, z[1:], z[2:]))

    for word in ("1d10t", "m0rrron", "s.t.u", "a!!b", "t0o00"):
        best = min(total(*p) for p in paths(X.lattice(word)))
        said = X.restore(word, costs)
        assert min(total(t, c) for t, c in paths(X.lattice(word)) if t == said) == pytest.approx(best)


def test_long_and_joined_runs(spark):
    docs, labels = corpus(spark)
    spaced = lambda x: " ".join(x.replace(" ", ""))
    hidden = ["on " + spaced("another ther stupid"), "an " + spaced("an ther ing on re another ther ing idiot ou ther ing an"), "re " + ".".join("therstupiding"), "on " + "i" * 40 + "diot"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(hidden)] + [(9, "on " + spaced("an ther ing on re another ther ing ou ther ing an"))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in X.score(rows, docs, labels).collect()}
    assert [i for i in range(4) if got[i] < 0.5] == [] and got[9] < 0.5


def test_trigrams_of_texts_counted_together(spark, monkeypatch):
    monkeypatch.setattr(X, "COUNTED", 50)
    texts = ["", None, "Äb  c", "x" * 130, *(f"an ther {i} \u65e5 on" for i in range(60)), "\U0001f600 a"]
    codes, expected = X._codes(), Counter()
    for t in texts:
        c = [int(codes[min(ord(s), 0x180)]) for s in f"  {t or ''}  "]
        expected.update((a * X.SIZE + b) * X.SIZE + d for a, b, d in zip(c, c[1:], c[2:]))
    assert codes[0x180] == X.OTHER
    got = X.count_trigrams(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1))
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(expected)


def test_reading_looks_up_only_words_that_may_have_evidence(monkeypatch):
    costs = X.language_model(np.ones(X.SIZE**3, np.int64))
    looked, features_of = [], X.features_of
    monkeypatch.setattr(X, "features_of", lambda w: looked.append(w) or features_of(w))
    reader = X.Reader(costs, {"idiot": 2.0, "stup*": 1.0})
    text = "the idiots, of an Idiot! stupidity is there " + " ".join(f"there{i:b}ing" for i in range(100))
    assert reader.evidence(text) == reader.evidence(text) == 3.0
    assert sorted(looked) == ["idiot", "idiots", "stupidity"]  # one look for each distinct word
    assert reader.evidence("of an") == 0 == reader.evidence(None)
    for word in ("1d10t", "m0rrron", "s.t.u", "a**b"):  # the flat list of costs says the same as the array
        assert X.restore(word, costs.ravel().tolist()) == X.restore(word, costs)


def test_suspect_signs():
    def plainly(word):
        if not any(c in X.LETTERS for c in word):
            return False
        if any(c in X.LOOKS for c in word) or X.DOTTED.match(word):
            return True
        pairs = [a == b for a, b in zip(word, word[1:])]
        return sum(pairs) > 2 or any(a and b for a, b in zip(pairs, pairs[1:]))

    rnd = random.Random(3)
    words = ["", "a", ".", "a.b.c", "a.b", "aa.bb.c", "aabbcc", "aabb", "baaa", "...", "a.b.", "日.日.日", "日.a.日"]
    words += ["".join(rnd.choice("aabbcé.-'\n0$日") for _ in range(rnd.randint(0, 8))) for _ in range(5000)]
    assert [w for w in words if X.suspect(w) != bool(plainly(w))] == []
