import re
from collections import Counter, defaultdict

import pyarrow as pa
from loamworks.llm import divergence as D


def brute(rows, least=3, top=200):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, found in rows:
        groups[lang].add(source)
        df[lang].update(set(found))
        n[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in df[lang].items() if d >= least]

        def shares(counts):
            of = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // of for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        whole = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][t] - whole[t]) ** 2 // whole[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


ROWS = [
    (1, "en", "a", "The cat, the CAT sat; été"), (2, "en", "b", "the dog été"), (3, "en", "a", "cat dog the"), (3, "en", "a", "cat dog the"), (None, "en", "c", None), (4, "en", "c", "1 2 3"),
    (5, None, "a", "x x y"), (6, "", None, "x y z"), (7, None, "b", "x z"), (8, "", "", "z y"), (9, "fr", "é", "un deux"), (10, "fr", "z", "un"), (11, "fr", "é", "trois"),
    (12, "en", "d", "dog " * 5000 + "unheard"), (13, "en", "a", ""), (14, "en", "b", "tie eit tie eit"), (15, "en", "b", "eit tie"), (16, "en", "b", "tie, eit"),
]
SCHEMA = "doc_id long, lang string, source string, text string, term int, p0 string, value double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], SCHEMA)


def got(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_brute_force(spark, monkeypatch):
    want = brute([r[1:] for r in ROWS])
    assert got(D.audit(frame(spark, ROWS))) == want
    assert got(D.audit(frame(spark, ROWS), top=1)) == brute([r[1:] for r in ROWS], top=1)
    monkeypatch.setattr(D, "SMALL", 0)  # joins by a shuffle
    assert got(D.audit(frame(spark, ROWS[::-1]).repartition(5))) == want


def test_without_terms_and_without_rows(spark):
    alone = [(1, "en", "a", None), (2, "en", "b", "12 34")]
    assert got(D.audit(frame(spark, alone))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert got(D.audit(frame(spark, []))) == []


def test_runs_go_on_across_batches():
    rows = [("en", "a", "s", 1, 2, 3), ("en", "a", "s", 2, 1, 1), ("en", "a", "t", 1, 1, 1), ("en", "a", "t", 1, 4, 5), ("fr", "a", "t", 1, 1, 1)]
    want = [("en", "a", "s", 3, 4), ("en", "a", "t", 5, 6), ("fr", "a", "t", 1, 1)]
    for size in (1, 2, 3, 5):
        batches = [pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows[i : i + size])], names=["lang", "term", "source", "document", "df", "n"]) for i in range(0, len(rows), size)]
        found = [tuple(r.values()) for b in D.run_lengths(iter(batches)) for r in b.to_pylist()]
        assert found == want


def test_many_sources(spark):
    rows = [(i, "en", f"s{i % 40}", " ".join(chr(97 + (i * k) % 26) * (1 + k % 3) for k in range(1, 30))) for i in range(300)]
    assert got(D.audit(frame(spark, rows))) == brute([r[1:] for r in rows])


def test_best_keeps_ties_in_order():
    best = D.Best(2)
    best.add(pa.table({"lang": ["e"] * 4, "source": ["a", "a", "a", "b"], "item": ["z", "é", "b", "q"], "value": pa.array([5, 5, 5, 1])}))
    best.cut()
    assert best.held.column("item").to_pylist() == ["b", "z", "q"]
