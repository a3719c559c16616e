import random
import textwrap

from loamworks.llm import licenses as L


def brute(text):
    """Each unit with each template, without bounds."""
    grams = lambda t: {(a, b) for a, b in zip(L.WORD.findall(t.lower()), L.WORD.findall(t.lower())[1:])}
    best = None
    g = grams(text)
    for name, t in L.TEMPLATES:
        h = grams(t)
        if g and (d := 2 * len(g & h) / (len(g) + len(h))) >= L.LEAST and (best is None or (-d, name) < (-best[0], best[1])):
            best = (d, name)
    return best


def test_units_equal_brute_force():
    rnd, index = random.Random(3), L.Index()
    for name, t in L.TEMPLATES:
        assert index.best(t) == (1.0, name)
        words = t.split()
        for _ in range(60):
            w = list(words)
            for _ in range(rnd.randint(0, 3)):
                k = rnd.randrange(len(w))
                w[k : k + 1] = rnd.choice([[], ["other"], [w[k], w[k]], ["MIT"]])
            text = " ".join(w * rnd.choice([1, 1, 1, 3]))
            assert index.best(text) == brute(text)


def test_scan(spark):
    full = dict((n + str(i), t) for i, (n, t) in enumerate(L.TEMPLATES))
    mit = next(t for n, t in full.items() if n.startswith("MIT") and t.startswith("Permission is hereby"))
    wrapped = mit.replace(" to ", "\nto ")
    rows = [(1, "Licensed under CC BY-NC 4.0.\nsome text é", "x"), (2, None, "x"), (3, "", "x"), (4, "a\n\n" + wrapped + "\n\nb", "x"), (5, "word " * 100_000 + "\nReleased under the MIT License.", "x"), (6, "plain prose without any", "x"), (6, "plain prose without any", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Licenses string")
    got = {r.doc_id: [tuple(m) for m in r.licenses] for r in L.find_licenses(df).collect()}
    assert got[1] == [(0, 28, "CC-BY-NC-4.0", 1.0)]
    assert got[2] == got[3] == got[6] == []
    assert [(m[0], m[1], m[2]) for m in got[4]] == [(3, 3 + len(wrapped), "MIT")]
    assert [(m[0], m[1], m[2]) for m in got[5]] == [(500_001, 500_032, "MIT")]
    assert L.find_licenses(df).count() == 7 and L.find_licenses(df.filter("false")).count() == 0


def test_full_texts_anywhere():
    """Licences within prose, wrapped over lines, within a long line, with empty lines in them, and twice in a row."""
    index, rnd = L.Index(), random.Random(2)
    prose = lambda n: " ".join(rnd.choice(["garden", "the", "of", "rain", "software", "and", "river", "license"]) for _ in range(n))
    wrap = lambda t: "\n".join(textwrap.wrap(t, 60))
    for name, text in L.TEMPLATES:
        for made in (f"{prose(80)} {text} {prose(70)}", f"{prose(30)}\n{wrap(text)}\n{prose(20)}", wrap(text).replace("\n", "\n\n", 2), f"x = 1\n# {text}\ny = 2"):
            found = index.scan(made)
            assert name in {f[2] for f in found}, (name, made, found)
            assert all(made[a:b].strip() for a, b, *_ in found)
        assert [f[2] for f in index.scan(f"{text}\n{prose(40)}\n{text}")].count(name) >= 2
    assert index.scan(prose(4000)) == []
    apache = dict(L.TEMPLATES)["Apache-2.0"]
    usual = apache.replace("License at http", "License at\n\n    http").replace("2.0 Unless", "2.0\n\nUnless")
    (a, b, name, dice), = index.scan(f"import os\n\n{usual}\n\ndef f():\n    return 1\n")
    assert name == "Apache-2.0" and dice > 0.95


def brute_windows(index, text):
    """The best coefficient of each template over windows of its size, each counted anew."""
    w, best = L.words_of(text), {}
    for t, n in enumerate(index.words):
        for i in range(max(1, len(w) - n + 1)):
            part = w[i : i + n]
            g = set(zip(part, part[1:]))
            d = 2 * len(g & index.grams[t]) / (len(g) + index.sizes[t]) if g else 0
            if d >= index.least:
                best.setdefault(t, []).append((i, d))
    return best


def test_windows_equal_brute_force():
    templates = (("a", "one two three four five six"), ("b", "two three one one two"), ("c", "six five four three two one six five four"))
    index, rnd = L.Index(templates, 0.6), random.Random(5)
    for _ in range(60):
        text = " ".join(rnd.choice("one two three four five six".split()) for _ in range(rnd.randint(0, 40)))
        words = L.words_of(text)
        grams = list(zip(words, words[1:]))
        want = brute_windows(index, text)
        for t in range(3):
            got = [(i, round(d, 9)) for i, d in index.windows(grams, t)]
            if len(words) >= index.words[t]:
                assert got == [(i, round(d, 9)) for i, d in want.get(t, [])], (text, t)
            if want.get(t):
                assert t in index.possible(set(grams))
