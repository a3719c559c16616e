import hashlib
import zlib

import pytest
from loamworks.llm import merkle as M
from pyspark.sql import functions as F


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc, source, lang, n, text)])


def up(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H(*now[i : i + fanout]) for i in range(0, len(now), fanout)])
    return levels


def others(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        lo = i // fanout * fanout
        out.append((nodes[lo:i], nodes[i + 1 : lo + fanout]))
        i //= fanout
    return out


def brute(rows, fanout=2):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = own, up([leaf(*r) for r in own], fanout)
    top = up([trees[x][1][-1][0] for x in langs], fanout)
    out = []
    for at, lang in enumerate(langs):
        own, levels = trees[lang]
        for i, r in enumerate(own):
            path = others(levels, i, fanout) + others(top, at, fanout)
            now = leaf(*r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now = leaf(r[0], r[1], r[2], r[3] + 1, r[4])
            for before, after in path:
                now = H(*before, now, *after)
            proof = H(*[x for a, b in path for x in (*a, *b)])
            out.append((r[0], leaf(*r), levels[-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


def got(spark, rows, fanout=2):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string, I int")
    made = M.manifest(df, fanout)
    made = made.withColumn("folded", M.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    made = made.select("doc_id", "leaf", "subroot", "root", M.siblings(F.col("path")), "folded", F.col("folded") == F.col("root"))
    return sorted(map(tuple, made.collect()), key=str)


ROWS = [(i * 3, f"s{i % 4}", "en", i, f"tëxt {i}") for i in range(41)] + [
    (7, None, None, None, None), (None, "a", None, 5, ""), (None, "a", None, 5, ""), (8, "a", None, 5, "é" * 9), (1, "a", "de", 1, "x"), (100, "", "", 0, "y"), (100, "", "", 0, "y"),
    (100, "", "", 0, "z"), (3, "a", "zz", 9_223_372_036_854_775_806, "x" * 50_000), (-4, "a", "é", 1, "b"), (14, "a", "é", None, "b"), (9_223_372_036_854_775_807, "a", "é", 2, "b"),
]


@pytest.mark.parametrize("fanout", [2, 3])
def test_brute_force(spark, fanout):
    assert any(zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in ROWS)
    assert got(spark, ROWS, fanout) == brute(ROWS, fanout)


def test_one_language_one_row_no_row(spark):
    assert got(spark, ROWS[:1]) == brute(ROWS[:1])
    assert got(spark, ROWS[:6]) == brute(ROWS[:6])
    assert got(spark, []) == []


def test_equal_rows_and_shuffled_languages(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL", 0)
    rows = [(5, "a", "en", 1, "same")] * 33 + [(i, "a", f"l{i}", 1, "") for i in range(9)]
    assert got(spark, rows) == brute(rows)


def test_a_run_of_one_is_no_run(spark):
    with pytest.raises(ValueError):
        M.manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string"), 1)
