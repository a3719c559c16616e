import random
import time

import numpy as np
import pytest
from loamworks.llm import suffixdedup as S


def brute(rows, length=50):
    seen = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            seen[s] = min(seen.get(s, 1 << 80), S.LAST if d is None else d)
    out = []
    for d, t in rows:
        b, d = (t or "").encode(), S.LAST if d is None else d
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] < d:
                gone[i : i + length] = True
        spans = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def rows():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcé ñ") for _ in range(rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rnd.randint(5, 40)) for _ in range(8)]
    common = "a common beginning of some length "
    out = [(5, None), (6, ""), (7, "short"), (8, "x" * 300), (9, "x" * 49), (3, "x" * 120)]
    for i in range(10, 130):
        t = text(rnd.randint(1, 30))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a, b = sorted((rnd.randrange(len(p)), rnd.randrange(len(p))))
            t = t + (p if rnd.random() < 0.5 else p[a:b]) + text(2)
        out.append((i, common + t if i % 3 == 0 else t))
    out += [(200 + i, out[20 + i][1]) for i in range(10)]
    out += [(300, out[25][1][:-7] + "?" + out[25][1][-7:]), (12, out[30][1]), (12, out[30][1]), (None, out[31][1]), (2, out[32][1])]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("batch,many,sorted_,length", [(6_000_000, 4096, 20_000, 50), (700, 4, 10, 50), (60, 1, 1, 50), (900, 3, 50, 20), (5000, 2, 7, 51), (700, 4, 10, 120), (3000, 4096, 100, 5)])
def test_equals_brute_force(spark, batch, many, sorted_, length):
    data = [(i, *r) for i, r in enumerate(rows())]
    df = spark.createDataFrame([(*r, 1, "c", 2, "x", 3, 4, None) for r in data], "no int, doc_id long, text string, h int, cd string, ch int, cuts string, d int, `_own_d` long, n_bytes string").repartition(3)
    made = S.dedup_passages(df, batch_bytes=batch, many=many, together=sorted_, length=length)
    assert made.columns == ["no", "doc_id", "text", "h", "cd", "ch", "cuts", "d", "_own_d", "n_bytes", "n_removed", "n_spans", "kept"]
    out = made.collect()
    assert {(r.h, r.cd, r.ch, r.cuts, r.d, r._own_d) for r in out} == {(1, "c", 2, "x", 3, 4)}
    got = {r.no: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out}
    want = brute([(d, t) for _, d, t in data], length)
    for no, d, t in data:
        assert got[no] == want[no], (no, d, t)
    assert sum(w[1] > 0 for w in want) > (30 if length < 120 else 10)
    assert S.dedup_passages(df.filter("false")).count() == 0


def test_suffix_sort():
    rnd = np.random.default_rng(2)
    text = rnd.integers(97, 99, 3000).astype(np.uint8)
    group = np.sort(rnd.integers(0, 9, 800))
    suffixes = rnd.permutation(2900)[:800]
    got = S.suffix_sort(text, S.Prefixes(text), suffixes, group, 50)
    raw = text.tobytes()
    for g in range(9):
        mine = [raw[s : s + 50] for s in got[group == g]]
        assert mine == sorted(raw[s : s + 50] for s in suffixes[group == g])


def test_collisions_are_told_apart():
    text = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60, np.uint8)
    start, count = np.array([0, 60, 120]), np.array([11, 11, 11])
    anchor, whole = np.full(3, 7, np.uint64), np.full(3, 9, np.uint64)
    apart = S.apart_where_unequal(text, start, count, anchor, whole, np.array([1, 2, 3]), 50)
    assert apart[0] == apart[2] == 9 and apart[1] != 9


def test_places_have_room():
    p = S.Packing(1 << 33, 50)
    anchor, first, n = p.unpack(p.pack(np.array([1 << 63, 5], np.uint64), np.array([1 << 33, 0]), np.array([31, 1])))
    assert first.tolist() == [1 << 33, 0] and n.tolist() == [31, 1] and anchor[0] != anchor[1]
    with pytest.raises(ValueError):
        S.Packing(1 << 46, 120)


def test_entries_leave_the_disks_before_texts_move(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_to = shuffled(), spark.conf.get(key, None)
    made = S.dedup_passages(spark.createDataFrame(rows(), "doc_id long, text string").repartition(3))
    until = time.time() + 20
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(key, None) == set_to
    # what stays is enough to run the rest, more than once
    assert made.agg({"n_removed": "sum"}).first() == made.agg({"n_removed": "sum"}).first()
