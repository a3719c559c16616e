import hashlib
import random

from loamworks.llm import chat as C


def test_round_trip(spark):
    rnd = random.Random(6)
    bits = ["\\", "#", "<", ":", ": ", "### ", "</turn>\n", "<+>", "\\b", "\\l", "a", "é🎉", "\n", " "]
    text = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))
    rows = list(C.HARD)
    for c in range(40):
        for t in range(rnd.randint(1, 7)):
            rows.append((c, t, rnd.choice(["user", "assistant", "assistant", "system", None, "a:b# <x"]), rnd.choice([None, text(), text(), text()])))
    rows += [(100, 1, "user", "same"), (100, 1, "user", "same"), (100, 1, "assistant", "x"), (None, None, "assistant", "y"), (101, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    chats = C.read_back(C.format_chats(df))
    got = {r.conv_id: r for r in chats.collect()}
    digest = {r.conv_id: r for r in C.digests(chats).collect()}
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in turns]
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].loss_text == loss
        d = digest[c]
        assert d.n_turns == len(turns) and d.loss_chars == len(loss) and d.formatted_chars == len(got[c].formatted)
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
    # adjacent turns of one role share a block
    assert got[100].formatted == "### assistant: x</turn>\n### user: same<+>same</turn>\n"
    assert C.format_chats(df.filter("false")).count() == 0
