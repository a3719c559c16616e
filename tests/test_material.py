"""Material, terms, cards and jobs against fixed values and plain loops in Python."""

import random
from collections import defaultdict

import pyarrow.parquet as pq
from loamworks.plans import cards, dialect, material, registry, terms

SF = "/root/testdata/sf0.001"
D = dialect.Spark


def over(spark, expression, rows):
    """Values of an SQL expression over a column x."""
    return [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").selectExpr("i", f"{expression} AS y").orderBy("i").collect()]


def test_middle_cut(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aé中😀") for _ in range(n)) for n in (0, 1, 20, 30, 31, 32, 40, 60, 61, 200) for _ in range(12)]

    def cut(text, head, tail):
        raw = text.encode()
        if len(raw) <= head + tail + 32:
            return text
        return raw[:head].decode(errors="ignore") + "\n...\n" + raw[len(raw) - tail :].decode(errors="ignore") + "\n"

    assert over(spark, material.middle_cut(D, "x", 20, 15), texts) == [cut(t, 20, 15) for t in texts]
    assert over(spark, material.head_bytes(D, "x", 17), texts) == [t.encode()[:17].decode(errors="ignore") for t in texts]


def test_specific_tokens(spark):
    cases = {
        "use v1.2 and (README) fooBar now": "v1.2 README fooBar",
        "v1 ab AB vX, V2.0.": "V2.0",
        "A_1 abc Abc aBc 123 12A。 v..": "A_1 aBc 12A",
        "": "",
    }
    got = over(spark, f"array_join({terms.specific_tokens(D, 'x')}, ' ')", list(cases))
    assert got == list(cases.values())


def test_suite_tier(spark):
    cases = {"只修改 一个文件": "", "先规划 再动手": "collaboration_preference", "用户体验 更重要": "cross_project_principle", "plain text": "project_rule", "planning for core functionality": "collaboration_preference"}
    assert over(spark, terms.suite_tier(D, "x"), list(cases)) == list(cases.values())


def test_names(spark):
    assert over(spark, cards.kebab(D, "x"), ["Use Bun, not NPM!", "--a--", "中文", "x" * 70, "a" * 63 + " b", ""]) == ["use-bun-not-npm", "a", "", "x" * 64, "a" * 63, ""]
    stems = over(spark, cards.file_stem(D, "x"), ["global:use-bun", "项目:短", "项目:a-name-that-is-long-enough"])
    assert stems[0] == "global-use-bun" and stems[2] == "a-name-that-is-long-enough"
    assert stems[1].startswith("memory-card-") and len(stems[1]) == 24
    assert over(spark, cards.card_error(D, "x", 128, True), [" ", "a" * 129, "a..b", "a/b", "a\\b", "C:a", "ok:id"]) == ["empty", "long", "dots", "separator", "separator", "drive", ""]


def test_preview_noise(spark):
    df = spark.createDataFrame([("global:global-x", "t", "b"), ("project:x", "现在的架构", "体验也不好"), ("project:x", "Cross_Project_Principle", "b"), ("agent:x", "always-on-rule", "plain")], "cid string, title string, body string")
    assert [r.y for r in df.selectExpr(f"{material.noise(D)} AS y").collect()] == [True, True, True, False]


def test_chunks(spark):
    sizes = {r.id: r.bytes for r in registry.queries()["compact_entries"](spark, SF).collect()}
    runs = defaultdict(list)
    for r in pq.read_table(f"{SF}/conversations.parquet", columns=["conv_id", "turn"]).to_pylist():
        runs[r["conv_id"]].append((-r["turn"], r["conv_id"] * 1000 + r["turn"]))
    want = set()
    for run, rows in runs.items():
        size = total = chunk = 0
        for _, i in sorted(rows):
            if size and size + sizes[i] > material.CHUNK:
                total, size, chunk = total + size, 0, chunk + 1
            if total >= material.TOTAL:
                break
            size += sizes[i]
            want.add((run, i, chunk))
    assert {(r.run, r.id, r.chunk) for r in registry.queries()["material_chunks"](spark, SF).collect()} == want


def test_long_runs_are_packed_until_full(spark, tmp_path):
    """A run of 200 long texts fills several chunks and then stops."""
    import duckdb

    rows = [(1, t, "user", "word " * (100 + t % 90)) for t in range(200)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.id, r.chunk) for r in registry.queries()["material_chunks"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cur = con.execute(registry.oracle_sql()["material_chunks"])
    place = [c[0] for c in cur.description].index
    assert got == {(r[place("id")], r[place("chunk")]) for r in cur.fetchall()}
    assert 20 < len(got) < 200 and len({c for _, c in got}) >= 4


def test_jobs(spark):
    state = {}
    for r in sorted(pq.read_table(f"{SF}/events.parquet").to_pylist(), key=lambda r: r["event_id"]):
        s = state.setdefault(r["user_id"], {"cancel": False, "life": ""})
        if r["event_type"] == "view":
            s.update(cancel=False, life="running")
        elif r["event_type"] == "click":
            s["life"] = "running"
        elif r["event_type"] == "error":
            s.update(cancel=True, life="cancelling")
        else:
            s["life"] = "cancelled" if s["cancel"] else "failed" if r["value"] < 20 else "completed"
    got = {r.job: (r.cancel_requested, r.lifecycle) for r in registry.queries()["job_lifecycle"](spark, SF).collect()}
    assert got == {k: (s["cancel"], s["life"]) for k, s in state.items()}


def test_sessions(spark):
    want = set()
    for r in pq.read_table(f"{SF}/events.parquet").to_pylist():
        if r["event_id"] % 5 < 3:
            want |= {(r["event_id"], f"s{r['event_id']}"), (r["event_id"], f"t{r['user_id']}")}
    assert {tuple(r) for r in registry.queries()["session_ids"](spark, SF).select("event_id", "session_id").collect()} == want
