import os

import pytest
from loamworks.sources import artifacts as A

FILES = "path string, content string, kind string"
AGENTS = "agent string, instructions string, rules_dir string, skills_dir string"
CARDS = "project string, agent string, id string, title string, body string, route string, skill string, stem string"


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, names in os.walk(root) for f in names if not f.startswith(".lock")}


def put(spark, root, files):
    A.write(spark.createDataFrame([(p, c, "k") for p, c in files.items()], FILES).repartition(3), str(root))


def states(spark, root):
    return {r.path: r.state for r in A.artifact_states(spark, str(root)).collect()}


def test_all_or_none(spark, tmp_path):
    root = tmp_path / "out"
    files = {f"p{i}/A.md": f"text {i} é" for i in range(7)}
    put(spark, root, files)
    assert tree(root) == files and set(states(spark, root).values()) == {"synced"}
    put(spark, root, files)  # again
    assert tree(root) == files and set(A.load_lock(str(root))) == set(files)
    (root / "p1/A.md").write_text("mine")
    with pytest.raises(Exception, match="drifted"):
        put(spark, root, files | {"new/B.md": "x", "p2/A.md": "changed"})
    assert tree(root) == files | {"p1/A.md": "mine"}  # nothing was written, nothing is left aside
    os.remove(root / "p3/A.md")
    assert states(spark, root) == {p: "synced" for p in files} | {"p1/A.md": "drifted", "p3/A.md": "missing"}
    (root / "own.md").write_text("by hand")
    with pytest.raises(Exception, match="unmanaged"):
        put(spark, root, {"own.md": "x"})
    with pytest.raises(Exception, match="outside"):
        put(spark, root, {"../up.md": "x"})
    with pytest.raises(Exception, match="repeated"):
        A.write(spark.createDataFrame([("a.md", "1", "k"), ("a.md", "2", "k")], FILES), str(root))
    put(spark, root, {"p0/A.md": "next", "p3/A.md": "again"})
    assert tree(root) == files | {"p0/A.md": "next", "p1/A.md": "mine", "p3/A.md": "again", "own.md": "by hand"}
    put(spark, tmp_path / "none", {})
    assert tree(tmp_path / "none") == {}


def test_a_run_that_died_between_renames(spark, tmp_path):
    root = tmp_path / "out"
    put(spark, root, {"a.md": "1", "b.md": "1"})
    writer = A.ArtifactWriter(str(root))
    row = lambda p: A.Row(path=p, content="2", kind="k")
    message = writer.write(iter([row("a.md"), row("b.md")]))
    real, moved = A.fs.LocalFileSystem.move, []

    class Dying:
        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            return getattr(self.store, name)

        def move(self, a, b):
            if moved:
                raise OSError("gone")
            moved.append(b)
            return real(self.store, a, b)

    store = A.store_of
    try:
        A.store_of = lambda path: (Dying(store(path)[0]), store(path)[1])
        with pytest.raises(OSError):
            writer.commit([message])
    finally:
        A.store_of = store
    assert (root / "a.md").read_text() == "2" and (root / "b.md").read_text() == "1"
    assert A.unsafe(str(root), ["a.md", "b.md"], A.load_lock(str(root))) == {}
    put(spark, root, {"a.md": "3", "b.md": "3"})
    assert {p: c for p, c in tree(root).items() if not p.startswith(".aside")} == {"a.md": "3", "b.md": "3"}


def test_tasks_that_fail_leave_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    root = tmp_path / "out"
    df = spark.createDataFrame([(f"{i}.md", "x", "k") for i in range(9)], FILES).repartition(2)
    df = df.withColumn("content", F.when(F.col("path") == "5.md", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception):
        A.write(df, str(root))
    assert all(p.startswith(".aside-") for p in tree(root))  # a task may have gone on for a moment
    A.sweep(str(root))
    assert tree(root) == {} and A.load_lock(str(root)) == {}


def test_lists_of_files_stay_with_tasks(spark, tmp_path, monkeypatch):
    root = tmp_path / "out"
    files = {f"p{i % 40}/{i}.md": f"text {i}" for i in range(1500)}
    for name in ("load_lock", "unsafe"):  # in the driver only: tasks have modules of their own
        monkeypatch.setattr(A, name, lambda *_: pytest.fail("the driver reads files"))
    put(spark, root, files)
    nodes = {p: os.stat(root / p).st_ino for p in files}
    put(spark, root, files | {"p1/1.md": "other"})
    assert [p for p in files if os.stat(root / p).st_ino != nodes[p]] == ["p1/1.md"]  # what is there is not written again
    assert tree(root) == files | {"p1/1.md": "other"}
    assert set(states(spark, root).values()) == {"synced"}
    monkeypatch.undo()
    assert set(A.load_lock(str(root))) == set(files)
    assert max(len(A.load_shard(str(root), s)) for s in A.shards(str(root))) < 15


def test_the_data_source_does_the_same(spark, tmp_path):
    root = str(tmp_path / "out")
    spark.dataSource.register(A.CardArtifacts)
    rows = spark.createDataFrame([(f"p/{i}.md", f"text {i}", "k") for i in range(30)], FILES)
    for _ in range(2):
        rows.write.format("card_artifacts").option("path", root).mode("append").save()
    assert tree(root) == {f"p/{i}.md": f"text {i}" for i in range(30)} and set(states(spark, root).values()) == {"synced"}
    put(spark, root, {"p/3.md": "next"})
    assert tree(root)["p/3.md"] == "next" and len(A.load_lock(root)) == 30


def test_render(spark):
    agents = spark.createDataFrame([("one", "ONE.md", ".one/rules", ".one/skills"), ("two", "TWO.md", None, None)], AGENTS)
    cards = [("p", "one", "b", "T b", "body b", "instructions", "b", "b"), ("p", "one", "a", "T a", "body a", "instructions", "a", "a"), ("p", "one", "c", 'T "c"', "body c", "skill", "t-c", "c"), ("q", "two", "d", "T", "x" * 33_000, "instructions", "d", "d"), ("q", "one", "e", "T e", "body", "none", "e", "e"), ("q", "three", "z", "T", "b", "skill", "z", "z")]
    rows = {r.path: r for r in A.render(spark.createDataFrame(cards, CARDS), agents).collect()}
    assert set(rows) == {"p/ONE.md", "p/.one/rules/cards.md", "p/.one/skills/cards/references/cards.md", "p/.one/skills/t-c/SKILL.md", "p/.one/skills/t-c/references/c.md", "q/TWO.md", "q/ONE.md", "q/.one/rules/cards.md", "q/.one/skills/cards/references/cards.md"}
    assert rows["p/ONE.md"].content == A.NOTE + "# Instructions\n\n## Skills\n\n- `t-c`\n\n## Cards\n\n### T a\n\nbody a\n\n### T b\n\nbody b\n\n"
    assert rows["p/.one/rules/cards.md"].content == A.NOTE + "# Rules\n\n## T a\n\nbody a\n\n## T b\n\nbody b\n\n"
    assert rows["q/ONE.md"].content.endswith("## Cards\n\n- No cards are declared for this agent yet.\n")
    assert 'description: ["T \\"c\\""]' in rows["p/.one/skills/t-c/SKILL.md"].content
    assert [p for p, r in rows.items() if r.over_budget] == ["q/TWO.md"]
    assert "- a (instructions): T a\n- b (instructions): T b\n- c (skill)" in rows["p/.one/skills/cards/references/cards.md"].content


def test_mirror_states(spark):
    cases = {
        "missing": ("s", None, "s"), "synced": ("s", "s", "s"), "synced too": ("s", "s", None), "source updated": ("s2", "s", "s"), "target drifted": ("s", "t", "s"),
        "source updated + target drifted": ("s2", "t", "s"), "unmanaged target exists": ("s", "t", None), "both alike": ("s2", "s2", "s"), "source gone": (None, "s", "s"), "nothing left": (None, None, "s"),
    }
    of = lambda i: spark.createDataFrame([(k, v[i]) for k, v in cases.items() if v[i]], "folder string, hash string")
    got = {r.folder: r.state for r in A.mirror_states(of(0), of(1), of(2)).collect()}
    assert got == {k: k for k in cases} | {"synced too": "synced", "both alike": "synced", "source gone": "source updated", "nothing left": "missing"}


def test_tree_hashes(spark):
    files = [("f", "b/x.md", "1"), ("f", "a.md", "2"), ("f", "b/lock.yml", "3"), ("g", "a.md", "2"), ("g", "b/x.md", "1"), ("h", "a.md", "12"), ("h", "b/x.md", None)]
    df = spark.createDataFrame(files, "folder string, path string, content string")
    got = {r.folder: (r.files, r.hash) for r in A.tree_hashes(df, skipped=("lock.yml",)).collect()}
    assert got["f"] == got["g"] and got["f"][0] == 2 and got["h"][1] != got["f"][1]
    assert got["f"][1] == A.text_hash(f"a.md\0{A.text_hash('2')}\nb/x.md\0{A.text_hash('1')}\n")
