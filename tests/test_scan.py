import os

from loamworks.sources import scan as S


def put(path, text, when=1000):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (when, when))


def test_front():
    long = "description: Use it whenever a build breaks at night.\n"
    assert S.front(f"---\nname: build-it\n{long}---\nbody", "x") == ("build-it", "Use it whenever a build breaks at night.", [])
    assert S.front("no front", "folder") == ("folder", "", ["missing frontmatter field: name", "missing frontmatter field: description", "description is short; agents may not dispatch it reliably"])
    assert S.front('---\nname: "  "\ndescription: 5\n---\n', "x") == ("  ", "", ["missing frontmatter field: description", "skill name is empty", "description is short; agents may not dispatch it reliably"])
    assert S.front("---\nname: open", "x")[0] == "x"


def test_ids():
    assert S.skill_id("/p/.claude/skills", "/p/.claude/skills/Tools/Build It", "n", "/p") == "tools:build-it"
    assert S.skill_id("/p/.claude/skills", "/p/.claude/skills/one", "My Name!", "/p") == "project:my-name"
    assert S.skill_id("/h/.codex/skills", "/h/.codex/skills/one", "n", "/p") == "local:n"


def test_scan_reads_what_has_changed(spark, tmp_path):
    p, h = tmp_path / "p", tmp_path / "home"
    put(p / "AGENTS.md", "rules")
    put(p / "sub/AGENTS.md", "not of the project's root")
    put(p / ".cursor/rules/deep/a.mdc", "x")
    put(p / ".cursor/rules/b.txt", "x")
    put(p / ".claude/skills/a/SKILL.md", "---\nname: Same\ndescription: Long enough to be dispatched by agents.\n---\n")
    put(p / ".claude/skills/b/SKILL.md", "---\nname: same\n---\n")
    put(p / ".claude/skills/c/SKILL.md", "a copy")
    put(p / ".claude/skills/c/.loamworks-mirror.json", "{}")
    put(h / ".codex/skills/set/inner/SKILL.md", "home")
    first = S.scan(spark, [str(p)], str(h))
    rows = {os.path.relpath(r.path, tmp_path): r for r in first.collect()}
    assert set(rows) == {"p/AGENTS.md", "p/.cursor/rules/deep/a.mdc", "p/.claude/skills/a/SKILL.md", "p/.claude/skills/b/SKILL.md", "home/.codex/skills/set/inner/SKILL.md"}
    assert {r.kind for r in rows.values()} == {"codex", "cursor", "skill"} and all(r.fresh for r in rows.values())
    found = {r.id: r for r in S.skills(first).collect()}
    assert set(found) == {"project:same", "project:same-2", "set:inner"}
    assert found["set:inner"].source_kind == "referenced" and found["project:same-2"].folder.endswith("/b")
    index = spark.createDataFrame(first.drop("fresh").collect(), S.READ)
    again = S.scan(spark, [str(p)], str(h), index).collect()
    assert not any(r.fresh for r in again) and {(r.path, r.hash) for r in again} == {(r.path, r.hash) for r in rows.values()}
    put(p / "AGENTS.md", "rules changed", 1010)
    os.remove(p / ".claude/skills/b/SKILL.md")
    put(p / "CLAUDE.md", "new")
    last = {os.path.relpath(r.path, p): r.fresh for r in S.scan(spark, [str(p)], None, index).collect()}
    assert last == {"AGENTS.md": True, "CLAUDE.md": True, ".cursor/rules/deep/a.mdc": False, ".claude/skills/a/SKILL.md": False}
    assert S.scan(spark, [str(tmp_path / "none")]).count() == 0


def test_projects_are_found_by_their_markers(spark, tmp_path):
    put(tmp_path / "a/AGENTS.md", "")
    put(tmp_path / "a/node_modules/x/CLAUDE.md", "")
    put(tmp_path / "a/sub/.claude/skills/s/SKILL.md", "")
    put(tmp_path / "a/sub/CLAUDE.md", "")
    put(tmp_path / "b/.git/config", "")
    put(tmp_path / "c/d/e/f/g/AGENTS.md", "")
    put(tmp_path / "c/build/AGENTS.md", "")
    put(tmp_path / "c/AGENTS.md/not-a-file", "")
    os.symlink(tmp_path / "a", tmp_path / "link")
    rows = {os.path.relpath(r.path, tmp_path): (r.markers, r.agents) for r in S.discover_projects(spark, [str(tmp_path), str(tmp_path / "a")], 3).collect()}
    assert rows == {"a": (["AGENTS.md"], ["codex"]), "a/sub": (["CLAUDE.md", ".claude/skills"], ["claude-code"]), "b": ([".git"], ["unknown"])}
    assert S.discover_projects(spark, [str(tmp_path / "none")]).count() == 0
    assert "c/d/e/f/g" in {os.path.relpath(r.path, tmp_path) for r in S.discover_projects(spark, [str(tmp_path)], 5).collect()}
