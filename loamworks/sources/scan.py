"""Rule files and skills of projects: a scan that reads only what has changed since the index.

A project's files are listed, a signature of size and time each. Files whose signature the index has are not read again: their records
come from it. Tasks read the rest, each file once. Skills in folders that a mirror marker says are copies are left out.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markers as M
from .ranges import listed, store_of
from .shared import written

MARKER = ".loamworks-mirror.json"
SKILL = "/SKILL.md"
FILES = "project string, root string, kind string, path string, size long, modified long, signature string"
READ = "project string, root string, kind string, path string, signature string, hash string, name string, description string, warnings array<string>, base string"
SHORT = 24


def signature(size: int, modified: int) -> str:
    return f"meta:{size}:{modified}"


def files_of(project: str, home: str | None = None) -> list[tuple]:
    """Rule files and skills of a project, and with a home the skills there. Marked copies are left out."""
    _, top = store_of(project)
    found = []
    for kind, name in M.RULE_FILES:
        found += [(kind, "", f) for f in listed(f"{project}/{name}", "", ()) if f.path == f"{top}/{name}"]
    for suffix in (".md", ".mdc"):
        found += [(M.RULE_FOLDER[0], "", f) for f in listed(f"{project}/{M.RULE_FOLDER[1]}", suffix, ())]
    roots = [f"{project}/{r}" for r in M.SKILL_ROOTS] + [f"{home}/{r}" for r in M.HOME_SKILL_ROOTS if home]
    for root in roots:
        marked = {posixpath.dirname(f.path) for f in listed(root, "/" + MARKER, ())}
        found += [("skill", store_of(root)[1], f) for f in listed(root, SKILL, ()) if posixpath.dirname(f.path) not in marked]
    return [(top, root, kind, f.path, f.size, f.modified, signature(f.size, f.modified)) for kind, root, f in found]


def front(text: str, fallback: str) -> tuple[str, str, list[str]]:
    """Name, description and warnings of a skill's text: plain ``key: value`` lines between two lines of dashes."""
    fields: dict[str, str] = {}
    end = text.find("\n---", 3) if text.startswith("---") else -1
    if end >= 0:
        for line in text[3:end].split("\n"):
            m = re.match(r"([A-Za-z_][\w-]*):[ \t]+(.*\S)\s*$", line)
            if m:
                value = m[2]
                quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
                if quoted or not re.fullmatch(r"-?\d+(\.\d+)?|true|false|null|~|[\[{].*", value):  # other values are no text
                    fields[m[1]] = value[1:-1] if quoted else value
    name, about = fields.get("name", fallback), fields.get("description", "")
    wrong = [f"missing frontmatter field: {k}" for k in ("name", "description") if k not in fields]
    wrong += ["skill name is empty"] if not name.strip() else []
    wrong += ["description is short; agents may not dispatch it reliably"] if len(about.strip().encode()) < SHORT else []
    return name, about, wrong


def slug(text: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_-]+", "-", text.strip().lower()).strip("-")


def skill_id(root: str, folder: str, name: str, project: str) -> str:
    parts = [s for s in (slug(p) for p in folder.removeprefix(root).split("/")) if s]
    if len(parts) >= 2:
        return f"{parts[0]}:{parts[-1]}"
    return f"{'project' if f'{folder}/'.startswith(f'{project}/') else 'local'}:{slug(name)}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in READ.split(", ")]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            store, path = store_of(r["path"])
            folder = posixpath.dirname(path)
            with store.open_input_file(path) as f:
                data = f.read()
            if r["kind"] != "skill":
                out.append((*[r[c] for c in names[:5]], hashlib.sha256(data).hexdigest(), None, None, None, None))
                continue
            whole = hashlib.sha256()
            for f in listed(folder, "", ()):  # a skill is its folder
                with store.open_input_file(f.path) as g:
                    whole.update(f"{f.path.removeprefix(folder + '/')}\0".encode() + g.read())
            about = front(data.decode("utf-8", "replace"), posixpath.basename(folder))
            out.append((*[r[c] for c in names[:5]], whole.hexdigest(), *about, skill_id(r["root"], folder, about[0], r["project"])))
        kinds = [pa.string()] * 8 + [pa.list_(pa.string()), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)


def scan(spark: SparkSession, projects: list[str], home: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Records of all rule files and skills: READ's columns and ``fresh``, whether the file was read now. ``index`` has the records of an
    earlier scan; those of files that are gone are left out."""
    files = spark.createDataFrame([f for p in projects for f in files_of(p, home)], FILES).dropDuplicates(["project", "path"])
    wanted, known = files, None
    if index is not None:
        held = index.select("project", "path", "signature", *["hash", "name", "description", "warnings", "base"])
        known = files.join(held, ["project", "path", "signature"]).select(*[c.split()[0] for c in READ.split(", ")], F.lit(False).alias("fresh"))
        wanted = files.join(held, ["project", "path", "signature"], "left_anti")
    read = wanted.select("project", "root", "kind", "path", "signature").repartition("path").mapInArrow(_read, READ).withColumn("fresh", F.lit(True))
    return read if known is None else read.unionByName(known)


def skills(records: DataFrame) -> DataFrame:
    """Skills of a scan with their ids; of equal ids in a project the second and further ones get a number."""
    rows = records.filter("kind = 'skill'").withColumn("folder", F.regexp_replace("path", "/SKILL[.]md$", ""))
    nth = F.row_number().over(Window.partitionBy("project", "base").orderBy("path"))
    low = F.lower("folder")
    kind = F.when(F.startswith(F.concat("folder", F.lit("/")), F.concat("project", F.lit("/"))), "project").when(low.contains("/.codex/superpowers/") | low.contains("/.agents/skills/superpowers/"), "superpowers").otherwise("referenced")
    return rows.select("project", F.when(nth == 1, F.col("base")).otherwise(F.concat_ws("-", "base", nth)).alias("id"), "name", "description", "folder", kind.alias("source_kind"), "hash", "warnings", "fresh")


# -- projects


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folders to their markers and the folders in them that are entered."""
    for batch in batches:
        markers, inner = [], []
        for path in batch.column("path").to_pylist():
            store, top = store_of(path)
            there = {f.base_name: f for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True))}
            is_dir = lambda name, store=store, top=top: store.get_file_info(f"{top}/{name}").type == fs.FileType.Directory
            found = [m for m in M.PROJECT_FILES if m in there and there[m].type == fs.FileType.File]
            found += [m for m in M.PROJECT_FOLDERS if m.split("/")[0] in there and is_dir(m)]
            markers.append(found)
            local = isinstance(store, fs.LocalFileSystem)
            inner.append(sorted(f.path for f in there.values() if f.type == fs.FileType.Directory and f.base_name not in M.PRUNED and not (local and os.path.islink(f.path))))
        kind = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(markers, kind), pa.array(inner, kind)], names=["path", "markers", "inner"])


def agents_of(markers: Column) -> Column:
    """The agents that a project's markers speak of, by name; unknown without any."""
    some = lambda *names: F.arrays_overlap(markers, F.array(*[F.lit(n) for n in names]))
    found = F.array_compact(F.array(*[F.when(some(*names), F.lit(agent)) for agent, names in M.AGENT_MARKERS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def discover_projects(spark: SparkSession, roots: list[str], depth: int = 4) -> DataFrame:
    """Folders with markers at most so deep below some folders: path, markers, agents. Links and folders of builds are not entered. A
    level's folders are a table, listed by tasks; the next level is what they hold."""
    level = spark.createDataFrame([(store_of(r)[1],) for r in roots], "path string").distinct()
    found = None
    for _ in range(depth + 1):
        level = written(level.mapInArrow(_look, "path string, markers array<string>, inner array<string>"))
        here = level.filter("size(markers) > 0").select("path", "markers")
        found = here if found is None else found.unionByName(here)
        level = level.select(F.explode("inner").alias("path"))
        if level.isEmpty():
            break
    return found.dropDuplicates(["path"]).withColumn("agents", agents_of(F.col("markers")))
