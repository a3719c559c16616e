"""Artifacts: files that are made of cards, written all or none, and compared with what is there.

``render`` makes the files' texts out of cards, by project and agent: instructions, rules, skills with references, and an overview of all
cards. ``write`` puts them down in steps, each a job. Tasks write each text that is not there yet aside; others check that every file is
either new or still what was last written, and only if all are, texts are renamed. The lock says what was written last: its next version
is put down before the first rename and made final after the last one, so a run that dies in between is made good by the next. Tasks that
are killed may leave texts aside, in a folder that nothing reads; ``sweep`` removes such folders when no run is under way.

The lock is cut into shards by a hash of the path. A shard and the files it names are read, checked and put down by one task, so what the
driver holds does not grow with the files. The data source ``card_artifacts`` does the same steps for rows whose list fits the driver.

``tree_hashes`` and ``mirror_states`` compare folders with their mirrors; ``artifact_states`` compares files with the lock.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .ranges import store_of
from .shared import written

#: Instructions beyond so many bytes are too long to be read each time.
BUDGET = 32 * 1024
#: Parts of the lock.
SHARDS = 1024
NOTE = "<!-- Generated by loamworks. Do not edit directly: import manual changes instead. -->\n\n"


# -- texts


def _listed(text: Column) -> Column:
    """Texts of a group in the order of the cards' ids."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("id", text.alias("text"))))), lambda x: x["text"]), "")


def section(level: str) -> Column:
    return F.concat(F.lit(f"{level} "), "title", F.lit("\n\n"), "body", F.lit("\n\n"))


def _or(text: Column, other: str) -> Column:
    return F.when(text == "", F.lit(other)).otherwise(text)


def render(cards: DataFrame, agents: DataFrame) -> DataFrame:
    """(project, agent, kind, path, content, over_budget). ``cards``: project, agent, id, title, body, route (instructions, skill or
    another), skill, stem; ``agents``: agent, instructions, rules_dir, skills_dir (null for what an agent does not read). An agent's
    files of a project are made if any card names the agent, whatever the card's route."""
    rows = cards.join(F.broadcast(agents), "agent")  # a configuration: a row an agent
    own = ["project", "agent"]
    config = ["instructions", "rules_dir", "skills_dir"]
    always = F.col("route") == "instructions"
    each = rows.groupBy(*own, *config).agg(
        _listed(F.when(always, section("###"))).alias("cards"),
        _listed(F.when(always, section("##"))).alias("rules"),
        _listed(F.when(F.col("route") == "skill", F.concat(F.lit("- `"), "skill", F.lit("`\n")))).alias("skills"),
        _listed(F.concat(F.lit("- "), "id", F.lit(" ("), "route", F.lit("): "), "title", F.lit("\n"))).alias("all"),
    )
    none = "- No cards are declared for this agent yet.\n"
    instructions = F.concat(F.lit(NOTE + "# Instructions\n\n## Skills\n\n"), _or(F.col("skills"), "- No skills are declared for this agent yet.\n"), F.lit("\n## Cards\n\n"), _or(F.col("cards"), none))
    rules = F.concat(F.lit(NOTE + "# Rules\n\n"), _or(F.col("rules"), none))
    overview = F.concat(F.lit(NOTE + "# Cards\n\n"), F.col("all"))
    whole = lambda where, kind, path, content: each.filter(F.col(where).isNotNull()).select(*own, F.concat("agent", F.lit(f":{kind}")).alias("kind"), path.alias("path"), content.alias("content"))
    made = whole("instructions", "instructions", F.concat_ws("/", "project", "instructions"), instructions)
    made = made.unionByName(whole("rules_dir", "rules", F.concat_ws("/", "project", "rules_dir", F.lit("cards.md")), rules))
    made = made.unionByName(whole("skills_dir", "overview", F.concat_ws("/", "project", "skills_dir", F.lit("cards/references/cards.md")), overview))
    skills = rows.filter((F.col("route") == "skill") & F.col("skills_dir").isNotNull())
    head = F.concat(F.lit("---\nname: "), "skill", F.lit("\ndescription: "), F.to_json(F.array("title")), F.lit("\n---\n\n"), F.lit(NOTE), section("#"), F.lit("Read `references/"), "stem", F.lit(".md` first.\n"))
    one = lambda kind, path, content: skills.select(*own, F.concat("agent", F.lit(f":{kind}")).alias("kind"), path.alias("path"), content.alias("content"))
    folder = F.concat_ws("/", "project", "skills_dir", "skill")
    made = made.unionByName(one("skill", F.concat(folder, F.lit("/SKILL.md")), head))
    made = made.unionByName(one("reference", F.concat(folder, F.lit("/references/"), "stem", F.lit(".md")), F.concat(F.lit(NOTE), section("#"))))
    return made.withColumn("over_budget", F.col("kind").endswith(":instructions") & (F.octet_length("content") > BUDGET))


# -- the lock


def text_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _read(store: fs.FileSystem, path: str) -> str | None:
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_file(path) as f:
        return f.read().decode()


def _write(store: fs.FileSystem, path: str, text: str) -> None:
    with store.open_output_stream(path) as f:
        f.write(text.encode())


def shard_of(path: str) -> int:
    return zlib.crc32(path.encode()) % SHARDS


def _shard_file(shard: int, version: str = "") -> str:
    return f".lock/.lock-{shard:04d}{version}.json"


def shards(root: str) -> list[int]:
    """Those that a lock has."""
    store, top = store_of(root)
    return sorted({int(f.base_name[6:10]) for f in store.get_file_info(fs.FileSelector(f"{top}/.lock", allow_not_found=True))})


def load_shard(root: str, shard: int) -> dict[str, dict]:
    """What was last written: kind and hash by path. Of a version that was not made final, the files that are there as it says count."""
    store, top = store_of(root)
    lock = json.loads(_read(store, f"{top}/{_shard_file(shard)}") or "{}")
    for path, entry in json.loads(_read(store, f"{top}/{_shard_file(shard, '.next')}") or "{}").items():
        text = _read(store, f"{top}/{path}") if lock.get(path) != entry else None
        if text is not None and text_hash(text) == entry["hash"]:
            lock[path] = entry
    return lock


def load_lock(root: str) -> dict[str, dict]:
    """All shards."""
    return {path: entry for shard in shards(root) for path, entry in load_shard(root, shard).items()}


def unsafe(root: str, paths: list[str], lock: dict[str, dict]) -> dict[str, str]:
    """Files that may not be written over, and why: unmanaged or drifted."""
    store, top = store_of(root)
    found = {}
    for path in paths:
        text = _read(store, f"{top}/{path}")
        if text is not None and path not in lock:
            found[path] = "unmanaged"
        elif text is not None and text_hash(text) != lock[path]["hash"]:
            found[path] = "drifted"
    return found


def _inside(path: str) -> bool:
    return not path.startswith("/") and ".." not in path.split("/")


# -- the steps of a run, each over some files: path, where the text is now (None: in place already), hash, kind

File = tuple[str, str | None, str, str]


def put_aside(root: str, aside: str, rows: Iterator[tuple[str, str, str]]) -> Iterator[File]:
    """Rows (path, content, kind). A text that its file has already stays there."""
    store, top = store_of(root)
    made = False
    for path, content, kind in rows:
        own = text_hash(content)
        there, now = _read(store, f"{top}/{path}") if _inside(path) else None, None
        if there is None or text_hash(there) != own:
            if not made:
                store.create_dir(f"{top}/{aside}", recursive=True)
                made = True
            now = f"{aside}/{uuid.uuid4().hex}"
            _write(store, f"{top}/{now}", content)
        yield path, now, own, kind


def refused(root: str, shard: int, paths: list[str]) -> dict[str, str]:
    """Files of a shard that may not be written, and why."""
    wrong = unsafe(root, [p for p in paths if _inside(p)], load_shard(root, shard)) | {p: "outside" for p in paths if not _inside(p)}
    return wrong | {p: "repeated" for p, n in Counter(paths).items() if n > 1}


def put_next(root: str, shard: int, files: list[File]) -> None:
    store, top = store_of(root)
    lock = load_shard(root, shard) | {path: {"hash": h, "kind": kind} for path, _, h, kind in files}
    store.create_dir(f"{top}/.lock", recursive=True)
    _write(store, f"{top}/{_shard_file(shard, '.next')}", json.dumps(lock, sort_keys=True, indent=0))


def rename(root: str, files: list[File]) -> None:
    """Again, too: what an earlier try has renamed is in place."""
    store, top = store_of(root)
    for path, now, own, _ in files:
        if now is None:
            continue
        store.create_dir(f"{top}/{path}".rpartition("/")[0], recursive=True)
        try:
            store.move(f"{top}/{now}", f"{top}/{path}")
        except OSError:
            text = _read(store, f"{top}/{path}")
            if text is None or text_hash(text) != own:
                raise


def make_final(root: str, shard: int) -> None:
    store, top = store_of(root)
    store.move(f"{top}/{_shard_file(shard, '.next')}", f"{top}/{_shard_file(shard)}")


def drop(root: str, aside: str) -> None:
    store, top = store_of(root)
    if store.get_file_info(f"{top}/{aside}").type == fs.FileType.Directory:
        store.delete_dir(f"{top}/{aside}")


def _refusal(wrong: dict[str, str], refusals: int, files: int) -> ValueError:
    return ValueError(f"nothing was written, as {refusals} of {files} files may not be: {dict(sorted(wrong.items())[:5])}")


# -- the sinks


@dataclass
class Aside(WriterCommitMessage):
    files: list[File]


class CardArtifacts(DataSource):
    """``df.write.format("card_artifacts").option("path", root)``: rows (path, content, kind), each path once."""

    @classmethod
    def name(cls) -> str:
        return "card_artifacts"

    def schema(self) -> str:
        return "path string, content string, kind string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArtifactWriter(self.options["path"])


class ArtifactWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root, self.aside = root, f".aside-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Aside:
        files: list[File] = []
        try:
            files.extend(put_aside(self.root, self.aside, ((r.path, r.content, r.kind) for r in iterator)))
        except BaseException:
            store, top = store_of(self.root)
            for _, now, _, _ in files:
                if now is not None:
                    store.delete_file(f"{top}/{now}")
            raise
        return Aside(files)

    def commit(self, messages: list[Aside | None]) -> None:
        store, top = store_of(self.root)
        store.create_dir(top, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        by_shard: dict[int, list[File]] = {}
        for f in files:
            by_shard.setdefault(shard_of(f[0]), []).append(f)
        wrong = {p: why for shard, some in by_shard.items() for p, why in refused(self.root, shard, [f[0] for f in some]).items()}
        if wrong:
            drop(self.root, self.aside)
            raise _refusal(wrong, len(wrong), len(files))
        for shard, some in by_shard.items():
            put_next(self.root, shard, some)
        rename(self.root, files)
        for shard in by_shard:
            make_final(self.root, shard)
        drop(self.root, self.aside)

    def abort(self, messages: list[Aside | None]) -> None:
        drop(self.root, self.aside)


def sweep(root: str) -> int:
    """Removes what killed tasks left aside; how many folders that were. No run may be under way."""
    store, top = store_of(root)
    left = [f.path for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.base_name.startswith(".aside-")]
    for path in left:
        store.delete_dir(path)
    return len(left)


FILE = "shard int, path string, now string, hash string, kind string"


def _files(table: pa.Table | pa.RecordBatch) -> list[File]:
    return list(zip(*(table.column(i).to_pylist() for i in range(1, 5))))


def write(artifacts: DataFrame, root: str) -> None:
    """Rows (path, content, kind), each path once: all of them, or none and an error."""
    aside = f".aside-{uuid.uuid4().hex}"
    schema = pa.schema([("shard", pa.int32()), *((n, pa.string()) for n in ("path", "now", "hash", "kind"))])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(put_aside(root, aside, zip(*(c.to_pylist() for c in batch.columns))))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (shard_of(f[0]), *f))) for f in found], schema)

    def check(part: pa.Table) -> pa.Table:
        wrong = refused(root, part.column("shard")[0].as_py(), part.column("path").to_pylist())
        return pa.table([pa.array(wrong.keys(), pa.string()), pa.array(wrong.values(), pa.string())], names=["path", "why"])

    def follow(part: pa.Table) -> pa.Table:
        put_next(root, part.column("shard")[0].as_py(), _files(part))
        return part.select(["shard"]).slice(0, 1)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rename(root, _files(batch))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    store, top = store_of(root)
    store.create_dir(top, recursive=True)
    try:
        files = written(artifacts.select("path", "content", "kind").mapInArrow(put, FILE))
        wrong = written(files.groupBy("shard").applyInArrow(check, "path string, why string"))
        if refusals := wrong.count():
            raise _refusal({r.path: r.why for r in wrong.orderBy("path").limit(5).collect()}, refusals, files.count())
        of_run = [r.shard for r in files.groupBy("shard").applyInArrow(follow, "shard int").collect()]
        files.mapInArrow(move, "n long").agg(F.sum("n")).collect()
        for shard in of_run:
            make_final(root, shard)
    finally:
        drop(root, aside)


def artifact_states(spark: SparkSession, root: str) -> DataFrame:
    """Per file of the lock: path, kind and state, which is synced, drifted or missing. Tasks read shards and the files that they name."""
    rows = spark.createDataFrame([(s,) for s in shards(root)], "shard int")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(root)
        for shard in (s for batch in batches for s in batch.column(0).to_pylist()):
            lock = load_shard(root, shard)
            texts = (_read(store, f"{top}/{p}") for p in lock)
            state = ["missing" if t is None else "synced" if text_hash(t) == e["hash"] else "drifted" for t, e in zip(texts, lock.values())]
            kinds = [e["kind"] for e in lock.values()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (list(lock), kinds, state)], names=["path", "kind", "state"])

    return rows.mapInArrow(look, "path string, kind string, state string")


# -- folders and their mirrors


def tree_hashes(files: DataFrame, key: str = "folder", skipped: tuple[str, ...] = ()) -> DataFrame:
    """Per folder: its files and the hash of their paths and contents' hashes, in the order of the paths. A task hashes contents one by
    one; only the hashes meet. Files of skipped names do not count."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    each = files.filter(~name.isin(*skipped)) if skipped else files
    line = F.struct("path", F.sha2(F.coalesce(F.col("content"), F.lit("")), 256).alias("hash"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(x["path"], F.lit("\0"), x["hash"], F.lit("\n")))
    return each.groupBy(key).agg(F.count("*").alias("files"), F.sha2(F.array_join(lines, ""), 256).alias("hash"))


def mirror_states(sources: DataFrame, targets: DataFrame, markers: DataFrame) -> DataFrame:
    """Per folder that is mirrored or has a mirror: its state. ``sources`` and ``targets`` have the hashes (folder, hash) that folders and
    mirrors have now, ``markers`` (folder, hash) those of the folders when they were mirrored, for mirrors that say so."""
    rows = sources.select("folder", F.col("hash").alias("source")).join(targets.select("folder", F.col("hash").alias("target")), "folder", "full_outer")
    rows = rows.join(markers.select("folder", F.col("hash").alias("mirrored")), "folder", "full_outer")
    moved, changed = ~F.col("mirrored").eqNullSafe(F.col("source")), F.col("mirrored") != F.col("target")
    state = (
        F.when(F.col("target").isNull(), "missing")
        .when(F.col("target") == F.col("source"), "synced")
        .when(F.col("mirrored").isNull(), "unmanaged target exists")
        .when(moved & changed, "source updated + target drifted")
        .when(moved, "source updated")
        .when(changed, "target drifted")
        .otherwise("synced")
    )
    return rows.select("folder", state.alias("state"))
