"""Histories of agents: which files there are, which project each belongs to, and their import as observations."""

from __future__ import annotations

import json
import posixpath
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markers as M
from . import ranges
from .logs import messages
from .shared import written

#: A probe reads so much of the start of a file.
PROBE_LINES, PROBE_BYTES = 200, 256 * 1024
PROJECT_KEYS = ("cwd", "project")


# -- files of a home folder


@dataclass(frozen=True)
class Conversation:
    path: str
    agent: str
    kind: str
    project: str | None  # None: not in an index of sessions, so only its lines can tell


def project_of_folder(name: str) -> str | None:
    """A project's path out of the name of its folder of sessions: dashes stand for slashes."""
    parts = [p for p in name.lstrip("-").split("-") if p]
    return (("/" if name.startswith("-") else "") + "/".join(parts)) if parts else None


def session_ids(index: object) -> list[str]:
    """Ids in an index of sessions: an object with ``sessions``, an object of objects, or a list of objects that name theirs."""
    if isinstance(index, dict):
        if isinstance(index.get("sessions"), dict):
            return sorted(index["sessions"])
        return sorted(index) if all(isinstance(v, dict) for v in index.values()) else []
    if isinstance(index, list):
        ids = [x.get("sessionId", x.get("session_id")) for x in index if isinstance(x, dict)]
        return [x for x in ids if isinstance(x, str)]
    return []


def _indexed(root: str) -> dict[str, str]:
    """Paths that the indices of sessions right below a folder name and that are there, with their projects."""
    store, top = ranges.store_of(root)
    found = {}
    for f in ranges.listed(root, "/sessions-index.json", ()):
        folder = posixpath.dirname(f.path)
        project = project_of_folder(posixpath.basename(folder))
        if posixpath.dirname(folder) != top.rstrip("/") or project is None:
            continue
        with store.open_input_file(f.path) as handle:
            index = json.loads(handle.read())
        found |= {f"{folder}/{i}.jsonl": project for i in session_ids(index)}
    there = {f.path for f in ranges.listed(root, skipped=())}
    return {p: project for p, project in found.items() if p in there}


def discover(home: str) -> list[Conversation]:
    """Conversation files below a home folder, by path: those of the indices first, then all others once, then single histories."""
    found: list[Conversation] = []
    for folder, agent, kind in M.HISTORY_FOLDERS:
        root = f"{home.rstrip('/')}/{folder}"
        indexed = _indexed(root)
        found += [Conversation(p, agent, kind, project) for p, project in indexed.items()]
        found += [Conversation(f.path, agent, kind, None) for f in ranges.listed(root) if f.path not in indexed]
    for name, agent, kind in M.HISTORY_FILES:
        found += [Conversation(f.path, agent, kind, None) for f in ranges.listed(f"{home.rstrip('/')}/{name}")]
    return sorted(found, key=lambda c: c.path)


# -- keys inside of JSON lines


def strings_under(rows: DataFrame, keys: tuple[str, ...], text: str = "line", first: bool = False) -> DataFrame:
    """Strings under one of the keys, at any depth of the JSON texts: the other columns, ``at`` (places of the nodes on the way; an
    object's members stand by name), ``nth`` (which key) and ``value``. With ``first``, a node that has one is not searched further.

    Texts are parsed once; a level of nodes is a written table, and the next one its members. Texts that are no JSON have none."""
    level = rows.withColumn("node", F.try_parse_json(text)).drop(text).filter("node IS NOT NULL").withColumn("at", F.array().cast("array<int>"))
    member = lambda k: f"""try_variant_get(node, '$["{k}"]', 'variant')"""
    held = F.array(*[F.when(F.expr(f"schema_of_variant({member(k)}) = 'STRING'"), F.struct(F.lit(i).alias("nth"), F.expr(f"""try_variant_get(node, '$["{k}"]', 'string')""").alias("value"))) for i, k in enumerate(keys)])
    found = None
    columns = [c for c in rows.columns if c != text]
    while True:
        level = written(level.withColumn("hits", F.filter(held, lambda x: x.isNotNull())))
        hits = level.select(*columns, "at", F.explode("hits").alias("hit")).select(*columns, "at", "hit.nth", "hit.value")
        found = hits if found is None else found.unionByName(hits)
        inner = level.filter("size(hits) = 0") if first else level
        below = rows.sparkSession.sql(f"SELECT {', '.join(f't.`{c}`' for c in columns)}, concat(t.at, array(m.pos)) AS at, m.value AS node FROM {{t}} t, LATERAL variant_explode(t.node) m", t=inner)
        # only objects and lists go on
        level = below.filter(F.expr("schema_of_variant(node) LIKE 'OBJECT<%' OR schema_of_variant(node) LIKE 'ARRAY<%'"))
        if inner.isEmpty() or level.isEmpty():
            return found


def probe(lines: DataFrame, keys: tuple[str, ...] = PROJECT_KEYS, most_lines: int = PROBE_LINES, most_bytes: int = PROBE_BYTES) -> DataFrame:
    """Per file (path, place, line) that names one in its first lines: path and project, the first string under one of the keys,
    outer objects before inner ones. Reading a file ends with the line before the one that exceeds the bytes."""
    order = Window.partitionBy("path").orderBy("place")
    head = lines.withColumn("nth_line", F.row_number().over(order)).filter(F.col("nth_line") <= most_lines)
    so_far = F.sum(F.octet_length("line")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    head = head.withColumn("so_far", so_far).filter(F.col("so_far") <= most_bytes).select("path", "nth_line", F.trim("line").alias("line"))
    found = strings_under(head.filter("line != ''"), keys, first=True)
    return found.groupBy("path").agg(F.min(F.struct("nth_line", "at", "nth", "value"))["value"].alias("project"))


def harvest(lines: DataFrame, keys: tuple[str, ...] = PROJECT_KEYS) -> DataFrame:
    """Projects that any line (agent, path, place, line) names: project, agents, files and mentions. Only what looks like a path."""
    named = strings_under(lines.select("agent", "path", F.trim("line").alias("line")), keys)
    value = F.trim("value")
    local = (F.octet_length(value) >= 3) & (value.contains(":\\") | value.startswith("\\\\") | value.startswith("/") | value.startswith("~/"))
    named = named.filter(local)
    return named.groupBy(F.col("value").alias("project")).agg(F.array_sort(F.collect_set("agent")).alias("agents"), F.count_distinct("path").alias("files"), F.count("*").alias("mentions"))


# -- projects of files


def normal_path(path: Column) -> Column:
    """With slashes, without empty or ``.`` parts and without one at the end."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    return F.concat(F.when(path.startswith("/") | path.startswith("\\"), "/").otherwise(""), F.array_join(parts, "/"))


def ancestors(path: Column) -> Column:
    """A normal path and the folders above it."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    front = F.when(path.startswith("/"), "/").otherwise("")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(front, F.array_join(F.slice(parts, F.lit(1), n), "/")))
    each = F.when(F.size(parts) > 0, each).otherwise(F.array().cast("array<string>"))
    return F.when(path.startswith("/"), F.concat(F.array(F.lit("/")), each)).otherwise(each)


def nearest_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files (path, project) with ``root``: of the roots (root) that hold the project's folder or are it, the longest; null without
    one. Whole parts count: ``/a/bc`` is not below ``/a/b``.

    Each file meets its own few ancestors by an equi-join, never the list of roots."""
    tops = roots.select(normal_path(F.col("root")).alias("top")).distinct()
    own = files.withColumn("own", normal_path(F.col("project")))
    each = own.select("path", F.explode(ancestors(F.col("own"))).alias("top")).join(tops, "top")
    best = each.groupBy("path").agg(F.max_by("top", F.length("top")).alias("root"))
    return files.join(best, "path", "left")


def replay_counts(files: DataFrame, roots: DataFrame) -> DataFrame:
    """How many files each root has, how many are of other projects and of none that is known: root, match, files."""
    met = nearest_root(files, roots)
    match = F.when(F.col("project").isNull(), "unknown").when(F.col("root").isNull(), "other").otherwise("match")
    return met.groupBy("root", match.alias("match")).agg(F.count("*").alias("files"))


# -- observations


def redacted(text: Column) -> Column:
    for pattern in M.REDACTIONS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def observations(lines: DataFrame) -> DataFrame:
    """Lines (source, agent, kind, place, line; ``place`` of any type that orders) to observations: what users wrote in a source, cleaned
    and without secrets. Sources that come to nothing are left out."""
    bodies = messages(lines.select(F.col("source").alias("path"), F.col("place").alias("line_no"), "line")).withColumnRenamed("path", "source")
    about = lines.select("source", "agent", "kind").distinct()
    rows = bodies.join(about, "source").withColumn("clean", redacted(F.col("body")))
    key = F.sha2(F.concat_ws(":", "kind", "source", "clean"), 256)
    return rows.select(F.concat(F.lit("obs:"), "agent", F.lit(":"), F.substring(key, 1, 12)).alias("id"), "source", "agent", "kind", F.col("clean").alias("body"), (F.col("clean") != F.col("body")).alias("redacted"))


def insert(store: str, new: DataFrame) -> DataFrame:
    """Adds to a folder of observations those whose id is not there, each once, and returns them."""
    spark = new.sparkSession
    new = new.dropDuplicates(["id"])
    had = load(spark, store)
    if had is not None:
        new = new.join(had.select("id"), "id", "left_anti")
    new = written(new)
    new.write.mode("append").parquet(store)
    return new


def load(spark: SparkSession, store: str) -> DataFrame | None:
    """All observations, by id; None of a folder that is not there."""
    files, top = ranges.store_of(store)
    if not any(f.extension == "parquet" for f in files.get_file_info(ranges.fs.FileSelector(top, allow_not_found=True))):
        return None
    return spark.read.parquet(store).orderBy("id")


def import_home(spark: SparkSession, home: str, roots: list[str] | None, index: str, store: str, unknown: bool = False) -> dict[str, int]:
    """Imports what is new in the files of a home folder that belong to one of the roots (None: all files). Returns how many files
    were matched, of another project or unknown, and how many observations came in. The index moves on when they are kept."""
    files = discover(home)
    if not files:
        return {"files": 0, "match": 0, "other": 0, "unknown": 0, "created": 0}
    table = spark.createDataFrame([(c.path, c.agent, c.kind, c.project) for c in files], "path string, agent string, kind string, project string")
    probed = probe(ranges.read(spark, home).join(table.filter("project IS NULL").select("path"), "path", "left_semi"))
    table = table.join(probed.withColumnRenamed("project", "probed"), "path", "left").withColumn("project", F.coalesce("project", "probed")).drop("probed")
    if roots is None:
        table = table.withColumn("match", F.lit("match"))
    else:
        table = nearest_root(table, spark.createDataFrame([(r,) for r in roots], "root string"))
        table = table.withColumn("match", F.when(F.col("project").isNull(), F.lit("match" if unknown else "unknown")).when(F.col("root").isNull(), "other").otherwise("match"))
    table = written(table)
    counts = {r["match"]: r["n"] for r in table.groupBy("match").agg(F.count("*").alias("n")).collect()}
    wanted = {r["path"] for r in table.filter("match = 'match'").select("path").collect()}
    reading = ranges.begin(spark, home, index, paths=wanted)
    lines = reading.lines.join(table.select("path", "agent", "kind"), "path").withColumnRenamed("path", "source")
    created = insert(store, observations(lines)).count() if reading.steps else 0
    reading.commit()
    return {"files": len(files), "match": counts.get("match", 0), "other": counts.get("other", 0), "unknown": counts.get("unknown", 0), "created": created}
