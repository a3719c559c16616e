"""Records as a fold of ordered operations: add, update, targets, clear, delete, approve, promote, merge.

An operation (seq, project, op, id, title, body, kind, scope, targets, agent, sources) does, in the order of ``seq``, which is unique:

* ``add``: the record, new or over what was there; it keeps when it was created. A null field is empty, null targets are none.
* ``update``: fields that are not null, of a record that is there.   * ``targets``: of a record that is there.
* ``clear``: takes the agent, or without one all, out of the targets of all records of the project.   * ``delete``.
* ``approve``: a draft. Without a record of its id it is added without targets. Else: if bodies are similar (Jaccard 0.75) nothing, if
  titles are equal or bodies similar by 0.45 its fields go over, or else it is in conflict and nothing happens.
* ``promote``: the record gets its global id and scope and remembers its project; one that has that id already is replaced.
* ``merge``: a procedure of the sources' bodies, each under its title; the sources go. If one is missing, nothing happens.

Most records take part in add, update, targets and delete only. For these the fold is a few aggregates, summed up in each task before
rows meet, so a record with very many operations is no burden. Operations whose result depends on what other records hold, or on the
body that is there, bind records together; each bound set is replayed by itself, in one task, after equal approvals in a row are made
one. Clearing looks at no record: what counts is whether an agent was cleared after the targets were set.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .components import components
from .dedupe import jaccard, tokens

FIELDS = ("title", "body", "kind", "scope")
STATE = "project string, id string, title string, body string, kind string, scope string, targets array<string>, source_project string, created long, updated long, set_at long"
BINDING = ("approve", "promote", "merge")
SAME, NEAR = 0.75, 0.45


def global_id(card: Column) -> Column:
    return F.concat(F.lit("global:"), F.regexp_replace(card, "^[^:]*:", ""))


def _node(project: Column, card: Column) -> Column:
    return F.to_json(F.array(project, card))


def _bound(ops: DataFrame) -> DataFrame:
    """(node, block) of the records that binding operations touch."""
    own = _node(F.col("project"), F.col("id"))
    bound = ops.filter(F.col("op").isin(*BINDING))
    merged = bound.filter("op = 'merge'").select(own.alias("u"), F.explode_outer("sources").alias("s"), "project").select("u", _node(F.col("project"), F.coalesce("s", F.lit(""))).alias("v"))
    promoted = bound.filter("op = 'promote'").select(own.alias("u"), _node(F.col("project"), global_id(F.col("id"))).alias("v"))
    links = written(merged.unionByName(promoted).unionByName(bound.filter("op = 'approve'").select(own.alias("u"), own.alias("v"))).distinct())
    nodes = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    # names pack well, so tables of them look small to Spark: with the hint no side goes to the driver
    return nodes.join(components(links).hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("block"))


def _simple(ops: DataFrame) -> DataFrame:
    """The state of records that nothing binds: what was last said since they were last created."""
    key = ["project", "id"]
    gone = ops.filter("op = 'delete'").groupBy(*key).agg(F.max("seq").alias("gone"))
    live = ops.filter("op != 'delete'").join(gone, key, "left").filter("gone IS NULL OR seq > gone").drop("gone")
    made = live.filter("op = 'add'").groupBy(*key).agg(F.min("seq").alias("created"))
    live = live.join(made, key).filter("seq >= created")
    told = F.col("op").isin("add", "update")
    value = lambda f: F.when(F.col("op") == "add", F.coalesce(f, F.lit(""))).when(F.col("op") == "update", F.col(f))
    last = lambda f: F.max_by(value(f), F.when(value(f).isNotNull(), F.col("seq"))).alias(f)
    aimed = F.when(F.col("op").isin("add", "targets"), F.col("seq"))
    state = live.groupBy(*key).agg(
        *[last(f) for f in FIELDS],
        F.max_by(F.coalesce("targets", F.array().cast("array<string>")), aimed).alias("targets"),
        F.first("created").alias("created"),
        F.max(F.when(told, F.col("seq"))).alias("updated"),
        F.max(aimed).alias("set_at"),
    )
    return state.withColumn("source_project", F.lit(None).cast("string"))


def step(state: dict, op: dict) -> None:
    """One operation on the records (project, id) of ``state``."""
    at, seq = (op["project"], op["id"]), op["seq"]
    now = state.get(at)
    given = {f: op[f] for f in FIELDS}

    def add(targets: list) -> None:
        old = state.get(at) or {}
        fields = {f: v or "" for f, v in given.items()}
        state[at] = {"source_project": old.get("source_project"), "created": old.get("created", seq)} | fields | {"targets": list(targets), "updated": seq, "set_at": seq}

    match op["op"]:
        case "add":
            add(op["targets"] if op["targets"] is not None else [])
        case "delete":
            state.pop(at, None)
        case "update" if now:
            now.update({f: v for f, v in given.items() if v is not None}, updated=seq)
        case "targets" if now:
            now.update(targets=list(op["targets"] if op["targets"] is not None else []), set_at=seq)
        case "approve":
            alike = jaccard(tokens(op["body"]), tokens(now["body"])) if now else 0.0
            if not now:
                add([])
            elif alike < SAME and ((op["title"] or "").strip() == now["title"].strip() or alike >= NEAR):
                now.update({f: v for f, v in given.items() if v is not None}, updated=seq)
        case "promote" if now:
            new = "global:" + (op["id"].split(":", 1)[1] if ":" in op["id"] else op["id"])
            state.pop(at)
            state[op["project"], new] = now | {"scope": "global", "source_project": op["project"], "updated": seq}
        case "merge":
            sources = list(op["sources"]) if op["sources"] is not None else []
            held = [state.get((op["project"], s)) for s in sources]
            if held and all(held):
                given = {"title": op["title"], "body": "".join(f"## {h['title']}\n\n{h['body']}\n\n" for h in held).strip(), "kind": "procedure", "scope": "project"}
                add(op["targets"] if op["targets"] is not None else [])
                for s in sources:
                    state.pop((op["project"], s), None)


#: States that are handed on at once, if no set has more.
AT_ONCE = 4096


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each bound set, of operations that come by set and ``seq``. Sets are many and most are small: nothing is done for
    a set but its operations, and none waits for the rest of its set."""
    long = ("created", "updated", "set_at")
    schema = pa.schema([(n, pa.int64() if n in long else pa.list_(pa.string()) if n == "targets" else pa.string()) for n in (c.split()[0] for c in STATE.split(", "))])
    state: dict = {}
    done: list[dict] = []
    block = None
    for batch in batches:
        for op in batch.to_pylist():
            if op["block"] != block:
                done += [{"project": p, "id": i} | r for (p, i), r in state.items()]
                state, block = {}, op["block"]
                if len(done) >= AT_ONCE:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done = []
            step(state, op)
    done += [{"project": p, "id": i} | r for (p, i), r in state.items()]
    yield pa.RecordBatch.from_pylist(done, schema)


def replay(ops: DataFrame) -> DataFrame:
    """The records that are there after all operations."""
    own = _node(F.col("project"), F.col("id"))
    rows = written(ops.filter("op != 'clear'").withColumn("node", own))
    marked = written(rows.join(_bound(rows).hint("merge"), "node", "left"))
    before = F.lag(F.struct("op", *FIELDS)).over(Window.partitionBy("node").orderBy("seq"))
    again = (F.col("op") == "approve") & F.coalesce(before == F.struct("op", *FIELDS), F.lit(False))
    bound = marked.filter("block IS NOT NULL").withColumn("again", again).filter("NOT again").drop("again", "node")
    states = _simple(marked.filter("block IS NULL").drop("block", "node")).unionByName(bound.repartition("block").sortWithinPartitions("block", "seq").mapInArrow(_replayed, STATE))
    clears = ops.filter("op = 'clear'").groupBy("project", "agent").agg(F.max("seq").alias("at"))
    clears = clears.groupBy("project").agg(F.max(F.when(F.col("agent").isNull(), F.col("at"))).alias("all_at"), F.collect_list(F.when(F.col("agent").isNotNull(), F.struct("agent", "at"))).alias("each"))
    states = states.join(clears, "project", "left")
    cleared = lambda t: F.coalesce(F.col("all_at") > F.col("set_at"), F.lit(False)) | F.coalesce(F.exists("each", lambda c: (c["agent"] == t) & (c["at"] > F.col("set_at"))), F.lit(False))
    return states.withColumn("targets", F.filter("targets", lambda t: ~cleared(t))).drop("all_at", "each", "set_at")
