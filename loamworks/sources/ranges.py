"""Log files by byte ranges: a Python Data Source that seeks to what is new, for batches and for streams.

Of each file an index knows how far it was read. A file of the same size and time is left alone; a grown one is read from where the
last reading ended; one that shrank, that has a new time at the same size, or whose head is not the one that was read before is a
new file and read from its start. Reading ends at the last line feed, so a line that is still being written waits for the next time.

What is to be read is cut into ranges of some bytes each; a range has the lines that start in it. So a file of any size is read by
many tasks, none holds more than a line, and bytes before the offset are never read.

A plan is fixed before it is read (``begin``): lines and new offsets come from the same sizes, and ``commit`` makes the offsets the
next version of the index by a rename. A run that dies in between leaves the old version, and its lines come again.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = 1
RANGE_BYTES = 64 << 20
BUFFER = 1 << 20
HEAD = 256
SKIPPED = ("subagents",)
SUFFIX = ".jsonl"


# -- files


@dataclass(frozen=True)
class LogFile:
    path: str
    size: int
    modified: int


@dataclass(frozen=True)
class State:
    """How far a file was read: up to ``processed``; its size, time and head were those then."""

    processed: int
    size: int
    modified: int
    head: str


@dataclass
class Range(InputPartition):
    """The lines of a file that start at ``low`` or later and before ``high``. Lines of this reading start at ``first``, which is the
    start of a line, and end before ``last``."""

    path: str
    first: int
    low: int
    high: int
    last: int


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(root: str, suffix: str = SUFFIX, skipped: tuple[str, ...] = SKIPPED) -> list[LogFile]:
    """Files below a folder, or the file that is named, by path. Links are not followed, nor are folders of skipped names entered."""
    store, top = store_of(root)
    low = {s.lower() for s in skipped}
    found = []
    about = store.get_file_info(top)
    if about.type == fs.FileType.File:
        found = [about]
    elif about.type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(top, recursive=True))
    local = isinstance(store, fs.LocalFileSystem)
    out = []
    for f in found:
        inner = f.path[len(top) :].split("/")
        if f.type != fs.FileType.File or not f.path.endswith(suffix) or any(p.lower() in low for p in (f.path.split("/") if f is about else inner)):
            continue
        if local and any(os.path.islink(top + "/".join(inner[: i + 1])) for i in range(1, len(inner))):
            continue
        out.append(LogFile(f.path, f.size, (f.mtime_ns or 0) // 1_000_000))
    return sorted(out, key=lambda f: f.path)


def last_line_end(handle, low: int, high: int) -> int:
    """The place after the last line feed between two places, read backwards; ``low`` without any."""
    while high > low:
        at = max(low, high - BUFFER // 16)
        handle.seek(at)
        place = handle.read(high - at).rfind(b"\n")
        if place >= 0:
            return at + place + 1
        high = at
    return low


def head_of(handle, size: int) -> str:
    import hashlib

    handle.seek(0)
    return hashlib.sha256(handle.read(min(size, HEAD))).hexdigest()[:16]


def advance(store: fs.FileSystem, file: LogFile, old: State | None) -> tuple[int, State] | None:
    """Where reading starts and the state after it, or None for a file that has not changed."""
    if old is not None and (old.size, old.modified) == (file.size, file.modified):
        return None
    with store.open_input_file(file.path) as handle:
        start = 0
        if old is not None and file.size > old.size and head_of(handle, old.processed) == old.head:
            start = old.processed
        end = last_line_end(handle, start, file.size)
        return start, State(end, file.size, file.modified, head_of(handle, end))


def ranges_of(path: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(path, start, at, min(at + size, end), end) for at in range(start, end, size)]


def lines_of(handle, part: Range, counted: list[int]) -> Iterator[tuple[int, bytes]]:
    """(place, line) of a range, without line ends. ``counted[0]`` grows by the bytes read."""
    at = part.low if part.low == part.first else part.low - 1
    skipping = part.low != part.first
    handle.seek(at)
    where = at
    pieces: list[bytes] = []  # of the line that starts at ``at``
    while where < part.last and at < part.high:
        block = handle.read(min(BUFFER, part.high - where if where < part.high else BUFFER // 64, part.last - where))
        if not block:
            return
        counted[0] += len(block)
        where += len(block)
        cuts = block.split(b"\n")
        for i, piece in enumerate(cuts):
            if i == len(cuts) - 1:
                pieces.append(piece)
                break
            line = b"".join([*pieces, piece])
            pieces = []
            if skipping:
                skipping = False
            elif at < part.high:
                yield at, line.removesuffix(b"\r")
            at += len(line) + 1


# -- the index


def load_index(folder: str) -> dict[str, State]:
    """The states of the last committed version; none for a folder that is not there."""
    store, top = store_of(folder)
    versions = sorted(f.path for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.base_name.startswith("offsets-") and f.extension == "parquet")
    if not versions:
        return {}
    rows = pq.read_table(versions[-1], filesystem=store)
    if int((rows.schema.metadata or {}).get(b"format", b"0")) != FORMAT:
        raise ValueError(f"{versions[-1]}: an index of another format")
    return {r.pop("path"): State(**r) for r in rows.to_pylist()}


def save_index(folder: str, states: dict[str, State]) -> str:
    """Adds a version: written aside, then renamed."""
    store, top = store_of(folder)
    store.create_dir(top, recursive=True)
    had = [f.base_name for f in store.get_file_info(fs.FileSelector(top)) if f.base_name.startswith("offsets-")]
    number = 1 + max([int(x[8:16]) for x in had], default=0)
    kinds = pa.schema([("path", pa.string()), ("processed", pa.int64()), ("size", pa.int64()), ("modified", pa.int64()), ("head", pa.string())], metadata={"format": str(FORMAT)})
    rows = pa.Table.from_pylist([{"path": p} | asdict(s) for p, s in sorted(states.items())], schema=kinds)
    aside, final = f"{top}/aside-{uuid.uuid4().hex}", f"{top}/offsets-{number:08d}.parquet"
    pq.write_table(rows, aside, filesystem=store)
    store.move(aside, final)
    return final


# -- the data source


def _read(root: str, part: Range, report: bool) -> Iterator[pa.RecordBatch]:
    store, _ = store_of(root)
    counted, places, lines, held = [0], [], [], 0

    def batch() -> pa.RecordBatch:
        text = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([part.path] * len(lines), pa.string()), pa.array(places, pa.int64()), text], names=["path", "place", "line"])

    with store.open_input_file(part.path) as handle:
        n = 0
        for place, line in lines_of(handle, part, counted):
            n += 1
            if report:
                continue
            places.append(place)
            lines.append(line)
            held += len(line)
            if held > 4 * BUFFER or len(lines) >= 10_000:
                yield batch()
                places, lines, held = [], [], 0
    if report:
        row = {"path": part.path, "low": part.low, "high": part.high, "lines": n, "bytes_read": counted[0]}
        yield pa.RecordBatch.from_pylist([row])
    elif lines:
        yield batch()


class LogRanges(DataSource):
    """``spark.read.format("log_ranges")``. Options: ``path``, a folder or a file; ``plan``, JSON [[path, start, end], ...] to read no
    more than that; ``range_bytes``; ``suffix``; ``report``, to get a row for each range, with the bytes read, instead of lines."""

    @classmethod
    def name(cls) -> str:
        return "log_ranges"

    def schema(self) -> str:
        return "path string, low long, high long, lines long, bytes_read long" if _true(self.options.get("report")) else "path string, place long, line string"

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RangeStream(dict(self.options))


def _true(x: str | None) -> bool:
    return str(x).lower() == "true"


class RangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.suffix = options.get("suffix", SUFFIX)
        self.plan = options.get("plan")
        self.bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.report = _true(options.get("report"))

    def partitions(self) -> list[Range]:
        if self.plan is not None:
            steps = json.loads(self.plan)
        else:
            store, _ = store_of(self.root)
            steps = []
            for f in listed(self.root, self.suffix):
                start, state = advance(store, f, None)
                steps.append((f.path, start, state.processed))
        return [r for path, start, end in steps for r in ranges_of(path, start, end, self.bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read: Spark asks once all the same
            return iter(())
        return _read(self.root, partition, self.report)


class RangeStream(DataSourceStreamReader):
    """Offsets are the states of all files; a micro-batch reads what is between two of them."""

    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.suffix = options.get("suffix", SUFFIX)
        self.bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.states: dict[str, State] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, _ = store_of(self.root)
        for f in listed(self.root, self.suffix):
            new = advance(store, f, self.states.get(f.path))
            if new is not None:
                self.states[f.path] = new[1]
        return {p: [s.processed, s.size, s.modified, s.head] for p, s in sorted(self.states.items())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, new in end.items():
            old, new = (State(*start[path]) if path in start else None), State(*new)
            if old == new:
                continue
            first = 0
            if old is not None and new.size > old.size:
                store, _ = store_of(self.root)
                with store.open_input_file(path) as handle:
                    first = old.processed if head_of(handle, old.processed) == old.head else 0
            out += ranges_of(path, first, new.processed, self.bytes)
        self.states = {p: State(*s) for p, s in end.items()} | self.states
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition, False)

    def commit(self, end: dict) -> None:
        pass


# -- incremental reading


@dataclass
class Reading:
    """A fixed reading: its lines (path, place, line) and, once they are kept, ``commit``."""

    lines: DataFrame
    report: DataFrame
    steps: list[tuple[str, int, int]]
    states: dict[str, State]
    index: str

    def commit(self) -> str:
        return save_index(self.index, self.states)


def begin(spark: SparkSession, root: str, index: str, range_bytes: int = RANGE_BYTES, suffix: str = SUFFIX, paths: set[str] | None = None) -> Reading:
    """What is new below a folder since the index's last version. With ``paths`` only these files are looked at. Files that are gone
    keep their state."""
    spark.dataSource.register(LogRanges)
    store, _ = store_of(root)
    states, steps = load_index(index), []
    for f in listed(root, suffix):
        new = advance(store, f, states.get(f.path)) if paths is None or f.path in paths else None
        if new is not None:
            start, states[f.path] = new
            if states[f.path].processed > start:
                steps.append((f.path, start, states[f.path].processed))
    source = spark.read.format("log_ranges").option("range_bytes", range_bytes).option("plan", json.dumps(steps))
    return Reading(source.load(root), source.option("report", "true").load(root), steps, states, index)


def read(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES, suffix: str = SUFFIX) -> DataFrame:
    """All whole lines below a folder."""
    spark.dataSource.register(LogRanges)
    return spark.read.format("log_ranges").option("range_bytes", range_bytes).option("suffix", suffix).load(root)


def stream(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES, suffix: str = SUFFIX) -> DataFrame:
    spark.dataSource.register(LogRanges)
    return spark.readStream.format("log_ranges").option("range_bytes", range_bytes).option("suffix", suffix).load(root)
