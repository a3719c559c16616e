"""Jobs and recurrences as streams that keep state per key, and counts by window.

State lives in the checkpoint, so a stream that is started again goes on where it was. Each micro-batch writes the rows of the keys that
it changed into a folder of its own, over what an earlier try of it left; a key's last row is its state (``latest``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Settings of a state store while a stream runs. Batches write what has changed, not the whole store again.
STATE = {PROVIDER: ROCKS, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
#: A job keeps so many details and log lines.
DETAILS, LOGS = 8, 24
FAILED = "失败"
JOB = "lifecycle string, running boolean, cancel_requested boolean, percent int, steps int, details array<string>, logs array<string>, seq long"


def advance(status: dict | None, kind: str, seq: int, stage: str, percent: int, message: str) -> dict | None:
    """A job's status after one of: begin, step, cancel, finish. A beginning starts anew; before the first one nothing counts."""
    if kind == "begin":
        status = {"cancel_requested": False, "details": [], "logs": [], "steps": 0}
    elif status is None:
        return None
    status = dict(status, seq=seq, steps=status["steps"] + 1)
    if kind == "cancel":
        return status | {"cancel_requested": True, "lifecycle": "cancelling", "logs": [*status["logs"], f"cancel:{seq}"][-LOGS:]}
    if kind == "finish":
        lifecycle = "cancelled" if status["cancel_requested"] else "failed" if FAILED in message else "completed"
        status |= {"lifecycle": lifecycle, "running": False, "percent": 100}
        line = f"finish:{message}"
    else:
        status |= {"lifecycle": "running", "running": True, "percent": min(percent, 100)}
        line = f"{stage}:{status['percent']}"
    return status | {"details": [*status["details"], line][-DETAILS:], "logs": [*status["logs"], line][-LOGS:]}


class Jobs(StatefulProcessor):
    """Input: job, seq, kind, stage, percent, message, ts. With ``stale``, a running job without a step for so many seconds of event
    time is reported as stalled, once, and goes on with its next step."""

    def __init__(self, stale: int | None = None) -> None:
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", JOB)

    def _held(self) -> dict | None:
        if not self.status.exists():
            return None
        return dict(zip([c.split()[0] for c in JOB.split(", ")], self.status.get()))

    def _row(self, key, status: dict) -> Row:
        shown = {c: status[c] for c in ("lifecycle", "running", "cancel_requested", "percent", "steps")}
        return Row(job=key[0], **shown, details="|".join(status["details"]), log_lines=len(status["logs"]), seq=status["seq"])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, last = self._held(), None
        for r in sorted(rows, key=lambda r: r.seq):
            status = advance(status, r.kind, r.seq, r.stage, r.percent, r.message)
            last = r.ts if last is None or r.ts > last else last
        if status is None:
            return
        self.status.update(tuple(status[c.split()[0]] for c in JOB.split(", ")))
        if self.stale is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if status["running"]:
                self.handle.registerTimer(int(last.replace(tzinfo=last.tzinfo or dt.UTC).timestamp() * 1000) + self.stale * 1000)
        yield self._row(key, status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status = self._held()
        if status is not None and status["running"]:
            yield self._row(key, status | {"lifecycle": "stalled"})

    def close(self) -> None:
        pass


JOB_ROWS = "job long, lifecycle string, running boolean, cancel_requested boolean, percent int, steps int, details string, log_lines int, seq long"


class Recurrences(StatefulProcessor):
    """Input: signature, id, origin. How often a signature came up, from how many origins, and its greatest id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long, last_id long")
        self.origins = handle.getMapState("origins", "origin string", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, last = self.count.get() if self.count.exists() else (0, None)
        for r in rows:
            n, last = n + 1, r.id if last is None else max(last, r.id)
            at = (r.origin,)
            held = self.origins.getValue(at)[0] if self.origins.containsKey(at) else 0
            self.origins.updateValue(at, (held + 1,))
        self.count.update((n, last))
        yield Row(signature=key[0], occurrences=n, origins=sum(1 for _ in self.origins.keys()), last_id=last)

    def close(self) -> None:
        pass


RECURRENCE_ROWS = "signature string, occurrences long, origins long, last_id long"


def job_states(source: DataFrame, stale: int | None = None, late: str = "0 seconds") -> DataFrame:
    rows = source if stale is None else source.withWatermark("ts", late)
    return rows.groupBy("job").transformWithState(Jobs(stale), JOB_ROWS, "Update", "None" if stale is None else "EventTime")


def recurrence_states(source: DataFrame) -> DataFrame:
    return source.groupBy("signature").transformWithState(Recurrences(), RECURRENCE_ROWS, "Update", "None")


def window_counts(source: DataFrame, minutes: int = 60, late: int = 120) -> DataFrame:
    """Events by type and window; a window's state goes when the watermark has passed it."""
    counted = source.withWatermark("ts", f"{late} minutes").groupBy(F.window("ts", f"{minutes} minutes"), "event_type").count()
    return counted.select(F.col("window.start").alias("start"), "event_type", F.col("count").alias("n"))


def run_all(states: DataFrame, out: str, checkpoint: str) -> None:
    """Runs through all there is, in micro-batches."""
    spark = states.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        query = states.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def latest(spark: SparkSession, out: str, key: tuple[str, ...]) -> DataFrame:
    """Of each key the row of its last micro-batch."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")


def in_waves(df: DataFrame, order: str, waves: int, states, base: str, key: tuple[str, ...]) -> DataFrame:
    """The last state of each key after the table came in by waves, in the order of a column. Each wave's files are added to a folder,
    and a new query goes on from the checkpoint of the one before."""
    spark, kept = df.sparkSession, df.filter(F.col(order).isNotNull())
    bounds = kept.select(F.percentile_approx(F.col(order).cast("double"), [i / waves for i in range(1, waves)], 10_000)).first()[0] or []
    wave = sum(((F.col(order).cast("double") > b).cast("int") for b in bounds), F.lit(0))
    source = None
    for i in range(waves):
        kept.filter(wave == i).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(df.schema).parquet(f"{base}/in") if source is None else source
        run_all(states(source), f"{base}/out", f"{base}/state")
    return latest(spark, f"{base}/out", key)
