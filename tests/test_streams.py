import datetime as dt
import os
import random

from loamworks.streaming import jobs as J
from pyspark.sql import functions as F

EVENTS = "job long, seq long, kind string, stage string, percent int, message string, ts timestamp"


def some(rnd, n, first=0):
    start = dt.datetime(2024, 1, 1)
    return [(rnd.randrange(6), first + i, rnd.choice(["begin", "step", "step", "step", "cancel", "finish"]), rnd.choice("ab"), rnd.randrange(130), rnd.choice(["done", "任务失败"]), start + dt.timedelta(minutes=first + i)) for i in range(n)]


def loop(events):
    held = {}
    for job, seq, kind, stage, percent, message, _ in sorted(events, key=lambda e: e[1]):
        held[job] = J.advance(held.get(job), kind, seq, stage, percent, message)
    return {j: (s["lifecycle"], s["running"], s["cancel_requested"], s["percent"], s["steps"], "|".join(s["details"]), len(s["logs"]), s["seq"]) for j, s in held.items() if s}


def read(spark, out, key=("job",)):
    return {r[0]: tuple(r)[1:] for r in J.latest(spark, out, key).collect()}


def test_status_by_hand():
    s = J.advance(None, "step", 1, "a", 5, "")
    assert s is None
    s = J.advance(s, "begin", 2, "a", 250, "")
    assert (s["lifecycle"], s["percent"], s["running"]) == ("running", 100, True)
    s = J.advance(J.advance(s, "cancel", 3, "", 0, ""), "step", 4, "b", 7, "")
    assert (s["lifecycle"], s["cancel_requested"], s["details"]) == ("running", True, ["a:100", "b:7"])
    assert J.advance(s, "finish", 5, "", 0, "失败")["lifecycle"] == "cancelled"
    assert J.advance(J.advance(s, "begin", 6, "", 0, ""), "finish", 7, "", 0, "x失败")["lifecycle"] == "failed"
    for i in range(40):
        s = J.advance(s, "step", 10 + i, "c", i, "")
    assert len(s["details"]) == 8 and len(s["logs"]) == 24 and s["details"][-1] == "c:39"


def test_jobs_go_on_after_a_restart(spark, tmp_path):
    rnd = random.Random(1)
    events = some(rnd, 120)
    folder, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    os.makedirs(folder)
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    for lo, hi in ((0, 50), (50, 51), (51, 120)):
        spark.createDataFrame(events[lo:hi], EVENTS).coalesce(1).write.mode("append").parquet(folder)
        J.run_all(J.job_states(source), out, state)  # a new query each time, from the checkpoint
        assert read(spark, out) == loop(events[:hi])
    J.run_all(J.job_states(source), out, state)
    assert read(spark, out) == loop(events)
    assert spark.conf.get(J.PROVIDER) != J.ROCKS


def test_stalled_jobs(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    folder, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    os.makedirs(folder)
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    waves = [[(1, 1, "begin", "a", 1, "", at(0)), (2, 2, "begin", "a", 1, "", at(0)), (3, 3, "begin", "a", 1, "", at(0)), (3, 4, "finish", "a", 1, "ok", at(1))], [(2, 5, "step", "a", 2, "", at(25))], [(4, 6, "begin", "a", 1, "", at(40))], [(4, 7, "step", "a", 1, "", at(41)), (1, 8, "step", "a", 9, "", at(42))]]
    seen = []
    for wave in waves:
        spark.createDataFrame(wave, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        J.run_all(J.job_states(source, stale=30 * 60), out, state)
        seen.append({j: r[0] for j, r in read(spark, out).items()})
    assert seen[0] == {1: "running", 2: "running", 3: "completed"}
    assert seen[2] == {1: "stalled", 2: "running", 3: "completed", 4: "running"}
    assert seen[3] == {1: "running", 2: "running", 3: "completed", 4: "running"}


def test_recurrences_and_windows(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"s{rnd.randrange(5)}", i, rnd.choice(["user", "assistant"])) for i in range(90)]
    df = spark.createDataFrame(rows, "signature string, id long, origin string")
    found = J.in_waves(df, "id", 3, J.recurrence_states, f"{tmp_path}/a", ("signature",))
    want = {s: (sum(r[0] == s for r in rows), len({r[2] for r in rows if r[0] == s}), max(r[1] for r in rows if r[0] == s)) for s in {r[0] for r in rows}}
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == want
    events = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), rnd.choice("ab")) for i in range(80)]
    df = spark.createDataFrame(events, "ts timestamp, event_type string")
    found = J.in_waves(df, "ts", 3, J.window_counts, f"{tmp_path}/b", ("start", "event_type"))
    got = {(r.start, r.event_type): r.n for r in found.collect()}
    want = {(r.start, r.event_type): r.n for r in df.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_a_table_of_many_files_is_streamed_whole(spark, tmp_path):
    import __spark_entry__

    rows = [(i, 0, "user" if i % 2 else None, f"text {i % 30}" if i % 5 else None) for i in range(200)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.repartition(20).write.parquet(f"{tmp_path}/many/conversations.parquet")  # three batches
    table.coalesce(1).write.parquet(f"{tmp_path}/one")
    os.makedirs(f"{tmp_path}/single")
    part = next(p for p in os.listdir(f"{tmp_path}/one") if p.endswith(".parquet"))
    os.rename(f"{tmp_path}/one/{part}", f"{tmp_path}/single/conversations.parquet")
    wanted = sorted({(r or "unknown", t) for _, _, r, t in rows}, key=str)
    for name in ("many", "single"):
        found = __spark_entry__.queries()["stream_observation_upsert"](spark, f"{tmp_path}/{name}").collect()
        assert sorted(((r.origin, r.body) for r in found), key=str) == wanted  # a null text once for each origin
