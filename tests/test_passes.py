"""The three passes against a loop over each run's texts."""

from loamworks.plans import passes as P
from loamworks.plans import registry


def test_later_passes_see_what_is_left(spark):
    folder = "/root/testdata/sf0.001"
    steps = P.three_passes(spark, folder, registry.run)
    rows = {k: v.collect() for k, v in steps.items()}
    runs = {r.run for k in ("first", "second", "left") for r in rows[k]}
    want, third_runs = [], set()
    for run in runs:
        seen = {}

        def take(name, run=run, seen=seen):
            for r in sorted((r for r in rows[name] if r.run == run), key=lambda r: (r.text_id, r.place)):
                seen.setdefault(r.cid, r)

        take("first")
        take("second")
        if not (len(seen) >= P.WANTED and any(r.memory_tier == "project_rule" for r in seen.values())):
            third_runs.add(run)
            take("third")
        want += [(run, cid, r.nth_pass, r.id) for cid, r in seen.items()]
    assert sorted((r.run, r.cid, r.nth_pass, r.id) for r in rows["merged"]) == sorted(want)
    assert {r.run for r in rows["left"]} <= third_runs and {r.run for r in rows["third"]} <= third_runs
    assert all(r.place <= P.OF_LINE for r in rows["first"]) and all(r.place <= P.WANTED for r in rows["third"])
    shown = P.q_passes(registry.run, spark, folder).collect()
    by = {}
    for r in shown:
        by.setdefault(r.run, []).append(r)
    assert shown and all(sorted(r.place for r in v) == list(range(1, len(v) + 1)) and len(v) <= P.WANTED for v in by.values())


def test_runs_with_enough_go_no_further(spark, tmp_path):
    lines = [f"以后所有项目必须先规划再执行：第{i}步使用工具{chr(65 + i)}完成流程，以便复用。" for i in range(14)]
    rule = "Always use vitest by default for unit tests of this repo."
    rows = [(1, 0, "user", "\n".join([*lines, rule])), (2, 0, "user", lines[0])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    steps = P.three_passes(spark, str(tmp_path), registry.run)
    so_far = P.merged(steps["first"].unionByName(steps["second"])).filter("run = 1").collect()
    enough = len(so_far) >= P.WANTED and any(r.memory_tier == "project_rule" for r in so_far)
    assert {r.run for r in steps["left"].collect()} == ({2} if enough else {1, 2})
    assert len(so_far) >= 3
