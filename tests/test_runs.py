import time

import pytest
from pyspark.sql import functions as F

from quarrylight.api import Engine
from quarrylight.operators import joins
from quarrylight.plans import runs


@pytest.fixture
def projects(spark):
    return spark.createDataFrame([("alpha",), ("beta",)], "slug string")


def numbers(n):
    return lambda spark, project: {"files": spark.range(n).toDF("k"), "empty": spark.range(0).toDF("k")}


def shown(runner, phase):
    return sorted((r["project"], r["k"]) for r in runner.table(phase).read().collect())


def test_a_run_replaces_a_projects_rows(spark, tmp_path, projects):
    runner = runs.Runner(spark, str(tmp_path), {"numbers": numbers(3), "fewer": numbers(1)}, projects)
    assert runner.run("numbers", "alpha").written == {"files": 3, "empty": 0}
    assert runner.run("numbers", "beta").success
    tools = Engine({"projects": projects})
    assert tools.run_extractor(runner, "fewer", "alpha").written == {"files": 1, "empty": 0}
    assert shown(runner, "files") == [("alpha", 0), ("beta", 0), ("beta", 1), ("beta", 2)] and shown(runner, "empty") == []
    told = runner.runs().collect()
    assert len(told) == 3 and all(r["success"] and r["duration_ms"] >= 0 for r in told)
    assert sorted(r["nodes"] for r in told) == [1, 3, 3]


def test_what_isnt_there_isnt_run(spark, tmp_path, projects):
    runner = runs.Runner(spark, str(tmp_path), {"numbers": numbers(3)}, projects)
    codes = [runner.run(*x).error_code for x in (("numbers", "No Slug!"), ("other", "alpha"), ("numbers", "gamma"))]
    assert codes == ["invalid_slug", "unknown_extractor", "project_not_registered"]
    assert runner.log().count() == 0


def test_a_failed_run_goes_on_behind_what_it_finished(spark, tmp_path, projects):
    calls = []

    def extract(spark, project):
        def broken():
            raise runs.ExtractorError("no_head", "the head is gone")

        calls.append(project)
        yield_from = {"files": spark.range(2).toDF("k")}
        if len(calls) == 1:
            return Phases(yield_from, broken)
        return {"files": spark.range(99).toDF("k"), "more": spark.range(5).toDF("k")}

    class Phases(dict):
        def __init__(self, first, then):
            super().__init__(first)
            self.then = then

        def items(self):
            yield from super().items()
            self.then()

    runner = runs.Runner(spark, str(tmp_path), {"x": extract}, projects)
    first = runner.run("x", "alpha", state="c1")
    assert (first.success, first.error_code, first.message, first.written) == (False, "no_head", "the head is gone", {"files": 2})
    second = runner.run("x", "alpha", state="c1")
    assert second.success and second.skipped == ["files"] and second.written == {"more": 5}
    assert shown(runner, "files") == [("alpha", 0), ("alpha", 1)]
    assert runner.run("x", "alpha", state="c1").written["files"] == 99  # the last run succeeded: all is done anew


def test_other_errors_are_told(spark, tmp_path, projects):
    runner = runs.Runner(spark, str(tmp_path), {"x": lambda spark, project: {"t": spark.range(1).select(F.raise_error(F.lit("bad row")).alias("k"))}}, projects)
    outcome = runner.run("x", "alpha")
    assert not outcome.success and outcome.error_code == "unknown"
    assert runner.runs().first()["error_code"] == "unknown"


def test_a_run_ends_in_time(spark, tmp_path, projects):
    def slow(spark, project):
        @F.pandas_udf("long")
        def wait(x):
            time.sleep(60)
            return x

        return {"t": spark.range(4).select(wait("id").alias("k"))}

    runner = runs.Runner(spark, str(tmp_path), {"numbers": lambda spark, project: {"t": spark.range(2).toDF("k")}, "slow": slow}, projects)
    runner.run("numbers", "alpha")
    began = time.time()
    outcome = runner.run("slow", "alpha", timeout_seconds=2)
    assert time.time() - began < 40
    assert (outcome.error_code, outcome.message) == ("extractor_runtime_error", "timeout after 2s")
    assert shown(runner, "t") == [("alpha", 0), ("alpha", 1)]  # the table is as it was


def test_places_and_last_values_over_many_ranges(spark):
    rows = [(k % 3 if k % 10 else 0, k * 7919 % 1009, k) for k in range(600)] + [(None, k, 1000 + k) for k in range(5)]
    df = spark.createDataFrame(rows, "key long, at long, id long").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: r["n"] for r in joins.placed(df, ["key"], [F.col("at"), F.col("id")], "n").collect()}
        right = df.where("id % 5 = 0").select("key", "at", F.col("id").alias("seen"))
        last = {r["id"]: r["seen"] for r in joins.as_of(df.where("id % 5 <> 0"), right, ["key"], "at", "seen").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for key in {r[0] for r in rows}:
        own = sorted((r[1], r[2]) for r in rows if r[0] == key)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    for key, at, i in rows:
        if i % 5:
            before = [(a, j) for k, a, j in rows if k == key and j % 5 == 0 and a <= at]
            want = max(before)[0] if before else None
            assert (last[i] is None) == (want is None) and (want is None or next(a for k, a, j in rows if j == last[i]) == want)


def test_processes_that_hold_a_lock(spark):
    import datetime as dt

    now = dt.datetime(2026, 1, 1, 12)
    issues = spark.createDataFrame([("a", "r1", now - dt.timedelta(minutes=90)), ("b", "r2", now - dt.timedelta(hours=30)), ("c", None, now)], "issue_id string, run_id string, locked_at timestamp")
    processes = spark.createDataFrame([(1, "01:30:40", 9.0, "tool --print x"), (2, "01:31:30", 9.0, "tool --print y"), (3, "45:00", 0.1, "tool --print z"), (4, "01:30:00", 0.0, "other --print"), (5, "10:00", 0.0, "tool --print")], "pid long, etime string, pcpu double, command string")
    tools = Engine({"issues": issues, "processes": processes}, as_of=now)
    assert tools.unstick_issue("a", ["tool", "--print"]) == ([1], True)
    assert tools.unstick_issue("b", ["tool", "--print"]) == ([3], True)  # none runs as long: an idle one
    assert tools.unstick_issue("c", ["tool"]) == ([], False) and tools.unstick_issue("x", ["tool"]) == ([], False)
    many = spark.createDataFrame([(k, "45:00", 0.0, "tool") for k in range(6)], processes.schema)
    crowded = Engine({"issues": issues, "processes": many}, as_of=now)
    assert crowded.unstick_issue("b", ["tool"])[1] is False and crowded.unstick_issue("b", ["tool"], force=True)[1] is True


def test_trailing_counts_against_brute_force(spark):
    import datetime as dt
    import random

    from quarrylight.operators import aggregates

    r = random.Random(2)
    start = dt.datetime(2026, 1, 1)
    rows = [(k, r.choice([1, 1, 1, 2, None]), start + dt.timedelta(seconds=r.randrange(4000)) if r.random() < 0.95 else None) for k in range(500)]
    for seconds in (1, 60, 977):
        found = {x["id"]: x["n"] for x in aggregates.trailing_counts(spark.createDataFrame(rows, "id long, key long, at timestamp"), ["key"], "at", seconds).collect()}
        for k, key, at in rows:
            near = [t for _, j, t in rows if j == key and ((t is None and at is None) or (t is not None and at is not None and 0 <= (at - t).total_seconds() <= seconds))]
            assert found[k] == len(near)
