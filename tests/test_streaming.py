"""Detectors on small feeds, and the streams that follow their findings."""

import datetime as dt

from pyspark.sql import functions as F

from quarrylight.streaming import alerts, detectors, windows

NOW = dt.datetime(2026, 1, 1, 12)
A, B, C = (f"{k}0000000-0000-0000-0000-000000000000" for k in "abc")


def ago(minutes):
    return NOW - dt.timedelta(minutes=minutes)


def issues(spark, *rows):
    """id, assignee, status, minutes since the last change; then origin, parent, run."""
    full = [(i, a, (x[2] if len(x) > 2 else None), s, (x[0] if x else None), (x[1] if len(x) > 1 else None), ago(m)) for i, a, s, m, *x in rows]
    return spark.createDataFrame(full, "issue_id string, assignee string, run_id string, status string, origin string, parent_id string, updated_at timestamp")


def comments(spark, *rows):
    return spark.createDataFrame([(f"c{k}", i, a, b, ago(m)) for k, (i, a, b, m) in enumerate(rows)], "comment_id string, issue_id string, author string, body string, created_at timestamp")


def agents(spark):
    return spark.createDataFrame([(A, "Builder"), (B, "Checker")], "agent_id string, name string")


def ids(df):
    return sorted(r["issue_id"] for r in df.collect())


def test_wrong_assignee(spark):
    feed = issues(spark, ("1", C, "todo", 10), ("2", A, "todo", 10), ("3", C, "todo", 1), ("4", C, "done", 10), ("5", C, "todo", 500), ("6", C, "todo", 10, "issue_productivity_review"), ("7", None, "todo", 10))
    assert ids(detectors.wrong_assignee(feed, agents(spark), F.lit(NOW))) == ["1"]


def test_comment_only_handoff(spark):
    feed = issues(spark, ("1", A, "todo", 10), ("2", A, "todo", 10), ("3", A, "todo", 10), ("4", A, "todo", 10))
    said = comments(spark, ("1", A, f"for [@x](agent://{B.upper()})", 20), ("1", A, "thanks", 11), ("2", A, f"agent://{A}", 20), ("3", B, f"agent://{C}", 20), ("4", A, f"agent://{B}", 12))
    found = detectors.comment_only_handoff(feed, said, F.lit(NOW)).collect()
    assert [(r["issue_id"], r["snapshot"]["target"], r["age_seconds"]) for r in found] == [("1", B, 600)]


def test_review_owned_by_implementer(spark):
    roles = spark.createDataFrame([("BUILDER", "implementer"), ("checker", "reviewer")], "name string, role string")
    feed = issues(spark, ("1", A, "in_review", 10), ("2", B, "in_review", 10), ("3", A, "todo", 10), ("4", A, "in_review", 2))
    assert ids(detectors.review_owned_by_implementer(feed, agents(spark), roles, F.lit(NOW))) == ["1"]


def test_cross_team_and_ownerless(spark):
    teams = spark.createDataFrame([(A, "one"), (B, "two")], "agent_id string, team string")
    feed = issues(spark, ("1", B.upper(), "todo", 10), ("2", A, "todo", 10), ("3", B, "todo", 10), ("4", C, "todo", 10))
    assert ids(detectors.cross_team_handoff(feed, comments(spark, ("3", A, "an infra-block", 5)), teams, "one", F.lit(NOW))) == ["1"]
    done = issues(spark, ("1", A, "done", 10), ("2", A, "done", 10), ("3", A, "done", 10, None, "1"), ("4", A, "todo", 10))
    passed = comments(spark, ("1", B, "Phase 4.1: QA PASS", 20), ("2", A, "Phase 4.1: QA PASS", 20))
    assert ids(detectors.ownerless_completion(done, passed, spark.createDataFrame([(B,)], "agent_id string"), F.lit(NOW))) == ["2"]


def test_outages_and_priority(spark):
    feed = issues(spark, ("1", C, "blocked", 10), ("2", C, "todo", 10), ("3", C, "todo", 10))
    said = comments(spark, ("1", A, "HTTP 503 from Cloudflare", 20), ("1", A, "error 1010", 10), ("2", A, "HTTP 429", 90), ("3", A, "cloudflare down", 5))
    found = detectors.infra_block(feed, said, F.lit(NOW))
    assert sorted((r["issue_id"], r["snapshot"]["error_kind"], r["actionable"]) for r in found.collect()) == [("1", "service_unavailable", False), ("3", "cloudflare_generic", False)]
    first = detectors.first_finding(found, detectors.wrong_assignee(feed, agents(spark), F.lit(NOW)))
    assert sorted((r["issue_id"], r["finding"]) for r in first.collect()) == [("1", "infra_block"), ("2", "wrong_assignee"), ("3", "wrong_assignee")]


def test_died_mid_work_and_wakes(spark):
    feed = issues(spark, ("1", A, "in_progress", 30), ("2", A, "in_progress", 30, None, None, "run"), ("3", A, "blocked", 30), ("4", A, "todo", 30), ("5", A, "todo", 1, None, "4"), ("6", B, "todo", 30), ("7", A, "todo", 900), ("8", B, "todo", 30))
    found = detectors.died_mid_work(feed, F.lit(NOW), 10, 600)
    assert ids(found) == ["1", "6", "8"]
    wakes = spark.createDataFrame([("1", A, ago(2)), ("x", B, ago(3)), ("y", B, ago(4))], "issue_id string, agent_id string, at timestamp")
    held = detectors.escalations(spark.createDataFrame([("8", ago(5)), *[("6", ago(40 + k)) for k in range(3)]], "issue_id string, at timestamp"))
    assert sorted((r["issue_id"], r["count"], r["permanent"]) for r in held.collect()) == [("6", 3, False), ("8", 1, False)]
    got = detectors.wake_decisions(found, wakes, held, F.lit(NOW), 300, 2, 900)
    assert sorted((r["issue_id"], r["decision"]) for r in got.collect()) == [("1", "skip"), ("6", "escalate")]


def test_stale_deployment_and_idle_processes(spark):
    log = spark.createDataFrame([(ago(60 * 50), "old"), (ago(60 * 30), "mid")], "at timestamp, sha string")
    assert detectors.stale_deployment(log, "new", F.lit(NOW)).first()["stale_hours"] == 30
    assert detectors.stale_deployment(log, "mid", F.lit(NOW)).count() == 0
    rows = [(1, "1:00:00", "0:01", "tool run", None), (2, "1:00:00", "30:00", "tool run", 999), (3, "1:00:00", "30:00", "tool run", 5), (4, "0:10", "0:00", "tool run", None), (5, "1:00:00", "0:01", "other", None)]
    found = detectors.idle_processes(spark.createDataFrame(rows, "pid long, etime string, time string, command string, stream_age_seconds long"), ["tool", "run"], 600, 0.01, 300)
    assert sorted(r["pid"] for r in found.collect()) == [1, 2]


def test_tiers():
    d = alerts.Delays(repairs=True)
    at = lambda m: NOW + dt.timedelta(minutes=m)
    seen = [(at(0), True, "s", True), (at(10), True, "s", True), (at(61), True, "s", True), (at(95), True, "s", True), (at(99), True, "s", True), (at(100), False, "s", True), (at(101), True, "s", True)]
    held, out = alerts.follow(None, iter(seen), d)
    assert [(a, t) for a, t, _ in out] == [("alert", 1), ("repair", 2), ("escalate", 3), ("clear", 0), ("alert", 1)] and held == ("s", at(101), 1)
    _, out = alerts.follow(None, iter([(at(0), True, "s", False), (at(61), True, "s", False), (at(95), True, "s", False)]), d)
    assert [a for a, *_ in out] == ["alert", "escalate"]  # nothing to repair
    held, out = alerts.follow(None, iter([(at(0), True, "s", True), (at(5), True, "t", True), (at(35), True, "t", True)]), d)
    assert [a for a, *_ in out] == ["alert", "alert"] and held[0] == "t"
    whole = alerts.follow(None, iter(seen), d)
    half, first = alerts.follow(None, iter(seen[:3]), d)
    rest = alerts.follow(half, iter(seen[3:]), d)
    assert (rest[0], first + rest[1]) == whole  # however the stream is cut into batches


def test_alert_stream(spark, tmp_path):
    rows = [("1", "wrong_assignee", NOW + dt.timedelta(minutes=m), True, "s", True) for m in (0, 30, 95)] + [("2", "infra_block", NOW, True, "x", False), ("2", "infra_block", NOW + dt.timedelta(minutes=5), False, None, None)]
    shape = "issue_id string, finding string, at timestamp, present boolean, snapshot string, actionable boolean"
    for k, r in enumerate(rows):
        spark.createDataFrame([r], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], shape).schema).parquet(str(tmp_path / "in"))
        if k in (1, 4):  # the second start goes on from the first one's state
            alerts.write_actions(alerts.alert_actions(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out" / "actions"))
    assert sorted((r["issue_id"], r["action"], r["tier"]) for r in found.collect()) == [("1", "alert", 1), ("1", "escalate", 3), ("2", "alert", 1), ("2", "clear", 0)]


def test_budgets(spark):
    log = spark.createDataFrame([(str(k), "f", "alert", 1, NOW) for k in range(30)] + [("x", "f", "repair", 2, NOW)], alerts.ACTIONS)
    none = log.limit(0)
    out, waiting = alerts.within_budget(log, none)
    assert out.count() == 21 and waiting.count() == 10
    cleared = spark.createDataFrame([(waiting.orderBy("issue_id").first()["issue_id"], "f", "clear", 0, NOW)], alerts.ACTIONS)
    later, left = alerts.within_budget(cleared, waiting, 6)  # the next tick: nothing new, one finding is gone
    assert sorted(r["action"] for r in later.collect()) == ["alert"] * 6 + ["clear"] and left.count() == 3
    sent = {r["issue_id"] for df in (out, later, left) for r in df.where("action = 'alert'").collect()} | {cleared.first()["issue_id"]}
    assert sent == {str(k) for k in range(30)}  # none is lost
    assert alerts.budget_use(log.withColumn("tick", F.lit(1))).first()[1:] == (30, True, 10)


def test_alerts_over_the_budget_go_out_in_later_ticks(spark, tmp_path):
    shape = "issue_id string, finding string, at timestamp, present boolean, snapshot string, actionable boolean"
    for k, issues in enumerate((["1", "2", "3"], ["9"])):
        spark.createDataFrame([(x, "f", NOW + dt.timedelta(minutes=k), True, "s", True) for x in issues], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        alerts.write_actions(alerts.alert_actions(stream), str(tmp_path / "out"), str(tmp_path / "state"), 2).awaitTermination()
        found = spark.read.parquet(str(tmp_path / "out" / "actions"))
        assert sorted((r["batch"], r["issue_id"]) for r in found.collect()) == [(0, "1"), (0, "2"), (1, "3"), (1, "9")][: 2 * (k + 1)]


def test_alert_ticks(spark):
    rows = [("a", 0, k) for k in range(5)] + [("a", 1, 9), ("a", 7, 1), ("b", 3, 1)]
    found = alerts.alert_ticks(spark.createDataFrame(rows, "feed string, tick long, id long"), "feed", "tick", ["id"], 2)
    assert sorted((r["feed"], r["tick"], r["id"], r["sent_at"]) for r in found.collect()) == [("a", 0, 0, 0), ("a", 0, 1, 0), ("a", 0, 2, 1), ("a", 0, 3, 1), ("a", 0, 4, 2), ("a", 1, 9, 2), ("a", 7, 1, 7), ("b", 3, 1, 3)]


def test_windows_over_a_stream(spark, tmp_path):
    rows = [(NOW + dt.timedelta(minutes=m), "k") for m in (1, 2, 70, 600)]
    spark.createDataFrame(rows, "ts timestamp, key string").coalesce(1).write.parquet(str(tmp_path / "in" / "events.parquet"))
    stream = spark.readStream.schema("ts timestamp, key string").parquet(str(tmp_path / "in" / "events.parquet"))
    found = windows.run_to_table(windows.tumbling_counts(stream, "ts", ["key"]), str(tmp_path / "w"))
    assert sorted((r["start"], r["n"]) for r in found.collect()) == [(NOW, 2), (NOW + dt.timedelta(hours=1), 1)]
    again = spark.readStream.schema("ts timestamp, key string").parquet(str(tmp_path / "in" / "events.parquet"))
    closed = windows.run_to_table(windows.sessions(again, "ts", ["key"]), str(tmp_path / "s"))
    assert sorted(r["n"] for r in closed.collect()) == [1, 2]


def test_ingest_progress(spark):
    members = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c"), ("z", "d")], "bundle string, member string")
    results = spark.createDataFrame([("x", "a", True), ("y", "c", False)], "bundle string, member string, ok boolean")
    assert sorted(tuple(r) for r in windows.ingest_progress(members, results).collect()) == [("x", 2, 1, 0, "running"), ("y", 1, 1, 1, "failed"), ("z", 1, 0, 0, "running")]


def test_issues_that_cant_be_read_stop_no_other(spark):
    feed = spark.createDataFrame([('{"id": "1", "status": "todo", "updatedAt": "2026-01-01T00:00:00Z"}',), ("{",), ('{"id": "2", "updatedAt": "2026-01-01T00:00:00Z"}',), ('{"id": "3", "status": "todo", "updatedAt": "never"}',), (None,)], "text string")
    good, errors = detectors.readable_issues(feed)
    assert [(r["issue_id"], r["status"]) for r in good.collect()] == [("1", "todo")]
    assert sorted((str(r["issue_id"]), r["error"]) for r in errors.collect()) == [("2", "no_status"), ("3", "no_time"), ("None", "malformed"), ("None", "malformed")]
    many = spark.range(100).selectExpr("cast(id AS string) AS issue_id", "id % 7 AS at")
    page = detectors.tick_page(many, [F.col("at"), F.col("issue_id")], 30)
    assert page.count() == 30 and page.agg(F.max("at")).first()[0] <= 2
