"""Streams with timers: the same outcome however the rows are cut into batches, and what comes due in silence."""

import datetime as dt
import random

import pytest

from quarrylight.streaming import timers
from quarrylight.streaming.alerts import Delays

NOW = dt.datetime(2026, 1, 1, 12)


def at(minutes):
    return NOW + dt.timedelta(minutes=minutes)


def followed(rows, upto, delays):
    """Brute force: one key's observations in order."""
    held, out = None, []
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        held, acts = timers.observed(held, row, delays)
        out += acts
    return out + timers.promoted(held, upto, delays)


def run(spark, tmp_path, batches, shape, transform, name):
    """Feed batches one by one, each through a new start of the query from the same checkpoint."""
    folder = tmp_path / name
    out, state = str(folder / "out"), str(folder / "state")
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = transform(timers.with_timers(spark).readStream.schema(shape).parquet(str(folder / "in")))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    return spark.read.schema(stream.schema).parquet(out)


OBSERVED = "issue_id string, finding string, at timestamp, present boolean, snapshot string, actionable boolean"


def test_a_silent_hour_escalates_once(spark, tmp_path):
    delays = Delays(repair_minutes=60, escalation_minutes=90, repairs=True)
    mine = [(at(0), True, "s", True)]
    other = [("2", "f", at(m), True, "x", False) for m in (1, 95, 300)]
    batches = [[("1", "f", *mine[0])], other[:1], other[1:2], other[2:]]
    found = run(spark, tmp_path, batches, OBSERVED, lambda s: timers.timed_actions(s, delays), "silent")
    got = sorted((r["issue_id"], r["action"], r["at"]) for r in found.collect())
    # issue 1 is heard of once; both of its actions come due while only issue 2 speaks
    assert got == [("1", "alert", at(0)), ("1", "escalate", at(90)), ("1", "repair", at(60)), ("2", "alert", at(1)), ("2", "escalate", at(91))]


@pytest.mark.parametrize("seed", [1, 2])
def test_actions_dont_depend_on_batches(spark, tmp_path, seed):
    r = random.Random(seed)
    delays = Delays(repair_minutes=30, escalation_minutes=50, cooldown_minutes=20, repairs=True)
    rows = [(str(r.randrange(4)), "f", at(k * 7 + r.random()), r.random() < 0.8, r.choice("st"), r.random() < 0.7) for k in range(60)]
    last = [("end", "f", at(2000), True, "s", False)]
    cuts = sorted(r.sample(range(1, 60), 3))
    whole = run(spark, tmp_path, [rows, last], OBSERVED, lambda s: timers.timed_actions(s, delays, "10 minutes"), "whole")
    parts = run(spark, tmp_path, [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 60], strict=True)] + [last], OBSERVED, lambda s: timers.timed_actions(s, delays, "10 minutes"), "parts")
    shown = lambda df: sorted((x["issue_id"], x["action"], x["tier"], x["at"]) for x in df.where("issue_id <> 'end'").collect())
    want = sorted((k, a, tier, t) for k in "0123" for a, tier, t in followed([x[2:] for x in rows if x[0] == k], at(1990), delays))
    assert shown(whole) == shown(parts) == want
    assert {a for _, a, _, _ in want} == {"alert", "clear", "repair", "escalate"}


def governed(rows, limits):
    """Brute force: one agent's requests in order."""
    wakes, escalated, out = [], {}, []
    for t, issue, touched in sorted(rows, key=lambda r: (r[0], r[1])):
        wakes = [w for w in wakes if t - w[1] < limits.kept]
        decision, after = timers.decided(wakes, escalated.get(issue), issue, t, touched, limits)
        if decision == "wake":
            wakes.append((issue, t))
        if after:
            escalated[issue] = after
        out.append((issue, t, decision, after.count if after else 0))
    return out


def test_wakes_are_governed_and_state_is_pruned(spark, tmp_path):
    r = random.Random(4)
    limits = timers.WakeLimits(issue_seconds=300, cap=3, window_seconds=900, most_cleared=1)
    shape = "agent string, issue string, at timestamp, touched timestamp"
    rows = [(r.choice("ab"), f"i{r.randrange(5)}", at(k + r.random() / 2), at(k) if r.random() < 0.3 else None) for k in range(90)]
    last = [("end", "x", at(5000), None)]
    found = run(spark, tmp_path, [rows[:30], rows[30:], last], shape, lambda s: timers.governed_wakes(s, limits), "wakes")
    want = sorted((agent, *x) for agent in "ab" for x in governed([(t, i, touched) for a, i, t, touched in rows if a == agent], limits))
    got = sorted((x["agent"], x["issue"], x["at"], x["decision"], x["escalations"]) for x in found.where("agent <> 'end'").collect())
    assert got == want
    assert {x[3] for x in want} == {"wake", "skip", "escalate", "held"} and max(x[4] for x in want) > 1
    state = spark.read.format("statestore").option("stateVarName", "wakes").load(str(tmp_path / "wakes" / "state"))
    assert [r["key"]["agent"] for r in state.select("key").distinct().collect()] == ["end"]  # the others went by their timers, escalations stay
    kept = spark.read.format("statestore").option("stateVarName", "escalated").load(str(tmp_path / "wakes" / "state"))
    assert kept.count() == len({x[:2] for x in want if x[4]})


def test_decisions():
    limits, none = timers.WakeLimits(issue_seconds=60, cap=2, window_seconds=600, most_cleared=3), None
    assert timers.decided([], none, "i", at(0), none, limits) == ("wake", None)
    assert timers.decided([("i", at(0))], none, "i", at(0.5), none, limits)[0] == "skip"
    two = [("x", at(0)), ("y", at(1))]
    decision, held = timers.decided(two, none, "i", at(2), none, limits)
    assert decision == "escalate" and held == timers.Escalation(at(2), 1, False)
    assert timers.decided([], held, "i", at(50), at(1), limits) == ("held", held)
    assert timers.decided([], held, "i", at(50), at(3), limits)[0] == "wake"
    for_good = timers.Escalation(at(2), 4, False)
    assert timers.decided([], for_good, "i", at(50), at(3), limits) == ("held", for_good)


def test_rows_of_a_key_wait_in_blocks(spark, tmp_path, monkeypatch):
    """However many rows of one agent a batch brings, no state value and no run of a task holds them all."""
    monkeypatch.setattr(timers, "RUN_ROWS", 300)
    monkeypatch.setattr(timers, "BLOCK_ROWS", 40)
    monkeypatch.setattr(timers, "KNOWN_ISSUES", 3)
    r = random.Random(5)
    limits = timers.WakeLimits(issue_seconds=300, cap=3, window_seconds=900, most_cleared=1)
    rows = [("a", f"i{r.randrange(9)}", at(r.random() * 900), at(r.random() * 900) if r.random() < 0.3 else None) for _ in range(1200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        shape = "agent string, issue string, at timestamp, touched timestamp"
        found = run(spark, tmp_path, [rows[:1000]], shape, lambda s: timers.governed_wakes(s, limits, "400 minutes"), "hot")
        sizes = [len(x["user_map_value"]["us"]) for x in spark.read.format("statestore").option("stateVarName", "blocks").load(str(tmp_path / "hot" / "state")).select("user_map_value").collect()]
        assert max(sizes) <= 40 and 300 < sum(sizes) < 600 and 0 < found.count() == 1000 - sum(sizes)
        late = max(x[2] for x in rows[:1000]) - dt.timedelta(minutes=400)
        more = [x for x in rows[1000:] if x[2] > late]
        found = run(spark, tmp_path, [more, [("end", "x", at(5000), None)]], shape, lambda s: timers.governed_wakes(s, limits, "400 minutes"), "hot")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(("a", *x) for x in governed([(t, i, touched) for _, i, t, touched in rows[:1000] + more], limits))
    assert sorted((x["agent"], x["issue"], x["at"], x["decision"], x["escalations"]) for x in found.where("agent <> 'end'").collect()) == want


def test_a_batch_of_a_finding_is_one_state_value(spark, tmp_path):
    rows = [(str(k % 3), "f", at(k), k % 7 > 0, "s", True) for k in range(300)] + [("0", "f", None, True, "s", True)]
    run(spark, tmp_path, [rows], OBSERVED, lambda s: timers.timed_actions(s, late="1000 minutes"), "few")
    blocks = spark.read.format("statestore").option("stateVarName", "blocks").load(str(tmp_path / "few" / "state"))
    assert sorted(len(x["user_map_value"]["us"]) for x in blocks.select("user_map_value").collect()) == [100, 100, 100]
