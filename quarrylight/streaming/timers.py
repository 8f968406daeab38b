"""Stateful operators in event time with timers: tiers of alerts that come due in silence, and a governor of wake-ups.

Rows of a key wait in its state until the watermark has passed them and are then taken in order of time, so the
outcome doesn't depend on how a stream is cut into batches. What comes due meanwhile has a timer: it fires when the watermark
passes it, whether or not the key is heard of again. State that can matter no more goes by a timer as well.

The state needs Spark's RocksDB provider (`with_timers` sets it for a session).
"""

from __future__ import annotations

import datetime as dt
import heapq
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from operator import itemgetter
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrylight.streaming.alerts import ACTIONS, Delays

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.datetime(1970, 1, 1)
NEVER = -(1 << 63)
# rows of a run, of a block of it and of a frame that comes out; issues whose escalations are held between two writes
RUN_ROWS, BLOCK_ROWS, OUT_ROWS, KNOWN_ISSUES = 100_000, 1_000, 10_000, 50_000
DECISIONS = "agent string, issue string, at timestamp, decision string, escalations int"


def with_timers(spark: SparkSession) -> SparkSession:
    """The session with a state store that keeps lists, maps and timers."""
    spark.conf.set(PROVIDER, ROCKS)
    return spark


def millis(at: dt.datetime) -> int:
    """The first whole millisecond of the epoch that isn't before a UTC time."""
    return -(-(at.replace(tzinfo=dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(milliseconds=1))


def micros(at: dt.datetime) -> int:
    """The microseconds of the epoch of a UTC time."""
    return (at - EPOCH) // dt.timedelta(microseconds=1)


def moment(us: int) -> dt.datetime:
    return EPOCH + dt.timedelta(microseconds=us)


def _up(us: int) -> int:
    """The first whole millisecond that isn't before these microseconds."""
    return -(-us // 1000)


# pure steps -----------------------------------------------------------------------------------------------------------


@dataclass
class Finding:
    """What is held of a finding: its snapshot, when it alerted, its tier, whether it may be repaired."""

    snapshot: str
    alerted_at: dt.datetime
    tier: int
    actionable: bool

    def due(self, delays: Delays) -> tuple[dt.datetime, int] | None:
        """When the next tier comes, and which."""
        if self.tier < 2 and self.actionable and delays.repairs and delays.repair_minutes < delays.escalation_minutes:
            return self.alerted_at + dt.timedelta(minutes=delays.repair_minutes), 2
        return (self.alerted_at + dt.timedelta(minutes=delays.escalation_minutes), 3) if self.tier < 3 else None


def promoted(held: Finding | None, upto: dt.datetime, delays: Delays) -> list[tuple[str, int, dt.datetime]]:
    """The actions that come due by a time; held has its new tier then."""
    out = []
    while held and (due := held.due(delays)) and due[0] <= upto:
        held.tier = due[1]
        out.append(("repair" if due[1] == 2 else "escalate", due[1], due[0]))
    return out


def observed(held: Finding | None, row: tuple[dt.datetime, bool, str, bool], delays: Delays) -> tuple[Finding | None, list[tuple[str, int, dt.datetime]]]:
    """The state after an observation (at, present, snapshot, actionable) and the actions until then.

    Another snapshot is another condition: it alerts once the cooldown is over; until then the old one is followed.
    """
    at, present, snapshot, actionable = row
    out = promoted(held, at, delays)
    if not present:
        return None, [*out, ("clear", 0, at)] if held else out
    if held is None or (snapshot != held.snapshot and at - held.alerted_at >= dt.timedelta(minutes=delays.cooldown_minutes)):
        return Finding(snapshot, at, 1, actionable), [*out, ("alert", 1, at)]
    return held, out


@dataclass(frozen=True)
class WakeLimits:
    """Seconds between two wakes of an issue, wakes of an agent within a window, escalations after which one stays."""

    issue_seconds: int = 1800
    cap: int = 10
    window_seconds: int = 900
    most_cleared: int = 3

    @property
    def kept(self) -> dt.timedelta:
        return dt.timedelta(seconds=max(self.issue_seconds, self.window_seconds))


@dataclass
class Escalation:
    at: dt.datetime
    count: int
    cleared: bool


def decided(wakes: list[tuple[str, dt.datetime]], escalated: Escalation | None, issue: str, at: dt.datetime, touched: dt.datetime | None, limits: WakeLimits) -> tuple[str, Escalation | None]:
    """The decision on a request to wake an agent for an issue, and the issue's escalation then.

    held: it is escalated, for good or untouched since; skip: woken lately; escalate: the agent was woken too often; wake.
    """
    if escalated and not escalated.cleared:
        if escalated.count > limits.most_cleared or touched is None or touched <= escalated.at:
            return "held", escalated
        escalated = Escalation(escalated.at, escalated.count, True)
    if any(i == issue and (at - t).total_seconds() < limits.issue_seconds for i, t in wakes):
        return "skip", escalated
    if sum((at - t).total_seconds() < limits.window_seconds for _, t in wakes) >= limits.cap:
        return "escalate", Escalation(at, (escalated.count if escalated else 0) + 1, False)
    return "wake", escalated


# operators ------------------------------------------------------------------------------------------------------------


class InOrder(StatefulProcessor):
    """Keeps the rows of a key until the watermark has passed them. Subclasses take them in order.

    Rows (us, the time in microseconds, and what `waiting` names) wait in runs: what came together is sorted and cut into
    blocks. A timer merges the runs and holds a block of each, so a task's memory doesn't grow with the rows of a key.
    """

    waiting: str
    order: Sequence[int]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = ", ".join(f"{name} array<{kind}>" for name, kind in (c.split() for c in f"us bigint, {self.waiting}".split(", ")))
        self.blocks = handle.getMapState("blocks", "run bigint, block bigint", arrays)
        self.runs = handle.getValueState("runs", "run array<bigint>, first array<bigint>, last array<bigint>, us array<bigint>")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None: ...

    def take(self, key: tuple, ready: Iterator[tuple], upto: dt.datetime, times: list[dt.datetime]) -> Iterator[tuple]:
        """The rows that come out once `ready` are taken and time is `upto`; `times` gets those that the key has to be seen at."""
        raise NotImplementedError

    def rank(self, row: tuple) -> list[tuple]:
        return [(row[k] is None, row[k]) for k in self.order]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        runs, came = self._runs(), []
        before = len(runs)
        for part in rows:
            columns = (part.iloc[:, n] for n in range(len(key) + 1, part.shape[1]))
            came += zip(*((c.astype(object).where(c.notna(), None) if c.hasnans else c).tolist() for c in columns), strict=True)
            if len(came) >= RUN_ROWS:
                runs.append(self._kept(came, runs))
                came = []
        if came:
            runs.append(self._kept(came, runs))
        if len(runs) > before:
            self.runs.update(tuple(map(list, zip(*runs, strict=True))))
            self.handle.registerTimer(min(_up(r[3]) for r in runs[before:]))
        yield from ()

    def _runs(self) -> list[tuple]:
        """Number, next and last block of each run, and the time of its next row."""
        held = self.runs.get()
        return list(zip(*held, strict=True)) if held else []

    def _kept(self, came: list[tuple], runs: list[tuple]) -> tuple:
        """What _runs tells of rows that are written as a run."""
        came.sort(key=self.rank)
        number, starts = max((r[0] for r in runs), default=-1) + 1, range(0, len(came), BLOCK_ROWS)
        for block, at in enumerate(starts):
            self._write(number, block, came[at : at + BLOCK_ROWS])
        return number, 0, len(starts) - 1, came[0][0]

    def _write(self, run: int, block: int, rows: list[tuple]) -> None:
        self.blocks.updateValue((run, block), tuple(map(list, zip(*rows, strict=True))))

    def _passed(self, run: tuple, upto: int, rest: list[tuple]) -> Iterator[tuple]:
        """The rows of a run up to a time, which leave it; `rest` gets what stays."""
        number, first, last, _ = run
        for block in range(first, last + 1):
            rows = list(zip(*self.blocks.getValue((number, block)), strict=True))
            n = bisect_right(rows, upto, key=itemgetter(0))
            yield from rows[:n]
            if n < len(rows):
                if n:
                    self._write(number, block, rows[n:])
                rest.append((number, block, last, rows[n][0]))
                return
            self.blocks.removeKey((number, block))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        runs, times = self._runs(), []
        due, rest = [r for r in runs if r[3] <= now * 1000], [r for r in runs if r[3] > now * 1000]
        ready = heapq.merge(*(self._passed(r, now * 1000, rest) for r in due), key=self.rank)
        out = self.take(key, ready, EPOCH + dt.timedelta(milliseconds=now), times)
        while rows := list(islice(out, OUT_ROWS)):
            yield self.frame(rows)
        if due:
            self.runs.update(tuple(map(list, zip(*sorted(rest), strict=True)))) if rest else self.runs.clear()
        following = [x for x in (*(_up(r[3]) for r in rest), *map(millis, times)) if x > now]
        if following:
            self.handle.registerTimer(min(following))

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError


class FollowedFindings(InOrder):
    waiting = "present boolean, snapshot string, actionable boolean"
    order = (0, 1, 2)

    def __init__(self, delays: Delays):
        self.delays = delays

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "snapshot string, alerted_at timestamp_ntz, tier int, actionable boolean")

    def take(self, key: tuple, ready: Iterator[tuple], upto: dt.datetime, times: list[dt.datetime]) -> Iterator[tuple]:
        was = self.held.get()
        held = Finding(*was) if was else None
        for us, *row in ready:
            held, acts = observed(held, (moment(us), *row), self.delays)
            yield from ((*key, *x) for x in acts)
        yield from ((*key, *x) for x in promoted(held, upto, self.delays))
        if held:
            self.held.update((held.snapshot, held.alerted_at, held.tier, held.actionable))
        elif was:
            self.held.clear()
        due = held.due(self.delays) if held else None
        if due:
            times.append(due[0])

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        issue, finding, action, tier, at = zip(*rows, strict=True)
        return pd.DataFrame({"issue_id": issue, "finding": finding, "action": action, "tier": np.array(tier, "int32"), "at": np.array([micros(t) for t in at])})


class WakeGovernor(InOrder):
    waiting = "issue string, touched bigint"
    order = (0, 1)

    def __init__(self, limits: WakeLimits):
        self.limits = limits

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.wakes = handle.getListState("wakes", "issue string, at timestamp_ntz")
        self.escalated = handle.getMapState("escalated", "issue string", "at timestamp_ntz, count int, cleared boolean")

    def take(self, key: tuple, ready: Iterator[tuple], upto: dt.datetime, times: list[dt.datetime]) -> Iterator[tuple]:
        held = [tuple(w) for w in self.wakes.get()]
        wakes, known, changed = list(held), {}, set()
        for us, issue, touched in ready:
            at = moment(us)
            while wakes and at - wakes[0][1] >= self.limits.kept:
                del wakes[0]
            if issue not in known:
                if len(known) >= KNOWN_ISSUES:
                    self._escalate(known, changed)
                was = self.escalated.getValue((issue,))
                known[issue] = Escalation(*was) if was else None
            before = known[issue]
            decision, after = decided(wakes, before, issue, at, None if touched == NEVER else moment(touched), self.limits)
            if decision == "wake":
                wakes.append((issue, at))
            if after and after != before:
                known[issue] = after
                changed.add(issue)
            yield (*key, issue, us, decision, after.count if after else 0)
        self._escalate(known, changed)
        wakes = [w for w in wakes if upto - w[1] < self.limits.kept]  # what no later request can meet
        if wakes != held:
            self.wakes.put(wakes) if wakes else self.wakes.clear()
        if wakes:
            times.append(min(w[1] for w in wakes) + self.limits.kept)

    def _escalate(self, known: dict[str, Escalation | None], changed: set[str]) -> None:
        """Write the escalations that have changed and forget what is known."""
        for issue in changed:
            self.escalated.updateValue((issue,), (known[issue].at, known[issue].count, known[issue].cleared))
        known.clear()
        changed.clear()

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        agent, issue, at, decision, escalations = zip(*rows, strict=True)
        return pd.DataFrame({"agent": agent, "issue": issue, "at": np.array(at), "decision": decision, "escalations": np.array(escalations, "int32")})


def _keyed(rows: DataFrame, keys: list[str], late: str) -> DataFrame:
    return rows.where("at is not null").withWatermark("at", late).withColumns({c: F.col(c).cast("string") for c in keys})


def _timed(found: DataFrame) -> DataFrame:
    return found.withColumn("at", F.timestamp_micros("at"))


def timed_actions(observations: DataFrame, delays: Delays = Delays(), late: str = "0 seconds") -> DataFrame:  # noqa: B008
    """The stream of actions on findings: alert, repair and escalate when they are due, clear.

    observations: issue_id, finding, at (timestamp), present, snapshot, actionable. Observations later than `late` are
    dropped; an action comes out once the watermark has passed its time.
    """
    rows = _keyed(observations, ["issue_id", "finding"], late)
    rows = rows.select("issue_id", "finding", "at", F.unix_micros("at").alias("us"), "present", F.coalesce("snapshot", F.lit("")).alias("snapshot"), F.coalesce("actionable", F.lit(True)).alias("actionable"))
    return _timed(rows.groupBy("issue_id", "finding").transformWithStateInPandas(FollowedFindings(delays), ACTIONS.replace("at timestamp", "at bigint"), "Append", "EventTime"))


def governed_wakes(requests: DataFrame, limits: WakeLimits = WakeLimits(), late: str = "0 seconds") -> DataFrame:  # noqa: B008
    """The stream of decisions on requests to wake an agent: agent, issue, at, touched (when the issue was last touched).

    State is kept by agent; an issue that moves to another agent begins anew there.
    """
    rows = _keyed(requests, ["agent", "issue"], late).select("agent", "at", F.unix_micros("at").alias("us"), "issue", F.coalesce(F.unix_micros("touched"), F.lit(NEVER)).alias("touched"))
    return _timed(rows.groupBy("agent").transformWithStateInPandas(WakeGovernor(limits), DECISIONS.replace("at timestamp", "at bigint"), "Append", "EventTime"))
