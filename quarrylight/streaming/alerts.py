"""Alerts that follow findings over time, as a stateful stream keyed by issue and finding.

An observation says that a finding holds (or no longer holds) at a time. The first one alerts; while it stays the same, it is
repaired after a delay and escalated after a longer one; a changed snapshot starts anew; a finding that is gone is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from quarrylight.operators.joins import placed, running_max

ACTIONS = "issue_id string, finding string, action string, tier int, at timestamp"
STATE = "snapshot string, alerted_at timestamp, tier int"


@dataclass(frozen=True)
class Delays:
    repair_minutes: int = 60
    escalation_minutes: int = 90
    cooldown_minutes: int = 30
    repairs: bool = False


def follow(held: tuple | None, seen: Iterator[tuple], delays: Delays) -> tuple[tuple | None, list[tuple]]:
    """The state after some observations (at, present, snapshot, actionable), in order of time, and the actions they cause.

    held: (snapshot, alerted_at, tier) or None.
    """
    out: list[tuple] = []
    for at, present, snapshot, actionable in seen:
        if not present:
            if held:
                out.append(("clear", 0, at))
            held = None
        elif held is None:
            held = snapshot, at, 1
            out.append(("alert", 1, at))
        elif snapshot != held[0]:  # another condition: alerted once the cooldown is over, and followed from then on
            if (at - held[1]).total_seconds() >= delays.cooldown_minutes * 60:
                held = snapshot, at, 1
                out.append(("alert", 1, at))
        else:
            minutes = (at - held[1]).total_seconds() / 60
            due = 3 if minutes >= delays.escalation_minutes else 2 if minutes >= delays.repair_minutes and actionable and delays.repairs else 1
            if due > held[2]:
                held = held[0], held[1], due
                out.append(("repair" if due == 2 else "escalate", due, at))
    return held, out


def alert_actions(observations: DataFrame, delays: Delays = Delays()) -> DataFrame:  # noqa: B008
    """The stream of actions. observations: issue_id, finding, at (timestamp), present, snapshot (string), actionable."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = [x for p in parts for x in zip(p["at"], p["present"], p["snapshot"], p["actionable"], strict=True)]
        seen.sort(key=lambda x: (x[0], not x[1], str(x[2])))
        held, out = follow(tuple(state.get) if state.exists else None, iter(seen), delays)
        if held:
            state.update(held)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*key, *x) for x in out], columns=["issue_id", "finding", "action", "tier", "at"])

    rows = observations.select(F.col("issue_id").cast("string"), "finding", "at", "present", F.coalesce("snapshot", F.lit("")).alias("snapshot"), F.coalesce("actionable", F.lit(True)).alias("actionable"))
    return rows.groupBy("issue_id", "finding").applyInPandasWithState(step, ACTIONS, STATE, "append", GroupStateTimeout.NoTimeout)


def within_budget(actions: DataFrame, waiting: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(what goes out now, what waits for the next tick) of a tick's actions and the alerts that wait from earlier ones.

    At most `most` alerts go out, the oldest first; other actions need no budget. An alert goes from the queue when its
    finding is cleared meanwhile.
    """
    gone = actions.where("action = 'clear'").select("issue_id", "finding")
    queue = waiting.join(gone, ["issue_id", "finding"], "left_anti").unionByName(actions.where("action = 'alert'"))
    now = queue.orderBy("at", "issue_id", "finding").limit(most)
    keys = ["issue_id", "finding", "at"]
    return now.unionByName(actions.where("action <> 'alert'")), queue.join(now.select(*keys), keys, "left_anti")


def write_actions(actions: DataFrame, path: str, checkpoint: str, most_alerts: int = 20):
    """Start the stream into path/actions, a part a batch; alerts over the budget wait in path/waiting for the next batch.

    A batch that is tried again reads what the batch before it left and replaces its own parts.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = spark.read.schema(ACTIONS).parquet(f"{path}/waiting/batch={number - 1}") if number else spark.createDataFrame([], ACTIONS)
        batch = batch.persist()
        try:
            out, waiting = within_budget(batch, held, most_alerts)
            out.write.mode("overwrite").parquet(f"{path}/actions/batch={number}")
            waiting.write.mode("overwrite").parquet(f"{path}/waiting/batch={number}")
        finally:
            batch.unpersist()

    return actions.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def budget_use(actions: DataFrame, soft: int = 5, hard: int = 20) -> DataFrame:
    """tick, alerts, over_soft, deferred (beyond the tick's own budget) of a log of actions with a tick column."""
    n = F.count_if(F.col("action") == "alert")
    return actions.groupBy("tick").agg(n.alias("alerts"), (n > soft).alias("over_soft"), F.greatest(n - hard, F.lit(0)).alias("deferred"))


def alert_ticks(alerts: DataFrame, feed: str, tick: str, order: list[str], hard: int = 20) -> DataFrame:
    """alerts with sent_at: the tick in which each goes out if a feed sends `hard` a tick, the oldest first.

    The k-th alert of a feed takes a slot after its predecessor's and none before its own tick, so its slot is k plus the
    largest of (tick * hard - place) up to it. Both are carried over ranges, so no task holds a feed's queue.
    """
    by = [F.col(c) for c in (tick, *order)]
    rows = placed(alerts, [feed], by, "_k").withColumn("_k", F.col("_k") - 1)
    slots = running_max(rows, [feed], by, F.col(tick) * hard - F.col("_k"), "_late")
    return slots.withColumn("sent_at", F.floor((F.col("_k") + F.col("_late")) / hard)).drop("_k", "_late")


def ranked_within(findings: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most so many findings a key, by priority and issue."""
    w = Window.partitionBy(*keys).orderBy("priority", "issue_id")
    return findings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
