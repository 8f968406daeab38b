"""Detectors over issues, their comments and the agents assigned to them.

Tables: issues(issue_id, assignee, run_id, status, origin, parent_id, updated_at), comments(comment_id, issue_id, author, body,
created_at), agents(agent_id, name). Every detector takes `now`, the time of the server that the feed comes from, and
returns issue_id, finding, priority, snapshot (a map: what makes it the same finding again), age_seconds, actionable.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.clock import cpu_seconds, elapsed_seconds, seconds_between

# Statuses of open work, origins that no detector looks at, patterns of outages in the order they are tried.
OPEN = ("todo", "in_progress", "in_review")
SKIPPED_ORIGINS = ("stranded_issue_recovery", "issue_productivity_review")
OUTAGES = {"cloudflare_1010": r"\b1010\b", "rate_limit_429": r"\b429\b", "service_unavailable": r"\b(502|503)\b", "cloudflare_generic": r"(?i)cloudflare"}
MENTION = r"(?i)agent://([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"

#: The detectors in the order in which one finding an issue is chosen.
PRIORITY = ("wrong_assignee", "comment_only_handoff", "review_owned_by_implementer", "cross_team_handoff", "ownerless_completion", "infra_block")


def mentions(body: Column) -> Column:
    """Ids of the agents that a comment mentions, lower case, in order."""
    return F.transform(F.regexp_extract_all(body, F.lit(MENTION), F.lit(1)), F.lower)


def age(now: Column, at: str = "updated_at") -> Column:
    return seconds_between(now, F.col(at))


def eligible(issues: DataFrame, now: Column, statuses: Sequence[str] = OPEN, window_minutes: int = 180) -> DataFrame:
    """Issues of a status, touched within the window, whose origin counts."""
    origin = F.coalesce(F.col("origin").isin(*SKIPPED_ORIGINS), F.lit(False))
    return issues.where(F.col("status").isin(*statuses) & ~origin & (age(now) <= window_minutes * 60))


def _finding(rows: DataFrame, name: str, snapshot: dict[str, Column], seconds: Column, actionable: bool = True) -> DataFrame:
    pairs = [x for k, v in snapshot.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select("issue_id", F.lit(name).alias("finding"), F.lit(PRIORITY.index(name)).alias("priority"), F.create_map(*pairs).alias("snapshot"), seconds.cast("long").alias("age_seconds"), F.lit(actionable).alias("actionable"))


def wrong_assignee(issues: DataFrame, agents: DataFrame, now: Column, least_minutes: int = 3, window_minutes: int = 180) -> DataFrame:
    """Assigned for a while to someone who is no agent."""
    rows = eligible(issues, now, OPEN, window_minutes).where(F.col("assignee").isNotNull() & (age(now) >= least_minutes * 60))
    lost = rows.join(agents.select(F.col("agent_id").alias("assignee")), "assignee", "left_anti")
    return _finding(lost, "wrong_assignee", {"assignee": F.col("assignee"), "status": F.col("status")}, age(now))


def comment_only_handoff(issues: DataFrame, comments: DataFrame, now: Column, lookback_minutes: int = 5, window_minutes: int = 180) -> DataFrame:
    """The assignee's last comment with a mention hands over to someone else, but the issue still is theirs."""
    said = comments.withColumn("target", F.get(mentions(F.col("body")), 0)).where("target is not null")
    last = said.groupBy("issue_id", F.col("author").alias("assignee")).agg(F.max_by(F.struct("comment_id", "target", "created_at"), F.struct("created_at", "comment_id")).alias("c"))
    rows = eligible(issues, now, OPEN, window_minutes).join(last, ["issue_id", "assignee"])
    since = seconds_between(F.col("updated_at"), F.col("c.created_at"))
    found = rows.where((F.col("c.target") != F.col("assignee")) & (since >= lookback_minutes * 60))
    return _finding(found, "comment_only_handoff", {"assignee": F.col("assignee"), "status": F.col("status"), "comment_id": F.col("c.comment_id"), "target": F.col("c.target")}, since)


def with_role(agents: DataFrame, roles: DataFrame) -> DataFrame:
    """agents with their role (null if unknown). roles(name, role); the case of names doesn't count."""
    known = roles.select(F.lower("name").alias("_name"), "role").dropDuplicates(["_name"])
    return agents.join(known, F.lower("name") == F.col("_name"), "left").drop("_name")


def review_owned_by_implementer(issues: DataFrame, agents: DataFrame, roles: DataFrame, now: Column, least_minutes: int = 5, window_minutes: int = 180) -> DataFrame:
    """In review for a while with someone whose role is to implement."""
    own = with_role(agents, roles).where("role = 'implementer'").select(F.col("agent_id").alias("assignee"))
    rows = eligible(issues, now, ("in_review",), window_minutes).where(age(now) >= least_minutes * 60).join(own, "assignee", "left_semi")
    return _finding(rows, "review_owned_by_implementer", {"assignee": F.col("assignee"), "status": F.col("status")}, age(now))


def cross_team_handoff(issues: DataFrame, comments: DataFrame, teams: DataFrame, team: str, now: Column, window_minutes: int = 180) -> DataFrame:
    """Assigned to an agent of another team, unless a comment marks it as meant. teams(agent_id, team)."""
    other = teams.where(F.col("team") != team).select(F.lower("agent_id").alias("_id")).join(teams.where(F.col("team") == team).select(F.lower("agent_id").alias("_id")), "_id", "left_anti").distinct()
    rows = eligible(issues, now, OPEN, window_minutes)
    rows = rows.join(other, F.lower("assignee") == F.col("_id"), "left_semi").join(comments.where(F.contains("body", F.lit("infra-block"))), "issue_id", "left_anti")
    return _finding(rows, "cross_team_handoff", {"assignee": F.col("assignee")}, age(now))


def ownerless_completion(issues: DataFrame, comments: DataFrame, approvers: DataFrame, now: Column, window_minutes: int = 180) -> DataFrame:
    """Done, no sub-task, and no approver (agent_id) has said that the tests of phase 4.1 passed."""
    passed = comments.where(F.col("body").rlike(r"(?i)phase\s+4[.\s]*1") & F.col("body").rlike(r"(?i)qa\s+pass")).join(approvers.select(F.col("agent_id").alias("author")), "author", "left_semi")
    rows = eligible(issues, now, ("done",), window_minutes).where("parent_id is null").join(passed, "issue_id", "left_anti")
    return _finding(rows, "ownerless_completion", {"status": F.col("status")}, age(now))


def infra_block(issues: DataFrame, comments: DataFrame, now: Column, lookback_minutes: int = 60, window_minutes: int = 180) -> DataFrame:
    """A recent comment tells of an outage; the first such comment and its first pattern name it."""
    kind = reduce(lambda c, x: c.when(F.col("body").rlike(x[1]), x[0]), OUTAGES.items(), F.when(F.lit(False), ""))
    told = comments.withColumn("kind", kind).where(F.col("kind").isNotNull() & (age(now, "created_at") <= lookback_minutes * 60))
    first = told.groupBy("issue_id").agg(F.min_by("kind", F.struct("created_at", "comment_id")).alias("kind"))
    rows = eligible(issues, now, (*OPEN, "blocked"), window_minutes).join(first, "issue_id")
    return _finding(rows, "infra_block", {"error_kind": F.col("kind")}, age(now), actionable=False)


def first_finding(*findings: DataFrame) -> DataFrame:
    """One finding an issue: the one whose detector comes first."""
    both = reduce(DataFrame.unionByName, findings)
    rest = [c for c in both.columns if c != "issue_id"]
    return both.groupBy("issue_id").agg(F.min_by(F.struct(*rest), "priority").alias("_f")).select("issue_id", "_f.*")


def died_mid_work(issues: DataFrame, now: Column, least_minutes: int, most_minutes: int) -> DataFrame:
    """Assigned issues without a run that nobody touched for a while (but not for too long) and that wait for no sub-task."""
    live = issues.where(F.col("status").isin(*OPEN) & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("issue_id")).distinct()
    idle = (F.col("status") != "blocked") & F.col("assignee").isNotNull() & F.col("run_id").isNull() & age(now).between(least_minutes * 60, most_minutes * 60)
    return issues.where(idle).join(live, "issue_id", "left_anti")


def wake_decisions(candidates: DataFrame, wakes: DataFrame, escalated: DataFrame, now: Column, issue_seconds: int, cap: int, window_seconds: int) -> DataFrame:
    """candidates with decision: skip (woken lately), escalate (the agent was woken too often) or wake.

    wakes(issue_id, agent_id, at); escalated(issue_id, escalated_at, permanent): such issues are left out, unless they were
    touched since and the escalation isn't permanent.
    """
    lately = wakes.where(seconds_between(now, F.col("at")) < issue_seconds).select("issue_id").distinct().withColumn("_lately", F.lit(True))
    often = wakes.where(seconds_between(now, F.col("at")) < window_seconds).groupBy(F.col("agent_id").alias("assignee")).agg(F.count("*").alias("_wakes"))
    held = escalated.select("issue_id", "escalated_at", "permanent")
    rows = candidates.join(held, "issue_id", "left").where("escalated_at is null or (not permanent and updated_at > escalated_at)").drop("escalated_at", "permanent")
    rows = rows.join(lately, "issue_id", "left").join(often, "assignee", "left")
    decision = F.when(F.col("_lately"), "skip").when(F.coalesce("_wakes", F.lit(0)) >= cap, "escalate").otherwise("wake")
    return rows.withColumn("decision", decision).drop("_lately", "_wakes")


def escalations(cycles: DataFrame, most_cleared: int = 3) -> DataFrame:
    """issue_id, escalated_at, count, permanent from a log of escalations (issue_id, at): permanent after most_cleared of them."""
    return cycles.groupBy("issue_id").agg(F.max("at").alias("escalated_at"), F.count("*").alias("count"), (F.count("*") > most_cleared).alias("permanent"))


def stale_deployment(log: DataFrame, current: str, now: Column, hours: int = 24) -> DataFrame:
    """deployed_sha, deployed_at, stale_hours if the last deployment of a log (at, sha) is old and not the current one."""
    last = log.where("sha is not null and at is not null").agg(F.max_by(F.struct("sha", "at"), F.col("at")).alias("d")).select(F.col("d.sha").alias("deployed_sha"), F.col("d.at").alias("deployed_at"))
    seconds = seconds_between(now, F.col("deployed_at"))
    return last.where((seconds >= hours * 3600) & (F.col("deployed_sha") != current)).withColumn("stale_hours", seconds / 3600)


def idle_processes(processes: DataFrame, tokens: Sequence[str], least_seconds: int, idle_ratio: float, stream_seconds: int) -> DataFrame:
    """Processes of a command that run for long with little CPU, or whose output has stood still.

    processes(pid, etime, time, command, stream_age_seconds), as ps prints them.
    """
    rows = processes.withColumns({"etime_s": F.coalesce(elapsed_seconds(F.col("etime")), F.lit(0)), "cpu_s": F.coalesce(cpu_seconds(F.col("time")), F.lit(0))})
    rows = rows.where(reduce(lambda a, b: a & b, (F.contains("command", F.lit(t)) for t in tokens), F.col("etime_s") >= least_seconds))
    rows = rows.withColumn("cpu_ratio", F.when(F.col("etime_s") > 0, F.col("cpu_s") / F.col("etime_s")).otherwise(F.lit(0.0)))
    return rows.where((F.col("cpu_ratio") < idle_ratio) | F.coalesce(F.col("stream_age_seconds") > stream_seconds, F.lit(False)))


ISSUE = "struct<id: string, assigneeAgentId: string, executionRunId: string, status: string, originKind: string, parentId: string, updatedAt: string>"


def readable_issues(feed: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(issues, errors) of a feed with an issue a row (JSON): one that can't be read is an error row and stops no other."""
    rows = feed.select(F.col(text).alias("text"), F.from_json(text, ISSUE).alias("j")).withColumn("at", F.col("j.updatedAt").try_cast("timestamp"))
    error = F.when(F.col("j.id").isNull(), "malformed").when(F.col("j.status").isNull(), "no_status").when(F.col("at").isNull(), "no_time")
    told = rows.withColumn("error", error)
    issues = told.where("error is null").select(F.col("j.id").alias("issue_id"), F.col("j.assigneeAgentId").alias("assignee"), F.col("j.executionRunId").alias("run_id"), "j.status", F.col("j.originKind").alias("origin"), F.col("j.parentId").alias("parent_id"), F.col("at").alias("updated_at"))
    return issues, told.where("error is not null").select(F.col("j.id").alias("issue_id"), "error", F.substring("text", 1, 200).alias("excerpt"))


def tick_page(issues: DataFrame, order: Sequence[Column], most: int = 30) -> DataFrame:
    """The issues that one tick looks at: the first of an order that names ties."""
    return issues.orderBy(*order).limit(most)


def _running(processes: DataFrame, tokens: Sequence[str]) -> DataFrame:
    own = reduce(lambda a, b: a & b, (F.contains("command", F.lit(t)) for t in tokens))
    return processes.where(own).select("pid", elapsed_seconds(F.col("etime")).cast("long").alias("ran"), F.col("pcpu").cast("double").alias("pcpu")).where("ran is not null")


def lock_holders(issues: DataFrame, processes: DataFrame, tokens: Sequence[str], now: Column, within_seconds: int = 60) -> DataFrame:
    """issue_id, pid, ran of the processes that run as long as an issue's lock is held, give or take.

    issues: issue_id, run_id (null: no lock), locked_at; processes: pid, etime, pcpu, command, of which those count whose
    command has all tokens. Times meet in buckets, so neither side is paired with all of the other.
    """
    bucket = 2 * within_seconds
    locked = issues.where("run_id is not null").select("issue_id", seconds_between(now, F.col("locked_at")).cast("double").alias("held")).where("held is not null")
    near = F.sequence(F.floor((F.col("held") - within_seconds) / bucket), F.floor((F.col("held") + within_seconds) / bucket))
    found = locked.withColumn("_b", F.explode(near)).join(_running(processes, tokens).withColumn("_b", F.floor(F.col("ran") / bucket)), "_b")
    return found.where(F.abs(F.col("ran") - F.col("held")) <= within_seconds).select("issue_id", "pid", "ran")


def long_idle(processes: DataFrame, tokens: Sequence[str], minutes: float = 30.0, percent: float = 0.5) -> DataFrame:
    """pid, ran of the processes of a command that have long run and use hardly any CPU."""
    return _running(processes, tokens).where((F.col("ran") >= minutes * 60) & (F.col("pcpu") < percent)).select("pid", "ran")
