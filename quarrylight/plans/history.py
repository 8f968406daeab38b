"""Hotspots and ownership from commits, touched files and blame."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions import scoring
from quarrylight.operators.lookup import latest


def churn(files: DataFrame, touched: DataFrame, commits: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """path, churn: commits of each file since as_of - days; files without any have 0."""
    recent = touched.join(commits.where(F.col("committed_at") >= F.lit(as_of - timedelta(days=days))).select("sha"), "sha")
    counts = recent.groupBy("path").agg(F.count("*").alias("churn"))
    return files.select("path").join(counts, "path", "left").select("path", F.coalesce("churn", F.lit(0)).alias("churn"))


def hotspots(files: DataFrame, touched: DataFrame, commits: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """path, ccn_total, churn_count, hotspot_score, severity. files: path, ccn."""
    complexity = files.groupBy("path").agg(F.sum("ccn").alias("ccn_total"))
    joined = complexity.join(churn(complexity, touched, commits, as_of, days), "path")
    score = scoring.hotspot_score(F.col("ccn_total"), F.col("churn"))
    return joined.select("path", "ccn_total", F.col("churn").alias("churn_count"), score.alias("hotspot_score"), scoring.hotspot_severity(score).alias("severity"))


def find_hotspots(found: DataFrame, top_n: int = 20, min_score: float = 0.0) -> DataFrame:
    return found.where(F.coalesce("hotspot_score", F.lit(0.0)) >= min_score).orderBy(F.desc("hotspot_score"), "path").limit(top_n)


def recency_churn(touched: DataFrame, commits: DataFrame, authors: DataFrame, as_of: Column, decay_days: float = 90.0, parts: int | None = None) -> DataFrame:
    """path, author, recency_score, commit_count, last_touched_at of human authors, merges left out.

    parts: the tasks that files are dealt to, where the session's shuffles have too few for the rows.

    commits: sha, author, committed_at, is_merge; authors: author, is_bot. A null flag leaves a row out, as NOT does.
    """
    own = commits.where(~F.col("is_merge")).join(authors.where(~F.col("is_bot")).select("author"), "author")
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.col("committed_at").cast("timestamp"))
    rows = touched.join(own, "sha")
    return (rows.repartition(parts, "path") if parts else rows).groupBy("path", "author").agg(
        F.sum(scoring.recency_weight(age, decay_days)).alias("recency_score"), F.count("*").alias("commit_count"), F.max("committed_at").alias("last_touched_at")
    )


def _by_file(rows: DataFrame, parts: int | None) -> DataFrame:
    return rows.repartition(parts, "path") if parts else rows.repartition("path")


def _stacked(blame: DataFrame, churned: DataFrame, parts: int | None) -> DataFrame:
    """The sums of both by file and author, dealt by file."""
    none = lambda name: F.lit(None).cast(churned.schema[name].dataType).alias(name)
    a = blame.select("path", "author", "lines", none("recency_score"), none("commit_count"), none("last_touched_at"))
    b = churned.select("path", "author", F.lit(None).cast(blame.schema["lines"].dataType).alias("lines"), "recency_score", "commit_count", "last_touched_at")
    # dealt by file: sums by file and author, the file's totals and its shares need no further exchange
    rows = a.unionByName(b)
    return _by_file(rows, parts).groupBy("path", "author").agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("recency_score"), F.lit(0.0)).alias("recency_score"),
        F.coalesce(F.sum("commit_count"), F.lit(0)).alias("commit_count"), F.max("last_touched_at").alias("last_touched_at"),
    )


def ownership(blame: DataFrame, churned: DataFrame, alpha: float = 0.5, parts: int | None = None) -> DataFrame:
    """One row a file and author with any share: weight = alpha blame share + (1 - alpha) recency share.

    blame: path, author, lines; churned: what recency_churn gives. Sums by file and author are one row a pair, so both sides
    are stacked and summed once instead of joined. parts: as for recency_churn.
    """
    return _weighted(_stacked(blame, churned, parts), alpha)


def _weighted(both: DataFrame, alpha: float) -> DataFrame:
    """Edges of sums by path and author; a file's totals are those of its authors."""
    of_file = Window.partitionBy("path")
    shares = {"blame_share": scoring.share(F.col("lines"), F.sum("lines").over(of_file)), "churn_share": scoring.share(F.col("recency_score"), F.sum("recency_score").over(of_file))}
    weighted = both.withColumns(shares).withColumn("weight", scoring.ownership_weight(F.col("blame_share"), F.col("churn_share"), alpha))
    return weighted.where("weight > 0").select("path", "author", "weight", "blame_share", "churn_share", F.col("lines").alias("lines_attributed"), "commit_count", "last_touched_at")


def find_owners(edges: DataFrame, top_n: int = 5) -> DataFrame:
    """The heaviest owners of each file, with the number of its authors."""
    authors = edges.groupBy("path").agg(F.count("*").alias("total_authors"))
    return latest(edges, ["path"], [F.desc("weight"), F.asc("author")], top_n).join(authors, "path")


def dirty_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, state (dirty or deleted) between two manifests (path, blob); a rename is one of each."""
    joined = old.select("path", F.col("blob").alias("_old")).join(new.select("path", F.col("blob").alias("_new")), "path", "full_outer")
    return joined.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("path", F.when(F.col("_new").isNull(), "deleted").otherwise("dirty").alias("state"))


def ownership_plan(heads: DataFrame, old: DataFrame, new: DataFrame, most_files: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(project, dirty, deleted, exit_reason; the changed files) of the next ownership runs.

    heads: project, last_head (null: never run), head; old, new: project, path, blob of the two heads. A project whose head
    stands is no_change, one without changed files no_dirty, one with more than most_files max_files_exceeded; the others succeed.
    """
    a, b = old.select("project", "path", F.col("blob").alias("_old")), new.select("project", "path", F.col("blob").alias("_new"))
    first = heads.where("last_head is null").select("project", F.lit(True).alias("_first"))
    both = a.join(b, ["project", "path"], "full_outer").join(first, "project", "left")
    changed = both.where(F.coalesce("_first", F.lit(False)) & F.col("_new").isNotNull() | F.col("_first").isNull() & ~F.col("_old").eqNullSafe(F.col("_new")))
    files = changed.select("project", "path", F.when(F.col("_new").isNull(), "deleted").otherwise("dirty").alias("state"))
    moved = heads.where(~F.col("last_head").eqNullSafe(F.col("head"))).select("project")
    files = files.join(moved, "project", "left_semi")
    counts = files.groupBy("project").agg(F.count_if(F.col("state") == "dirty").alias("dirty"), F.count_if(F.col("state") == "deleted").alias("deleted"))
    rows = heads.join(counts, "project", "left").fillna(0, ["dirty", "deleted"])
    reason = F.when(F.col("last_head").eqNullSafe(F.col("head")), "no_change").when(F.col("dirty") + F.col("deleted") == 0, "no_dirty").when(F.col("dirty") > most_files, "max_files_exceeded").otherwise("success")
    plan = rows.select("project", "dirty", "deleted", reason.alias("exit_reason"))
    return plan, files.join(plan.where("exit_reason = 'success'").select("project"), "project", "left_semi")


def refreshed_ownership(edges: DataFrame, files: DataFrame, found: DataFrame) -> DataFrame:
    """edges without those of changed files, and what was found for the dirty ones; all by project and path."""
    keys = ["project", "path"]
    fresh = found.join(files.where("state = 'dirty'").select(*keys), keys, "left_semi")
    return edges.join(files.select(*keys), keys, "left_anti").unionByName(fresh.select(edges.columns))


def ownership_state(blame: DataFrame, churned: DataFrame, as_of: Column, parts: int | None = None) -> DataFrame:
    """What the next run goes on from: path, author, lines, recency_score, commit_count, last_touched_at, as_of."""
    return _stacked(blame, churned, parts).withColumn("as_of", as_of.cast("timestamp"))


def refreshed_state(state: DataFrame, blame: DataFrame, churned: DataFrame, files: DataFrame, as_of: Column, decay_days: float = 90.0, parts: int | None = None) -> DataFrame:
    """The state of the changed files, from their old state and what is new: blame of the dirty files, churn of new commits.

    files: path, state (dirty or deleted). An old sum of weights is moved to the new time by one factor, as all its weights
    shrink alike; the state of other files keeps its own time, which doesn't matter to shares. parts: as for recency_churn.
    """
    dirty = files.where("state = 'dirty'").select("path")
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp("as_of")
    old = state.select("path", "author", F.lit(0).cast("double").alias("lines"), (F.col("recency_score") * scoring.recency_weight(age, decay_days)).alias("recency_score"), "commit_count", "last_touched_at")
    come = churned.select("path", "author", F.lit(0).cast("double").alias("lines"), "recency_score", "commit_count", "last_touched_at")
    own = blame.select("path", "author", F.col("lines").cast("double").alias("lines"), F.lit(0.0).alias("recency_score"), F.lit(0).cast("long").alias("commit_count"), F.lit(None).cast(state.schema["last_touched_at"].dataType).alias("last_touched_at"))
    # dealt by file once: neither the files nor the sums need a further exchange
    merged = _by_file(old.unionByName(come).unionByName(own), parts).join(dirty, "path", "left_semi").groupBy("path", "author").agg(
        F.sum("lines").alias("lines"), F.sum("recency_score").alias("recency_score"), F.sum("commit_count").alias("commit_count"), F.max("last_touched_at").alias("last_touched_at")
    )
    return merged.withColumns({"lines": F.col("lines").cast(state.schema["lines"].dataType), "as_of": as_of.cast("timestamp")}).select(state.columns)


def ownership_of_state(state: DataFrame, alpha: float = 0.5, parts: int | None = None) -> DataFrame:
    """The edges that a state tells, as `ownership` gives them. parts: as for recency_churn."""
    rows = state.drop("as_of")
    return _weighted(rows.repartition(parts, "path") if parts else rows, alpha)
