"""Ledgers of runs, checkpoints, projects, bundles and decisions: append-only tables and the views over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quarrylight.functions.checks import SLUG  # noqa: F401 - the form of slugs


class SchemaDrift(ValueError):
    """A table doesn't have the columns that are expected of it."""


def check_schema(df: DataFrame, expected: StructType | str) -> DataFrame:
    """df, if it has the expected columns with their types (further ones are allowed); else SchemaDrift names the others."""
    want = StructType.fromDDL(expected) if isinstance(expected, str) else expected
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have[f.name].simpleString() if f.name in have else 'missing'}, not {f.dataType.simpleString()}" for f in want if have.get(f.name) != f.dataType]
    if wrong:
        raise SchemaDrift("; ".join(wrong))
    return df


def runs(log: DataFrame) -> DataFrame:
    """One row a run from its rows in the log (run_id, event start or end, at, project, extractor, success, error_code, nodes, edges)."""
    started = F.min(F.when(F.col("event") == "start", F.col("at"))).alias("started_at")
    ended = F.max(F.when(F.col("event") == "end", F.col("at"))).alias("finished_at")
    last = lambda c: F.max_by(c, F.when(F.col("event") == "end", F.col("at"))).alias(c)
    rows = log.groupBy("run_id").agg(F.min("project").alias("project"), F.min("extractor").alias("extractor"), started, ended, *map(last, ("success", "error_code", "nodes", "edges")))
    return rows.withColumn("duration_ms", F.when(F.col("finished_at").isNotNull(), F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))))


def extractor_of(source: Column, extractor: Column) -> Column:
    """The extractor of old rows that only have a source `extractor.<name>`."""
    return F.coalesce(extractor, F.when(source.startswith("extractor."), F.substring(source, 11, 1 << 20)))


def reconcile(checkpoints: DataFrame, counted: DataFrame) -> DataFrame:
    """run_id, phase, expected, actual, agrees: counts written down at the end of a phase against those in the table."""
    last = checkpoints.groupBy("run_id", "phase").agg(F.max_by("count", "at").alias("expected"))
    actual = counted.groupBy("run_id", "phase").agg(F.count("*").alias("actual"))
    rows = last.join(actual, ["run_id", "phase"], "full_outer").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return rows.withColumn("agrees", F.col("expected").eqNullSafe(F.col("actual")))


def merge_projects(old: DataFrame, new: DataFrame, coalesced: Sequence[str] = ("language_profile", "created_at")) -> DataFrame:
    """Projects by slug: new values win, but where they are null the coalesced columns keep the old ones."""
    own = new.select(F.lit(True).alias("_new"), *(F.col(c).alias(c if c == "slug" else f"_{c}") for c in old.columns))
    value = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in coalesced else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c))
    return old.join(own, "slug", "full_outer").select(*(F.col(c) if c == "slug" else value(c).alias(c) for c in old.columns))


def add_members(members: DataFrame, new: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with the new ones, errors): unknown projects and those that are in the bundle already don't come in."""
    keys = ["bundle", "slug"]
    unknown = new.join(projects.select("slug"), "slug", "left_anti").select(*keys, F.lit("project_not_registered").alias("error"))
    again = new.join(members.select(*keys), keys, "left_semi").select(*keys, F.lit("already_member").alias("error"))
    fresh = new.join(projects.select("slug").distinct(), "slug", "left_semi").join(members.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return members.unionByName(fresh.select(members.columns)), unknown.unionByName(again)


def delete_bundle(members: DataFrame, bundle: str, cascade: bool = False) -> DataFrame:
    """members without a bundle; one that has members is deleted by cascade only."""
    if not cascade and members.where(F.col("bundle") == bundle).take(1):
        raise ValueError(f"bundle {bundle!r} has members")
    return members.where(F.col("bundle") != bundle)


def slug_kind(asked: DataFrame, bundles: DataFrame, projects: DataFrame) -> DataFrame:
    """asked (slug) with kind: bundle, else project, else unknown."""
    b = bundles.select(F.col("bundle").alias("slug"), F.lit(True).alias("_b")).distinct()
    p = projects.select("slug", F.lit(True).alias("_p")).distinct()
    return asked.join(b, "slug", "left").join(p, "slug", "left").withColumn("kind", F.when(F.col("_b"), "bundle").when(F.col("_p"), "project").otherwise("unknown")).drop("_b", "_p")


def resolve_groups(asked: str | Sequence[str] | None, projects: DataFrame, default: str) -> DataFrame:
    """group_id of what is asked for: nothing (the default), * (all), one slug or several; unknown slugs are an error."""
    spark = projects.sparkSession
    if asked is None:
        return spark.createDataFrame([(default,)], "group_id string")
    known = projects.select("slug").distinct()
    if asked != "*":
        wanted = spark.createDataFrame([(x,) for x in dict.fromkeys([asked] if isinstance(asked, str) else asked)], "slug string")
        lost = [r["slug"] for r in wanted.join(known, "slug", "left_anti").take(10)]
        if lost:
            raise LookupError(f"unknown project {', '.join(sorted(lost))}")
        known = known.join(F.broadcast(wanted), "slug", "left_semi")
    return known.select(F.concat(F.lit("project/"), F.col("slug")).alias("group_id"))


def valid_decisions(decisions: DataFrame, makers: Sequence[str], slices: str, most_title: int = 200, most_body: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(good, errors) of decisions (title, body, slice_ref, maker, confidence); slices: what a slice_ref looks like."""
    error = (
        F.when(F.length(F.trim("title")).between(1, most_title).eqNullSafe(F.lit(False)) | F.col("title").isNull(), "title").when(F.col("body").isNull() | (F.length("body") > most_body), "body")
        .when(F.col("slice_ref").isNull() | ~F.col("slice_ref").rlike(slices), "slice_ref").when(F.col("maker").isNull() | ~F.col("maker").isin(*makers), "maker")
        .when(F.col("confidence").isNotNull() & ~F.col("confidence").between(0, 1), "confidence")
    )
    rows = decisions.withColumn("error", error)
    return rows.where("error is null").drop("error"), rows.where("error is not null")


def document_records(commits: DataFrame, pulls: DataFrame, comments: DataFrame, most: int = 65_535) -> DataFrame:
    """doc_id, kind, body, at of commits, pull requests and their comments, for text search."""
    part = lambda df, kind, key, body, at: df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("doc_id"), F.lit(kind).alias("kind"), F.substring(F.coalesce(F.col(body), F.lit("")), 1, most).alias("body"), F.col(at).alias("at"))
    return part(commits, "commit", "sha", "message", "committed_at").unionByName(part(pulls, "pr", "number", "body", "updated_at")).unionByName(part(comments, "pr_comment", "comment_id", "body", "created_at"))


def envelope_errors(rows: DataFrame, provenances: Sequence[str] = ("asserted", "derived", "inferred")) -> DataFrame:
    """Rows whose envelope (confidence, provenance, observed_at) doesn't hold."""
    good = F.col("confidence").between(0, 1) & F.col("provenance").isin(*provenances) & F.col("observed_at").isNotNull()
    return rows.where(~F.coalesce(good, F.lit(False)))


def embedded(rows: DataFrame, text: str, embed: Callable[[list[str]], list], batch: int = 512) -> DataFrame:
    """rows with `embedding`: embed takes a list of texts, in batches, and gives a list of vectors."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for a in range(0, len(texts), batch) for v in embed(texts[a : a + batch])])

    return rows.withColumn("embedding", vectors(text))


class BudgetExceeded(RuntimeError):
    """A run has used up its budget."""


def check_budget(written: int, most: int, phase: str, override: bool = False) -> None:
    """To be called before a phase writes anything."""
    if written >= most and not override:
        raise BudgetExceeded(f"before {phase}: {written} of {most} rows are written")


def check_resume(last_error: str | None, override: bool = False) -> None:
    """A run that ended for its budget isn't taken up again before someone allows it."""
    if last_error == "budget_exceeded" and not override:
        raise BudgetExceeded("the last run ended with budget_exceeded")


def phase_states(phases: DataFrame, most: int) -> DataFrame:
    """phases (run_id, place, written, last_error) with written_before and state: resume_blocked, budget_exceeded or ok.

    What a phase writes counts for the later ones; a run has a few phases, so its window is small.
    """
    w = Window.partitionBy("run_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = phases.withColumn("written_before", F.coalesce(F.sum("written").over(w), F.lit(0)))
    state = F.when(F.col("last_error") == "budget_exceeded", "resume_blocked").when(F.col("written_before") >= most, "budget_exceeded").otherwise("ok")
    return rows.withColumn("state", state)


def counts_of(rows: DataFrame) -> DataFrame:
    """run_id, phase, n: how many rows each run wrote in each phase."""
    return rows.groupBy("run_id", "phase").agg(F.count("*").alias("n"))


def count_of(rows: DataFrame, run_id: str, phase: str) -> int:
    """How many rows a run wrote in a phase."""
    return counts_of(rows.where((F.col("run_id") == run_id) & (F.col("phase") == phase))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def superseded(records: DataFrame, changes: DataFrame) -> DataFrame:
    """records (slug, title, status, body) after changes (old, new, reason): the old ones get their status and a banner once,
    the new ones are active and come in if they are unknown."""
    old = changes.groupBy(F.col("old").alias("slug")).agg(F.max("new").alias("_by"))
    new = changes.select(F.col("new").alias("slug"), F.lit(True).alias("_on")).distinct()
    rows = records.join(old, "slug", "left").join(new, "slug", "left")
    banner = F.concat(F.lit("**SUPERSEDED by "), F.col("_by"), F.lit("**\n\n"), F.col("body"))
    body = F.when(F.col("_by").isNotNull() & ~F.col("body").startswith("**SUPERSEDED by"), banner).otherwise(F.col("body"))
    status = F.when(F.col("_by").isNotNull(), "superseded").when(F.col("_on"), "active").otherwise(F.col("status"))
    unknown = new.join(records.select("slug"), "slug", "left_anti").select("slug", F.col("slug").alias("title"), F.lit("active").alias("status"), F.lit("").alias("body"))
    return rows.select("slug", "title", status.alias("status"), body.alias("body")).unionByName(unknown)
