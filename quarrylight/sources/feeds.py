"""Feeds of other systems: process lists, deployment logs, pull requests, requested comparisons, helper contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PULLS = "array<struct<number: bigint, title: string, body: string, state: string, author: struct<login: string>, createdAt: string, updatedAt: string, mergedAt: string, comments: array<struct<id: string, author: struct<login: string>, body: string, createdAt: string>>>>"
RANGE = "struct<start_line: int, end_line: int>"
HELPER = (
    "schema_version int, files array<struct<path: string, module_name: string, parse_status: string,"
    f" components: array<struct<component_ref: string, module_name: string, component_kind: string, qualified_name: string, display_name: string, range: {RANGE}, resolution_status: string>>,"
    f" states: array<struct<state_ref: string, owner_component_ref: string, state_name: string, state_kind: string, range: {RANGE}, resolution_status: string>>,"
    f" effects: array<struct<effect_ref: string, owner_component_ref: string, effect_kind: string, callee_name: string, trigger_expression_kind: string, range: {RANGE}, resolution_status: string>>,"
    f" edges: array<struct<edge_ref: string, edge_kind: string, from_ref: string, to_ref: string, owner_component_ref: string, trigger_expression_kind: string, range: {RANGE}, resolution_status: string>>,"
    " diagnostics: array<struct<code: string, severity: string, ref: string, message: string>>>>"
)
# Limits of a helper's document.
MOST_BYTES, MOST_FILES, MOST_EDGES, MOST_WARNINGS, SCHEMA_VERSION = 1_000_000, 128, 512, 64, 1


def process_list(outputs: DataFrame, text: str = "text") -> DataFrame:
    """pid, etime, time, command from `ps -o pid,etime,time,command`; heads and other lines are left out."""
    lines = outputs.select(F.explode(F.split(text, "\r?\n")).alias("l"))
    pattern = r"^\s*(\d+)\s+(\S+)\s+(\S+)\s+(.+)$"
    return lines.where(F.col("l").rlike(pattern)).select(F.regexp_extract("l", pattern, 1).cast("long").alias("pid"), *(F.regexp_extract("l", pattern, k).alias(n) for k, n in enumerate(("etime", "time", "command"), 2)))


def deployment_log(logs: DataFrame, text: str = "text") -> DataFrame:
    """at, sha of the lines that name a deployed main_sha."""
    lines = logs.select(F.explode(F.split(text, "\r?\n")).alias("l"))
    f = F.split("l", "\t")
    sha = F.nullif(F.regexp_extract("l", r"\tmain_sha=([^\t]+)", 1), F.lit(""))
    return lines.select(F.get(f, 0).try_cast("timestamp").alias("at"), sha.alias("sha")).where("sha is not null and at is not null")


def pull_requests(pages: DataFrame, since: str | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pull requests, comments) of pages (text: a JSON array); those updated before `since` are left out."""
    rows = pages.select(F.explode(F.from_json(text, PULLS)).alias("p")).select("p.*").withColumn("updated_at", F.to_timestamp("updatedAt"))
    if since is not None:
        rows = rows.where(F.col("updated_at") >= F.to_timestamp(F.lit(since)))
    last = rows.groupBy("number").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "number"]), "updated_at").alias("_p")).select("number", "_p.*")
    pulls = last.select("number", "title", "body", "state", F.col("author.login").alias("author"), F.to_timestamp("createdAt").alias("created_at"), "updated_at", F.to_timestamp("mergedAt").alias("merged_at"))
    comments = last.select("number", F.explode("comments").alias("c")).select(F.col("c.id").alias("comment_id"), "number", F.col("c.author.login").alias("author"), "c.body", F.to_timestamp("c.createdAt").alias("created_at"))
    return pulls, comments


def delta_requests(files: DataFrame, text: str = "text") -> DataFrame:
    """consumer, producer, from_commit, to_commit of requested comparisons (text: a JSON array)."""
    shape = "array<struct<consumer: string, producer: string, from_commit: string, to_commit: string>>"
    return files.select(F.explode(F.from_json(text, shape)).alias("r")).select("r.*").where("from_commit is not null and to_commit is not null")


def helper_documents(files: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(files, errors) of helper documents: files that keep the contract, and why others don't.

    A document has a size, a version and a number of files; a file has limits of edges and warnings, a path inside
    the repository, unique references, and no reference to what it doesn't hold.
    """
    told = files.select(F.monotonically_increasing_id().alias("document"), F.octet_length(text).alias("_bytes"), F.from_json(text, HELPER).alias("j"))
    bad = (
        F.when(F.col("j").isNull() | F.col("j.files").isNull(), "malformed").when(F.col("_bytes") > MOST_BYTES, "too_large")
        .when(~F.col("j.schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), "schema_version").when(F.size("j.files") > MOST_FILES, "too_many_files")
    )
    told = told.withColumn("error", bad)
    rows = told.where("error is null").select("document", F.explode("j.files").alias("f")).select("document", "f.*")
    refs = lambda field, ref: F.transform(F.coalesce(field, F.array().cast(field_type[field])), lambda x: x[ref])
    field_type = {c: rows.schema[c].dataType for c in ("components", "states", "effects", "edges", "diagnostics")}
    components, states, effects, edges = refs("components", "component_ref"), refs("states", "state_ref"), refs("effects", "effect_ref"), refs("edges", "edge_ref")
    entities = F.concat(components, states, effects)
    known = F.concat(entities, edges)
    within = lambda used, allowed: F.size(F.array_except(F.array_compact(used), allowed)) == 0
    owners = F.concat(refs("states", "owner_component_ref"), refs("effects", "owner_component_ref"), refs("edges", "owner_component_ref"))
    ends = F.concat(refs("edges", "from_ref"), refs("edges", "to_ref"))
    lacks_trigger = F.exists(F.coalesce("edges", F.array().cast(field_type["edges"])), lambda e: (e["edge_kind"] == "triggers_effect") & e["trigger_expression_kind"].isNull())
    error = (
        F.when(F.col("path").isNull() | F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)"), "path")
        .when(F.size(edges) > MOST_EDGES, "too_many_edges").when(F.size(refs("diagnostics", "ref")) > MOST_WARNINGS, "too_many_warnings")
        .when(F.size(F.array_distinct(known)) < F.size(known), "duplicate_ref").when(~within(owners, components), "dangling_owner").when(~within(ends, entities), "dangling_edge")
        .when(~within(refs("diagnostics", "ref"), known), "dangling_diagnostic").when(lacks_trigger, "missing_trigger")
    )
    checked = rows.withColumn("error", error)
    errors = told.where("error is not null").select("document", F.lit(None).cast("string").alias("path"), "error").unionByName(checked.where("error is not null").select("document", "path", "error"))
    return checked.where("error is null").drop("error"), errors
