"""Occurrences, references, dependency skew, API contracts and dead symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions import ids, scoring
from quarrylight.operators.joins import snapshot_diff
from quarrylight.operators.lookup import kth
from quarrylight.session import cut

KEPT_KINDS = ("def", "decl")


def evict(shadow: DataFrame, key: str, threshold: float, per_symbol: int, total: int, batch: int = 10_000) -> DataFrame:
    """shadow with evicted_in: null (stays) or the round that removed the row.

    Definitions and declarations always stay. Round 1 removes up to `batch` of the least important below the threshold; round
    2 the oldest of a symbol beyond its cap; round 3 the least important beyond the total cap. Ties go by key.
    shadow: key, symbol, kind, importance, last_seen.

    A round that removes the first of an order needs only the last row that goes: rows up to it in the order are marked, none
    is joined. Rounds 1 and 2 are one pass over the table, which is written; the third counts and marks what was written.
    """
    movable = ~F.col("kind").isin(*KEPT_KINDS)
    order = ["importance", "last_seen", key]
    low = shadow.where(movable & (F.col("importance") < threshold)).select(F.struct(*order).alias("_o"))
    last = low.orderBy("_o").limit(batch).agg(F.max("_o").alias("_o")).first()["_o"]
    in_first = movable & (F.col("importance") < threshold) & _upto(last, shadow, order)
    # those that are gone don't count for their symbol
    place = F.row_number().over(Window.partitionBy("symbol", in_first, ~movable).orderBy(F.desc("last_seen"), F.desc(key)))
    two = shadow.withColumn("_n", place).withColumn("evicted_in", F.when(in_first, 1).when(movable & (F.col("_n") > per_symbol), 2)).drop("_n")
    held = cut(two)
    counts = held.agg(F.count_if(F.col("evicted_in").isNull()).alias("left"), F.count_if(F.col("evicted_in").isNull() & movable).alias("movable")).first()
    beyond = max(0, counts["left"] - total)
    if not beyond:
        return held
    last = kth(held.where(F.col("evicted_in").isNull() & movable).select(*order), order, min(beyond, counts["movable"]))
    return held.withColumn("evicted_in", F.when(F.col("evicted_in").isNull() & movable & _upto(last, held, order), 3).otherwise(F.col("evicted_in")))


def _upto(last: Row | None, rows: DataFrame, order: list[str]) -> Column:
    """Whether a row comes no later than `last` in an order."""
    if last is None:
        return F.lit(False)
    return F.struct(*order) <= F.struct(*(F.lit(last[c]).cast(rows.schema[c].dataType).alias(c) for c in order))


def phases(occurrences: DataFrame, budget: int) -> DataFrame:
    """occurrences with phase: definitions always, own uses while they take half the budget, vendor uses 30 % of it.

    occurrences: kind, vendor (boolean). A phase that would start beyond its share is skipped (null).
    """
    n = occurrences.agg(F.count_if(F.col("kind").isin(*KEPT_KINDS)), F.count_if(~F.col("kind").isin(*KEPT_KINDS) & ~F.col("vendor"))).first()
    definitions, own = int(n[0]), int(n[1])
    own_fits, vendor_fits = definitions < 0.5 * budget, definitions + own < 0.3 * budget
    is_def = F.col("kind").isin(*KEPT_KINDS)
    return occurrences.withColumn("phase", F.when(is_def, "phase1_defs").when(~F.col("vendor") & F.lit(own_fits), "phase2_user_uses").when(F.col("vendor") & F.lit(vendor_fits), "phase3_vendor_uses"))


def find_references(occurrences: DataFrame, evicted: DataFrame, runs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each asked symbol with references, evicted and state: not_indexed (its project has no run), partial (some were evicted) or ok.

    occurrences, evicted, symbols: project, symbol; runs: project, one row a finished ingest. coverage_pct is whole percent.
    """
    keys = ["project", "symbol"]
    found = occurrences.groupBy(*keys).agg(F.count("*").alias("references"))
    gone = evicted.groupBy(*keys).agg(F.count("*").alias("evicted"))
    indexed = runs.select("project", F.lit(True).alias("_indexed")).distinct()
    joined = symbols.select(*keys).distinct().join(found, keys, "left").join(gone, keys, "left").join(indexed, "project", "left").fillna(0, ["references", "evicted"])
    state = F.when(F.col("_indexed").isNull(), "not_indexed").when(F.col("evicted") > 0, "partial").otherwise("ok")
    return joined.withColumns({"state": state}).drop("_indexed").withColumns({"coverage_pct": scoring.coverage_pct(F.col("references"), F.col("evicted"))})


def skew_groups(deps: DataFrame) -> DataFrame:
    """purl_root, ecosystem, version_count, severity, scopes, aligned for each external package.

    deps: purl, ecosystem, version, scope_id. Groups seen in one scope only are left out; one version is aligned.
    """
    own = deps.where(F.col("purl").startswith("pkg:") & F.col("version").isNotNull()).withColumn("purl_root", ids.purl_root(F.col("purl")))
    part = lambda k: ids.version_part(F.col("version"), k)
    grouped = own.groupBy("purl_root", "ecosystem").agg(
        F.count_distinct("version").alias("version_count"), F.count_distinct("scope_id").alias("scopes"), F.count_distinct(part(0)).alias("_major"),
        F.count_distinct(F.when(part(0).isNotNull(), F.struct(part(0), part(1)))).alias("_minor"), F.count_distinct(F.when(part(0).isNotNull(), F.col("version"))).alias("_readable"),
    )
    severity = F.when(F.col("version_count") > 1, ids.skew_level(F.col("_major"), F.col("_minor"), F.col("_readable")))
    return grouped.where("scopes > 1").select("purl_root", "ecosystem", "version_count", "scopes", severity.alias("severity"), (F.col("version_count") == 1).alias("aligned"))



def find_skew(groups: DataFrame, least: str = "unknown", top_n: int = 50) -> DataFrame:
    """True skew, worst first: severity, then versions, then name."""
    rank = F.when(F.col("severity") == "major", 3).when(F.col("severity") == "minor", 2).when(F.col("severity") == "patch", 1).otherwise(0)
    floor = {"major": 3, "minor": 2, "patch": 1, "unknown": 0}[least]
    return groups.where((F.col("version_count") > 1) & (rank >= floor)).orderBy(rank.desc(), F.desc("version_count"), F.asc("purl_root")).limit(top_n)


def contract_snapshot(uses: DataFrame, most: int = 5) -> DataFrame:
    """consumer, producer, symbol with use_count, file_count, first_path and up to `most` evidence paths.

    uses: consumer, producer, symbol, path; a module's own uses don't count. Paths are ranked before any are gathered, so a
    symbol that very many files use holds a few of them only.
    """
    keys = ["consumer", "producer", "symbol"]
    files = uses.where("consumer <> producer").groupBy(*keys, "path").agg(F.count("*").alias("uses"))
    ranked_files = files.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("path")))
    shown = F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.col("path")))).alias("evidence_paths")
    return ranked_files.groupBy(*keys).agg(F.sum("uses").alias("use_count"), F.count("path").alias("file_count"), F.min("path").alias("first_path"), shown)


def contract_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """consumer, producer, added, removed, changed symbols and the severity of what went."""
    diff = snapshot_diff(old, new, ["consumer", "producer", "symbol"], ["use_count"])
    counted = diff.groupBy("consumer", "producer").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")))
    return counted.withColumn("severity", scoring.removed_severity(F.col("removed")))


def dead_symbols(findings: DataFrame, public: DataFrame, shadows: DataFrame, blocked: DataFrame) -> DataFrame:
    """findings with state, skip_reason and confidence, by the first rule that holds.

    Rules: skipped in the report; several public or indexed symbols match; no key (a candidate of low confidence if it has
    a place, else skipped); retained because public; blocked by a contract; a candidate (high confidence if indexed).
    findings: finding_id, symbol_key, skipped, has_place, retain_public; public: symbol_key, public_id; shadows: symbol_key,
    symbol_id; blocked: public_id.
    """
    one = lambda df, value: df.groupBy("symbol_key").agg(F.count_distinct(value).alias(f"_n_{value}"), F.min(value).alias(f"_{value}"))
    joined = findings.join(one(public, "public_id"), "symbol_key", "left").join(one(shadows, "symbol_id"), "symbol_key", "left")
    stops = blocked.select(F.col("public_id").alias("_public_id")).distinct().withColumn("_blocked", F.lit(True))
    joined = joined.join(stops, "_public_id", "left").fillna(0, ["_n_public_id", "_n_symbol_id"]).fillna(False, ["_blocked"])
    many = (F.col("_n_public_id") > 1) | (F.col("_n_symbol_id") > 1)
    no_key = F.coalesce(F.col("symbol_key"), F.lit("")) == ""
    state = (
        F.when(F.col("skipped") | many | (no_key & ~F.col("has_place")), "skipped").when(no_key, "unused_candidate")
        .when((F.col("_n_public_id") == 1) & F.col("retain_public"), "retained_public_api").when(F.col("_blocked"), "blocked_by_contract").otherwise("unused_candidate")
    )
    reason = F.when(F.col("skipped"), "reported_skip").when(many, "ambiguous_symbol_match").when(no_key & ~F.col("has_place"), "missing_symbol_key")
    confidence = F.when(F.col("state").isin("skipped") | no_key, "low").when((F.col("state") == "unused_candidate") & (F.col("_n_symbol_id") == 1), "high").otherwise("medium")
    return joined.withColumn("state", state).withColumns({"skip_reason": reason, "confidence": confidence}).select(*findings.columns, "state", "skip_reason", "confidence")


def rank_within(rows: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def target_status(slugs: DataFrame, projects: DataFrame, deps: DataFrame) -> DataFrame:
    """slug, status of each asked slug: not_registered, not_indexed (without dependencies) or indexed."""
    known = projects.select("slug", F.lit(True).alias("_known")).distinct()
    counted = deps.select("slug", F.lit(True).alias("_has")).distinct()
    rows = slugs.select("slug").distinct().join(known, "slug", "left").join(counted, "slug", "left")
    return rows.select("slug", F.when(F.col("_known").isNull(), "not_registered").when(F.col("_has").isNull(), "not_indexed").otherwise("indexed").alias("status"))
