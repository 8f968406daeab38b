"""Latest runs, audit status, sections of findings, bundle health and the rendered report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.scoring import severity_rank
from quarrylight.operators.lookup import latest_value


def latest_runs(runs: DataFrame, successful: bool = False) -> DataFrame:
    """project, extractor and the latest run's run_id, started_at, success; ties by run_id."""
    own = runs.where("success") if successful else runs
    return latest_value(own, ["project", "extractor"], F.struct("started_at", "run_id"), "run_id", "started_at", "success")


def audit_status(projects: DataFrame, extractors: DataFrame, profile: DataFrame, runs: DataFrame) -> DataFrame:
    """project, extractor, status: NOT_APPLICABLE (outside the profile), NOT_ATTEMPTED, RUN_FAILED or OK.

    projects: project, language; extractors: extractor; profile: language, extractor; runs: as in latest_runs.
    """
    fits = profile.select("language", "extractor").distinct().withColumn("_fits", F.lit(True))
    grid = projects.withColumn("extractor", F.explode(F.array(*map(F.lit, _registered(extractors)))))
    joined = grid.join(fits, ["language", "extractor"], "left").join(latest_runs(runs), ["project", "extractor"], "left")
    status = F.when(F.col("_fits").isNull(), "NOT_APPLICABLE").when(F.col("run_id").isNull(), "NOT_ATTEMPTED").when(~F.col("success"), "RUN_FAILED").otherwise("OK")
    return joined.select("project", "extractor", status.alias("status"))


def _registered(extractors: DataFrame, most: int = 1000) -> list[str]:
    """Names of the registry, which a program holds: an error beyond `most`."""
    names = [r["extractor"] for r in extractors.select("extractor").distinct().orderBy("extractor").take(most + 1)]
    if not 0 < len(names) <= most:
        raise ValueError(f"a registry has 1 to {most} extractors")
    return names


def sections(findings: DataFrame, per_section: int, position: Column) -> DataFrame:
    """The worst findings of each section, ranked by severity and, within it, by position; with the section's total."""
    w = Window.partitionBy("section").orderBy(severity_rank(F.col("severity")), position)
    top = findings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_section)  # cut in every task before the exchange
    return top.join(findings.groupBy("section").agg(F.count("*").alias("total")), "section")


def section_order(names: DataFrame, pinned: list[str]) -> DataFrame:
    """section, worst (severity rank) with pinned sections first in their order, then worst first, then by name."""
    place = F.when(F.lit(False), 0)
    for k, name in enumerate(pinned):
        place = place.when(F.col("section") == name, k)
    return names.orderBy(place.otherwise(len(pinned)), "worst", "section")


def bundle_health(members: DataFrame, runs: DataFrame, as_of: Column, fresh_days: int = 7) -> DataFrame:
    """bundle, member, health: never, failed, fresh (within days) or stale, by the member's latest run.

    members: bundle, member; runs: member, run_id, started_at, success.
    """
    last = latest_value(runs, ["member"], F.struct("started_at", "run_id"), "started_at", "success")
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    health = F.when(F.col("started_at").isNull(), "never").when(~F.col("success"), "failed").when(age < fresh_days * 86400, "fresh").otherwise("stale")
    return members.join(last, "member", "left").select("bundle", "member", health.alias("health"), "started_at")


def bundle_status(health: DataFrame) -> DataFrame:
    """Members by health, the oldest and the newest run of each bundle."""
    kinds = ("fresh", "stale", "failed", "never")
    return health.groupBy("bundle").agg(F.count("*").alias("members"), *(F.count_if(F.col("health") == k).alias(k) for k in kinds), F.min("started_at").alias("oldest"), F.max("started_at").alias("newest"))


def source_distribution(findings: DataFrame) -> DataFrame:
    """section with findings by source context, and no_library: more than 10 findings, none in a library."""
    kinds = ("library", "example", "test", "other")
    counted = findings.groupBy("section").agg(*(F.count_if(F.col("context") == k).alias(k) for k in kinds), F.count("*").alias("total"))
    return counted.withColumn("no_library", (F.col("total") > 10) & (F.col("library") == 0))


def render(project: str, top: DataFrame) -> str:
    """A report in Markdown of all that sections() gives; the rows of each section are capped there."""
    rows = top.orderBy("section", "rank").collect()
    out, at = [f"# Audit of {project}"], None
    for r in rows:
        if r["section"] != at:
            at = r["section"]
            out += ["", f"## {at} ({r['total']})", ""]
        out.append(f"- **{r['severity']}** {r['message']}")
    return "\n".join(out if rows else [*out, "", "No findings."]) + "\n"


def summaries(hotspots: DataFrame, dead: DataFrame, deps: DataFrame, owners: DataFrame, skew: DataFrame, public: DataFrame, contracts: DataFrame, testability: DataFrame) -> DataFrame:
    """section, statistic, value: the figures at the head of each section of a report."""
    figures = [
        hotspots.agg(F.count("*").cast("double").alias("file_count"), F.coalesce(F.max("hotspot_score"), F.lit(0.0)).alias("max_score")),
        dead.agg(*(F.count_if(F.col("state") == s).cast("double").alias(s) for s in ("confirmed_dead", "unused_candidate", "skipped"))),
        deps.agg(F.count_distinct("scope").cast("double").alias("scopes"), F.coalesce(F.bool_and(F.col("version") == "unresolved"), F.lit(False)).cast("int").cast("double").alias("missing_lockfile")),
        owners.agg(F.count("*").cast("double").alias("files_analysed"), F.count_if(F.coalesce("weight", F.lit(1.0)) < 0.2).cast("double").alias("diffuse_ownership_count")),
        skew.agg(*(F.count_if(F.col("severity") == s).cast("double").alias(s) for s in ("major", "minor", "patch"))),
        public.agg(F.count_distinct("module").cast("double").alias("module_count")),
        contracts.agg(F.count_if(F.col("removed") > 0).cast("double").alias("breaking"), F.count_if(F.col("changed") > 0).cast("double").alias("signature_changes")),
        testability.agg(F.count("style").cast("double").alias("patterns"), F.count_distinct("double").cast("double").alias("test_doubles"), F.count_distinct("site").cast("double").alias("untestable_sites")),
    ]
    names = ["hotspot", "dead_symbols", "dependencies", "ownership", "version_skew", "public_api", "contracts", "testability"]
    parts = [f.unpivot([], f.columns, "statistic", "value").select(F.lit(n).alias("section"), "statistic", "value") for n, f in zip(names, figures, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def health(tables: dict[str, DataFrame], runs: DataFrame, projects: DataFrame) -> DataFrame:
    """kind, name, value, at: rows of every table, the last run of every extractor, and projects without any run."""
    from quarrylight.operators.aggregates import label_counts

    counts = label_counts(tables).select(F.lit("rows").alias("kind"), F.col("label").alias("name"), F.col("n").alias("value"), F.lit(None).cast("timestamp").alias("at"))
    last = runs.groupBy("extractor").agg(F.max_by(F.struct("success", "started_at"), F.col("started_at")).alias("r"))
    last = last.select(F.lit("last_run").alias("kind"), F.col("extractor").alias("name"), F.col("r.success").cast("long").alias("value"), F.col("r.started_at").cast("timestamp").alias("at"))
    unused = projects.join(runs.select(F.col("project").alias("slug")).distinct(), "slug", "left_anti").select(F.lit("never_run").alias("kind"), F.col("slug").cast("string").alias("name"), F.lit(0).cast("long").alias("value"), F.lit(None).cast("timestamp").alias("at"))
    return counts.unionByName(last).unionByName(unused)
