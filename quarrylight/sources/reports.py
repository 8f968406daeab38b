"""Reports of other tools: dead symbols, complexity, scanners, translations, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.paths import source_context

DEAD_ITEM = "array<struct<ids: array<string>, name: string, location: string, accessibility: string, kind: string, hints: array<string>, modifiers: array<string>, attributes: array<string>, modules: array<string>>>"


def dead_symbol_report(reports: DataFrame, required: Sequence[str] = ("kind", "name", "location", "ids"), skip_paths: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Findings and warnings of reports (text: a JSON array). Rows without a required key become warnings."""
    items = reports.select(F.explode(F.from_json("text", DEAD_ITEM)).alias("i")).select("i.*")
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in required)))
    rows = items.withColumn("lacking", lacking)
    warnings = rows.where(F.size("lacking") > 0).select("name", F.concat(F.lit("lacks "), F.concat_ws(", ", "lacking")).alias("warning"))
    place = r"^(.*):(\d+):(\d+)$"
    good = rows.where(F.size("lacking") == 0).select(
        F.get("ids", 0).alias("symbol_key"), F.col("name").alias("display_name"), "kind", F.regexp_extract("location", place, 1).alias("source_file"), F.regexp_extract("location", place, 2).try_cast("int").alias("source_line"),
        (F.col("accessibility").isin("public", "open")).alias("public"), F.coalesce(F.concat_ws(",", "hints"), F.lit("")).alias("hints"),
    )
    skipped = F.lit(False)
    for pattern in skip_paths:
        skipped = skipped | F.col("source_file").rlike(pattern)
    return good.withColumn("skipped", skipped), warnings


def complexity_report(spark_xml: DataFrame) -> DataFrame:
    """path, name, start_line, end_line, nloc, ccn from rows (name, values) of a function measure.

    name reads function(...) at file:line; values are nloc, ccn and more, at least three.
    """
    pattern = r"^(.*?)(?:\([^)]*\))?\s+at\s+(.*):(\d+)$"
    start = F.regexp_extract("name", pattern, 3).try_cast("int")
    number = lambda k: F.get("values", k).try_cast("int")
    rows = spark_xml.where((F.size("values") >= 3) & F.col("name").rlike(pattern))
    return rows.select(F.regexp_extract("name", pattern, 2).alias("path"), F.regexp_extract("name", pattern, 1).alias("function"), start.alias("start_line"), (start + F.greatest(number(1) - 1, F.lit(0))).alias("end_line"), number(1).alias("nloc"), number(2).alias("ccn"))


SCAN = "results array<struct<check_id: string, path: string, start: struct<line: int, col: int>, end: struct<line: int, col: int>, extra: struct<message: string, severity: string, lines: string>>>"
# Severities of a scanner in the engine's words.
SCAN_SEVERITIES = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}


def scan_report(reports: DataFrame) -> DataFrame:
    """rule, path, start, end, message, severity of scanner reports (text: JSON), each finding once with its worst severity."""
    rows = reports.select(F.explode(F.from_json("text", SCAN)["results"]).alias("r")).select("r.*")
    known = F.create_map(*(F.lit(x) for pair in SCAN_SEVERITIES.items() for x in pair))
    severity = F.coalesce(known[F.upper("extra.severity")], F.lit("informational"))
    found = rows.select(F.element_at(F.split("check_id", r"\."), -1).alias("rule"), "path", F.col("start.line").alias("start"), F.col("end.line").alias("end"), F.col("extra.message").alias("message"), severity.alias("severity"))
    rank = F.array_position(F.array(*map(F.lit, ("high", "medium", "low", "informational"))), F.col("severity"))
    return found.groupBy("rule", "path", "start").agg(F.min_by(F.struct("end", "message", "severity"), rank).alias("v")).select("rule", "path", "start", "v.*")


SCANNED = "results array<struct<check_id: string, path: string, start: struct<line: int>, end: struct<line: int>, extra: struct<message: string, severity: string, lines: string, metadata: struct<kind: string, context: string>>>>"
# Severities, worst first, and what a scanner's words mean.
WORST_FIRST = ("critical", "high", "medium", "low", "informational")
SCANNED_SEVERITIES = {"CRITICAL": "critical", "HIGH": "high", "ERROR": "high", "WARNING": "medium", "INFO": "low"}


def scanned(reports: DataFrame, default_kind: str | None = None) -> DataFrame:
    """Every result of scanner reports (text: JSON): path, start_line, end_line, kind, severity, message, rule_id, context,
    literal (what was matched, 100 characters), source_context (by the path).

    A result without a kind has default_kind, or its rule's name; without lines it is on line 1; without an end it ends where
    it starts; an unknown severity is informational.
    """
    rows = reports.select(F.explode(F.from_json("text", SCANNED)["results"]).alias("r")).select("r.*").where("path is not null or check_id is not null")
    known = F.create_map(*(F.lit(x) for pair in SCANNED_SEVERITIES.items() for x in pair))
    start, rule = F.coalesce("start.line", F.lit(1)), F.coalesce("check_id", F.lit("unknown"))
    return rows.select(
        F.coalesce("path", F.lit("")).alias("path"), start.alias("start_line"), F.coalesce("end.line", start).alias("end_line"),
        F.coalesce("extra.metadata.kind", F.lit(default_kind) if default_kind else rule).alias("kind"), F.coalesce(known[F.upper("extra.severity")], F.lit("informational")).alias("severity"),
        F.coalesce("extra.message", F.lit("")).alias("message"), rule.alias("rule_id"), F.coalesce("extra.metadata.context", F.lit("other")).alias("context"),
        F.substring(F.trim(F.coalesce("extra.lines", F.lit(""))), 1, 100).alias("literal"),
    ).withColumn("source_context", source_context(F.col("path")))


def worst_scanned(reports: DataFrame) -> DataFrame:
    """What `scanned` gives, of each path, lines and kind the worst; of equally bad ones the first by its rule and message."""
    rows = scanned(reports)
    rank = F.array_position(F.array(*map(F.lit, WORST_FIRST)), F.col("severity"))
    keys = ["path", "start_line", "end_line", "kind"]
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank, "rule_id", "message")).alias("_v")).select(*keys, "_v.*")


def translations(catalogs: DataFrame) -> DataFrame:
    """path, locale, keys from string catalogs (text: JSON with strings -> localizations)."""
    shape = "sourceLanguage string, strings map<string, struct<localizations: map<string, string>>>"
    rows = catalogs.select("path", F.from_json("text", shape).alias("j"))
    base = rows.select("path", F.col("j.sourceLanguage").alias("locale"), F.size("j.strings").alias("keys"))
    others = rows.select("path", F.col("j.sourceLanguage").alias("_s"), F.explode("j.strings").alias("_k", "v")).select("path", "_s", F.explode(F.map_keys("v.localizations")).alias("locale")).where("locale <> _s")
    return base.unionByName(others.groupBy("path", "locale").agg(F.count("*").cast("int").alias("keys")))


def string_tables(files: DataFrame) -> DataFrame:
    """path, locale, keys of .strings files (in xx.lproj) and Android strings.xml (in values-xx)."""
    apple, android = r'(?m)^\s*"((?:[^"\\]|\\.)+)"\s*=', r'<string\s+name="([^"]+)"'
    is_xml = F.col("path").endswith(".xml")
    keys = F.when(is_xml, F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(android), F.lit(1))))).otherwise(F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(apple), F.lit(1)))))
    locale = F.when(is_xml, F.coalesce(F.nullif(F.regexp_extract("path", r"values-([^/]+)/", 1), F.lit("")), F.lit("en"))).otherwise(F.regexp_extract("path", r"([^/]+)\.lproj/", 1))
    return files.select("path", locale.alias("locale"), keys.alias("keys"))


def coverage(tables: DataFrame, base: str = "en") -> DataFrame:
    """locale, keys, coverage_pct against the base locale's first table by path."""
    most = tables.where(F.col("locale") == base).agg(F.min_by("keys", "path")).first()[0]
    counted = tables.groupBy("locale").agg(F.sum("keys").alias("keys"))
    return counted.select("locale", "keys", (F.round(100 * F.col("keys") / F.lit(most), 1) if most else F.lit(None).cast("double")).alias("coverage_pct"))


TRACE = "trace_id string, threshold_cpu_share double, summary struct<total_cpu_samples: bigint, total_wall_ms: bigint>, samples array<struct<symbol_name: string, cpu_samples: bigint, wall_ms: bigint, thread_name: string>>"


def instruments_trace(traces: DataFrame) -> DataFrame:
    """trace_id, symbol, thread, cpu_samples, wall_ms, cpu_share, wall_share, hot (text: JSON); missing totals are summed."""
    rows = traces.select(F.from_json("text", TRACE).alias("j")).select("j.*")
    total = lambda c, field: F.coalesce(F.col(f"summary.{c}"), F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, s: a + F.coalesce(s[field], F.lit(0))))
    own = rows.select("trace_id", F.coalesce("threshold_cpu_share", F.lit(0.05)).alias("threshold"), total("total_cpu_samples", "cpu_samples").alias("_c"), total("total_wall_ms", "wall_ms").alias("_w"), F.explode("samples").alias("s"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return own.select("trace_id", F.col("s.symbol_name").alias("symbol"), F.col("s.thread_name").alias("thread"), "s.cpu_samples", "s.wall_ms", share("s.cpu_samples", "_c").alias("cpu_share"), share("s.wall_ms", "_w").alias("wall_share"), (share("s.cpu_samples", "_c") >= F.col("threshold")).alias("hot"))


def sampled_frames(samples: DataFrame, callsites: DataFrame, frames: DataFrame, threads: DataFrame) -> DataFrame:
    """symbol, thread, samples: profile samples joined to their call site's frame and thread."""
    rows = samples.join(callsites, "callsite_id").join(frames, "frame_id").join(threads, "thread_id", "left")
    return rows.groupBy("symbol", "thread").agg(F.count("*").alias("samples"))
