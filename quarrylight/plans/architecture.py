"""Layer rules, cycles, conventions and configuration of modules."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.paths import glob_regex
from quarrylight.operators.aggregates import mode
from quarrylight.operators.graph import strong_components
from quarrylight.operators.joins import overlap, set_differences

KINDS = ("forbidden_dependency", "forbidden_module_glob_dependency", "no_circular_module_deps", "manifest_dep_actually_used", "ast_dep_not_declared")


@dataclass(frozen=True)
class Rule:
    """One rule; `sources` and `targets` are layers or globs, by kind."""

    rule_id: str
    kind: str
    severity: str = "medium"
    sources: tuple[str, ...] = field(default=())
    targets: tuple[str, ...] = field(default=())


def read_rules(raw: list[dict]) -> tuple[list[Rule], list[str]]:
    """Rules of a parsed configuration, and a warning for each of unknown kind."""
    rules, warnings = [], []
    for k, x in enumerate(raw):
        if x.get("kind") not in KINDS:
            warnings.append(f"rule {x.get('id', k)}: unknown kind {x.get('kind')!r}")
            continue
        rules.append(Rule(str(x.get("id", k)), x["kind"], x.get("severity", "medium"), tuple(x.get("from", ())), tuple(x.get("to", ()))))
    return rules, warnings


def layers_of(modules: DataFrame, layers: dict[str, list[str]]) -> DataFrame:
    """modules (module) with layer: the first whose globs match the name."""
    out = F.when(F.lit(False), "")
    for layer, globs in layers.items():
        out = out.when(reduce(lambda a, b: a | b, (F.col("module").rlike(glob_regex(g)) for g in globs), F.lit(False)), layer)
    return modules.withColumn("layer", out)


def violations(rules: list[Rule], edges: DataFrame, imports: DataFrame, module_layers: DataFrame) -> DataFrame:
    """rule_id, kind, severity, src, dst of every violation; a cycle gives one row with its members joined in src.

    edges, imports: src, dst; module_layers: module, layer.
    """
    out = []
    tag = lambda df, r: df.select(F.lit(r.rule_id).alias("rule_id"), F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"), "src", "dst")
    for r in rules:
        if r.kind == KINDS[0]:
            of = lambda end: module_layers.select(F.col("module").alias(end), F.col("layer").alias(f"{end}_layer"))
            out.append(tag(edges.join(of("src"), "src").join(of("dst"), "dst").where(F.col("src_layer").isin(*r.sources) & F.col("dst_layer").isin(*r.targets)), r))
        elif r.kind == KINDS[1]:
            hit = lambda end, globs: reduce(lambda a, b: a | b, (F.col(end).rlike(glob_regex(g)) for g in globs), F.lit(False))
            out.append(tag(edges.where(hit("src", r.sources) & hit("dst", r.targets)), r))
        elif r.kind == KINDS[2]:
            cycles = strong_components(edges).groupBy("component").agg(F.concat_ws(",", F.array_sort(F.collect_list("node"))).alias("src"))
            out.append(tag(cycles.withColumn("dst", F.lit(None).cast("string")), r))
        else:
            side = "unused" if r.kind == KINDS[3] else "undeclared"
            out.append(tag(set_differences(edges, imports, ["src", "dst"]).where(F.col("kind") == side).drop("kind"), r))
    if not out:
        return tag(edges.limit(0), Rule("", KINDS[0]))
    return reduce(DataFrame.unionByName, out)


def convention_outliers(choices: DataFrame, least: int = 5) -> DataFrame:
    """module, rule, dominant choice, votes, total, outliers and severity (10 % outliers and more are high).

    choices: module, rule, choice; groups of fewer than `least` say nothing.
    """
    found = mode(choices, ["module", "rule"], "choice").where(F.col("total") >= least)
    severity = F.when(F.col("outliers") == 0, "informational").when(F.col("outliers") / F.col("total") >= 0.1, "high").otherwise("medium")
    return found.withColumn("severity", severity)


def suppressed(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """findings (path, start, end) with suppressed: a mark (path, line) lies on the line before or within."""
    spans = findings.select("path", "start", "end").distinct().select("*", (F.col("start") - 1).alias("_s"), F.col("end").alias("_e"))
    points = marks.select("path", F.col("line").alias("_s"), F.col("line").alias("_e")).distinct()
    hit = overlap(spans, points, ["path"], "_s", "_e", 50).groupBy("path", "start", "end").agg(F.lit(True).alias("suppressed"))
    return findings.join(hit, ["path", "start", "end"], "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))
