"""Dependency manifests and module graphs.

Line formats are read by regular expressions in the engine; TOML goes through the standard parser, a file at a time.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.ids import purl

# Dependency groups and configurations with their scopes.
GRADLE_SCOPES = {"api": "compile", "implementation": "compile", "compileOnly": "compile", "runtimeOnly": "runtime", "testImplementation": "test", "androidTestImplementation": "test", "ksp": "build", "kapt": "build"}
REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*([^;]*)")


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[-_.]+", "-")


def normal_url(url: Column) -> Column:
    """A repository address without scheme, user, .git and case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), r"^(?:[a-z+]+://)?(?:[^@/]+@)?", ""), r"(?<=^[^/:]{1,200}):", "/"), r"(?:\.git)?/?$", ""))


def _pyproject(text: str) -> list[tuple[str, str, str]]:
    try:
        told = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    project = told.get("project", {})
    groups = {"compile": project.get("dependencies", []), **{f"optional:{k}": v for k, v in project.get("optional-dependencies", {}).items()}}
    groups |= {("test" if k in ("test", "tests", "dev") else k): v for k, v in told.get("dependency-groups", {}).items()}
    return [(m[1], m[2].strip(), scope) for scope, own in groups.items() for x in own if isinstance(x, str) and (m := REQUIREMENT.match(x))]


def _uv_lock(text: str) -> list[tuple[str, str, str]]:
    try:
        return [(x["name"], x.get("version", ""), "lock") for x in tomllib.loads(text).get("package", [])]
    except (tomllib.TOMLDecodeError, KeyError):
        return []


def _toml_rows(files: DataFrame, parse) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *x) for p, t in zip(part["path"], part["text"], strict=True) for x in parse(t or "")]
            yield pd.DataFrame(rows, columns=["path", "name", "constraint", "scope"])

    return files.select("path", "text").mapInPandas(run, "path string, name string, constraint string, scope string")


def python_dependencies(manifests: DataFrame, locks: DataFrame) -> DataFrame:
    """declared_in, name, constraint, scope, version, purl; what the lock lacks is 'unresolved'."""
    declared = _toml_rows(manifests, _pyproject).withColumn("_k", normal_name(F.col("name")))
    locked = _toml_rows(locks, _uv_lock).select(normal_name(F.col("name")).alias("_k"), F.col("constraint").alias("version")).dropDuplicates(["_k"])
    joined = declared.join(locked, "_k", "left").withColumn("version", F.coalesce("version", F.lit("unresolved")))
    return joined.select(F.col("path").alias("declared_in"), "name", "constraint", "scope", "version", purl(F.lit("pypi"), F.col("name"), F.col("version")).alias("purl"))


def swift_dependencies(manifests: DataFrame, pins: DataFrame) -> DataFrame:
    """declared_in, url, constraint, version, purl from Package.swift texts and Package.resolved texts (versions 1 to 3)."""
    call = r'\.package\(\s*(?:name:\s*"[^"]*",\s*)?url:\s*"([^"]+)"\s*,\s*([^)]*\)?)'
    rows = manifests.select(F.col("path").alias("declared_in"), F.explode(F.regexp_extract_all("text", F.lit(call), F.lit(0))).alias("c"))
    declared = rows.select("declared_in", F.regexp_extract("c", call, 1).alias("url"), F.regexp_extract("c", r'"([^"]+)"[^"]*$', 1).alias("constraint"))
    shape = "pins array<struct<location: string, state: struct<version: string, revision: string>>>, object struct<pins: array<struct<repositoryURL: string, state: struct<version: string, revision: string>>>>"
    told = pins.select(F.from_json("text", shape).alias("j"))
    new = told.select(F.explode("j.pins").alias("p")).select(F.col("p.location").alias("u"), "p.state.*")
    old = told.select(F.explode("j.object.pins").alias("p")).select(F.col("p.repositoryURL").alias("u"), "p.state.*")
    known = new.unionByName(old).select(normal_url(F.col("u")).alias("_k"), F.coalesce("version", "revision").alias("version")).dropDuplicates(["_k"])
    joined = declared.withColumn("_k", normal_url(F.col("url"))).join(known, "_k", "left").withColumn("version", F.coalesce("version", F.lit("unresolved")))
    kind = F.when(F.col("_k").startswith("github.com/"), "github").otherwise("generic")
    return joined.select("declared_in", "url", "constraint", "version", purl(kind, F.regexp_replace("_k", "^github.com/", ""), F.col("version")).alias("purl"))


def _catalog(text: str) -> list[tuple[str, str, str]]:
    try:
        told = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    versions, out = told.get("versions", {}), []
    for alias, x in told.get("libraries", {}).items():
        module, version = (x.rsplit(":", 1) if isinstance(x, str) else (x.get("module") or f"{x.get('group')}:{x.get('name')}", x.get("version", "")))
        if isinstance(version, dict):
            version = versions.get(version.get("ref", ""), "")
        out.append((alias, module, version if isinstance(version, str) else ""))
    return out


def gradle_dependencies(catalogs: DataFrame, scripts: DataFrame) -> DataFrame:
    """declared_in, name, scope, version, purl of catalog aliases and plain coordinates in build scripts."""
    known = _toml_rows(catalogs, _catalog).select(F.regexp_replace("name", "[-_]", ".").alias("alias"), F.col("constraint").alias("module"), F.col("scope").alias("_version"))
    use = r'\b(' + "|".join(GRADLE_SCOPES) + r')\s*\(\s*(?:libs\.([\w.]+)|"([^":]+:[^":]+)(?::([^"]+))?")\s*\)'
    rows = scripts.select(F.col("path").alias("declared_in"), F.explode(F.regexp_extract_all("text", F.lit(use), F.lit(0))).alias("c"))
    part = lambda k: F.nullif(F.regexp_extract("c", use, k), F.lit(""))
    scopes = F.create_map(*(F.lit(x) for pair in GRADLE_SCOPES.items() for x in pair))
    found = rows.select("declared_in", scopes[part(1)].alias("scope"), part(2).alias("alias"), part(3).alias("plain"), part(4).alias("plain_version")).join(known, "alias", "left")
    named = found.withColumns({"name": F.coalesce("module", "plain", "alias"), "version": F.coalesce(F.nullif(F.col("_version"), F.lit("")), F.col("plain_version"), F.lit("unresolved"))})
    return named.select("declared_in", "name", "scope", "version", purl(F.lit("maven"), F.replace("name", F.lit(":"), F.lit("/")), F.col("version")).alias("purl"))


def swift_targets(manifests: DataFrame) -> DataFrame:
    """src, dst, declared_in: targets and those of the same file that they depend on."""
    target = r'\.(?:target|testTarget|executableTarget)\(\s*name:\s*"([^"]+)"((?:(?!\.(?:target|testTarget|executableTarget)\(\s*name:).)*)'
    rows = manifests.select(F.col("path").alias("declared_in"), F.explode(F.regexp_extract_all("text", F.lit("(?s)" + target), F.lit(0))).alias("c"))
    src, rest = F.regexp_extract("c", "(?s)" + target, 1), F.regexp_extract("c", r"(?s)dependencies:\s*\[(.*?)\]", 1)
    deps = rows.select("declared_in", src.alias("src"), F.explode_outer(F.regexp_extract_all(rest, F.lit(r'(?:^|[\s,(\[])(?:\.(?:target|byName)\(name:\s*)?"([^"]+)"'), F.lit(1))).alias("dst"))
    own = deps.select("declared_in", F.col("src").alias("dst")).distinct()
    return deps.join(own, ["declared_in", "dst"], "left_semi").select("src", "dst", "declared_in")


def gradle_modules(scripts: DataFrame) -> DataFrame:
    """src (the script's folder), dst, declared_in of project(":dst") dependencies."""
    rows = scripts.select(F.col("path").alias("declared_in"), F.explode(F.regexp_extract_all("text", F.lit(r'project\(\s*(?:path\s*=\s*)?"(:[^"]+)"'), F.lit(1))).alias("d"))
    return rows.select(F.concat(F.lit(":"), F.replace(F.regexp_replace("declared_in", "/?[^/]+$", ""), F.lit("/"), F.lit(":"))).alias("src"), F.col("d").alias("dst"), "declared_in")
