"""Configuration of projects and answers of a sidecar: small files read as text on the driver, rows as tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarrylight.operators.joins import longest_prefix

# Files by which a project's profile is known, in the order they are tried.
PROFILE_FILES = (("Package.swift", "swift_kit"), ("build.gradle.kts", "android_kit"), ("pyproject.toml", "python_service"))
MOST_ENTRIES = 10_000


def read_text(text: str) -> dict:
    """A configuration in JSON, or in YAML where a parser is there; an object."""
    try:
        told = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        told = yaml.safe_load(text)
    if not isinstance(told, dict):
        raise ValueError("a configuration is an object")
    return told


def first_file(spark: SparkSession, root: str, names: Sequence[str]) -> tuple[str | None, str | None]:
    """(name, text) of the first of several files that is there below root, else none."""
    for name in names:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return name, spark.read.text(str(at.toString()), wholetext=True).first()[0]
    return None, None


def _pairs(spark: SparkSession, pairs: list[tuple], shape: str) -> DataFrame:
    if len(pairs) > MOST_ENTRIES:
        raise ValueError(f"a configuration has at most {MOST_ENTRIES} entries")
    return spark.createDataFrame(pairs, shape)


def owner_map(spark: SparkSession, text: str) -> DataFrame:
    """root, owner of a map of paths to modules."""
    return _pairs(spark, [(k.strip("/"), v) for k, v in read_text(text).items() if isinstance(v, str)], "root string, owner string")


def mapped_owner(files: DataFrame, owners: DataFrame, path: str = "path") -> DataFrame:
    """files with the owner of the longest path of the map that holds them."""
    return longest_prefix(files, owners, path, "root", "owner").drop("root")


def context_overrides(text: str | None) -> dict[str, str]:
    """Globs and the context of what they match; none without a file."""
    return {str(k): str(v) for k, v in read_text(text).get("overrides", {}).items()} if text else {}


def allowlist(spark: SparkSession, text: str) -> DataFrame:
    """literal: the lines of a list without blanks around them; empty ones and those that start with # say nothing."""
    lines = [x.strip() for x in text.splitlines()]
    return _pairs(spark, [(x,) for x in dict.fromkeys(lines) if x and not x.startswith("#")], "literal string")


def sidecar_rows(answers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """answers with the given columns, as text, of every node in them, whichever of three shapes an answer (text) has.

    An answer is a list of nodes, an object with nodes under `results` or `nodes`, or `columns` with `rows` of values.
    """
    node = StructType([StructField(c, StringType()) for c in columns])
    kept = [c for c in answers.columns if c != "text"]
    named = "struct<" + ", ".join(f"`{c}`: string" for c in columns) + ">"
    body = F.col("text")
    plain = F.from_json(F.when(body.rlike(r"^\s*\["), body), f"array<{named}>")
    told = F.from_json(F.when(~body.rlike(r"^\s*\["), body), f"results array<{named}>, nodes array<{named}>, columns array<string>, rows array<array<string>>")
    place = lambda c: F.array_position(F.col("_o.columns"), c).cast("int")
    value = lambda row, c: F.when(place(c) > 0, F.try_element_at(row, place(c)))
    rows = answers.select(*kept, plain.alias("_l"), told.alias("_o"))
    table = F.transform("_o.rows", lambda row: F.struct(*(value(row, c).alias(c) for c in columns)))
    every = F.coalesce("_l", "_o.results", "_o.nodes", table.cast(f"array<{named}>"))
    return rows.select(*kept, F.explode(every).alias("_n")).select(*kept, *(F.col(f"_n.{f.name}") for f in node))


def resolved_edges(edges: DataFrame, nodes: DataFrame, at: str = "at") -> DataFrame:
    """edges whose src and dst name nodes, with their ids instead; the last node of a name counts, unknown ends leave an edge out."""
    last = nodes.groupBy("name").agg(F.max_by("id", at).alias("_id"))
    out = edges
    for end in ("src", "dst"):
        out = out.join(last.withColumnsRenamed({"name": end, "_id": f"_{end}"}), end)
    return out.drop("src", "dst").withColumnsRenamed({"_src": "src", "_dst": "dst"})


def resolve_profiles(projects: DataFrame, files: DataFrame) -> DataFrame:
    """project, profile, source: the profile given (explicit), else that of the first known file at the root (manifest), else
    unknown_profile. projects: project, language_profile; files: project, path."""
    rank = F.when(F.lit(False), 0)
    profile = F.when(F.lit(False), "")
    for k, (name, known) in enumerate(PROFILE_FILES):
        rank, profile = rank.when(F.col("path") == name, k), profile.when(F.col("path") == name, known)
    found = files.withColumns({"_r": rank, "_p": profile}).where("_r is not null").groupBy("project").agg(F.min_by("_p", "_r").alias("_p"))
    rows = projects.join(found, "project", "left")
    source = F.when(F.col("language_profile").isNotNull(), "explicit").when(F.col("_p").isNotNull(), "manifest").otherwise("unknown_profile")
    return rows.select("project", F.coalesce("language_profile", "_p").alias("profile"), source.alias("source"))


