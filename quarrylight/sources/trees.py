"""Source trees read by Spark: which files count, their text, module and context."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.paths import language_of, module_of, source_context
from quarrylight.session import Steps

# Folders never entered, and extensions whose functions are measured.
STOP_FOLDERS = (".git", ".venv", "venv", "node_modules", "__pycache__", "build", "dist", "target", ".gradle", "Pods", ".build", "DerivedData", "vendor", ".idea")
MEASURED = ("py", "js", "jsx", "ts", "tsx", "java", "kt", "kts", "swift", "c", "h", "cc", "cpp", "hpp", "go", "rs", "rb", "cs", "scala", "sol")


def relative(path: Column, root: str) -> Column:
    """A file's path below the root."""
    return F.regexp_replace(path, "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")


def in_stop_folder(path: Column, folders: Sequence[str] = STOP_FOLDERS) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders)))


def binary_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path, length, content of the files under root, those whose name matches a glob."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (found.option("pathGlobFilter", pattern) if pattern else found).load(root)


def source_tree(spark: SparkSession, root: str, extensions: Sequence[str] = MEASURED, most_bytes: int = 1 << 20) -> DataFrame:
    """path, length, text, language, module, context of each file under root; text is null above most_bytes."""
    return source_rows(binary_files(spark, root), root, extensions, most_bytes)


def source_rows(files: DataFrame, root: str, extensions: Sequence[str] = MEASURED, most_bytes: int = 1 << 20) -> DataFrame:
    """The same of files that are rows (path, length, content)."""
    path = relative(F.col("path"), root)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.when(F.col("length") <= most_bytes, F.decode(F.col("content"), "UTF-8"))
    found = files.select(path.alias("path"), "length", text.alias("text")).where(extension.isin(*extensions) & ~in_stop_folder(F.col("path")))
    return found.withColumns({"language": language_of(F.col("path")), "module": module_of(F.col("path")), "context": source_context(F.col("path"))})


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """A store that pyarrow knows (local, HDFS, S3, GCS), and the place in it; path as Spark names it."""
    if path.startswith("file:") or ":/" not in path:
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path)


def walked(spark: SparkSession, root: str, patterns: Sequence[str] = ("*",), tasks: int | None = None) -> DataFrame:
    """path (below root), length of the files whose names match one of the globs, outside stop folders.

    Tasks list the folders, one level of the tree after another, so the driver sees no names; stop folders aren't entered.
    """
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = store_of(root.rstrip("/"))
        for part in parts:
            for folder in part["path"]:
                found = system.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/")))
                own = [(f"{folder}/{x.base_name}".lstrip("/"), x.size or 0, x.type == pafs.FileType.Directory) for x in found if x.base_name not in STOP_FOLDERS]
                own = [x for x in own if x[2] or any(fnmatchcase(x[0].rsplit("/", 1)[-1], p) for p in patterns)]
                for at in range(0, len(own), 10_000):
                    yield pd.DataFrame(own[at : at + 10_000], columns=["path", "length", "folder"])

    steps, found = Steps(spark, "walked"), None
    level = spark.createDataFrame([("",)], "path string")
    while level.take(1):
        came = steps.table(level.repartition(tasks, "path").mapInPandas(listed, "path string, length long, folder boolean"))
        files = came.where("not folder").select("path", "length")
        found = files if found is None else found.unionByName(files)
        level = came.where("folder").select("path")
    return found


def named_files(spark: SparkSession, root: str, *patterns: str) -> DataFrame:
    """path, text of files whose name matches a glob, such as *.api, outside stop folders. Tasks find and read them."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = store_of(root.rstrip("/"))
        for part in parts:
            held, size = [], 0
            for path in part["path"]:
                with system.open_input_file(f"{base}/{path}") as file:
                    held.append((path, file.read().decode("utf-8", "replace")))
                size += len(held[-1][1])
                if size > 4 << 20:
                    yield pd.DataFrame(held, columns=["path", "text"])
                    held, size = [], 0
            yield pd.DataFrame(held, columns=["path", "text"])

    found = walked(spark, root, patterns).select("path")
    return found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInPandas(read, "path string, text string")


def skipped_files(spark: SparkSession, root: str, most_bytes: int, generated: str = r"(^|/)(generated|vendor|Pods)(/|$)") -> DataFrame:
    """path, reason (too_large, generated) of files that an analysis leaves out."""
    return left_out(binary_files(spark, root).select(relative(F.col("path"), root).alias("path"), "length"), most_bytes, generated)


def left_out(files: DataFrame, most_bytes: int, generated: str = r"(^|/)(generated|vendor|Pods)(/|$)") -> DataFrame:
    """The same of files that are rows (path, length)."""
    reason = F.when(F.col("path").rlike(f"(?i){generated}"), "generated").when(F.col("length") > most_bytes, "too_large")
    return files.withColumn("reason", reason).where("reason is not null").select("path", "reason")


def imports(files: DataFrame, modules: DataFrame, parts: int | None = None) -> DataFrame:
    """path, line, module, status (ok, ambiguous) of each import that names a known module or a prefix of it.

    files: path, language, text; modules: module, name (what an import says). Swift names match as a whole; of dotted names
    every beginning is tried and the longest known one counts. parts: the tasks that lines are dealt to, where the session's
    shuffles have too few.
    """
    lines = files.select("path", "language", F.posexplode(F.split("text", "\r?\n")).alias("_n", "content"))
    said = F.regexp_extract("content", r"^\s*(?:@testable\s+)?(?:import|from)\s+(?:(?:class|struct|func|enum|protocol)\s+)?([A-Za-z_][\w.]*)", 1)
    found = lines.withColumn("said", said).where("said <> ''")
    names = F.split("said", r"\.")
    tries = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.concat_ws(".", F.slice(names, 1, n)))
    # of one line the length of a beginning names it, so the longest is found by one sum, without a join
    known = modules.groupBy("name").agg(F.min("module").alias("_a"), F.max("module").alias("_b"))
    tried = found.select("path", (F.col("_n") + 1).alias("line"), F.explode(tries).alias("name")).join(known, "name")
    best = (tried.repartition(parts, "path", "line") if parts else tried).groupBy("path", "line").agg(F.max(F.struct(F.length("name"), "_a", "_b")).alias("_m"))
    return best.select("path", "line", F.col("_m._a").alias("module"), F.when(F.col("_m._a") != F.col("_m._b"), "ambiguous").otherwise("ok").alias("status"))
