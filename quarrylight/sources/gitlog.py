"""Git output as rows, by splitting and regular expressions in the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.paths import is_bot

LOG_FORMAT = "%H%x00%an%x00%ae%x00%cI%x00%P%x00%s%x1e"


def commits(blobs: DataFrame, text: str = "text") -> DataFrame:
    """sha, name, email, committed_at, parents, subject, is_merge, is_bot from `git log --format` with LOG_FORMAT."""
    records = blobs.select(F.explode(F.split(text, "\x1e")).alias("r")).where(F.col("r").rlike(r"\S"))
    f = F.split(F.regexp_replace("r", r"^\s+", ""), "\x00")
    part = lambda k: F.get(f, k)
    rows = records.select(
        part(0).alias("sha"), part(1).alias("name"), F.lower(part(2)).alias("email"), F.to_timestamp(part(3)).alias("committed_at"),
        F.filter(F.split(F.coalesce(part(4), F.lit("")), " "), lambda x: x != "").alias("parents"), F.substring(part(5), 1, 200).alias("subject"),
    )
    return rows.withColumns({"is_merge": F.size("parents") > 1, "is_bot": is_bot(F.col("email"), F.col("name"))})


def message_excerpt(message: Column, most: int = 1024) -> Column:
    return F.when(F.length(message) > most, F.concat(F.substring(message, 1, most), F.lit("..."))).otherwise(message)


def numstat(blobs: DataFrame, text: str = "text") -> DataFrame:
    """sha, path, added, deleted from `git log --numstat --format=commit:%H`; binary files have null counts."""
    lines = blobs.withColumn("_b", F.monotonically_increasing_id()).select("_b", F.posexplode(F.split(text, "\r?\n")).alias("_n", "line"))
    from pyspark.sql.window import Window

    sha = F.nullif(F.regexp_extract("line", r"^commit:([0-9a-f]{7,40})$", 1), F.lit(""))
    w = Window.partitionBy("_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    f = F.split("line", "\t")
    rows = lines.withColumn("sha", F.last(sha, ignorenulls=True).over(w)).where(F.size(f) == 3)
    return rows.select("sha", F.get(f, 2).alias("path"), F.get(f, 0).try_cast("int").alias("added"), F.get(f, 1).try_cast("int").alias("deleted"))


def ls_tree(blobs: DataFrame, text: str = "text") -> DataFrame:
    """mode, kind, blob, path from `git ls-tree -r`."""
    lines = blobs.select(F.explode(F.split(text, "\r?\n")).alias("line")).where("line <> ''")
    pattern = r"^(\d+) (\w+) ([0-9a-f]+)\t(.*)$"
    return lines.where(F.col("line").rlike(pattern)).select(*(F.regexp_extract("line", pattern, k).alias(n) for k, n in enumerate(("mode", "kind", "blob", "path"), 1)))


def diff(blobs: DataFrame, text: str = "text") -> DataFrame:
    """path, old_path, hunks, added, deleted of each file of `git diff` or `git show`, in blobs named by a column `blob`.

    A text is cut where files begin and each file where its first hunk does, in the row that has it: nothing moves.
    """
    files = blobs.select("blob", F.explode(F.split(text, "\r?\n(?=diff --git )")).alias("_f")).where(F.startswith("_f", F.lit("diff --git ")))
    lines = F.split(F.regexp_replace("_f", r"(?s)\r?\n@@ .*", ""), "\r?\n")
    rows = files.select("blob", lines.alias("_head"), F.split(F.regexp_extract("_f", r"(?s)\r?\n(@@ .*)", 1), "\r?\n").alias("_body"))
    named = lambda mark: F.array_max(F.transform("_head", lambda x: F.nullif(F.regexp_extract(x, rf"^{mark} [ab]/(.*)$", 1), F.lit(""))))
    count = lambda mark: F.size(F.filter("_body", lambda x: x.startswith(mark))).cast("long")
    return rows.select("blob", named(r"\+\+\+").alias("path"), named("---").alias("old_path"), count("@@ ").alias("hunks"), count("+").alias("added"), count("-").alias("deleted"))


def capped(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first `most` lines of each output, and whether more were there."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(order)
    numbered = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most + 1)
    more = numbered.groupBy(key).agg((F.max("_k") > most).alias("truncated"))
    return numbered.where(F.col("_k") <= most).drop("_k").join(more, key)


def blame(blobs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, name, email, lines, last_commit_at from `git blame --line-porcelain`, one text a file."""
    entries = blobs.select(path, F.explode(F.expr(f"regexp_extract_all({text}, '(?s)(?:^|\\\\n)([0-9a-f]{{40}} [^\\\\t]*?\\\\n\\\\t)', 1)")).alias("e"))
    one = lambda name: F.regexp_extract("e", rf"(?:^|\n){name} ([^\n]*)", 1)
    rows = entries.select(path, one("author").alias("name"), F.lower(F.regexp_replace(one("author-mail"), "[<>]", "")).alias("email"), F.timestamp_seconds(one("author-time").try_cast("long")).alias("at"))
    return rows.groupBy(path, "email").agg(F.min("name").alias("name"), F.count("*").alias("lines"), F.max("at").alias("last_commit_at"))


def new_commits(spark: SparkSession, commit_table: DataFrame, cursor: tuple | None) -> DataFrame:
    """Commits after a cursor (committed_at, sha); an unknown cursor sha asks for all again."""
    if cursor is None or not commit_table.where(F.col("sha") == cursor[1]).take(1):
        return commit_table
    at, sha = (F.lit(x) for x in cursor)
    return commit_table.where((F.col("committed_at") > at) | ((F.col("committed_at") == at) & (F.col("sha") > sha)))
