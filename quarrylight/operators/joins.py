"""Joins by prefix, interval, ambiguous key and snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.session import cut


def path_prefixes(path: Column) -> Column:
    """The path and all directories above it: a/b/c gives a/b/c, a/b, a."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))


def longest_prefix(files: DataFrame, roots: DataFrame, path: str, root: str, *values: str) -> DataFrame:
    """Each file with the values of the longest root that holds it, null if none does.

    An equality join on every directory of the path, so neither side need be small.
    """
    tried = files.select(path).distinct().select(path, F.explode(path_prefixes(F.col(path))).alias(root))
    best = tried.join(roots.select(root, *values), root).groupBy(path).agg(F.max_by(F.struct(root, *values), F.length(root)).alias("_v"))
    return files.join(best.select(path, "_v.*"), path, "left")


def ambiguous_lookup(rows: DataFrame, known: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """rows with status (missing, ok, ambiguous) and, where exactly one value is known, the value."""
    found = known.groupBy(*keys).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value))
    status = F.when(F.coalesce("_n", F.lit(0)) == 0, "missing").when(F.col("_n") == 1, "ok").otherwise("ambiguous")
    return rows.join(found, list(keys), "left").withColumn("status", status).withColumn(value, F.when(F.col("status") == "ok", F.col(value))).drop("_n")


def first_key_wins(rows: DataFrame, keys: str, known: DataFrame, key: str, value: str, row_id: str) -> DataFrame:
    """rows (with an array of candidate keys) and the value of the first key that is known; the least of several."""
    once = known.groupBy(key).agg(F.min(value).alias(value))
    tried = rows.select(row_id, F.posexplode(keys).alias("_at", key))
    found = tried.join(once, key).groupBy(row_id).agg(F.min_by(value, "_at").alias(value))
    return rows.join(found, row_id, "left")


def overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str, end: str, width: int) -> DataFrame:
    """Pairs of intervals with equal keys that overlap (ends included); right's bounds get the suffix _r.

    Intervals are dealt to buckets of `width` and meet in their first common bucket only.
    """
    buckets = lambda df, a, b: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    other = right.withColumnsRenamed({start: f"{start}_r", end: f"{end}_r"})
    met = buckets(left, start, end).join(buckets(other, f"{start}_r", f"{end}_r"), [*keys, "_b"])
    first = F.floor(F.greatest(F.col(start), F.col(f"{start}_r")) / width)
    return met.where((F.col(start) <= F.col(f"{end}_r")) & (F.col(f"{start}_r") <= F.col(end)) & (F.col("_b") == first)).drop("_b")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, *values: str) -> DataFrame:
    """left with the values of right's last row of the key at or before its time.

    Both sides are sorted together by key and time in ranges, so a hot key lies in many of them. Within a range a window
    carries the last values on; what a key had at the end of earlier ranges, one row a key and range, is added to it.
    """
    mine = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType)})
    theirs = right.select(*keys, at, F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    rows = stretches(mine.unionByName(theirs, allowMissingColumns=True), keys, [F.col(at), F.col("_side")])
    own = Window.partitionBy(*keys, "_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*keys, "_p").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_m"))).alias("_end"))
    before = ends.withColumn("_came", F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    carried = before.where("_came is not null").select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col("_p").alias("_q"), "_came")
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)), F.col("_p") == F.col("_q"))
    found = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(own)).where("_side = 1").join(carried, same, "left")
    return found.withColumn("_v", F.coalesce("_v", "_came")).select(*left.columns, "_v.*")


def stretches(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """rows sorted by keys and an order in ranges, with _p (the range) and _m (the place, growing along the order); written,
    so that both stay what they are."""
    by = [*map(F.col, keys), *order]
    held = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()))
    return held.withColumn("_p", F.shiftright("_m", 33))


def placed(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """rows with their place from 1 within the key, in an order that names ties; no task holds a hot key."""
    held = stretches(rows, keys, order)
    counts = held.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)), F.col("_p") == F.col("_q"))
    own = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_m"))
    return held.withColumn(name, own).join(starts, same).withColumn(name, F.col(name) + F.col("_before")).select(*rows.columns, name)


def running_max(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """rows with the largest value of the key up to each, in an order that names ties; no task holds a hot key."""
    held = stretches(rows.withColumn(name, value), keys, order)
    ends = held.groupBy(*keys, "_p").agg(F.max(name).alias("_end"))
    before = F.max("_end").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    came = ends.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col("_p").alias("_q"), before.alias("_before"))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)), F.col("_p") == F.col("_q"))
    own = F.max(name).over(Window.partitionBy(*keys, "_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn(name, own).join(came, same).withColumn(name, F.greatest(name, "_before")).select(*rows.columns, name)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """keys, change (added, removed, changed, same) and both sides' compared columns (old_, new_)."""
    a = old.select(*keys, F.lit(True).alias("_old"), *(F.col(c).alias(f"old_{c}") for c in compared))
    b = new.select(*keys, F.lit(True).alias("_new"), *(F.col(c).alias(f"new_{c}") for c in compared))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same, "same").otherwise("changed")
    return a.join(b, list(keys), "full_outer").withColumn("change", change).drop("_old", "_new")


def changed_rows(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """New rows whose digest differs from the old one's (nulls are equal), or whose key is new."""
    known = old.select(key, F.col(digest).alias("_was"), F.lit(True).alias("_known"))
    joined = new.join(known, key, "left")
    return joined.where(F.col("_known").isNull() | ~F.col(digest).eqNullSafe(F.col("_was"))).select(new.columns)


def set_differences(declared: DataFrame, used: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs on one side only: unused (declared, not used) and undeclared (used, not declared)."""
    a, b = declared.select(*keys).distinct(), used.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("kind", F.lit("unused")).unionByName(b.join(a, list(keys), "left_anti").withColumn("kind", F.lit("undeclared")))


def canonical(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """rows with the canonical form of a lower-cased name; without an alias the name itself."""
    known = aliases.select(F.lower("raw").alias("_raw"), F.lower("canonical").alias("_to")).dropDuplicates(["_raw"])
    return rows.join(known, F.lower(F.col(column)) == F.col("_raw"), "left").withColumn(column, F.coalesce("_to", F.lower(F.col(column)))).drop("_raw", "_to")


def owner_by_prefix(files: DataFrame, roots: DataFrame, path: str, root: str, module: str) -> DataFrame:
    """files with module and status: resolved if all roots above the file name one module, ambiguous if several, else unresolved."""
    tried = files.select(path).distinct().select(path, F.explode(path_prefixes(F.col(path))).alias("_r"))
    own = roots.select(F.regexp_replace(root, "/+$", "").alias("_r"), module)
    found = tried.join(own, "_r").groupBy(path).agg(F.count_distinct(module).alias("_n"), F.min(module).alias(module))
    status = F.when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "ambiguous").otherwise("unresolved")
    return files.join(found, path, "left").withColumn("status", status).withColumn(module, F.when(F.col("_n") == 1, F.col(module))).drop("_n")


def reconciled_owner(first: DataFrame, second: DataFrame, key: str, module: str) -> DataFrame:
    """key, module, status of two resolutions (key, module, status): the first counts, unless they contradict each other."""
    b = second.select(key, F.col(module).alias("_m"), F.col("status").alias("_s"))
    rows = first.join(b, key, "full_outer").withColumns({"_a": F.coalesce("status", F.lit("unresolved")), "_s": F.coalesce("_s", F.lit("unresolved"))})
    clash = (F.col("_a") == "ambiguous") | ((F.col("_a") == "unresolved") & (F.col("_s") == "ambiguous")) | ((F.col("_a") == "resolved") & (F.col("_s") == "resolved") & (F.col(module) != F.col("_m")))
    status = F.when(clash, "ambiguous").when(F.col("_a") == "resolved", "resolved").otherwise(F.col("_s"))
    return rows.select(key, F.when(~clash, F.coalesce(module, "_m")).alias(module), status.alias("status"))


def suffix_lookup(asked: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """asked (name) with status and match: the one known name that ends with it; none or several are told apart.

    An end is the whole name or begins after one of . / : #. Known names are cut to each length that an asked name has and
    counted by what is left, partially first; the counts meet the asked names by equality. So names that share an end make no
    pairs. Lengths are as few as the longest name allows.
    """
    own = asked.select(name).where(F.length(name) > 0).distinct()
    lengths = sorted(r[0] for r in own.select(F.length(name)).distinct().collect())
    tried = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: (n == F.length("_k")) | F.substring(F.col("_k"), F.length("_k") - n, F.lit(1)).isin(".", "/", ":", "#") & (n < F.length("_k")))
    ends = known.select(F.col(name).alias("_k")).distinct().select("_k", F.explode(F.transform(tried, lambda n: F.right("_k", n))).alias(name))
    found = own.join(ends.groupBy(name).agg(F.count("*").alias("_n"), F.min("_k").alias("match")), name)
    status = F.when(F.coalesce("_n", F.lit(0)) == 0, "not_found").when(F.col("_n") == 1, "ok").otherwise("ambiguous")
    return asked.join(found, name, "left").withColumn("status", status).withColumn("match", F.when(F.col("_n") == 1, F.col("match"))).drop("_n")


def unallowed(findings: DataFrame, allowed: DataFrame, text: str, literal: str) -> DataFrame:
    """findings whose text holds none of the allowed literals. allowed is a configuration of a project, a few rows."""
    literals = [r[0] for r in allowed.select(literal).where(F.col(literal) != "").distinct().take(10_001)]
    if len(literals) > 10_000:
        raise ValueError("an allowlist has at most 10,000 literals")
    listed = F.array(*map(F.lit, literals)) if literals else F.array().cast("array<string>")
    return findings.where(~F.exists(listed, lambda x: F.contains(F.coalesce(F.col(text), F.lit("")), x)))
