"""Upserts and replacements of tables without a merge statement.

Each returns the new state as a plan; write it as a new version or as replaced partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Old rows stay; of new rows with unknown keys the first of each key comes in."""
    fresh = new.join(old.select(*keys).distinct(), list(keys), "left_anti")
    return old.unionByName(keep_first(fresh, keys, order or [F.lit(0)]).select(old.columns))


def last_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """New rows replace old ones of their key; of several new ones the last."""
    latest = keep_first(new, keys, [c.desc() for c in order] or [F.lit(0)])
    return old.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest.select(old.columns))


def widen(old: DataFrame, new: DataFrame, keys: Sequence[str], at: str, kept: Sequence[str] = (), replaced: Sequence[str] = ()) -> DataFrame:
    """Sightings folded into first_seen, last_seen; `kept` columns take the first value there is, `replaced` the latest.

    old: keys, first_seen, last_seen, kept, replaced. new: keys, at, kept, replaced.
    """
    rows = old.withColumn("_at", F.col("last_seen")).withColumn("_new", F.lit(0)).unionByName(
        new.withColumns({"first_seen": F.col(at), "last_seen": F.col(at), "_at": F.col(at), "_new": F.lit(1)}).select(*old.columns, "_at", "_new")
    )
    aggregates = [F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]
    aggregates += [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_new", "_at"))).alias(c) for c in kept]
    aggregates += [F.max_by(c, F.struct("_new", "_at")).alias(c) for c in replaced]
    return rows.groupBy(*keys).agg(*aggregates).select(old.columns)


def replace_scope(old: DataFrame, new: DataFrame, scope: Sequence[str], scopes: DataFrame | None = None) -> DataFrame:
    """All old rows of the scopes named (by default those of the new rows) go; the new rows come."""
    named = (scopes if scopes is not None else new).select(*scope).distinct()
    return old.join(named, list(scope), "left_anti").unionByName(new.select(old.columns))


def delete_keys(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def invalidate(edges: DataFrame, id_column: str, prefixes: Sequence[str], now: Column) -> DataFrame:
    """Edges whose id starts with a prefix and that still hold get invalid_at."""
    hit = reduce(lambda a, b: a | b, (F.col(id_column).startswith(p) for p in prefixes), F.lit(False))
    return edges.withColumn("invalid_at", F.when(hit & F.col("invalid_at").isNull(), now).otherwise(F.col("invalid_at")))


def evict_stale(rows: DataFrame, kept: DataFrame, key: str, seen: str, started: Column) -> DataFrame:
    """Rows go that are neither kept nor seen since the run started."""
    stale = rows.where(F.col(seen) < started).join(kept.select(key).distinct(), key, "left_anti").select(key)
    return rows.join(stale.distinct(), key, "left_anti")


def mark_stale(rows: DataFrame, kept: DataFrame, key: str, seen: str, started: Column, values: dict[str, Column]) -> DataFrame:
    """The same rows stay, with the given values."""
    known = kept.select(F.col(key).alias("_kept")).distinct()
    joined = rows.join(known, rows[key] == known["_kept"], "left")
    stale = F.col("_kept").isNull() & (F.col(seen) < started)
    return joined.withColumns({c: F.when(stale, v).otherwise(F.col(c)) for c, v in values.items()}).select(rows.columns)


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def delete_counted(old: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(old without the rows of the keys, how many keys were asked for, whether they were there or not)."""
    return delete_keys(old, gone, [key]), gone.select(key).distinct().count()


def enriched(rows: DataFrame, samples: DataFrame, key: str, *values: Column) -> DataFrame:
    """rows with values over their current samples; what has none any more is null again, so replacing samples resets them."""
    return rows.join(samples.groupBy(key).agg(*values), key, "left")


def valid_batches(batches: DataFrame, facts: DataFrame) -> DataFrame:
    """The batches all of whose facts keep their scope; the others are left out as a whole.

    batches: batch, file_path (null: of the run), language; facts: batch, kind (component, state, effect, diagnostic, edge),
    file_path, language. A diagnostic of a run has no file; an effect's language may be unknown; an edge's doesn't count.
    """
    own = facts.withColumnsRenamed({"file_path": "_p", "language": "_l"}).join(batches, "batch")
    path = F.when(F.col("kind") == "diagnostic", F.col("_p").eqNullSafe(F.col("file_path"))).otherwise(F.col("file_path").isNull() | F.col("_p").eqNullSafe(F.col("file_path")))
    same = F.col("_l").eqNullSafe(F.col("language"))
    language = F.when(F.col("kind") == "edge", F.lit(True)).when(F.col("kind") == "effect", same | (F.col("_l") == "unknown")).otherwise(same)
    return batches.join(own.where(~(path & F.coalesce(language, F.lit(False)))).select("batch").distinct(), "batch", "left_anti")
