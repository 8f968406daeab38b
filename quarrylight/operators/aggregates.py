"""Aggregations that keep zero rows, modes, shares and bounded counters."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import reduce, total_ordering
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.operators.lookup import ranked
from quarrylight.session import cut


def counts_with_zero(dimension: DataFrame, facts: DataFrame, keys: Sequence[str], name: str = "n", condition: Column | None = None) -> DataFrame:
    """Every key of the dimension with how many facts (that meet the condition) it has."""
    found = (facts if condition is None else facts.where(condition)).groupBy(*keys).agg(F.count("*").alias(name))
    return dimension.join(found, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def label_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """label, n of each table, empty ones too."""
    out = None
    for label, rows in tables.items():
        own = rows.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def share_of(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with value / its sum over the key, 0 where that is 0. Sums are partial first; a null key is a key.

    The sums have one row a key, so that the join may broadcast them where they are small and split a hot key elsewhere.
    """
    totals = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.sum(value).alias("_total"))
    same = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(totals[f"_k{i}"]) for i, k in enumerate(keys)))
    share = F.when(F.col("_total") > 0, F.col(value) / F.col("_total")).otherwise(F.lit(0.0))
    return rows.join(totals, same).withColumn(name, share).select(*rows.columns, name)


def mode(rows: DataFrame, keys: Sequence[str], choice: str) -> DataFrame:
    """keys, choice (the most frequent; of equal ones the greatest), votes, total and outliers."""
    votes = rows.groupBy(*keys, choice).agg(F.count("*").alias("_n"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("_n", choice)).alias("_b"), F.sum("_n").alias("total"))
    return best.select(*keys, F.col(f"_b.{choice}").alias(choice), F.col("_b._n").alias("votes"), "total", (F.col("total") - F.col("_b._n")).alias("outliers"))


def heavy_hitters(rows: DataFrame, key: str, most: int, slack: float = 0.1) -> DataFrame:
    """key, n: exact counts; if there are more than most (1 + slack) keys, exactly most / 10 fewer remain, the least going.

    Ties at the cut go by key. The counts are ranked over a range-partitioned sort, never in one task.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    keys = counts.count()
    drop = most // 10 if keys > most * (1 + slack) else 0
    return ranked(counts, [F.desc("n"), F.asc(key)], "_r").where(F.col("_r") <= keys - drop).drop("_r") if drop else counts


def bounded_counts(rows: DataFrame, key: str, most: int) -> DataFrame:
    """key, n, at_most and floor of at most `most` keys: counts that need bounded memory, however many keys there are.

    A task counts up to most + most // 10 keys; one more, and the most // 10 keys of the least counts go (of equal counts the
    later keys). What a key may have lost in a task is never more than the sum of the largest counts that went there. The
    tasks' counts are added, and the `most` largest stay. True counts of kept keys lie within n and at_most; keys that
    aren't kept have no more than floor. Rows aren't shuffled, only what the tasks have held. A null key isn't counted.
    """
    limit, drop = most + most // 10, max(1, most // 10)
    shape = f"key {rows.schema[key].dataType.simpleString()}, n long, lost long, held long"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[Any, int] = {}
        lost = held = 0
        for part in parts:
            for k in part["key"]:
                counts[k] = counts.get(k, 0) + 1
                if len(counts) > limit:
                    held = max(held, len(counts))
                    least = heapq.nsmallest(drop, ((n, Reversed(k)) for k, n in counts.items()))
                    lost += least[-1][0]
                    for _, k in least:
                        del counts[k.key]
        held = max(held, len(counts))
        yield pd.DataFrame({"key": list(counts), "n": list(counts.values()), "lost": None, "held": None}, columns=["key", "n", "lost", "held"])
        yield pd.DataFrame({"key": [None], "n": [None], "lost": [lost], "held": [held]})

    tasks = cut(rows.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).mapInPandas(run, shape))
    lost = tasks.agg(F.coalesce(F.sum("lost"), F.lit(0)).alias("lost"), F.max("held").alias("held"))
    added = tasks.where("lost is null").groupBy("key").agg(F.sum("n").alias("n"))
    kept = added.orderBy(F.desc("n"), "key").limit(most + 1).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("n"), "key")))
    beyond = kept.agg(F.coalesce(F.max(F.when(F.col("_r") > most, F.col("n"))), F.lit(0)).alias("beyond"))
    bound = lost.crossJoin(beyond)  # two single rows
    found = kept.where(F.col("_r") <= most).drop("_r").crossJoin(F.broadcast(bound))
    return found.select(F.col("key").alias(key), "n", (F.col("n") + F.col("lost")).alias("at_most"), (F.col("lost") + F.col("beyond")).alias("floor"), F.col("held").alias("most_held"))


@total_ordering
class Reversed:
    """A key whose order is the reverse of its own."""

    def __init__(self, key: Any):
        self.key = key

    def __lt__(self, other: Reversed) -> bool:
        return other.key < self.key

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Reversed) and other.key == self.key

    __hash__ = None


def top_share(rows: DataFrame, order: Sequence[Column], share: float = 0.05) -> DataFrame:
    """The top share of rows (at least one), with rank from 0 and confidence 1 - rank / cutoff."""
    cutoff = max(1, int(rows.count() * share))
    top = ranked(rows, order, "rank").where(F.col("rank") <= cutoff).withColumn("rank", F.col("rank") - 1)
    return top.withColumn("confidence", 1 - F.col("rank") / F.lit(cutoff))


def status_counts(rows: DataFrame, known: Sequence[str], column: str = "status") -> DataFrame:
    """How often each known status occurs, in one row."""
    return rows.agg(*(F.count_if(F.col(column) == s).alias(s) for s in known), F.count("*").alias("total"))


def trailing_counts(rows: DataFrame, keys: Sequence[str], at: str, seconds: int, name: str = "n") -> DataFrame:
    """rows with the number of the key's rows in the last seconds up to each, itself included.

    Time is dealt to buckets of that many seconds. A row's count is that of its own bucket up to it and that of the bucket
    before from its beginning on, so a window holds what a key does in one bucket, never all of a hot key.
    """
    sec = F.unix_seconds(F.col(at).cast("timestamp"))
    counted = rows.groupBy(*keys, sec.alias("_s")).agg(F.count("*").alias("_c")).withColumns({"_b": F.floor(F.col("_s") / seconds), "_at": F.col("_s")})
    asked = counted.withColumns({"_b": F.col("_b") - 1, "_at": F.col("_s") - seconds})
    bucket = Window.partitionBy(*keys, "_b")
    own = counted.withColumn("_n", F.sum("_c").over(bucket.orderBy("_at")))
    both = counted.withColumn("_q", F.lit(0)).unionByName(asked.withColumns({"_c": F.lit(0).cast("long"), "_q": F.lit(1)}))
    before = both.withColumn("_n", F.sum("_c").over(bucket.orderBy(F.desc("_at")))).where("_q = 1 and _s is not null")
    found = own.select(*keys, "_s", "_n").unionByName(before.select(*keys, "_s", "_n")).groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_s").alias("_t")).agg(F.sum("_n").alias(name))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), sec.eqNullSafe(F.col("_t")))
    return rows.join(found, same).select(*rows.columns, name)


def keep_worst(rows: DataFrame, keys: Sequence[str], rank: Column) -> DataFrame:
    """One row a key: the one of the least rank, of several the least by its columns."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(rank.alias("_r"), *rest)).alias("_v")).select(*keys, *(F.col(f"_v.{c}").alias(c) for c in rest))


def hash_statistics(ids: DataFrame, column: str) -> DataFrame:
    """total, distinct, collisions, negative and share_negative of 64-bit ids."""
    found = ids.agg(F.count("*").alias("total"), F.count_distinct(column).alias("distinct_ids"), F.count_if(F.col(column) < 0).alias("negative"))
    return found.withColumns({"collisions": F.col("total") - F.col("distinct_ids"), "share_negative": F.when(F.col("total") > 0, F.col("negative") / F.col("total"))})


def sites_per_group(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], most: int = 20) -> DataFrame:
    """keys, n and sites: the first `most` distinct sites of each group in order. Ranked before they are gathered."""
    distinct = rows.select(*keys, *fields).distinct()
    first = distinct.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*fields))).where(F.col("_n") <= most)
    sites = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("sites"))
    return sites.join(distinct.groupBy(*keys).agg(F.count("*").alias("n")), list(keys))
