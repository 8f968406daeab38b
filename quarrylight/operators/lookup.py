"""Filters by name, latest rows, top rows and search."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.session import cut

Filters = Mapping[str, Callable[[Any], Column]]


def equals(column: str) -> Callable[[Any], Column]:
    return lambda v: F.col(column) == F.lit(v)


def contains(column: str) -> Callable[[Any], Column]:
    return lambda v: F.contains(F.col(column), F.lit(v))


def starts_with(column: str) -> Callable[[Any], Column]:
    return lambda v: F.col(column).startswith(v)


def at_least(column: str, default: Any = None) -> Callable[[Any], Column]:
    return lambda v: (F.col(column) if default is None else F.coalesce(F.col(column), F.lit(default))) >= F.lit(v)


def since(column: str) -> Callable[[Any], Column]:
    return lambda v: F.col(column) >= F.lit(v)


def any_tag(column: str) -> Callable[[Any], Column]:
    return lambda v: F.arrays_overlap(F.col(column), F.array(*map(F.lit, v)))


def one_of(column: str) -> Callable[[Any], Column]:
    return lambda v: F.col(column).isin(*v)


def apply_filters(rows: DataFrame, known: Filters, asked: Mapping[str, Any]) -> tuple[DataFrame, list[str]]:
    """All asked filters that are known, joined by and; the names of the others. None asks nothing."""
    found = [known[k](v) for k, v in asked.items() if k in known and v is not None]
    return rows.where(reduce(lambda a, b: a & b, found, F.lit(True))), [f"unknown filter {k!r}" for k in asked if k not in known]


def page(rows: DataFrame, order: Sequence[Column], limit: int, most: int = 100) -> DataFrame:
    """The first rows in an order; the limit is held within 1 and `most`."""
    return rows.orderBy(*order).limit(max(1, min(most, limit)))


def truncated(rows: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """At most `limit` rows, and whether there are more."""
    return rows.limit(limit), bool(rows.offset(limit).take(1))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order that names ties."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def latest_value(rows: DataFrame, keys: Sequence[str], order: Column, *values: str) -> DataFrame:
    """The values of each key's last row; partial sums first, so a hot key needs no sort."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*")


def ranked(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """rows with their place from 1 in an order that names ties.

    A range-partitioned sort, kept in the shared folder, is numbered within its partitions; one number a partition goes
    through the driver, so that no task sees all rows.
    """
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    held = cut(own)
    part = F.shiftright("_m", 33)
    sizes = held.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).orderBy("_p").collect()
    before, starts = 0, []
    for r in sizes:
        starts.append((r["_p"], before))
        before += r["n"]
    offsets = held.sparkSession.createDataFrame(starts, "_p long, _before long")
    place = F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.join(F.broadcast(offsets), part == F.col("_p")).withColumn(name, place).drop("_m", "_p", "_before")


def kth(rows: DataFrame, order: Sequence[str], k: int) -> Row | None:
    """The k-th row (from 1) in an ascending order of columns that names ties; None if there are fewer.

    A range-partitioned copy is counted by partition and only the partition that holds the row is sorted.
    """
    held = cut(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    for r in held.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():  # a number a partition
        if k <= r["n"]:
            return held.where(F.col("_p") == r["_p"]).drop("_p").orderBy(*order).offset(k - 1).first()
        k -= r["n"]
    return None


def over_cap(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """The rows of each key beyond the first `cap` of an order that names ties; no task holds a hot key."""
    from quarrylight.operators.joins import placed

    return placed(rows, keys, order, "_n").where(F.col("_n") > cap).drop("_n")


def flagged(rows: DataFrame, order: Sequence[Column], limit: int, most: int = 1000) -> DataFrame:
    """The first rows of an order, each with `truncated`: whether there are more. Only limit + 1 rows are gathered."""
    limit = max(1, min(most, limit))
    top = rows.orderBy(*order).limit(limit + 1).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return top.withColumn("truncated", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")
