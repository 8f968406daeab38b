"""Binary profiles: a head, then records behind their lengths, which refer to tables of files, symbols and threads.

A record is read once in the task that has its file and becomes rows, those of equal samples one; what a sample refers to is joined by file, so the tables of
names need not fit anywhere as a whole.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import Steps
from quarrylight.sources.scip import fields

# The head of a profile, its version, the largest file, the share from which a function is hot.
MAGIC, VERSION, MOST_BYTES, HOT = b"SIMPLEPERF", 1, 64 << 20, 0.05
# Field numbers of a record's kinds.
SAMPLE, FILE, THREAD = 1, 3, 4

RECORDS = "path string, error string, kind string, id long, symbol_id long, thread_id long, address long, weight long, name string"


class Unreadable(ValueError):
    pass


def _signed(value: int) -> int:
    """A 64-bit number as it is meant, of which negative ones take ten bytes."""
    return value - (1 << 64) if value >> 63 else value


def _text(value: int | memoryview) -> str:
    return "" if isinstance(value, int) else bytes(value).decode("utf-8", "replace").strip()


def records(data: bytes) -> Iterator[memoryview]:
    """The records of a profile, up to one of no length or the end."""
    if len(data) < len(MAGIC) + 2:
        raise Unreadable("truncated")
    if data[: len(MAGIC)] != MAGIC:
        raise Unreadable("no_header")
    if struct.unpack_from("<H", data, len(MAGIC))[0] != VERSION:
        raise Unreadable("version")
    view, at = memoryview(data), len(MAGIC) + 2
    while at + 4 <= len(data):
        size = struct.unpack_from("<I", data, at)[0]
        if not size:
            return
        if at + 4 + size > len(data):
            raise Unreadable("truncated")
        yield view[at + 4 : at + 4 + size]
        at += 4 + size


@lru_cache(maxsize=1 << 14)  # samples of a hot function are often equal
def _sample(body: bytes) -> tuple:
    """The leaf of a sample's call chain, its thread and its weight, one at least."""
    thread = count = 0
    leaf = None
    for k, v in fields(memoryview(body)):
        if k == 2:
            thread = v
        elif k == 4:
            count = v
        elif k == 3 and leaf is None:
            leaf = dict(fields(v))
    leaf = leaf or {}
    return "sample", leaf.get(2, 0) if leaf else None, _signed(leaf.get(3, 0)), thread, leaf.get(1, 0), max(count, 1), None


def rows_of(data: bytes) -> Iterator[tuple]:
    """kind, id, symbol_id, thread_id, address, weight, name: samples, names of files, symbols and threads."""
    for record in records(data):
        for number, body in fields(record):
            if number == SAMPLE:
                yield _sample(bytes(body))
            elif number == THREAD:
                own = dict(fields(body))
                yield "thread", None, None, own.get(1, 0), None, None, _text(own.get(3, 0))
            elif number == FILE:
                key, path, symbols, mangled = 0, "", [], []
                for k, v in fields(body):
                    if k == 1:
                        key = v
                    elif k == 2:
                        path = _text(v)
                    elif k in (3, 4):
                        (symbols if k == 3 else mangled).append(_text(v))
                yield "file", key, None, None, None, None, path
                for n in range(max(len(symbols), len(mangled))):
                    name = next((s[n] for s in (symbols, mangled) if n < len(s) and s[n]), "")
                    if name:
                        yield "symbol", key, n, None, None, None, name


def _summed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """rows_of with one row for all samples of a leaf and thread; a profile is bounded, and so are they."""
    weights: Counter = Counter()
    for row in rows:
        if row[0] == "sample":
            weights[row[:5]] += row[5]
        else:
            yield row
    yield from ((*key, weight, None) for key, weight in weights.items())


def profile_records(files: DataFrame) -> DataFrame:
    """The records of profiles (path, length, content) as rows; of an unreadable profile one row with its error."""
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                if content is None:
                    yield pd.DataFrame([(path, "too_large", *[None] * 7)], columns=names)
                    continue
                try:
                    found = ((path, None, *r) for r in _summed(rows_of(content)))
                    while some := list(islice(found, 20_000)):
                        yield pd.DataFrame(some, columns=names).astype(dict.fromkeys(("id", "symbol_id", "thread_id", "address", "weight"), "Int64"))
                except (Unreadable, ValueError, IndexError) as problem:
                    yield pd.DataFrame([(path, str(problem) if isinstance(problem, Unreadable) else "malformed", *[None] * 7)], columns=names)

    small = F.when(F.col("length") <= MOST_BYTES, F.col("content"))
    return files.select("path", small.alias("content")).mapInPandas(run, RECORDS)


def profiles(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, errors): path, symbol, thread, cpu_samples, cpu_share, hot by leaf function and thread; and path, error.

    A leaf is named by its symbol, else by its file and address, else it is unknown. A profile without samples, or with a
    record that can't be read, has an error and no samples.
    """
    rows = Steps(files.sparkSession, "profiles").table(profile_records(files))  # read once, used several times
    errors = rows.where("error is not null").select("path", "error")
    samples = rows.where("kind = 'sample'").groupBy("path", "id", "symbol_id", "thread_id", "address").agg(F.sum("weight").alias("cpu_samples"))
    empty = files.select("path").join(samples.select("path").distinct(), "path", "left_anti").join(errors, "path", "left_anti").withColumn("error", F.lit("no_samples"))
    samples = samples.join(errors.select("path"), "path", "left_anti")
    one = lambda kind, *keys: rows.where(F.col("kind") == kind).groupBy("path", *keys).agg(F.max("name").alias(f"_{kind}"))
    named = samples.join(one("symbol", "id", "symbol_id"), ["path", "id", "symbol_id"], "left").join(one("file", "id"), ["path", "id"], "left").join(one("thread", "thread_id"), ["path", "thread_id"], "left")
    place = F.when(F.col("_file") != "", F.concat("_file", F.lit("!0x"), F.lower(F.hex("address"))))
    symbol = F.coalesce("_symbol", place, F.lit("unknown"))
    found = named.groupBy("path", symbol.alias("symbol"), F.nullif("_thread", F.lit("")).alias("thread")).agg(F.sum("cpu_samples").alias("cpu_samples"))
    totals = found.groupBy("path").agg(F.sum("cpu_samples").alias("_total"))
    shared = found.join(totals, "path").withColumn("cpu_share", F.col("cpu_samples") / F.col("_total"))
    return shared.select("path", "symbol", "thread", "cpu_samples", "cpu_share", (F.col("cpu_share") >= HOT).alias("hot")), errors.unionByName(empty)
