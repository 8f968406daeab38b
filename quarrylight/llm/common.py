"""Shared folder, written tables and small helpers for the operators of this package."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which the shuffle files of a query go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only on a local master whose session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarrylight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: The folders that the run at hand has begun, where one says when they go; runs of other threads have their own.
_begun: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("begun", default=None)
_rest: list[tuple[SparkSession, str]] = []
_lock, _using = threading.Lock(), Counter()


class Scratch:
    """Written tables of one run, each cutting the lineage; they survive the loss of executors.

    A result may read them until it has been used, so they go when a `Scratch.until_used` that they were begun in ends, or else
    when the program does.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        own = _begun.get()
        (_rest if own is None else own).append((spark, self.root))

    @staticmethod
    @contextlib.contextmanager
    def until_used() -> Iterator[None]:
        """What is begun within goes at the end: a result that reads it has been used by then."""
        own: list[tuple[SparkSession, str]] = []
        token = _begun.set(own)
        try:
            yield
        finally:
            _begun.reset(token)
            for spark, root in own:
                delete_path(spark, root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back; Spark removes the shuffle files of that job when it ends."""
        with shuffles_go(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete_path(self.spark, self.path(name))


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go with their job. The setting is the session's: the last of several threads puts it back."""
    key = id(spark)
    with _lock:
        if not _using[key]:
            before = spark.conf.get(SHUFFLES_GO, None)
            _held[key] = before
            spark.conf.set(SHUFFLES_GO, "true")
        _using[key] += 1
    try:
        yield
    finally:
        with _lock:
            _using[key] -= 1
            if not _using[key]:
                before = _held.pop(key)
                spark.conf.set(SHUFFLES_GO, before) if before else spark.conf.unset(SHUFFLES_GO)


_held: dict[int, str | None] = {}


def shared_warehouse(spark: SparkSession) -> str:
    """The warehouse, which has to be named on a cluster: unnamed, it is a folder of the driver's machine."""
    folder = spark.conf.get("spark.sql.warehouse.dir")
    own = f"{os.getcwd()}/spark-warehouse"
    if spark.sparkContext.master.split("[")[0] != "local" and folder.removeprefix("file:").rstrip("/") == own:
        raise ValueError("spark.sql.warehouse.dir has to name a folder that driver and executors share")
    return folder


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so that any store works."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_all() -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        for spark, root in _rest:
            delete_path(spark, root)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices whose texts take about most_bytes (a longer text stands alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)
