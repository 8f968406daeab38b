"""Session helper used by the bench, the tests and the examples."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quarrylight", **settings: str) -> SparkSession:
    """A UTC session on this machine; on a cluster, pass your own session to the operators instead.

    settings: further ones, with __ for the dots of their names.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(map={k.replace("__", "."): v for k, v in settings.items()})
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share; a local one only on a local master whose session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarrylight-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df read back from a checkpoint in the shared folder: its lineage ends here.

    Spark deletes a checkpoint once nothing refers to it where spark.cleaner.referenceTracking.cleanCheckpoints is set, as it
    is here and should be on a cluster; without it checkpoints stay.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


class Steps:
    """Tables that a loop writes one after another, compressed, in the shared folder: each cuts the lineage.

    A table that is read no more is dropped by the loop, the others go when the program ends. Unlike checkpoints they don't wait
    for a collector of garbage.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.next = spark, shared_folder(spark, name), 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        _begun.append((spark, self.root))

    def table(self, df: DataFrame, *gone: DataFrame) -> DataFrame:
        """df written and read back; those of `gone` that were written here are dropped then."""
        self.next += 1
        path = f"{self.root}/{self.next}"
        df.write.parquet(path)
        held = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(held)] = held, path
        for old in gone:
            if id(old) in self.paths:
                _delete(self.spark, self.paths.pop(id(old))[1])
        return held


_begun: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_all() -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        for spark, root in _begun:
            _delete(spark, root)
