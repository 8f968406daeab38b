"""Windows over event streams: late rows are dropped behind a watermark, closed windows are emitted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its files."""
    shape = spark.read.parquet(f"{folder}/{name}.parquet").schema
    single = spark.readStream.schema(shape).option("recursiveFileLookup", "true")
    return single.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def tumbling_counts(events: DataFrame, at: str, keys: list[str], width: str = "1 hour", late: str = "180 minutes") -> DataFrame:
    """start, keys, n of each closed window."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, width).alias("_w"), *keys).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, keys: list[str], gap: str = "30 minutes", late: str = "180 minutes") -> DataFrame:
    """start, end, keys, n of each closed session."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.session_window(at, gap).alias("_w"), *keys).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "n")


def run_to_table(stream: DataFrame, path: str, timeout_seconds: int = 600) -> DataFrame:
    """Run a stream over all that is there now and read what it emitted."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    if not query.awaitTermination(timeout_seconds):
        query.stop()
        raise TimeoutError("the stream did not end")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def ingest_progress(members: DataFrame, results: DataFrame) -> DataFrame:
    """bundle, members, done, failed, state of an ingest: running, succeeded or failed; one member's failure stops no other.

    members(bundle, member); results(bundle, member, ok): what has come in so far.
    """
    rows = members.select("bundle", "member").distinct().join(results.groupBy("bundle", "member").agg(F.max("ok").alias("ok")), ["bundle", "member"], "left")
    n, done, failed = F.count("*"), F.count("ok"), F.count_if(~F.col("ok"))
    state = F.when(done < n, "running").when(failed > 0, "failed").otherwise("succeeded")
    return rows.groupBy("bundle").agg(n.alias("members"), done.alias("done"), failed.alias("failed"), state.alias("state"))
