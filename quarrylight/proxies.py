"""The engine's inputs (commits, files, symbols, runs, ...) read from the star-schema tables.

orders are commits, lineitem rows touch files, parts are files and packages, customers are authors, suppliers blamed
authors, nations modules, regions layers and bundles, events ingest runs, occurrences and issues.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Views of one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def parts(self, name: str, most_rows: int = 500_000) -> int:
        """Tasks for the rows of a table: as many as the session's shuffles have, more where one would get over most_rows."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.read(name).count() // most_rows))

    def commits(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("sha"), F.col("o_orderdate").cast("timestamp").alias("committed_at"), F.col("o_custkey").alias("author"), (F.col("o_orderstatus") == "P").alias("is_merge")
        )

    def touched(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path")).repartition(self.parts("lineitem"), "sha").distinct()

    def files(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("ccn"), F.col("p_name").alias("name"))

    def authors(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").alias("author"), F.col("c_name").alias("name"), (F.col("c_mktsegment") == "MACHINERY").alias("is_bot"), F.col("c_nationkey").alias("module"))

    def blame(self) -> DataFrame:
        rows = self.read("lineitem").select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("author"), "l_quantity").repartition(self.parts("lineitem"), "path")
        return rows.groupBy("path", "author").agg(F.sum("l_quantity").alias("lines"))

    def last_commit(self) -> datetime:
        return self.commits().agg(F.max("committed_at")).first()[0]

    def dependencies(self) -> DataFrame:
        version = F.concat_ws(".", F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_size") % 10).cast("string"), (F.col("p_partkey") % 3).cast("string"))
        return self.read("part").select(
            F.concat(F.lit("pkg:maven/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("@"), version).alias("purl"), F.lit("maven").alias("ecosystem"), version.alias("version"), F.col("p_type").alias("scope_id")
        )

    def uses(self, year: int | None = None) -> DataFrame:
        """consumer, producer, symbol, path: a part ordered by a customer's nation from a supplier's nation."""
        orders = self.read("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
        rows = self.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(orders if year is None else orders.where(F.col("year") == year), F.col("l_orderkey") == F.col("o_orderkey"))
        rows = rows.join(self.read("customer").select("c_custkey", F.col("c_nationkey").alias("consumer")), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(self.read("supplier").select("s_suppkey", F.col("s_nationkey").alias("producer")), F.col("l_suppkey") == F.col("s_suppkey"))
        return rows.select("consumer", "producer", F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("path"))

    def module_edges(self) -> DataFrame:
        """src, dst: the two nations that each nation's customers order most from, itself left out."""
        from quarrylight.operators.lookup import latest

        counts = self.uses().where("consumer <> producer").groupBy("consumer", "producer").agg(F.count("*").alias("n"))
        return latest(counts, ["consumer"], [F.desc("n"), F.asc("producer")], 2).select(F.col("consumer").alias("src"), F.col("producer").alias("dst"))

    def module_layers(self) -> DataFrame:
        return self.read("nation").select(F.col("n_nationkey").alias("module"), F.col("n_regionkey").cast("string").alias("layer"))

    def runs(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("run_id"), F.col("user_id").alias("project"), F.col("event_type").alias("extractor"), F.col("ts").cast("timestamp").alias("started_at"), (F.col("event_type") != "error").alias("success"), "value"
        )

    def shadow(self) -> DataFrame:
        """key, symbol, kind, importance, last_seen; signups play definitions."""
        events = self.read("events")
        most = events.agg(F.max("value")).first()[0]
        return events.select(
            F.col("event_id").alias("key"), F.col("user_id").alias("symbol"), F.when(F.col("event_type") == "signup", "def").otherwise("use").alias("kind"), (F.col("value") / F.lit(most)).alias("importance"), F.col("ts").cast("timestamp").alias("last_seen")
        )

    def feed_time(self) -> Column:
        """The server's time: that of the last event."""
        return F.lit(self.read("events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0])

    def issues(self) -> DataFrame:
        """An issue a user, as its last event leaves it."""
        status = F.coalesce(F.create_map(*map(F.lit, ("view", "todo", "click", "in_progress", "purchase", "in_review", "error", "blocked")))[F.col("last.event_type")], F.lit("done"))
        last = self.read("events").groupBy("user_id").agg(F.max("ts").alias("at"), F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("last"))
        event = F.col("last.event_id")
        return last.select(
            F.col("user_id").alias("issue_id"), (event % 40).alias("assignee"), F.when(event % 4 == 0, event).alias("run_id"), status.alias("status"), F.lit(None).cast("string").alias("origin"),
            F.when(F.col("user_id") % 3 == 0, F.col("user_id") + 1).alias("parent_id"), F.col("at").cast("timestamp").alias("updated_at"),
        )
