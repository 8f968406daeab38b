"""Exact dedup over a persistent digest index.

The index is a table bucketed and sorted by digest. One that stays has a name and lies in the warehouse, one of a single run lies
with the run's other tables in the shared folder and needs no warehouse. A batch of new rows is reduced to one row a digest,
anti-joined with the index by a sort-merge join (the index side needs no shuffle) and what is new is appended
to the same buckets. Only DataFrame operations are used.

Defined results: a null text counts as empty, so null and empty texts are equal; a null doc_id never beats
another; rows that share doc_id and text are one document given twice and get the same values; an empty table
gives an empty result; further columns are ignored. Texts are hashed whole, however long; ties of doc_id are one document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, delete_path, documents, shared_warehouse, spare, text_or_empty


class DigestIndex:
    """A bucketed, sorted table (digest, keep_id) in the warehouse; first come, first kept.

    buckets: of a new index; by default as many as the session's shuffles have partitions, so that a task writes one file.
    path: of a new index that lies in this folder instead, which driver and executors share.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, path: str | None = None):
        if path is None:
            shared_warehouse(spark)
        self.spark, self.table, self.place = spark, table, {} if path is None else {"path": path}
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if spark.catalog.tableExists(table):
            self.buckets = int(spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Num Buckets'").first()["data_type"])

    def _append(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest")
            .options(**self.place).saveAsTable(self.table)
        )

    def add(self, batch: DataFrame) -> None:
        """batch: doc_id, digest. Of equal digests in a batch the largest doc_id enters; known digests don't."""
        firsts = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        if self.spark.catalog.tableExists(self.table):
            firsts = firsts.join(self.rows().hint("merge"), "digest", "left_anti")
        self._append(firsts)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        for path in self.place.values():  # Spark leaves the files of a table with a path
            delete_path(self.spark, path)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and SHA-256 of the whole text in UTF-8, as 32 bytes."""
    return docs.select("doc_id", F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"))


def deal(rows: DataFrame, batches: int) -> list[DataFrame]:
    """rows in parts of about equal size, those with the largest doc_id first and null ones last; any two longs may occur."""
    cuts = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    place = F.lit(0)
    for cut in sorted(set(cuts or [])):
        place = place + F.when(F.col("doc_id") >= cut, 0).otherwise(1)
    return [rows.where(place == k) for k in range(len(set(cuts or [])) + 1)]


def exact_dedup(docs: DataFrame, buckets: int | None = None, batches: int = 2, index: str | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256. The largest doc_id of equal texts stays.

    The documents enter the index in `batches` parts, those with the largest doc_id first, so that the index's
    rule (first come, first kept) keeps the largest doc_id over all parts.

    index: name of an index table that stays: what it holds from earlier runs is kept before any new document, and what is
    new is appended; it needs a shared warehouse. Without a name the index lies in the shared folder and goes when the result is known.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    rows = scratch.table(digests(docs), "digests")
    held = DigestIndex(spark, index or f"digest_index_{uuid.uuid4().hex}", buckets, None if index else scratch.path("index"))
    for part in deal(rows, batches):
        held.add(part)
    groups = rows.groupBy("digest").agg(F.count("*").alias("group_size")).join(held.rows().hint("merge"), "digest")
    groups = scratch.table(groups, "groups")  # written, so that the join below may split a digest with very many rows
    if index is None:
        held.drop()
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that exact_dedup keeps, each once, with all their columns. Texts move through one exchange."""
    digest = spare(docs, "digest")
    scratch = Scratch(docs.sparkSession, "drop-copies")
    found = exact_dedup(docs).groupBy("doc_id", F.col("text_sha256").alias(digest)).agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
    found = scratch.table(found, "kept")
    kept = found.where("kept")
    own = docs.withColumn(digest, F.sha2(text_or_empty(), 256))
    same = own["doc_id"].eqNullSafe(kept["doc_id"]) & (own[digest] == kept[digest])
    out = own.join(kept, same, "left_semi")
    if kept.where("times > 1").take(1):  # rows equal in doc_id and text
        out = out.dropDuplicates([digest])
    return out.select(docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = {
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents"""
}
