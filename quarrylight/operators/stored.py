"""Tables that are written in place: scopes replaced as a whole, and postings served from buckets.

A change is staged where no reader looks and becomes visible by one rename of a small table that says which batch holds each
scope. So a reader sees all of a change or nothing of it, whatever happens to the writer, and a second writer that began at
the same version finds the name taken and begins anew at the newer one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, none if there is no such folder."""
    at = _path(spark, folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at = _path(spark, path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Give a folder its name; False if the name is taken."""
    a, b = _path(spark, old), _path(spark, new)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), spark._jsc.hadoopConfiguration()) if a.toUri().getScheme() else spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(a, b, none)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception):
            return False
        raise
    return True


class ScopedTable:
    """Rows by scope in a folder: data/batch=..., and versions/v-... with the batch that holds each scope."""

    def __init__(self, spark: SparkSession, folder: str, scope: Sequence[str]):
        self.spark, self.folder, self.scope = spark, folder.rstrip("/"), list(scope)

    def versions(self) -> list[str]:
        return [n for n in names_in(self.spark, f"{self.folder}/versions") if re.fullmatch(r"v-\d{12}", n)]

    def _held(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/versions/{version}")

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        found = F.lit(True)
        for c in self.scope:
            found &= a[c].eqNullSafe(b[c])
        return found

    def read(self, version: str | None = None) -> DataFrame:
        """The rows of the newest version, or of one that hasn't been vacuumed."""
        version = version or self.versions()[-1]
        held = self._held(version).withColumnRenamed("batch", "_batch")
        rows = self.spark.read.option("basePath", f"{self.folder}/data").option("mergeSchema", "true").parquet(f"{self.folder}/data")
        return rows.join(held, self._same(rows, held) & (rows["batch"] == held["_batch"]), "left_semi").drop("batch")

    def replace(self, rows: DataFrame, scopes: DataFrame | None = None, tries: int = 10) -> str:
        """All rows of the scopes named (by default those of the rows) go, the rows come, at once; the new version's name.

        A scope that is named and has no rows is gone afterwards; rows of scopes that aren't named are an error.
        """
        batch = f"b{uuid.uuid4().hex}"  # never read as a number
        rows.write.parquet(f"{self.folder}/data/batch={batch}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/data/batch={batch}").select(*self.scope).distinct()
        named = written if scopes is None else scopes.select(*self.scope).distinct()
        if scopes is not None and written.join(named, self._same(written, named), "left_anti").take(1):
            raise ValueError("rows lie outside the scopes that are replaced")
        for _ in range(tries):
            before = self.versions()
            held = written.withColumn("batch", F.lit(batch))
            if before:
                old = self._held(before[-1])
                held = old.join(named, self._same(old, named), "left_anti").unionByName(held)
            staged = f"{self.folder}/versions/_staged-{uuid.uuid4().hex}"
            held.write.parquet(staged)
            version = f"v-{int(before[-1][2:]) + 1 if before else 1:012d}"
            if self._commit(staged, version):
                return version
            delete(self.spark, staged)
        raise RuntimeError(f"{tries} other writers were faster")

    def _commit(self, staged: str, version: str) -> bool:
        return renamed(self.spark, staged, f"{self.folder}/versions/{version}")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the last `keep` versions, and batches that none of those holds; no writer may be at work.

        The batches that went. Their number is that of changes, not of rows.
        """
        kept = self.versions()[-keep:]
        for name in names_in(self.spark, f"{self.folder}/versions"):
            if name not in kept:
                delete(self.spark, f"{self.folder}/versions/{name}")
        used = set()
        for version in kept:
            used |= {r["batch"] for r in self._held(version).select("batch").distinct().toLocalIterator()}
        gone = [n for n in names_in(self.spark, f"{self.folder}/data") if n.startswith("batch=") and n[6:] not in used]
        for name in gone:
            delete(self.spark, f"{self.folder}/data/{name}")
        return gone


class PostingIndex:
    """Postings (a term, a document key, further columns) in a table bucketed and sorted by term.

    A posting replaces that of its key, a deletion leaves a mark; both are appended, and a read takes the last of each key.
    A key's postings have one term, as a key names what is found where, so they lie in one bucket.
    """

    def __init__(self, spark: SparkSession, table: str, term: str, key: str, buckets: int = 64):
        self.spark, self.table, self.term, self.key, self.buckets = spark, table, term, key, buckets

    def _append(self, rows: DataFrame, gone: bool) -> None:
        turn = 1
        if self.spark.catalog.tableExists(self.table):
            turn += self.spark.table(self.table).agg(F.max("_turn")).first()[0] or 0
            columns = self.spark.table(self.table).columns
            shape = self.spark.table(self.table).schema
            rows = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(shape[c].dataType).alias(c) for c in columns if c not in ("_turn", "_gone")))
        marked = rows.dropDuplicates([self.term, self.key]).withColumns({"_turn": F.lit(turn), "_gone": F.lit(gone)})
        dealt = marked.repartition(self.buckets, self.term)
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, self.term).sortBy(self.term, self.key).saveAsTable(self.table)

    def add(self, rows: DataFrame) -> None:
        """Postings come in the place of those of their keys; of several of one key any."""
        self._append(rows, False)

    def remove(self, keys: DataFrame) -> None:
        """The postings of (term, key) go."""
        self._append(keys.select(self.term, self.key), True)

    def _current(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (self.term, self.key, "_turn")]
        last = rows.groupBy(self.term, self.key).agg(F.max_by(F.struct(*rest), "_turn").alias("_v"))
        return last.select(self.term, self.key, "_v.*").where(~F.col("_gone")).drop("_gone")

    def postings(self) -> DataFrame:
        """All postings; grouped by term and key within their buckets."""
        return self._current(self.spark.table(self.table))

    def lookup(self, *values, **equal) -> DataFrame:
        """The postings of one term or a few, read from their buckets; equal: values of further columns (a list: any of them)."""
        found = self._current(self.spark.table(self.table).where(F.col(self.term).isin(*values)))
        for column, wanted in equal.items():
            found = found.where(F.col(column).isin(*wanted) if isinstance(wanted, (list, tuple, set)) else F.col(column) == F.lit(wanted))
        return found

    def lookup_all(self, terms: DataFrame) -> DataFrame:
        """The postings of many terms; their table is dealt to the index's buckets, the index stays where it is."""
        return self._current(self.spark.table(self.table).join(terms.select(self.term).distinct().hint("shuffle_hash"), self.term, "left_semi"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
