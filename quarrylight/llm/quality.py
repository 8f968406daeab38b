"""Quality by hierarchical empirical Bayes.

A logistic classifier on a document's shape gives its evidence. Over all documents, hosts and paths within hosts get a
posterior share of good documents: a path's counts are shrunk toward its host, a host's toward the whole corpus, the more
the fewer documents it has. The strength of shrinking is estimated from the spread between sites (method of moments).
A document's own evidence is left out of its site's counts, and its posterior odds are its own odds times its site's
odds over the corpus's.

host: what stands before the first "/" of `source`; path: its next segment, else the document's `lang` (sites keep
languages in sections).

Defined results: null text counts as empty and is rejected like an empty one by the classifier's evidence; a null source or
lang is a site of its own; repeated rows get equal values; with no labelled rows of both kinds, all evidence is 0.5 and
nothing is rejected; an empty table gives an empty result; further columns are ignored. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import Scratch, documents, slices, spare, text_or_empty
from quarrylight.llm.models import Logistic

LETTERS = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
UPPER = np.array([65 <= b <= 90 for b in range(256)])
DIGIT = np.array([48 <= b <= 57 for b in range(256)])
BLANK = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
SENTENCE = np.array([b in b".,;:'\"-()?" for b in range(256)])
SYMBOL = np.array([33 <= b < 127 for b in range(256)]) & ~LETTERS & ~DIGIT & ~SENTENCE
N_FEATURES = 13


def features(text: bytes) -> list[float]:
    """The shape of a whole text."""
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, words, lines = max(1, len(text)), text.split(), text.split(b"\n")
    m = max(1, len(words))
    return [
        np.log1p(len(text)),
        count[UPPER].sum() / n,
        count[DIGIT].sum() / n,
        np.sqrt(count[SYMBOL].sum() / n),
        count[SENTENCE].sum() / n,
        count[BLANK].sum() / n,
        count[128:].sum() / n,
        len(text) / m,
        len(set(words)) / m,
        np.sqrt(sum(map(eq, words, words[1:])) / m),
        len(set(lines)) / len(lines),
        len(lines) / m,
        float(not words),
    ]


def document_features(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, text_key, the carried columns and x: the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 8 << 20):
            x = pa.array([features(t.as_py()) for t in part.column("text")], pa.list_(pa.float64()))
            rest = part.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, x], [*rest.schema.names, "x"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("text_key"), *carried, text_or_empty().cast("binary").alias("text"))
    out = rows.drop("text").schema.add("x", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(run, out)


def site_columns() -> tuple[Column, Column]:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    path = F.regexp_extract(source, "^[^/]*/([^/]+)", 1)
    return F.regexp_extract(source, "^([^/]*)", 1).alias("host"), F.when(path != "", path).otherwise(F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("path")


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled doc_ids, chosen by a hash of the id."""
    return labels.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def strength(groups: DataFrame, mean: float, least: float = 1.0, most: float = 1e4) -> float:
    """Beta strength of a prior from the spread of group means: groups has n and s (count and sum of evidence)."""
    n, total, between, inner = groups.agg(
        F.count("*"), F.sum("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.lit(mean), 2)), F.sum(F.col("s") * (1 - F.col("s") / F.col("n")))
    ).first()
    if not n or n < 2 or not total:
        return most
    spread = between / total - (n / total) * (inner / total)  # less what chance alone spreads
    return float(min(most, max(least, mean * (1 - mean) / spread - 1))) if spread > 0 else most


def quality_posteriors(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> DataFrame:
    """doc_id, text_key, host, path, evidence, host_posterior, path_posterior, quality (probability of being good)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    rows = scratch.table(document_features(docs, *site_columns()), "features")
    sample = labelled_sample(labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")), most_labelled)
    one = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("x", "text_key").alias("x"))  # of several rows with an id one
    seen = one.orderBy("doc_id").select("x", "quality").toPandas()
    model = None
    if seen["quality"].nunique() > 1:
        model = Logistic().fit(np.stack(seen["x"]), seen["quality"].to_numpy(float))
        weights, mean, scale = (F.array(*map(F.lit, map(float, v))) for v in (model.weights[1:], model.mean, model.scale))
        terms = F.transform(F.arrays_zip(F.col("x"), weights.alias("w"), mean.alias("m"), scale.alias("s")), lambda z: (z["x"] - z["m"]) / z["s"] * z["w"])
        score = F.aggregate(terms, F.lit(float(model.weights[0])), lambda a, b: a + b)
        evidence = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))))
    else:
        evidence = F.lit(0.5)
    scored = rows.select("doc_id", "text_key", "host", "path", evidence.alias("evidence"))
    sums = scratch.table(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s")), "paths")
    hosts = sums.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n, s = sums.agg(F.sum("n"), F.sum("s")).first()
    base = min(1 - 1e-6, max(1e-6, s / n)) if n else 0.5
    by_host, by_path = strength(hosts, base), strength(sums, base)
    sites = sums.select("host", "path", F.col("n").alias("path_n"), F.col("s").alias("path_s")).join(hosts.withColumnsRenamed({"n": "host_n", "s": "host_s"}), "host")
    shrunk = lambda s, n, k, prior: (s + k * prior) / (n + k)
    own = F.col("evidence")
    host = shrunk(F.col("host_s") - own, F.col("host_n") - 1, F.lit(by_host), F.lit(base))
    odds = lambda p: F.log(p / (1 - p))
    safe = lambda p: F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    joined = scored.join(sites, ["host", "path"]).withColumn("host_posterior", safe(host))
    joined = joined.withColumn("path_posterior", safe(shrunk(F.col("path_s") - own, F.col("path_n") - 1, F.lit(by_path), F.col("host_posterior"))))
    logit = odds(safe(own)) + odds(F.col("path_posterior")) - F.lit(float(np.log(base / (1 - base))))
    return joined.select("doc_id", "text_key", "host", "path", "evidence", "host_posterior", "path_posterior", (1 / (1 + F.exp(-logit))).alias("quality"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.2) -> DataFrame:
    """The documents whose quality is at least `least`, with all columns; rows equal in doc_id and text go together."""
    key = spare(docs, "text_key")
    bad = quality_posteriors(docs, labels).where(F.col("quality") < least).select("doc_id", F.col("text_key").alias(key)).distinct()
    own = docs.withColumn(key, F.xxhash64(text_or_empty()))
    same = own["doc_id"].eqNullSafe(bad["doc_id"]) & (own[key] == bad[key])
    return own.join(bad, same, "left_anti").select(docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_posteriors(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.drop("text_key").withColumn("kept", F.col("quality") >= 0.2)
