"""Toxicity by a classifier chain.

Categories are predicted in order; each linear model sees the text's features and the probabilities of the categories
before it. In training those are out-of-fold predictions, so that a later model meets the errors it will meet in use.
Features are words and beginnings of words, chosen per category by their association with it in the labelled sample,
and the shape of the text.

The sample is bounded (`most_labelled` documents, chosen by a hash of doc_id; of several rows with an id the one whose text
has the least hash); counting words over it is a Spark job, and the
driver gets only the chosen vocabulary and the sample's rows in it. Every document's whole text is scored.

Defined results: null text counts as empty; a null doc_id is carried through; null labels are no labels; repeated rows get
equal values; a category with only one label in the sample has that label's share as its probability; without labels all
probabilities are 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, documents, slices, text_or_empty
from quarrylight.llm.models import Logistic, out_of_fold
from quarrylight.llm.quality import N_FEATURES, features, labelled_sample

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)


def word_features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


class Hits(dict):
    """Codes of the vocabulary's features of each word; forgets all when it holds many words."""

    def __init__(self, vocabulary: list[str], most: int = 400_000):
        super().__init__()
        self.code, self.most = {f: k for k, f in enumerate(vocabulary)}, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > self.most:
            self.clear()
        found = self[word] = tuple(self.code[f] for f in word_features(word) if f in self.code)
        return found

    def row(self, text: bytes) -> np.ndarray:
        """1 for each feature of the vocabulary in the text, then the text's shape."""
        out = np.zeros(len(self.code) + N_FEATURES)
        words = set(WORD.findall(text.decode(errors="replace").lower()))
        out[[k for found in map(self.__getitem__, words) if found for k in found]] = 1
        out[len(self.code) :] = features(text)
        return out


class Chain:
    """Logistic models in order; labels is rows x categories."""

    def fit(self, x: np.ndarray, labels: np.ndarray) -> Chain:
        self.models: list[Logistic | float] = []
        earlier = np.zeros((len(x), 0))
        for y in labels.T.astype(float):
            seen = np.hstack([x, earlier])
            if len(set(y)) < 2:
                self.models.append(float(y.mean()) if len(y) else 0.0)
                found = np.full(len(x), self.models[-1])
            else:
                self.models.append(Logistic(penalty=3.0).fit(seen, y))
                found = out_of_fold(lambda: Logistic(penalty=3.0), seen, y)
            earlier = np.hstack([earlier, found[:, None]])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for model in self.models:
            found = np.full(len(x), model) if isinstance(model, float) else model.predict(np.hstack([x, out]))
            out = np.hstack([out, found[:, None]])
        return out


def _vocabulary(rows: DataFrame, category: str, most: int, least_rows: int) -> list[str]:
    """The features most associated with a category: signed root of the likelihood ratio, over the labelled rows."""
    total, ones = rows.agg(F.count("*"), F.sum(category)).first()
    if not total or not ones or ones == total:
        return []
    found = rows.select(F.explode("words").alias("feature"), category).groupBy("feature").agg(F.count("*").alias("n"), F.sum(category).alias("k")).where(F.col("n") >= least_rows)
    share = float(ones) / total
    part = lambda k, m: F.when(k > 0, k * F.log(k / m)).otherwise(F.lit(0.0))
    score = part(F.col("k"), F.col("n") * share) + part(F.col("n") - F.col("k"), F.col("n") * (1 - share))
    return [r["feature"] for r in found.withColumn("score", score).where("score > 4").orderBy(F.desc("score"), "feature").limit(most).select("feature").collect()]


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most_labelled: int = 8_000, vocabulary: int = 150, least_rows: int = 3) -> DataFrame:
    """One row a document: doc_id and p_<category> for each category.

    categories: name to a 0/1 column over labels, in the order of the chain.
    """
    spark, names = docs.sparkSession, list(categories)
    scratch = Scratch(spark, "toxicity")
    known = labels.select("doc_id", *(c.cast("int").alias(k) for k, c in categories.items())).dropna().groupBy("doc_id").agg(*(F.max(k).alias(k) for k in names))
    sample = labelled_sample(known, most_labelled)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            found = [sorted({f for w in WORD.findall(t.as_py().decode(errors="replace").lower()) for f in word_features(w)}) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.string()))], [*part.schema.names, "words"])

    seen = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", *names).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", *names)
    seen = scratch.table(seen.mapInArrow(words, f"doc_id long, text binary, {', '.join(f'{k} int' for k in names)}, words array<string>"), "sample")
    chosen = list(dict.fromkeys(f for k in names for f in _vocabulary(seen, k, vocabulary, least_rows)))

    def sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(chosen)
        for part in slices(batches, "text", 4 << 20):
            x = pa.array([hits.row(t.as_py()).astype(np.float32).tobytes() for t in part.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(k) for k in names), x], ["doc_id", *names, "x"])

    got = seen.select("doc_id", "text", *names).mapInArrow(sample_rows, f"doc_id long, {', '.join(f'{k} int' for k in names)}, x binary").orderBy("doc_id").toPandas()  # as many rows as the sample has documents
    width = len(chosen) + N_FEATURES
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]) if len(got) else np.zeros((0, width), np.float32)
    chain = Chain().fit(x, got[names].to_numpy().reshape(-1, len(names)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(chosen)
        for part in slices(batches, "text", 2 << 20):
            p = chain.predict(np.stack([hits.row(t.as_py()) for t in part.column("text")]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(names)))], ["doc_id", *(f"p_{k}" for k in names)])

    return rows.mapInArrow(score, f"doc_id long, {', '.join(f'p_{k} double' for k in names)}")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain: unsound (low quality), toxic, toxic_unsound; a document is toxic from probability 0.5."""
    unsound, toxic = F.col("quality") == 0, F.col("toxic") == 1
    found = toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), {"unsound": unsound, "toxic": toxic, "toxic_unsound": unsound & toxic})
    return found.withColumn("toxic", F.col("p_toxic") >= 0.5)
