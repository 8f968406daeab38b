"""SimHash near-dedup by anchor-point covering.

Anchors are the words of a covering code of 64 bits: two perfect Golay codes of 23 bits (radius 3), a perfect Hamming
code of 15 bits (radius 1) and a repetition code of 3 bits (radius 1), so that each point of the space lies within 8
bits of its anchor. A fingerprint goes to the anchor of every point within half the threshold of it, all of which lie
within the covering radius plus the threshold. Of two fingerprints within the threshold, a point midway lies within
half the threshold of both, so both reach that point's anchor. Fingerprints are compared per anchor only, and an
anchor's links are thinned to a spanning forest there. Equal fingerprints are one fingerprint throughout, so copies
are never compared, and a hot anchor is dealt to points (see `links`).

Defined results: a null or empty text, or one of white space, has fingerprint zero, linked like any other; a null
doc_id is carried through and never is a component's id unless all ids of the component are null; repeated rows get
equal values; an empty table gives an empty result; further columns are ignored. Texts are read whole, however long; a bit that
is set in exactly half the shingles is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, documents, slices, spare, text_or_empty
from quarrylight.llm.components import connected_components

#: Fixed value: the generator polynomial of the binary Golay code.
GOLAY = 0b110001110101


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """64 bits, each the majority over the XXH64 of the shingles of lower-cased words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        n = len(words) - shingle + 1
        shingles = map(b" ".join, zip(*(words[k : n + k] for k in range(shingle)), strict=True))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, seed) for x in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, block):
        part = hashes[a : a + block].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 8 << 20):
            found = np.array([fingerprint(x, shingle) for x in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(found.view(np.int64))], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


class CoveringCode:
    """The nearest anchor of any point, and the anchors that a fingerprint is replicated to."""

    def __init__(self) -> None:
        self.golay_rest = self._rests(23, GOLAY, 11)
        self.golay_error = np.zeros(1 << 11, np.uint64)
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                error = sum(1 << b for b in bits)
                self.golay_error[self._rest(self.golay_rest, np.array([error], np.uint64))[0]] = error

    @staticmethod
    def _rests(bits: int, generator: int, degree: int) -> np.ndarray:
        """The rest of each single bit after division by the generator."""
        rests = []
        for b in range(bits):
            x = 1 << b
            for k in range(b, degree - 1, -1):
                if x >> k & 1:
                    x ^= generator << (k - degree)
            rests.append(x)
        return np.array(rests, np.uint64)

    @staticmethod
    def _rest(rests: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for b, r in enumerate(rests):
            out ^= (x >> np.uint64(b) & np.uint64(1)) * r
        return out

    def anchor(self, x: np.ndarray) -> np.ndarray:
        """The nearest anchor of each point."""
        low, mid = x & np.uint64(0x7FFFFF), x >> np.uint64(23) & np.uint64(0x7FFFFF)
        hamming, three = x >> np.uint64(46) & np.uint64(0x7FFF), x >> np.uint64(61)
        low = low ^ self.golay_error[self._rest(self.golay_rest, low)]
        mid = mid ^ self.golay_error[self._rest(self.golay_rest, mid)]
        wrong = self._rest(np.arange(1, 16, dtype=np.uint64), hamming)  # the place of the wrong bit, from 1
        hamming = hamming ^ np.where(wrong > 0, np.uint64(1) << (np.maximum(wrong, np.uint64(1)) - np.uint64(1)), np.uint64(0))
        three = np.where(np.bitwise_count(three) >= 2, np.uint64(7), np.uint64(0))
        return low | mid << np.uint64(23) | hamming << np.uint64(46) | three << np.uint64(61)

    def reached(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into x, anchor): the anchors of all points within radius, each once a fingerprint."""
        flips = [0, *(sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(64), r))]
        found = np.sort(self.anchor((x[:, None] ^ np.array(flips, np.uint64)[None, :]).ravel()).reshape(len(x), -1), axis=1)
        first = np.ones(found.shape, bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        return np.nonzero(first)[0], found[first]


def forest(fps: np.ndarray, threshold: int, small: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) that connect what links within the threshold connect; fps are distinct."""
    n = len(fps)
    if n <= small or threshold != 2:
        parts = [np.nonzero(np.bitwise_count(fps[a : a + small, None] ^ fps[None, :]) <= threshold) + (a,) for a in range(0, n, small)]
        a, b = np.concatenate([x + k for x, _, k in parts]), np.concatenate([y for _, y, _ in parts])
    else:  # two within 2 bits share a point within 1 bit of both, and all that share one are within 2 bits
        flips = np.array([0, *(1 << k for k in range(64))], np.uint64)
        points = (fps[:, None] ^ flips[None, :]).ravel()
        order = np.argsort(points, kind="stable")
        sorted_points, owner = points[order], order // 65
        start = np.ones(len(points), bool)
        start[1:] = sorted_points[1:] != sorted_points[:-1]
        a, b = owner[start][np.cumsum(start) - 1], owner
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.nonzero(label != np.arange(n))[0]
    return fps[label[member]], fps[member]


def links(distinct: DataFrame, threshold: int = 2, most_held: int = 4096) -> DataFrame:
    """Edges (u, v) between fingerprints (column fp) that connect all within threshold bits of each other.

    An anchor with more than `most_held` fingerprints is hot: theirs are dealt to all points within half the threshold of
    them instead, and each point links what reaches it. Two that share a point are within the threshold, and two within an
    even threshold share one, so nothing is lost and no task holds the anchor.
    """
    if threshold % 2:
        most_held = 1 << 62  # an odd threshold has no midpoint: two that share a point may be too far apart

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = CoveringCode()
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for a in range(0, len(fps), 4096):
                at, anchors = code.reached(fps[a : a + 4096], (threshold + 1) // 2)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(fps[a : a + 4096][at].view(np.int64))], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64)]

        def found(anchors: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cuts = np.concatenate([[0], np.nonzero(anchors[1:] != anchors[:-1])[0] + 1, [len(anchors)]])
            sizes = np.diff(cuts)
            out = [forest(fps[a : a + n], threshold) for a, n in zip(cuts[:-1][sizes > 1], sizes[sizes > 1], strict=True)]
            u, v = (np.concatenate([np.zeros(0, np.uint64), *(x[k] for x in out)]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = np.concatenate([held[0], batch.column("anchor").to_numpy()])
            fps = np.concatenate([held[1], batch.column("fp").to_numpy().view(np.uint64)])
            last = np.searchsorted(anchors, anchors[-1])  # what has the last anchor may go on in the next batch
            held = [anchors[last:], fps[last:]]
            yield found(anchors[:last], fps[:last])
        yield found(*held)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.array([0, *(sum(1 << b for b in bits) for r in range(1, threshold // 2 + 1) for bits in combinations(range(64), r))], np.uint64)
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for a in range(0, len(fps), 1024):
                some = fps[a : a + 1024]
                reached = (some[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(reached.view(np.int64)), pa.array(np.repeat(some, len(flips)).view(np.int64))], ["point", "fp"])

    scratch = Scratch(distinct.sparkSession, "links")
    copies = scratch.table(distinct.select("fp").mapInArrow(replicate, "anchor long, fp long"), "copies")
    counts = scratch.table(copies.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    cold = copies.join(counts.where(F.col("n") <= most_held).select("anchor"), "anchor", "left_semi")
    near = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "u long, v long")
    hot = copies.join(counts.where(F.col("n") > most_held).select("anchor"), "anchor", "left_semi").select("fp").distinct()
    reached = hot.mapInArrow(points, "point long, fp long")
    least = reached.groupBy("point").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").select("point", "u")
    met = reached.join(least, "point").where("u <> fp").select("u", F.col("fp").alias("v"))
    return near.unionByName(met).distinct()


def simhash_components(docs: DataFrame, threshold: int = 2, shingle: int = 3) -> DataFrame:
    """One row a document: doc_id, text_key, fingerprint, root (a fingerprint that names the component) and component_id
    (the least doc_id reachable over links)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = scratch.table(fingerprints(docs, shingle), "fingerprints")
    distinct = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    edges = scratch.table(links(distinct, threshold), "links")
    roots = connected_components(edges).withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = distinct.join(linked.join(least, "root").select("fp", "root", "component_id"), "fp", "left")
    of_fp = of_fp.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    of_fp = scratch.table(of_fp, "components")  # written, so that the join below may split a fingerprint with very many rows
    return rows.join(of_fp, "fp").select("doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")


def keep_one(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """One document of each component, with all columns: the one with the least doc_id (nulls last).

    Of several rows with that doc_id the one with the least hash of its text stays; rows equal in both are one document.
    """
    key = spare(docs, "text_key")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    kept = simhash_components(docs, threshold).groupBy("root").agg(first.alias("one")).select("one.doc_id", F.col("one.text_key").alias(key))
    own = docs.withColumn(key, F.xxhash64(text_or_empty()))
    same = own["doc_id"].eqNullSafe(kept["doc_id"]) & (own[key] == kept[key])
    return own.join(kept, same, "left_semi").dropDuplicates(["doc_id", key]).select(docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir)).drop("text_key", "root")
