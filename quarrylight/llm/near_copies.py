"""SimHash near-dedup of texts at a Jaccard similarity, operator 9 completed by MinHash bands.

SimHash fingerprints over the shingles are linked through anchors as in simhash.py. At a Jaccard similarity of 0.8 two
fingerprints of 64 bits differ in about 10 bits, far beyond what anchors reach, so that they alone would miss most links.
Therefore texts that share a band of MinHash values are candidates too. Every candidate is held against the exact
similarity of the two sets of shingles, so that no pair below the least similarity is ever linked. A pair at 0.8 exactly
shares none of the 32 bands of 5 values with probability (1 - 0.8 ** 5) ** 32 = 3e-6, a more similar one more rarely.
Equal sets are one set throughout.

First each set is compared with the least of every band and fingerprint it is in, which is linear; then, within a band,
with those that are not in its component yet. There a sketch rules pairs out before they become rows: the parity of a
set's members in 256 cells. Each member that only one of two sets has flips one cell, so the cells in which they differ are
never more than their symmetric difference, and no similar pair is ruled out. Together these link what all pairs of the
band would.

Defined results: a text without words has the set of the empty shingle, one of fewer words than a shingle that of all its
words; null text counts as empty; a null doc_id is carried through; an empty table gives an empty result; texts are taken
whole, however long; of equal doc_ids the row that comes first stays; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, slices, spare, text_or_empty
from quarrylight.llm.components import connected_components
from quarrylight.llm.simhash import links
from quarrylight.llm.suffix_dedup import numbered

SEED = 20240301
#: Cells of the parity sketch, and its columns.
CELLS, SKETCH = 256, ("p0", "p1", "p2", "p3")


def shingles(text: bytes, words_in: int = 5) -> np.ndarray:
    """The sorted set of the XXH64 of the shingles of lower-cased words; 64 bits stand for equal shingles."""
    words = text.lower().split()
    n = max(1, len(words) - words_in + 1)
    parts = map(b" ".join, zip(*(words[k : n + k] for k in range(words_in)), strict=True)) if len(words) >= words_in else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, n))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets have a Jaccard similarity of percent or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= percent * (len(a) + len(b) - both)


def band_keys(found: np.ndarray, factors: np.ndarray, bands: int, block: int = 2048) -> np.ndarray:
    """A hash of each band of MinHash values of a set."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), block):
        x = found[None, a : a + block] * factors[:, None]
        np.minimum(least, x.min(1), out=least)
    rows = least.astype("<u8").reshape(bands, -1)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(rows)], np.uint64)


def parities(found: np.ndarray) -> np.ndarray:
    """CELLS bits: whether an odd number of members lies in each cell, in longs."""
    odd = np.bincount((found >> np.uint64(32) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def fingerprint_of(found: np.ndarray) -> int:
    """64 bits, each the majority over the members."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<i8")[0])


def signatures(texts: DataFrame, words_in: int, bands: int, in_band: int) -> DataFrame:
    """row_id, d1 and d2 (digest of the set), n (its size), fp (SimHash fingerprint), p0 to p3 (parities) and keys (one of
    each band); texts: row_id and text (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(SEED).integers(1, 1 << 63, bands * in_band, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for part in slices(batches, "text", 2 << 20):
            sets = [shingles(x, words_in) for x in part.column("text").to_pylist()]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.astype("<u8").tobytes()) for x in sets), ">i8").reshape(-1, 2).astype(np.int64)
            keys = pa.array([band_keys(x, factors, bands).view(np.int64) for x in sets], pa.list_(pa.int64()))
            sketch = np.stack([parities(x) for x in sets])
            own = [digests[:, 0], digests[:, 1], np.array([len(x) for x in sets], np.int32), np.array([fingerprint_of(x) for x in sets], np.int64), *sketch.T]
            yield pa.RecordBatch.from_arrays([part.column("row_id"), *map(pa.array, own), keys], ["row_id", "d1", "d2", "n", "fp", *SKETCH, "keys"])

    return texts.select("row_id", "text").mapInArrow(run, f"row_id long, d1 long, d2 long, n int, fp long, {', '.join(f'{p} long' for p in SKETCH)}, keys array<long>")


def set_table(texts: DataFrame, words_in: int) -> DataFrame:
    """row_id and set: the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            sets = [shingles(x, words_in).astype("<u8").tobytes() for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row_id"), pa.array(sets, pa.binary())], ["row_id", "set"])

    return texts.select("row_id", "text").mapInArrow(run, "row_id long, set binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda x: np.frombuffer(x.as_buffer(), "<u8")
            same = [similar(read(a), read(b), percent) for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(same, pa.bool_()))

    left, right = sets.select(F.col("row_id").alias("u"), F.col("set").alias("a")), sets.select(F.col("row_id").alias("v"), F.col("set").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def fingerprint_links(one: DataFrame, scratch: Scratch, threshold: int = 2) -> DataFrame:
    """(u, v) of rows (row_id, fp) that connect all whose fingerprints differ in at most threshold bits."""
    of_fp = scratch.table(one.groupBy("fp").agg(F.min("row_id").alias("rep")), "fingerprints")
    equal = one.select("fp", "row_id").join(of_fp, "fp").where("row_id <> rep").select(F.col("rep").alias("u"), F.col("row_id").alias("v"))
    near = links(of_fp, threshold)
    end = lambda name: of_fp.select(F.col("fp").alias(name), F.col("rep").alias(f"rep_{name}"))
    return near.join(end("u"), "u").join(end("v"), "v").select(F.least("rep_u", "rep_v").alias("u"), F.greatest("rep_u", "rep_v").alias("v")).unionByName(equal)


def similar_components(texts: DataFrame, scratch: Scratch, percent: int = 80, words_in: int = 5, bands: int = 32, in_band: int = 5) -> DataFrame:
    """(row_id, root) for all rows that are linked to another row; texts: row_id (unique) and text (binary)."""
    rows = scratch.table(signatures(texts, words_in, bands, in_band), "signatures")
    sets_of = rows.groupBy("d1", "d2").agg(F.min("row_id").alias("first"), F.count("*").alias("rows"))
    sets_of = scratch.table(sets_of, "sets")
    same = rows.join(sets_of.where("rows > 1"), ["d1", "d2"]).select(F.col("row_id").alias("u"), F.col("first").alias("v")).where("u <> v")
    one = rows.join(sets_of.select(F.col("first").alias("row_id")), "row_id", "left_semi")
    keyed = scratch.table(one.select("row_id", "n", F.posexplode("keys").alias("band", "key")), "keyed")
    shared = keyed.groupBy("key").agg(F.min(F.struct("row_id", "n")).alias("least"), F.count("*").alias("times")).where("times > 1")
    banded = scratch.table(keyed.join(shared.select("key", "least"), "key"), "banded")
    scratch.drop("keyed")
    # the smaller of two similar sets has at least percent of the larger one's size
    sized = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    star = banded.where((F.col("row_id") != F.col("least.row_id")) & sized(F.col("n"), F.col("least.n"))).select(F.col("least.row_id").alias("u"), F.col("row_id").alias("v"))
    star = scratch.table(star.unionByName(fingerprint_links(one, scratch)).distinct(), "candidates")
    members = banded.select("row_id").union(star.select("u")).union(star.select("v")).distinct()
    sets = scratch.table(set_table(texts.join(members, "row_id", "left_semi"), words_in), "members")
    edges = scratch.table(verified(star, sets, percent), "star")
    roots = scratch.table(connected_components(edges), "roots-1")
    member = banded.join(roots.withColumnRenamed("node", "row_id"), "row_id", "left").select("key", "band", "row_id", "n", F.coalesce("root", "row_id").alias("root"))
    open_keys = member.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    left = member.join(open_keys, "key", "left_semi").join(one.select("row_id", *SKETCH, "keys"), "row_id")
    left = scratch.table(left, "open")
    other = left.drop("band").withColumnsRenamed({"row_id": "v", "n": "m", "root": "other", "keys": "its_keys"} | {p: f"q{p}" for p in SKETCH})
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(p).bitwiseXOR(F.col(f"q{p}"))) for p in SKETCH))
    may = differ * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)
    # a pair meets in each band that it shares and becomes a row in the first of them
    once = F.array_position(F.zip_with("keys", "its_keys", lambda a, b: a == b), True) == F.col("band") + 1
    rest = left.withColumnRenamed("row_id", "u").join(other, "key").where((F.col("u") < F.col("v")) & (F.col("root") != F.col("other")) & sized(F.col("n"), F.col("m")) & may & once).select("u", "v")
    rest = rest.join(star, ["u", "v"], "left_anti")
    more = verified(rest, sets, percent)
    found = connected_components(scratch.table(edges.unionByName(more).unionByName(same), "edges"))
    return found.withColumnRenamed("node", "row_id")


def keep_one_similar(docs: DataFrame, percent: int = 80, words_in: int = 5) -> DataFrame:
    """One document of each component of similar ones, with all columns: the one with the least doc_id (nulls last)."""
    scratch, row = Scratch(docs.sparkSession, "near-copies"), spare(docs, "row_id")
    rows = numbered(docs, scratch, row)
    texts = rows.select(F.col(row).alias("row_id"), text_or_empty().cast("binary").alias("text"))
    found = scratch.table(similar_components(texts, scratch, percent, words_in), "components")
    own = rows.select(F.col(row).alias("row_id"), "doc_id").join(found, "row_id")
    kept = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("one")).select("one.row_id")
    gone = found.select("row_id").join(kept, "row_id", "left_anti").withColumnRenamed("row_id", row)
    return rows.join(gone, row, "left_anti").select(docs.columns)
