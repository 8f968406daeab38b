"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Every string of `length` bytes (a window) picks the least-hashed of its `gram`-byte substrings as its anchor, by its
content alone, so equal windows pick their anchor at the same place. The suffixes that start at anchors form a sparse
suffix array: sorted by the hash of the gram they start with, then by the digest of the stretch of text that the
windows of this anchor cover together. A batch of documents becomes such an array; it is merge-scanned against each
level of the family for grams that both hold, stored as level 0, and while two levels have equal size they are
merged into the next. Only suffixes with a matched gram can take part in a repeat.

Of those, stretches that occur twice are repeats as a whole. A stretch that occurs once, but shares its gram with a
different one, is resolved by a suffix array of the suffixes at all windows of that gram's different stretches, bounded at
`length` bytes and built by prefix doubling. Grams with very many different stretches are split into parts; what is
alone in its part is then counted by the digest of its window over all parts. Before that, the windows of such a
stretch are taken in cells of neighbours: the bytes that all windows of a cell share have to occur in another stretch at
the same distance from the gram, or no window of the cell can.

No step gathers the rows of one gram, one stretch or one window in a task beyond that bound: sums are partial first and
joins may be split. The result is exact; hashes of 128 bits stand for equal strings.

Defined results: null text counts as empty; texts below `length` bytes lose nothing; a null doc_id is carried through;
a document given twice (rows equal in doc_id and text) is two documents, which repeat each other; an empty table gives
an empty result; further columns are ignored. Texts are taken whole, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, documents, slices, spare, text_or_empty

#: A fixed odd multiplier and a fixed seed for the rolling hash.
BASE, SEED = np.uint64(0x9E3779B97F4A7C15), 20240229
#: Bytes of a word's code.
WORD = 8


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Powers:
    """Powers of the base and of its inverse, as far as they have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        self.of_byte = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)

    def until(self, n: int) -> None:
        if len(self.up) < n:
            self.up = np.concatenate([[np.uint64(1)], np.full(n - 1, BASE)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([[np.uint64(1)], np.full(n - 1, self.inverse)]).cumprod(dtype=np.uint64)

    def grams(self, data: np.ndarray, gram: int) -> np.ndarray:
        """A hash of each gram of the data."""
        n = len(data) - gram + 1
        self.until(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.up[: len(data)], dtype=np.uint64, out=total[1:])
        return _mixed((total[gram:] - total[:n]) * self.down[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, powers: Powers, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, windows) of each anchor; starts: where texts start in data, and its end."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none
    hashes = powers.grams(data, gram)
    place = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64(0xFFFFFF)
    picked = sliding_least((hashes & ~low) | place, length - gram + 1) & low
    windows = len(data) - length + 1
    ends = np.zeros(len(data) + 1, np.int64)  # a window is whole if no text starts in it but at its first byte
    np.add.at(ends, starts[:-1], 1)
    before = np.cumsum(ends)
    whole = before[length - 1 : length - 1 + windows] == before[:windows]
    at = picked[:windows].astype(np.int64)
    at[~whole] = -1
    cuts = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
    sizes = np.diff(np.concatenate([cuts, [windows]]))
    real = at[cuts] >= 0
    return hashes[at[cuts[real]]], cuts[real], sizes[real]


def sparse_suffixes(docs: DataFrame, length: int, gram: int, block: int = 1 << 20) -> DataFrame:
    """One row a document and stretch: gram, c1 and c2 (digest of the stretch), row_id, los (first window of each of its
    occurrences there), n (windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, names = Powers(), ["gram", "c1", "c2", "row_id", "los", "n"]

        def found(rows: list[int], texts: list[bytes], shift: int = 0) -> pa.RecordBatch:
            data = b"".join(texts)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
            grams, lo, n = anchors(np.frombuffer(data, np.uint8), starts, powers, length, gram)
            digest = xxhash.xxh3_128_digest
            view = memoryview(data)
            classes = np.frombuffer(b"".join([digest(view[a : a + k + length - 1]) for a, k in zip(lo.tolist(), n.tolist(), strict=True)]), ">i8").reshape(-1, 2).astype(np.int64)
            owner = np.searchsorted(starts, lo, "right") - 1
            order = np.lexsort((lo, classes[:, 1], classes[:, 0], owner))
            keys = np.stack([owner, classes[:, 0], classes[:, 1]], 1)[order]
            first = np.nonzero(np.concatenate([np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]).any(1)]))[0]
            one = order[first]
            los = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array((lo - starts[owner] + shift)[order].astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)[one]), pa.array(classes[one, 0]), pa.array(classes[one, 1]), pa.array(np.array(rows, np.int64)[owner[one]]), los, pa.array(n[one].astype(np.int32))], names)

        for part in slices(batches, "text", block):
            rows, texts = part.column("row_id").to_pylist(), part.column("text").to_pylist()
            if len(texts) == 1 and len(texts[0]) > 2 * block:  # a very long text goes in blocks that share their edges
                for a in range(0, len(texts[0]) - length + 1, block):
                    yield found(rows, [texts[0][a : a + block + length - 1]], a)
            else:
                yield found(rows, texts)

    return docs.select("row_id", "text").mapInArrow(run, "gram long, c1 long, c2 long, row_id long, los array<int>, n int")


class SuffixFamily:
    """Levels of sparse suffix arrays in the shared folder; level k holds 2**k batches."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.made = scratch, {}, 0
        self.matched: list[DataFrame] = []

    def _sorted(self, rows: DataFrame) -> DataFrame:
        self.made += 1
        name = f"level-{self.made}"
        salt = F.pmod(F.xxhash64("row_id"), F.lit(16))  # so that a gram or stretch with very many rows lies in many partitions
        return self.scratch.table(rows.repartition("gram", salt).sortWithinPartitions("gram", "c1", "c2"), name), name

    def add(self, suffixes: DataFrame) -> None:
        """Scan a new batch against each level, store it, then merge levels of equal size."""
        rows, name = self._sorted(suffixes)
        grams = rows.groupBy("gram").agg(F.sum(F.size("los")).alias("times"))
        found = [grams.where("times > 1").select("gram")]
        for level, _ in self.levels.values():
            found.append(grams.select("gram").join(level.select("gram").distinct(), "gram", "left_semi"))
        both = found[0]
        for x in found[1:]:
            both = both.unionByName(x)
        self.matched.append(self.scratch.table(both.distinct(), f"matched-{self.made}"))
        merged, names, k = [rows], [name], 0
        while k in self.levels:
            held, its = self.levels.pop(k)
            merged.append(held)
            names.append(its)
            k += 1
        if len(merged) > 1:
            both = merged[0]
            for x in merged[1:]:
                both = both.unionByName(x)
            rows, name = self._sorted(both)
            for x in names:
                self.scratch.drop(x)
        self.levels[k] = (rows, name)

    def drop(self) -> None:
        """Delete the levels and what the scans found."""
        for _, name in self.levels.values():
            self.scratch.drop(name)
        for k in range(1, self.made + 1):
            self.scratch.drop(f"matched-{k}")

    def candidates(self) -> DataFrame:
        """The suffixes whose gram was matched in any scan."""
        rows = matched = None
        for level, _ in self.levels.values():
            rows = level if rows is None else rows.unionByName(level)
        for x in self.matched:
            matched = x if matched is None else matched.unionByName(x)
        return rows.join(self.scratch.table(matched.distinct(), "matched"), "gram", "left_semi")


def bounded_suffix_array(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at the places `at`, sorted by their first `length` bytes, and each one's rank; equal ones share it.

    Prefix doubling: ranks by 8 bytes, then by 16, 32, ... where the last step overlaps to reach exactly `length`.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n].astype(np.uint64)
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    reach = 8
    while reach < length:
        step = min(reach, length - reach)
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + second + 1, return_inverse=True)[1].astype(np.int64)
        reach += step
    order = np.argsort(rank[at], kind="stable")
    return order, rank[at]


def cut_stretches(picks: DataFrame, length: int) -> DataFrame:
    """The bytes of each stretch. picks: row_id, text, stretches (array of gram, part, parts, times, lo, n)."""
    kinds = [("gram", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("times", pa.int64()), ("lo", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            for row, text, stretches in zip(batch.column("row_id").to_pylist(), batch.column("text"), batch.column("stretches").to_pylist(), strict=True):
                view = memoryview(text.as_buffer())
                pieces = pa.array([bytes(view[x["lo"] : x["lo"] + x["n"] + length - 1]) for x in stretches], pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in stretches], t) for k, t in kinds), pa.array([row] * len(stretches), pa.int64()), pieces], [*(k for k, _ in kinds), "row_id", "piece"])

    return picks.select("row_id", "text", "stretches").mapInArrow(run, "gram long, part int, parts int, times long, lo long, row_id long, piece binary")


def shared_cells(pieces: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """row_id, lo, off, cells: for stretches of grams with several parts the cells of windows that may occur elsewhere.

    A window's cell is its distance before the gram over `width`; off is the distance of the stretch's first window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, digest, low = Powers(), xxhash.xxh3_128_digest, np.uint64(0xFFFFFF)
        for batch in batches:
            out: list[tuple] = []
            for row, lo, piece in zip(batch.column("row_id").to_pylist(), batch.column("lo").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                off = int(np.argmin(powers.grams(np.frombuffer(piece, np.uint8, length), gram) & ~low))
                for cell in range((off - (len(piece) - length)) // width, off // width + 1):
                    start = off - width * cell
                    core = digest(piece[start : start + length - width + 1], cell)
                    out.append((int.from_bytes(core[:8], "big", signed=True), int.from_bytes(core[8:], "big", signed=True), row, lo, off, cell))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], ["d1", "d2", "row_id", "lo", "off", "cell"])

    cores = pieces.where("parts > 1").select("row_id", "lo", "piece").mapInArrow(run, "d1 long, d2 long, row_id long, lo long, off int, cell int")
    again = cores.groupBy("d1", "d2").agg(F.count("*").alias("times")).where("times > 1").select("d1", "d2")
    return cores.join(again, ["d1", "d2"], "left_semi").groupBy("row_id", "lo").agg(F.max("off").alias("off"), F.collect_set("cell").alias("cells"))


def window_runs(pieces: DataFrame, length: int, width: int, block: int = 1 << 19) -> DataFrame:
    """Suffix arrays of the windows of stretches; pieces: what cut_stretches gives, with off and cells of shared_cells, a
    gram's part lying together.

    Rows with null d1: windows [a, b) (their first bytes) of a stretch that occurs once, which occur elsewhere in the same
    part. Other rows, for grams of several parts and windows of their cells: the digest (d1, d2) of a window and, where it
    is alone in its part and in a stretch that occurs once, its row_id and place a; b is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d1", "d2", "row_id", "a", "b"]

        def found(held: list[tuple]) -> pa.RecordBatch:
            data = b"".join(x["piece"] for x in held)
            sizes = np.array([len(x["piece"]) for x in held], np.int64)
            starts = np.cumsum(sizes) - sizes
            n = np.maximum(sizes - length + 1, 0)
            which = np.repeat(np.arange(len(held)), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = starts[which] + inner
            order, rank = bounded_suffix_array(np.frombuffer(data, np.uint8), at, length)
            runs = rank[order]
            first = np.concatenate([[True], runs[1:] != runs[:-1]])
            run_of = np.cumsum(first) - 1
            repeated = np.empty(len(at), bool)
            repeated[order] = (np.bincount(run_of) > 1)[run_of]
            single = np.array([x["times"] == 1 for x in held])[which]
            row, lo = np.array([x["row_id"] for x in held], np.int64), np.array([x["lo"] for x in held], np.int64)
            hit = np.nonzero(repeated & single)[0]  # in text order within a stretch
            new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (which[hit[1:]] != which[hit[:-1]])]) if len(hit) else np.zeros(0, bool)
            begin, end = hit[new], hit[np.concatenate([new[1:], [True]])] if len(hit) else hit
            off, cells = np.array([x["off"] or 0 for x in held])[which], [x["cells"] or () for x in held]
            codes = np.array([k << 10 | c for k, own in enumerate(cells) for c in own], np.int64)
            split = np.isin(which << 10 | (off - inner) // width, codes)
            rest = order[first & split[order]]  # one window of each run
            view, digest = memoryview(data), xxhash.xxh3_128_digest
            own = np.frombuffer(b"".join([digest(view[k : k + length]) for k in at[rest].tolist()]), ">i8").reshape(-1, 2).astype(np.int64)
            alone = single[rest] & ~repeated[rest]
            none, place = np.zeros(len(begin), bool), lo[which] + inner
            empty = lambda x, known: pa.array(x, pa.int64(), mask=~known)
            return pa.RecordBatch.from_arrays(
                [
                    empty(np.concatenate([np.zeros(len(begin), np.int64), own[:, 0]]), np.concatenate([none, np.ones(len(rest), bool)])),
                    empty(np.concatenate([np.zeros(len(begin), np.int64), own[:, 1]]), np.concatenate([none, np.ones(len(rest), bool)])),
                    empty(np.concatenate([row[which[begin]], row[which[rest]]]), np.concatenate([~none, alone])),
                    empty(np.concatenate([place[begin], place[rest]]), np.concatenate([~none, alone])),
                    empty(np.concatenate([place[end] + 1, place[rest]]), np.concatenate([~none, np.zeros(len(rest), bool)])),
                ],
                names,
            )

        held, total, last = [], 0, None
        for batch in batches:
            for x in batch.to_pylist():
                key = x["gram"], x["part"]
                if total > block and key != last:
                    yield found(held)
                    held, total = [], 0
                held.append(x)
                total += len(x["piece"])
                last = key
        if held:
            yield found(held)

    return pieces.mapInArrow(run, "d1 long, d2 long, row_id long, a long, b long")


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = 400, gram: int = 128, batches: int = 4, most_in_part: int = 1000, width: int = 16) -> DataFrame:
    """(row_id, runs): arrays of spans of bytes (a, b) covered by strings of `length` bytes that also start elsewhere.

    docs: row_id (unique) and text (binary). A gram with more than most_in_part different stretches is split into parts,
    and windows in cells of `width` neighbours.
    """
    suffixes = scratch.table(sparse_suffixes(docs, length, gram).withColumn("batch", F.pmod(F.xxhash64("row_id"), F.lit(batches)).cast("int")), "suffixes")
    family = SuffixFamily(scratch)
    for k in range(batches):
        family.add(suffixes.where(F.col("batch") == k).drop("batch"))
    scratch.drop("suffixes")
    rows = scratch.table(family.candidates(), "candidates")
    family.drop()
    stretches = scratch.table(rows.groupBy("gram", "c1", "c2").agg(F.sum(F.size("los")).alias("times"), F.min(F.struct("row_id", F.get("los", 0).alias("lo"), "n")).alias("one")), "stretches")
    mixed = stretches.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1")
    mixed = scratch.table(mixed.select("gram", F.ceil(F.col("kinds") / most_in_part).cast("int").alias("parts")), "mixed")
    part = F.pmod(F.xxhash64("c1", "c2"), F.col("parts")).cast("int").alias("part")
    picks = stretches.join(mixed, "gram").groupBy("one.row_id").agg(F.collect_list(F.struct("gram", part, "parts", "times", "one.lo", "one.n")).alias("stretches"))
    pieces = scratch.table(cut_stretches(docs.join(picks, "row_id"), length), "pieces")
    cells = scratch.table(shared_cells(pieces, length, gram, width), "cells")
    whole = pieces.where("parts = 1").withColumns({"off": F.lit(None).cast("int"), "cells": F.lit(None).cast("array<int>")})
    split = pieces.where("parts > 1").join(cells, ["row_id", "lo"], "left").select(whole.columns)
    together = whole.unionByName(split).repartition("gram", "part").sortWithinPartitions("gram", "part")
    windows = scratch.table(window_runs(together, length, width), "windows")
    scratch.drop("pieces")
    over_parts = windows.where("d1 is not null")
    equal = over_parts.groupBy("d1", "d2").agg(F.count("*").alias("times")).where("times > 1").select("d1", "d2")
    split = over_parts.where("row_id is not null").join(equal, ["d1", "d2"], "left_semi").select("row_id", "a", (F.col("a") + length).alias("b"))
    # a window alone in its part counts by its row; one repeated there is a hit already, and its row here stands for all
    single = windows.where("d1 is null").select("row_id", "a", (F.col("b") - 1 + length).alias("b")).unionByName(split)
    copied = rows.join(stretches.where("times > 1").select("gram", "c1", "c2"), ["gram", "c1", "c2"], "left_semi")
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    runs = F.transform("los", lambda lo: span(lo, lo + F.col("n") - 1 + length))
    return single.select("row_id", F.array(span(F.col("a"), F.col("b"))).alias("runs")).unionByName(copied.select("row_id", runs.alias("runs")))


def numbered(docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """docs with a column `name`: the doc_id where it names each row, else a number given in a written copy."""
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").take(1):
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    return scratch.table(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def with_spans(docs: DataFrame, name: str, length: int = 400) -> DataFrame:
    """docs with a column `name`: an array of (a, b), unsorted and overlapping, null where nothing is removed."""
    scratch, row = Scratch(docs.sparkSession, "suffix-dedup"), spare(docs, "row_id")
    rows = numbered(docs, scratch, row)
    texts = rows.select(F.col(row).alias("row_id"), text_or_empty().cast("binary").alias("text"))
    spans = repeated_spans(texts, scratch, length).groupBy("row_id").agg(F.flatten(F.collect_list("runs")).alias(name))
    return rows.join(spans.withColumnRenamed("row_id", row), row, "left").drop(row)


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in (() if spans is None else spans)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def word_codes(texts: DataFrame) -> DataFrame:
    """row_id and text: WORD bytes a word, its hash, so that equal runs of words are equal strings whatever the words' lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 8 << 20):
            coded = [b"".join(map(xxhash.xxh64_digest, x.split())) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row_id"), pa.array(coded, pa.binary())], ["row_id", "text"])

    return texts.select("row_id", "text").mapInArrow(run, "row_id long, text binary")


def with_passages(docs: DataFrame, name: str, length: int, words: int) -> DataFrame:
    """docs with a column `name`: an array of (a, b, coded), spans of with_spans (coded false) and spans over word_codes of
    passages of `words` words and more that occur again (coded true); null where nothing is removed."""
    scratch, row = Scratch(docs.sparkSession, "suffix-dedup"), spare(docs, "row_id")
    rows = numbered(docs, scratch, row)
    texts = rows.select(F.col(row).alias("row_id"), text_or_empty().cast("binary").alias("text"))
    found = None
    for coded, of, n in ((False, texts, length), (True, word_codes(texts), words * WORD)):
        own = Scratch(docs.sparkSession, "suffix-dedup")
        spans = repeated_spans(scratch.table(of, "codes") if coded else of, own, n)
        marked = F.transform("runs", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.lit(coded).alias("coded")))  # noqa: B023
        spans = scratch.table(spans.select("row_id", marked.alias("runs")), f"spans-{coded}")
        own.drop("")
        found = spans if found is None else found.unionByName(spans)
    spans = found.groupBy("row_id").agg(F.flatten(F.collect_list("runs")).alias(name))
    return rows.join(spans.withColumnRenamed("row_id", row), row, "left").drop(row)


def of_words(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Spans of bytes of the text for runs over its word codes: all words that lie in a run as a whole."""
    if not runs:
        return []
    places = [m.span() for m in re.finditer(rb"\S+", text)]
    return [{"a": places[-(-a // WORD)][0], "b": places[b // WORD - 1][1]} for a, b in runs]


def remove_repeats(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """docs without the repeated bytes; characters cut in half go too, and n_chars follows the text.

    With `words`, passages of that many words in a row that occur again go as well, however short their words are.
    """

    def spans_of(text: bytes, spans: list[dict]) -> list[tuple[int, int]]:
        if words is None:
            return merged(spans)
        plain, coded = ([x for x in spans if x["coded"] == k] for k in (False, True))
        return merged(plain + of_words(text, merged(coded)))

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([x if s is None else without(x.encode(), spans_of(x.encode(), s)).decode(errors="ignore") for x, s in zip(texts, spans, strict=True)], dtype=object)

    name = spare(docs, "spans")
    found = with_spans(docs, name, length) if words is None else with_passages(docs, name, length, words)
    out = found.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(kept("text", name)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the SHA-256 of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                text, runs = text.as_py(), merged(spans)
                out.append((len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(without(text, runs)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, [pa.int64()] * 3 + [pa.string()], strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_spans(documents(spark, sf_dir).select("doc_id", "text"), "spans")
    rows = found.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("text"), "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
