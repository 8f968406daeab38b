"""Periodic runs of words in linear time, after Ellert and Fischer.

A run is a maximal stretch with a smallest period. Words are only ever compared: no suffix structure, no hash of a word.
For the order of words and for the reverse of it, the Lyndon array gives at each place the next smaller suffix, and
what lies between is the longest Lyndon word there. Each run holds such a word as its period in one of the two orders,
so a run is found where the word's matches to the right and to the left of it together are as long as the word.

Both directions reuse what has been matched. To the right, places are taken in order; the pair that has matched furthest
is a window whose second half equals its first. A pair inside the window has its counterpart in the first half, whose
match holds here too unless it ends at the window's edge, and matching goes on from that edge. Along the chain of smaller
suffixes the stored matches of its links decide, or matching goes on from the edge as well. To the left, places are taken
backwards with a window of the same kind: inside it, Lyndon words have their counterparts, too. So the edges only ever
move one way, and comparisons are linear in the number of words whatever the text.

Defined results: a null text has no words; texts without words or without runs have an empty list; texts are taken whole,
however long (a text's lists lie in one task's memory, compactly beyond `LARGE` words); a null doc_id is carried through;
repeated rows get equal values; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import documents, slices, text_or_empty

#: Beyond so many words lists of numbers are arrays of 4 bytes a number.
LARGE = 200_000
RUN = "struct<start: long, length: long, period: long>"


def _numbers(n: int, value: int) -> list[int] | array:
    return [value] * n if n <= LARGE else array("i", [value]) * n


def next_smaller(words: Sequence, up: bool) -> tuple[Sequence[int], Sequence[int]]:
    """For each suffix the place of the next smaller one (len(words) if none) and the length of their common prefix.

    up: the order of the words; else the reverse of it. A proper prefix is smaller in both.
    """
    n = len(words)
    after, match = _numbers(n, n), _numbers(n, 0)
    before, shared = _numbers(n, -1), _numbers(n, 0)  # the last smaller suffix before, and the common prefix with it
    at = shift = edge = 0  # words[at:edge] equals words[at - shift : edge - shift]
    for y in range(1, n):
        x, k, unknown = y - 1, 0, True
        if y < edge:
            c = y - shift
            k = match[c - 1] if after[c - 1] == c else shared[c]
            unknown = y + k >= edge
            if unknown:
                k = edge - y
        while True:
            if unknown:
                e = y + k
                d = x - y
                while e < n and words[e] == words[e + d]:
                    e += 1
                at, shift, edge, k = y, -d, e, e - y
                smaller = e == n or (words[e] < words[e + d]) == up
            else:
                smaller = after[x - shift] == y - shift
            if not smaller:
                before[y], shared[y] = x, k
                break
            link = k + 1
            while link > k:  # x and what is before it go on alike beyond k: y is smaller than both
                after[x], match[x] = y, k
                link, x = shared[x], before[x]
                if x < 0:
                    break
            if x < 0:
                break
            if link < k:
                before[y], shared[y] = x, link
                break
            unknown = True
            if y + k < edge and x >= at:
                c = y - shift
                k = match[x - shift] if after[x - shift] == c else shared[c]
                unknown = y + k >= edge
                if unknown:
                    k = edge - y
    return after, match


def _found(words: Sequence, up: bool, least: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, length, period) of at least `least` words that show in one order."""
    after, match = next_smaller(words, up)
    n = len(words)
    left = _numbers(n, 0)
    low, shift = n, 0  # words[low:at] equals words[low + shift : at + shift] for the place `at` that set the window
    for at in range(n - 1, -1, -1):
        period = after[at] - at
        x = at
        if at > low:
            k = left[at + shift]
            if k < at - low:
                x = at - k
            elif k > at - low:
                x, shift = low, period
            else:
                x = low
                while x and words[x - 1] == words[x - 1 + period]:
                    x -= 1
                low, shift = x, period
        else:
            d = period - 1
            while x and words[x - 1] == words[x + d]:
                x -= 1
            low, shift = x, period
        k = at - x
        if k:
            left[at] = k
        if k < period <= k + match[at] and period + k + match[at] >= least:  # the first of the run's Lyndon words
            yield x, period + k + match[at], period


def runs_of(words: Sequence, least: int = 12) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) with at least `least` words and two periods, by start, then period."""
    if len(words) < max(2, least):
        return []
    return sorted({*_found(words, True, least), *_found(words, False, least)}, key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that any run holds after its first period."""
    out, done = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        if b > done:
            out += words[done : max(a, done)]
            done = b
    return b" ".join([*out, *words[done:]] if done else words)


def word_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """One row a document: doc_id, n_words, runs (start, length, period in words, by start, then period) and collapsed (the
    text as bytes with one period of each run, words joined by a space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for part in slices(batches, "text", 4 << 20):
            n, found, texts = [], [], []
            for text in part.column("text"):
                words = text.as_py().split()
                runs = runs_of(words, least)
                n.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                texts.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed binary")


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the documents (by a checksum of doc_id) repeats a stretch of words to its end."""
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, turn = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    start = turn % n
    period = 1 + F.floor((n - start) / (3 + turn % 8))
    periodic = F.transform("words", lambda w, i: F.when(i < F.col("start"), w).otherwise(F.get("words", (F.col("start") + (i - F.col("start")) % F.col("period")).cast("int"))))
    chosen = docs.select(F.col("doc_id").cast("long"), "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    made = chosen.withColumns({"start": F.when(n > 0, start), "period": F.when(n > 0, period)})
    return made.select("doc_id", F.when(F.col("start").isNotNull(), F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def longest(runs: str) -> Column:
    """The run with the greatest length, of equal ones the first by start and period; null if there is none."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(ranked)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs(with_periods(documents(spark, sf_dir))).withColumn("best", longest("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
