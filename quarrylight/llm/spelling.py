"""Groups of spelling variants by Aho-Corasick automata over the halves of words.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Such an edit leaves one half of
either word as it is: the first half at the start of the other word, or the second half at its end. Automaton shards hold
the halves of all words, every word is scanned by the shards that may hold a half of a near word, a hit counts if its
offset and the words' lengths fit, and the distance of the two words is verified.

A shard holds the first halves that begin with the same three code points or the second halves that end with the same
three, so a word has to be scanned by two shards only. A shard of more than `most_held` words is dealt to parts, each of
which scans all the shard's words. Words that share a half don't all meet: the rest of each is halved again, one of its
parts stays as well, and only words that share that part, too, are compared. A pair is given once: by the half of the
lesser word that stays, the first if both do. No word has more near words than its length and the alphabet allow, so
pairs grow as words do.

A word's form is its near word with the largest count (of equal counts the first in code-point order) if that count is
`ratio` times its own or more. Counts grow along forms, so they end after a few steps; roots are found by doubling steps.

Defined results: a null text has no words; a null doc_id counts as empty in the checksum of the query's slips; texts and
words are taken whole, however long; ties are decided by code-point order; repeated rows count as often as they occur; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, documents, slices, text_or_empty

#: Code points that the words of a shard share; halves have as many at least, so words need twice as many.
SHARED = 3
LETTERS = "A-Za-zÀ-ÿ"


def slipped(prefix: bytes, run: str) -> str:
    """run, or in one of 31 cases by a checksum run without one code point."""
    h = zlib.crc32(run.encode(), zlib.crc32(prefix + b":"))
    if h % 31:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, least: int = 7, alter: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """word and n: the maximal runs of letters, A to Z lower-cased, with `least` code points or more.

    alter: gives the word for a doc_id (its digits) and a run; it may shorten a run, not lengthen it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = re.compile(f"[{LETTERS}]{{{least},}}").findall
        for part in slices(batches, "text", 8 << 20):
            counts: Counter[str] = Counter()
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                words = found(text.as_py().lower().decode("utf-8", "replace"))  # lower() of bytes leaves all but A to Z
                if alter is None:
                    counts.update(words)
                    continue
                prefix = b"" if doc_id is None else b"%d" % doc_id
                for word, n in Counter(words).items():
                    if len(made := alter(prefix, word)) >= least:
                        counts[made] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes one word the other."""
    if len(a) > len(b):
        a, b = b, a
    k = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        k += 1
    if len(a) == len(b):
        return k < len(a) and a[k + 1 :] == b[k + 1 :]
    return len(a) + 1 == len(b) and a[k:] == b[k + 1 :]


class Halves:
    """An automaton over one half of each of some words, and what it finds in another word."""

    def __init__(self, words: list[tuple[str, int]], last: bool):
        self.last = last
        self.machine = ahocorasick.Automaton()
        for word, n in words:
            half = len(word) // 2
            segment, rest = (word[half:], word[:half]) if last else (word[:half], word[half:])
            if segment not in self.machine:
                self.machine.add_word(segment, (len(segment), {}))
            of_rest, cut = self.machine.get(segment)[1], len(rest) // 2
            of_rest.setdefault((len(word), True, rest[:cut]), []).append((word, n))
            of_rest.setdefault((len(word), False, rest[cut:]), []).append((word, n))
        self.machine.make_automaton()

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The held words below `word` that are near it and that this half is to give."""
        size = len(word)
        for end, (length, of_rest) in self.machine.iter(word):
            if (end + 1 != size) if self.last else (end + 1 != length):
                continue  # the half stands elsewhere
            rest = word[: size - length] if self.last else word[length:]
            met = set()
            for own in (size - 1, size, size + 1):
                if length != (own - own // 2 if self.last else own // 2):
                    continue
                cut = (own - length) // 2
                tail = own - length - cut
                met.update(of_rest.get((own, True, rest[:cut]), ()))
                met.update(of_rest.get((own, False, rest[len(rest) - tail :]), ()) if tail <= len(rest) else ())
            for other, n in met:
                if other < word and one_edit(other, word) and not (self.last and word.startswith(other[: len(other) // 2])):
                    yield other, n


def near_pairs(words: DataFrame, most_held: int = 20_000) -> DataFrame:
    """(a, a_n, b, b_n), a < b: the pairs of near words, each once; words: word (distinct, of 7 code points or more) and n."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, halves = None, [], None
        for batch in batches:
            found: list[tuple[str, int, str, int]] = []
            for shard, part, scanned, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, part) != group:
                    group, held, halves = (shard, part), [], None
                if not scanned:
                    held.append((word, n))
                    continue
                if not held:  # a part of a shard may be empty
                    continue
                if halves is None:
                    halves = Halves(held, shard[0] == ">")
                found += ((other, m, word, n) for other, m in halves.near(word))
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], ["a", "a_n", "b", "b_n"])

    first, last = F.concat(F.lit("<"), F.substring("word", 1, SHARED)), F.concat(F.lit(">"), F.substring("word", -SHARED, SHARED))
    keyed = words.select("word", "n", F.explode(F.array(first, last)).alias("shard"))
    large = keyed.groupBy("shard").agg(F.ceil(F.count("*") / most_held).cast("int").alias("parts")).where("parts > 1")
    dealt = keyed.join(large, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    holds = dealt.select("shard", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("scanned"), "word", "n")
    scans = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("scanned"), "word", "n")
    shards = holds.unionByName(scans).repartition("shard", "part").sortWithinPartitions("shard", "part", "scanned")
    return shards.mapInArrow(scan, "a string, a_n long, b string, b_n long")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): the end of each word's path along (word, form); forms may not lead in a circle."""
    held, k = scratch.table(forms.select("word", F.col("form").alias("root")), "steps-0"), 0
    while True:
        k += 1
        on = held.select(F.col("word").alias("root"), F.col("root").alias("further"))
        doubled = held.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        doubled = scratch.table(doubled, f"steps-{k}")
        if not doubled.where("moved").take(1):
            return held
        held = doubled.drop("moved")


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n for each row of words (word, n)."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.table(words.select("word", "n"), "words")
    pairs = scratch.table(near_pairs(words), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))
    found = scratch.table(found, "forms")
    ends = roots(found.where("form is not null"), scratch)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(documents(spark, sf_dir), alter=slipped).where("n >= 2"))
