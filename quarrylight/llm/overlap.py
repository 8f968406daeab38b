"""Jaccard join of shingle sets by T-occurrence search with DivideSkip.

Two sets link at a similarity of `percent` or more, so they share T = percent of the larger one's size or more. Members are
taken in one order for all sets. If a set of n members, T of which a partner shares, keeps its first n - T + m ones, the first m
common members are among those that both keep.

First the order is that of the members' hashes: a set whose kept members don't meet m others on any list has no partner and
leaves; m is a tenth of the size. Of the sets that are left all members are counted; one with fewer than T members that others have leaves as well.
Then the order is by the number of sets, rare members first, and the kept members form the inverted index: a list of sets
for each; m is a twentieth. So a group of texts that share much, but not enough, meets on its rare members only, which few of them share.

DivideSkip divides a set's lists: the longest are put aside, fewer than the required occurrences, the short ones are merged
through a heap, and what occurs often enough there is probed for in the long ones by bisection. Sets that reach the required
number of occurrences are compared exactly. A set's lists hold only what it may link to: later sets of a fitting size that
aren't in its component yet.

Hot lists: equal sets are one set throughout. In lists of more than `long` sets each set is first compared with the sets there
that share most of their members, three at most, and what links becomes one component, so a list within one component needs
no search, and a group of near copies isn't searched pair by pair. Lists are dealt to classes of sets, so that none is held
whole. No pair becomes a row unless the two share the required number of lists.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; a text of fewer words than
a shingle has one shingle of all its words; texts are taken whole, however long; a null doc_id is carried through and never
is a component's id unless all ids of the component are null; repeated rows get equal values; an empty table gives an empty
result; further columns are ignored. 64 bits stand for equal shingles.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, documents, slices, spare, text_or_empty
from quarrylight.llm.components import connected_components
from quarrylight.llm.near_copies import set_table, shingles, verified
from quarrylight.llm.suffix_dedup import numbered


def required(n: int) -> int:
    """The number of kept members that sets of n or more members have to share."""
    return max(1, n // 10)


def least_overlap(n: int, percent: int) -> int:
    """The least number of members that a set of n shares with a similar one; also the least size of that one."""
    return -(-n * percent // 100)


def signatures(texts: DataFrame, words_in: int, percent: int) -> DataFrame:
    """row_id, doc_id, d1 and d2 (digest of the set), n (its size), keys (the members kept for the index) and need (the number
    of keys that a partner has, too); texts: row_id, doc_id and text (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            sets = [shingles(x, words_in) if x.strip() else np.zeros(0, np.uint64) for x in part.column("text").to_pylist()]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.astype("<u8").tobytes()) for x in sets), ">i8").reshape(-1, 2).astype(np.int64)
            sizes = [len(x) for x in sets]
            partners = [least_overlap(n, percent) for n in sizes]
            keys = pa.array([x[: n - t + required(n)].view(np.int64) for x, n, t in zip(sets, sizes, partners, strict=True)], pa.list_(pa.int64()))
            own = [digests[:, 0], digests[:, 1], np.array(sizes, np.int64), np.array([required(t) for t in partners], np.int64)]
            yield pa.RecordBatch.from_arrays([part.column("row_id"), part.column("doc_id"), *map(pa.array, own), keys], ["row_id", "doc_id", "d1", "d2", "n", "need", "keys"])

    return texts.select("row_id", "doc_id", "text").mapInArrow(run, "row_id long, doc_id long, d1 long, d2 long, n long, need long, keys array<long>")


def set_aside(lengths: Sequence[int], need: int, weight: float = 0.01) -> int:
    """How many of the longest lists to probe instead of merging, always fewer than need.

    The published rule T / (weight * log2(M) + 1), M the length of the longest list: the more lists are put aside, the fewer
    entries are merged, but the more sets pass the lower bar and are probed for.
    """
    return min(need - 1, len(lengths), int(need / (weight * math.log2(max(lengths, default=0) or 1) + 1)))


def occurring(lists: Sequence[Sequence[int]], need: int, own: dict[int, int] | None = None) -> list[int]:
    """What occurs in `need` or more of the ascending lists (T-occurrence), by DivideSkip; own: higher numbers for some."""
    lists = sorted(lists, key=len)
    aside = set_aside([len(x) for x in lists], need)
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    out = []
    for value, same in groupby(heapq.merge(*short)):
        times = sum(1 for _ in same)
        enough = own.get(value, need) if own else need
        if times < enough - aside:
            continue
        for k, other in enumerate(long):
            if times >= enough or times + len(long) - k < enough:
                break
            at = bisect_left(other, value)
            times += at < len(other) and other[at] == value
        if times >= enough:
            out.append(value)
    return out


def candidates(lists: DataFrame) -> DataFrame:
    """(u, v): v occurs in so many of u's lists as the two need; lists: u, part, ids (ascending) and needs, a row a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(u: int, held: list[list[int]], needs: dict[int, int]) -> list[tuple[int, int]]:
            return [(u, v) for v in occurring(held, min(needs.values()), needs)]

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

        group: tuple[int, int] | None = None
        held: list[list[int]] = []
        known: dict[int, int] = {}
        for batch in batches:
            pairs: list[tuple[int, int]] = []
            for u, part, ids, needs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (u, part):
                    pairs += found(group[0], held, known) if group else []
                    group, held, known = (u, part), [], {}
                held.append(ids)
                known.update(zip(ids, needs, strict=True))
            yield batch_of(pairs)
        yield batch_of(found(group[0], held, known) if group else [])

    rows = lists.select("u", "part", "ids", "needs").repartition("u", "part").sortWithinPartitions("u", "part")
    return rows.mapInArrow(run, "u long, v long")


def _sized(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _hub_pairs(index: DataFrame, lengths: DataFrame, percent: int, long: int, hubs: int = 3) -> DataFrame:
    """(u, v): in the long lists each set with the sets there whose members others have most, those it shares most lists with."""
    order = F.struct((-F.col("times") / F.col("n")).alias("less"), F.xxhash64("id").alias("order"), "id", "n")
    hub = index.join(lengths.where(F.col("length") > long).select("key"), "key", "left_semi").groupBy("key").agg(F.min(order).alias("hub"))
    met = index.join(hub, "key").where((F.col("id") != F.col("hub.id")) & _sized(F.col("n"), F.col("hub.n"), percent))
    met = met.groupBy("id", F.col("hub.id").alias("hub")).agg(F.count("*").alias("lists"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("lists"), "hub"))
    return met.withColumn("rank", best).where(F.col("rank") <= hubs).select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct()


def _lists(index: DataFrame, components: DataFrame, percent: int, most_ids: int) -> DataFrame:
    """u, part, ids and needs: for each set the lists of what it may link to beyond its component.

    Two sets share at least their overlap less what the one with more members beyond its kept ones has there.
    """
    held = index.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_keys = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("length")).where("low <> high")
    longest = open_keys.agg(F.max("length")).first()[0] or 0
    parts = -(-longest // most_ids) or 1
    held = held.join(open_keys.select("key"), "key", "left_semi").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    listed = held.groupBy("key", "part").agg(F.array_sort(F.collect_list(F.struct("id", "root", "n", "rest"))).alias("list"))
    query = held.select("key", F.col("id").alias("u"), F.col("root").alias("own"), F.col("n").alias("size"), F.col("rest").alias("own_rest"))
    fits = lambda x: (x["id"] > F.col("u")) & (x["root"] != F.col("own")) & _sized(x["n"], F.col("size"), percent)
    overlap = lambda x: F.ceil((x["n"] + F.col("size")) * percent / F.lit(100 + percent))
    needs = F.transform("list", lambda x: F.greatest(overlap(x) - F.greatest(x["rest"], "own_rest"), F.lit(1)).cast("int"))
    rows = query.join(listed, "key").withColumn("list", F.filter("list", fits)).where(F.size("list") > 0)
    return rows.select("u", "part", F.col("list.id").alias("ids"), needs.alias("needs"))


def _meeting(rows: DataFrame, least: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, key) those with keys of several sets and of sets with enough of them, and the sets (id, times);
    least: id and the number that is enough. Twice, as lists get shorter when sets leave."""
    for k in range(2):
        shared = scratch.table(rows.groupBy("key").agg(F.count("*").alias("length")).where("length > 1"), f"{name}-lengths-{k}")
        rows = scratch.table(rows.join(shared.select("key"), "key", "left_semi"), f"{name}-shared-{k}")
        enough = rows.groupBy("id").agg(F.count("*").alias("times")).join(least, "id").where("times >= least").select("id", "times")
        enough = scratch.table(enough, f"{name}-sets-{k}")
        if not k:
            rows = scratch.table(rows.join(enough.select("id"), "id", "left_semi"), f"{name}-rows")
    return rows.join(enough.select("id"), "id", "left_semi"), enough


def _members(sets: DataFrame) -> DataFrame:
    """(id, key): a row a member of sets (row_id, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "set", 2 << 20):
            held = [np.frombuffer(x.as_buffer(), "<i8") for x in part.column("set")]
            ids = np.repeat(part.column("row_id").to_numpy(), [len(x) for x in held])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([np.zeros(0, np.int64), *held]))], ["id", "key"])

    return sets.mapInArrow(run, "id long, key long")


def overlap_links(sets: DataFrame, texts: DataFrame, scratch: Scratch, percent: int, words_in: int, long: int = 32, most_ids: int = 1024) -> DataFrame:
    """(u, v), which connect all similar sets; sets: id, n, need and keys of distinct sets, texts: row_id (the ids) and text."""
    sizes = scratch.table(sets.select("id", "n", "need"), "sizes")
    _, near = _meeting(scratch.table(sets.select("id", F.explode("keys").alias("key")), "keys"), sizes.select("id", F.col("need").alias("least")), scratch, "keys")
    members = scratch.table(set_table(texts.join(near.select(F.col("id").alias("row_id")), "row_id", "left_semi"), words_in), "members")
    overlap = F.ceil(F.col("n") * percent / F.lit(100)).cast("long")
    rows, near = _meeting(_members(members), sizes.select("id", overlap.alias("least")), scratch, "members")
    rows = scratch.table(rows, "near")
    lengths = rows.groupBy("key").agg(F.count("*").alias("sets"))
    order = Window.partitionBy("id").orderBy("sets", "key")
    ranked = rows.join(lengths, "key").withColumn("rank", F.row_number().over(order)).join(near.join(sizes, "id"), "id")
    # members that no other set has come first and are no rows
    rest = overlap - F.greatest(F.lit(1), F.floor(F.col("n") / 20))
    index = scratch.table(ranked.where(F.col("rank") <= F.col("times") - rest).select("id", "key", "n", "times", rest.alias("rest")), "index")
    listed = scratch.table(index.groupBy("key").agg(F.count("*").alias("length")).where("length > 1"), "lists")
    index = scratch.table(index.join(listed.select("key"), "key", "left_semi"), "listed")
    edges = scratch.table(verified(_hub_pairs(index, listed, percent, long), members, percent), "hub-links")
    components = scratch.table(connected_components(edges), "hub-components")
    found = scratch.table(candidates(_lists(index, components, percent, most_ids)), "candidates")
    return edges.unionByName(verified(found, members, percent))


def overlap_components(docs: DataFrame, percent: int = 80, words_in: int = 5) -> DataFrame:
    """One row a document: doc_id, n_shingles and component_id, the least doc_id that links reach (its own without any)."""
    scratch, row = Scratch(docs.sparkSession, "overlap"), spare(docs, "row_id")
    rows = numbered(docs, scratch, row).select(F.col(row).alias("row_id"), F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("text"))
    signed = scratch.table(signatures(rows, words_in, percent), "signatures")
    kinds = signed.where("n > 0").groupBy("d1", "d2").agg(F.min("row_id").alias("id"), F.min("doc_id").alias("first"))
    kinds = scratch.table(kinds, "sets")
    sets = signed.join(kinds.select(F.col("id").alias("row_id")), "row_id", "left_semi").withColumnRenamed("row_id", "id")
    edges = scratch.table(overlap_links(sets, rows.select("row_id", "text"), scratch, percent, words_in), "links")
    roots = scratch.table(connected_components(edges), "roots")
    placed = kinds.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_set = scratch.table(placed.join(least, "root").select("d1", "d2", "component_id"), "components")
    own = signed.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2")
    linked = own.where("n_shingles > 0").join(of_set, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_components(documents(spark, sf_dir), 85, 4)
