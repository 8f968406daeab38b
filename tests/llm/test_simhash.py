import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import simhash as op
from tests.llm import cases

CODE = op.CoveringCode()


def plain_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(fps: list[int], threshold: int = 2) -> list[int]:
    """For each fingerprint the place of the first one it is linked to."""
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def brute(rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    found = components(fps)
    least = {}
    for r, c in zip(rows, found, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return sorted(((r[0], f"{fp:016x}", least.get(c)) for r, fp, c in zip(rows, fps, found, strict=True)), key=repr)


def test_against_brute_force(spark, tmp_path):
    at = cases.folder(spark, str(tmp_path), cases.table(spark, clashing=True))
    assert cases.plain_rows(op.op9_simhash(spark, at)) == brute(cases.rows())


def test_whole_table_against_brute_force(spark):
    at = cases.sf()
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    assert cases.plain_rows(op.op9_simhash(spark, at)) == brute(rows)


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
@settings(max_examples=300, deadline=None)
def test_two_within_the_threshold_share_an_anchor(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    reached = [set(CODE.reached(np.array([v], np.uint64), 1)[1].tolist()) for v in (x, y)]
    assert reached[0] & reached[1]


@given(st.integers(0, 2**64 - 1))
@settings(max_examples=300, deadline=None)
def test_anchors_lie_within_the_covering_radius_and_stay(x):
    a = int(CODE.anchor(np.array([x], np.uint64))[0])
    assert (a ^ x).bit_count() <= 8
    assert int(CODE.anchor(np.array([a], np.uint64))[0]) == a


def chained(n: int, seed: int) -> list[int]:
    """Fingerprints in walks of one or two flips, with some apart."""
    r = random.Random(seed)
    out, x = set(), r.getrandbits(64)
    while len(out) < n:
        out.add(x)
        x = r.getrandbits(64) if r.random() < 0.05 else x ^ sum(1 << b for b in r.sample(range(12), r.choice((1, 2, 3))))
    return sorted(out)


def test_forest_of_large_and_small_groups():
    for n, small in ((200, 512), (200, 16), (900, 512)):
        fps = chained(n, n + small)
        u, v = op.forest(np.array(fps, np.uint64), 2, small)
        root = {x: x for x in fps}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            root[find(b)] = find(a)
        place = {x: k for k, x in enumerate(fps)}
        groups = lambda labels: {frozenset(x for x, y in zip(fps, labels, strict=True) if y == z) for z in set(labels)}
        assert groups([find(x) for x in fps]) == groups([fps[c] for c in components(fps)]), place


def test_links_over_partitions_and_hot_anchors(spark):
    fps = chained(600, 5)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    want = components(fps)
    groups = lambda labels: {frozenset(x for x, y in zip(signed, labels, strict=True) if y == z) for z in set(labels)}
    for most_held in (4096, 3, 0):  # some anchors, or all of them, are hot
        edges = op.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3), most_held=most_held)
        found = {r["node"]: r["root"] for r in op.connected_components(edges).collect()}
        assert groups([found.get(x, x) for x in signed]) == groups([signed[c] for c in want])


def test_one_document_of_each_group_stays(spark):
    docs = cases.table(spark, clashing=True)
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns
    rows = cases.rows()
    groups = components([plain_fingerprint(r[1]) for r in rows])
    got = kept.collect()
    place = {(r[0], r[1]): c for r, c in zip(rows, groups, strict=True)}
    assert sorted(place[r["doc_id"], r["text"]] for r in got) == sorted(set(groups))
    least = {c: min(((r[0] is None, r[0] or 0) for r, d in zip(rows, groups, strict=True) if d == c)) for c in set(groups)}
    assert all(least[place[r["doc_id"], r["text"]]] == (r["doc_id"] is None, r["doc_id"] or 0) for r in got)
