import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from quarrylight.llm import near_copies as op
from tests.llm import cases


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute(rows):
    """rows: (doc_id, text). The ids that stay."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, d), d)
    return sorted(least.values())


def edited(text, places):
    words = text.split()
    for p in places:
        words[p] = f"other{p}"
    return " ".join(words)


def test_stage_against_brute_jaccard(spark):
    base = [(k, cases.prose(1000 + k, 150 + k)) for k in range(8)]
    # one edit breaks 5 shingles of about 150: two edits lie above 0.8, five below, a chain links its ends
    near = [(100 + 10 * k + e, edited(base[k][1], range(9, 9 + 30 * e, 30))) for k in range(8) for e in range(1, 6)]
    short = [(500, "One two"), (501, "one  TWO"), (502, "one two three"), (503, ""), (504, " "), (505, None)]
    rows = base + near + short
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == brute(rows)
    assert len(got) < len(rows) - 20


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_stage_on_whole_tables(spark, name):
    docs = spark.read.parquet(f"{cases.sf(name)}/documents.parquet").dropDuplicates(["text"])
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == brute(rows)


def test_a_dense_group_below_the_border_makes_few_pairs(spark, tmp_path):
    """Copies of one short text with an edit each share bands, but no two are similar enough."""
    rows = [(k, edited(cases.prose(7, 24), [k % 24]) + f" tail{k}") for k in range(300)]
    from quarrylight.llm.common import Scratch

    scratch = Scratch(spark, "dense")
    texts = spark.createDataFrame([(k, t.encode()) for k, t in rows], "row_id long, text binary")
    found = op.similar_components(texts, scratch)
    roots = {r["row_id"]: r["root"] for r in found.collect()}
    assert len(rows) - len(roots) + len(set(roots.values())) == len(brute(rows))


@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
@settings(max_examples=200, deadline=None)
def test_the_sketch_rules_no_similar_pair_out(a, b, both):
    a, b = (np.array(sorted(x | both), np.uint64) for x in (a, b))
    differ = int(np.bitwise_count((op.parities(a) ^ op.parities(b)).view(np.uint64)).sum())  # of signed numbers it counts the bits of the absolute value
    assert differ <= len(np.setxor1d(a, b))


def test_similarity_at_the_border():
    a = np.arange(9, dtype=np.uint64)
    assert op.similar(a[:8], a[:8], 80) and op.similar(a[:4], a[:5], 80) and not op.similar(a[:7], a[:9], 80)
