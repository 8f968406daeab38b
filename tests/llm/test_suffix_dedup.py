import hashlib
import random
from collections import Counter

import pytest

from quarrylight.llm import suffix_dedup as op
from quarrylight.llm.common import Scratch
from tests.llm import cases


def covered(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Maximal runs covered by strings of `length` bytes that start in more than one place."""
    times = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        runs: list[tuple[int, int]] = []
        for k in range(len(t) - length + 1):
            if times[t[k : k + length]] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1] = runs[-1][0], k + length
                else:
                    runs.append((k, k + length))
        out.append(runs)
    return out


def brute(rows, length=400):
    texts = [(r[1] or "").encode() for r in rows]
    out = []
    for r, t, runs in zip(rows, texts, covered(texts, length), strict=True):
        kept = bytearray()
        at = 0
        for a, b in runs:
            kept += t[at:a]
            at = b
        kept += t[at:]
        out.append((r[0], len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(bytes(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(autouse=True)
def short_long_text(monkeypatch):
    monkeypatch.setattr(cases, "LONG", cases.LONG[:30_000])


def test_against_brute_force(spark, tmp_path):
    at = cases.folder(spark, str(tmp_path), cases.table(spark, clashing=True))
    assert cases.plain_rows(op.op8_suffix_dedup(spark, at)) == brute(cases.rows())


def test_whole_table_against_brute_force(spark):
    at = cases.sf()
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    assert cases.plain_rows(op.op8_suffix_dedup(spark, at)) == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_small_alphabets_many_parts(spark, seed):
    """Few letters, so that grams are hot, and parts of two stretches, so that matches over parts count."""
    r = random.Random(seed)
    texts = ["".join(r.choice("ab" if k % 2 else "abcd") for _ in range(r.randint(0, 160))) for k in range(12)]
    texts += [texts[1][10:60] + "x" + texts[3][:70], "a" * 90, "a" * 90, "ab" * 60, ""]
    docs = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "row_id long, text binary").repartition(3)
    for most in (2, 1000)[seed % 2 :]:
        spans = op.repeated_spans(docs, Scratch(spark, "test"), length=24, gram=6, batches=3, most_in_part=most, width=1 + seed * 4)
        got = {k: [] for k in range(len(texts))}
        for x in spans.collect():
            got[x["row_id"]] += x["runs"]
        assert [op.merged(got[k]) for k in range(len(texts))] == covered([t.encode() for t in texts], 24)


def test_a_very_long_text_goes_in_blocks(spark):
    r = random.Random(9)
    passage = bytes(r.choice(b"abcdefghij") for _ in range(700))
    long = bytes(r.choice(b"klmnopq") for _ in range(9_000))
    texts = [long[:4_000] + passage + long[4_000:], passage, long[:300]]
    docs = spark.createDataFrame(list(enumerate(texts)), "row_id long, text binary")
    rows = op.sparse_suffixes(docs, 400, 128, block=1_000).collect()
    whole = op.sparse_suffixes(docs, 400, 128).collect()
    windows = lambda got: {(x["row_id"], lo + k) for x in got for lo in x["los"] for k in range(x["n"])}
    assert windows(rows) == windows(whole) == {(k, a) for k, t in enumerate(texts) for a in range(len(t) - 399)}
    spans = op.repeated_spans(docs, Scratch(spark, "test")).collect()
    runs = [op.merged([s for x in spans if x["row_id"] == k for s in x["runs"]]) for k in range(3)]
    assert runs == covered(texts, 400) == [[(4_000, 4_700)], [(0, 700)], []]


def test_removed_from_the_text_with_all_columns(spark):
    docs = cases.table(spark, clashing=True)
    out = op.remove_repeats(docs)
    assert out.columns == docs.columns
    got = sorted(((x["doc_id"], x["text"]) for x in out.collect()), key=repr)
    rows = cases.rows()
    want = []
    for r, runs in zip(rows, covered([(x[1] or "").encode() for x in rows], 400), strict=True):
        want.append((r[0], op.without(r[1].encode(), runs).decode(errors="ignore") if runs else r[1]))
    assert got == sorted(want, key=repr)
    assert all(x["spans"] == "own spans" and x["row_id"] == "own row_id" for x in out.select("spans", "row_id").collect())
