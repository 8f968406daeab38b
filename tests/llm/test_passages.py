import re

import corpus_pipeline
from quarrylight.llm import suffix_dedup as op
from tests.llm import cases
from tests.llm.test_suffix_dedup import covered


def brute(texts, words=51):
    """What the stage leaves of the texts (bytes)."""
    seen, places = {}, [[m.span() for m in re.finditer(rb"\S+", t)] for t in texts]
    for k, t in enumerate(texts):
        own = t.split()
        for a in range(len(own) - words + 1):
            seen.setdefault(tuple(own[a : a + words]), []).append((k, a))
    spans = [[{"a": a, "b": b} for a, b in runs] for runs in covered(texts, 400)]
    for found in seen.values():
        if len(found) > 1:
            for k, a in found:
                spans[k].append({"a": places[k][a][0], "b": places[k][a + words - 1][1]})
    return [op.without(t, op.merged(s)).decode(errors="ignore") for t, s in zip(texts, spans, strict=True)]


def short_words(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 4))) for _ in range(n))


def test_stage_takes_short_passages(spark):
    rows = []
    for n in range(48, 66):
        passage = short_words(n, n)
        assert len(passage) < 400
        rows += [(2 * n + k, f"{short_words(1000 + 2 * n + k, 40)} {passage}{' ' * (k + 1)}{short_words(2000 + 2 * n + k, 30)}") for k in (0, 1)]
    rows += [(900 + k, "w" * 450 + f" {k}") for k in (0, 1)] + [(910, None), (911, " ")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert [got[d] or "" for d, _ in rows] == brute([(t or "").encode() for _, t in rows])
    for n in range(48, 66):
        assert (short_words(n, n) in got[2 * n]) == (n < 51)


def test_stage_on_cases(spark):
    rows = [r[:2] for r in cases.rows() if r[0] not in (404, 405)]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert [got[d] or "" for d, _ in rows] == brute([(t or "").encode() for _, t in rows])
