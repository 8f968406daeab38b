import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrylight.llm import packing as op
from tests.llm import cases

TOKENIZER = Tokenizer.from_file(op.tokenizer_path())
ENCODER = op.WordwiseEncoder(op.tokenizer_path())


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, op.END]


def check(rows, pieces, capacity=2048):
    """Every id lies in exactly one piece, checksums fit, sequences are gapless and padded little."""
    own = {}
    for r in rows:
        own.setdefault(r[0], []).append(ids_of(r[1]))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(own)
    for doc_id, texts in own.items():
        assert sum(p["length"] for p in by_doc[doc_id]) == sum(map(len, texts))
        if len(texts) > 1:
            continue
        at, ids = 0, texts[0]
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= capacity


def test_every_id_in_one_piece(spark):
    found = op.pack(cases.table(spark, clashing=True).repartition(3)).collect()
    check(cases.rows(), found)


def test_whole_table_with_little_padding(spark):
    at = cases.sf()
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    found = op.op10_packing(spark, at).collect()
    check(rows, found)
    sizes = {}
    for p in found:
        sizes[p["sequence_id"]] = sizes.get(p["sequence_id"], 0) + p["length"]
    padding = sum(2048 - n for n in sizes.values() if n & (n - 1))
    assert padding < 0.03 * sum(sizes.values())


@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_ids_are_those_of_the_library(texts):
    ENCODER._forget()
    for _ in range(2):  # the second time from memory
        assert [x.tolist() for x in ENCODER.encode(texts)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "a\n b\x85 c", "x <|endoftext|> y", "don't  'll　z", "​ ᠎ x", "1 22  333", "a \x1c b", "﻿ a"])
def test_ids_of_odd_texts(text):
    assert ENCODER.encode([text, "w " + text])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 9000), max_size=60))
@settings(max_examples=100, deadline=None)
def test_classes_are_filled_by_a_fixed_count(sizes):
    packer, rows = op.HarmonicPacker(2048, 32, 0), []
    for k, n in enumerate(sizes):
        rows += packer.put(k, np.zeros(n, np.uint32))
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r[5], []).append(r[2])
    for lengths in by_sequence.values():
        classes = {2048 // n for n in lengths}
        assert len(classes) == 1 and len(lengths) == classes.pop()
    rows += packer.close()
    assert sum(r[2] for r in rows) == sum(sizes)
    late = {}
    for r in rows:
        late[r[5]] = late.get(r[5], 0) + r[2]
    assert all(n == 2048 or n & (n - 1) == 0 or s in by_sequence for s, n in late.items())
