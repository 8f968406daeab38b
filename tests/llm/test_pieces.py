import random
import time

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import pieces as op
from tests.llm import cases

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=op.model_path())
ENCODER = op.PieceEncoder(op.model_path())


def test_suffix_search_finds_all_occurrences():
    data = b"abracadabra abra"
    search = op.SuffixSearch(data)
    import numpy as np

    for piece in (b"abra", b"a", b"bra ", b"zz", b"abracadabra abra"):
        pad = lambda fill, piece=piece: np.frombuffer(piece[:16].ljust(16, fill), ">u8").astype(np.uint64).reshape(1, 2)
        a, b = search.ranges(pad(b"\0"), pad(b"\xff"))
        want = {k for k in range(len(data)) if data.startswith(piece, k)}
        assert set(search.order[a[0] : b[0]].tolist()) == want


@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=40), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_ids_are_those_of_the_library(texts):
    assert [x.tolist() for x in ENCODER.encode(texts)] == LIBRARY.encode(texts)


@given(st.text("ab ▁", max_size=12))
@settings(max_examples=200, deadline=None)
def test_marks_and_blanks(text):
    ids = ENCODER.encode([text])[0]
    assert ids.tolist() == LIBRARY.encode(text)
    if op.MARK not in text:
        assert ENCODER.decode(ids) == text


@given(st.lists(st.tuples(st.integers(0, 70), st.text("abe\n▁é", max_size=6)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_runs_of_blanks(parts):
    text = "".join(" " * n + word for n, word in parts)
    assert ENCODER.encode([text])[0].tolist() == LIBRARY.encode(text)


def test_single_pairs_follow_as_many_do():
    import numpy as np

    r = random.Random(3)
    n = len(ENCODER.model.names)
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(20_000)]
    pairs += [(int(a), int(b)) for a, b in zip(ENCODER.model.left, ENCODER.model.right, strict=True) if a >= 0]
    many = ENCODER.model.follow(*(np.array([p[k] for p in pairs]) for k in (0, 1)))
    assert [ENCODER.model.follows(*p) for p in pairs] == many.tolist() and 0 < many.sum() < len(pairs)


def test_very_long_words_take_time_in_proportion():
    r = random.Random(1)
    took = {}
    for n in (100_000, 1_000_000):
        for name, text in {"blanks": " " * n, "letters": "  " + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), "same": "  " + "a" * n}.items():
            encoder = op.PieceEncoder(op.model_path())
            began = time.process_time()
            ids = encoder.encode([text])[0]
            took[name, n] = time.process_time() - began
            assert encoder.decode(ids) == text
            if n == 100_000:
                assert ids.tolist() == LIBRARY.encode(text)
    assert all(took[name, 1_000_000] < 60 for name in ("blanks", "letters", "same")), took
    assert all(took[name, 1_000_000] < 25 * (took[name, 100_000] + 0.2) for name in ("blanks", "letters", "same")), took


def test_whole_table(spark):
    at = cases.sf()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    found = op.encode_pieces(spark.read.parquet(f"{at}/documents.parquet")).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == {k: LIBRARY.encode(t) for k, t in texts.items()}
    assert all(r["round_trip"] or op.MARK in texts[r["doc_id"]] for r in found)


def test_odd_rows(spark):
    rows = [r for r in cases.rows() if "\x00" not in (r[1] or "")]
    found = op.encode_pieces(cases.table(spark, rows, clashing=True)).collect()
    assert sorted(((r["doc_id"], r["n_pieces"]) for r in found), key=repr) == sorted(((r[0], len(LIBRARY.encode(r[1] or ""))) for r in rows), key=repr)
