import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import runs as op
from tests.llm import cases


def brute(words, least=12):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        a = 0
        while a + q < n:
            if words[a] != words[a + q]:
                a += 1
                continue
            b = a
            while b + q < n and words[b] == words[b + q]:
                b += 1
            length = b + q - a
            smaller = any(all(words[x] == words[x + p] for x in range(a, a + length - p)) for p in range(1, q))
            if length >= max(least, 2 * q) and not smaller:
                out.append((a, length, q))
            a = b
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@given(st.lists(st.sampled_from("ab"), max_size=40) | st.lists(st.sampled_from("abc"), max_size=60), st.integers(2, 12))
@settings(max_examples=1500, deadline=None)
def test_runs_of_few_letters(words, least):
    assert op.runs_of(words, least) == brute(words, least)


@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=6), st.integers(1, 5)), max_size=8))
@settings(max_examples=800, deadline=None)
def test_runs_of_repeated_blocks(blocks):
    words = [w for block, times in blocks for w in block * times]
    assert op.runs_of(words, 2) == brute(words, 2)


@pytest.mark.parametrize("n", [1, 2, 13, 60, 150])
def test_runs_of_known_texts(n):
    for text in (fibonacci(n), "a" * n, "ab" * n, "".join(bin(k).count("1") % 2 and "b" or "a" for k in range(n)), "".join("abcdefghij"[k // 13 % 10] for k in range(n))):
        assert op.runs_of(text, 2) == brute(text, 2)


class Counted:
    """A word that counts how often it is compared."""

    times = 0

    def __init__(self, value):
        self.value = value

    def __eq__(self, other):
        Counted.times += 1
        return self.value == other.value

    def __lt__(self, other):
        Counted.times += 1
        return self.value < other.value

    __hash__ = None


def test_comparisons_are_linear():
    r = random.Random(3)
    block = [r.choice("ab") for _ in range(997)]
    texts = {
        "one letter": lambda n: "a" * n,
        "fibonacci": fibonacci,
        "ruler": lambda n: "".join("abcdefghijklmnopqrst"[(k & -k).bit_length()] for k in range(1, n + 1)),
        "halves": lambda n: "".join("tsrqponmlkjihgfedcba"[(k & -k).bit_length()] for k in range(1, n + 1)),
        "random": lambda n: "".join(r.choice("ab") for _ in range(n)),
        "block": lambda n: "".join(block * (n // 997)),
        "tail": lambda n: "a" * (n // 2) + "b" + "a" * (n // 2 - 1) + "c",
        "nested": lambda n: ("".join(["a" * k + "b" for k in range(1, int((2 * n) ** 0.5))]) * 2)[:n],
    }
    for name, make in texts.items():
        for n in (2_000, 32_000):
            words = [Counted(c) for c in make(n)]
            Counted.times = 0
            op.runs_of(words)
            assert Counted.times <= 14 * n, (name, n, Counted.times / n)


def test_long_texts_hold_numbers_compactly(monkeypatch):
    text = fibonacci(300) + "abc" * 30
    want = op.runs_of(text)
    monkeypatch.setattr(op, "LARGE", 10)
    assert op.runs_of(text) == want


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = op.runs_of(words) if n > 3000 else brute(words)
    dropped = {k for a, length, q in runs for k in range(a + q, a + length)}
    best = min(((-length, a, q) for a, length, q in runs), default=None)
    shown = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    digests = ["".join(f"{a},{length},{q}\n" for a, length, q in runs), " ".join(w for k, w in enumerate(words) if k not in dropped)]
    return (doc_id, len(runs), *shown, *(hashlib.sha256(x.encode()).hexdigest() for x in digests))


def test_query_against_brute_force(spark, tmp_path):
    more = [(k, cases.prose(k, 30 + k % 90), None, None, 0) for k in range(1000, 1200)]
    more += [(2000, "a " * 11, "", "", 0), (2001, "a " * 12 + "b", "", "", 0), (2002, "x y z " * 4 + "x y", "", "", 0)]
    rows = cases.rows() + more
    at = cases.folder(spark, str(tmp_path), cases.table(spark, rows, clashing=True))
    want = sorted((expected(r[0], r[1]) for r in rows), key=repr)
    assert cases.plain_rows(op.op11_runs(spark, at)) == want
    assert sum(r[1] > 0 for r in want) > 15


def test_query_on_the_small_table(spark):
    at = cases.sf()
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 6000]
    got = {r[0]: r for r in cases.plain_rows(op.op11_runs(spark, at))}
    assert all(got[d] == expected(d, t) for d, t in rows)


def test_operator_gives_spans_and_texts(spark):
    docs = spark.createDataFrame([(1, "u v " + "k l m " * 5 + "end"), (2, None)], "doc_id long, text string")
    one, none = sorted(op.word_runs(docs).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r) for r in one["runs"]] == [(2, 15, 3)] and bytes(one["collapsed"]) == b"u v k l m end" and one["n_words"] == 18
    assert none["runs"] == [] and bytes(none["collapsed"]) == b"" and none["n_words"] == 0
