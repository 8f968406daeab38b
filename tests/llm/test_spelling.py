import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import spelling as op
from tests.llm import cases


def variants(word, letters):
    out = {word[:k] + word[k + 1 :] for k in range(len(word))}
    for c in letters:
        out |= {word[:k] + c + word[k + 1 :] for k in range(len(word))} | {word[:k] + c + word[k:] for k in range(len(word) + 1)}
    return out - {word}


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(words, ratio=10):
    letters = sorted({c for w in words for c in w})
    out, form = [], {}
    near = {w: variants(w, letters) & words.keys() for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def slips(seed, n):
    """Words with one or two edits, some often, some hardly."""
    r = random.Random(seed)
    out = {}
    for _ in range(n):
        word = "".join(r.choice("abé") for _ in range(r.randint(7, 9)))
        out[word] = r.choice((2, 3, 40, 500, 7000))
        for _ in range(4):
            word = r.choice(sorted(x for x in variants(word, "abé") if len(x) >= 7))
            out.setdefault(word, r.choice((2, 3, 20, 30, 300)))
    return out


def test_operator_against_brute_force(spark):
    words = slips(1, 150) | {"zzzzzzzzz" + "y" * 5000: 5, "zzzzzzzzz" + "y" * 4999: 70}
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    got = cases.plain_rows(op.spelling_variants(df))
    assert got == brute(words)
    assert len({r[2] for r in got}) < len(got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_large_shards_are_dealt_to_parts(spark):
    words = slips(2, 80)
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    got = sorted((r["a"], r["a_n"], r["b"], r["b_n"]) for r in op.near_pairs(df, most_held=5).collect())
    want = sorted((a, words[a], b, words[b]) for a in words for b in variants(a, "abé") & words.keys() if a < b)
    assert got == want


@given(st.text("ab", min_size=7, max_size=12), st.integers(0, 10**6))
@settings(max_examples=400, deadline=None)
def test_one_edit_keeps_a_half(word, pick):
    options = sorted(x for x in variants(word, "abc") if len(x) >= 7)
    other = options[pick % len(options)]
    a, b = sorted((word, other))
    found = [x for last in (False, True) for x, _ in op.Halves([(a, 1)], last).near(b)]
    assert found == [a]
    assert op.one_edit(a, b) and op.one_edit(b, a) and not op.one_edit(a, a) and not op.one_edit(word, word[2:])


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    words = [w for w, n in slips(7, 60).items() for _ in range(min(n, 40))]
    r.shuffle(words)
    more = [(5000 + k, ". ".join(words[k::60]).title() + " ÀÉ×÷ßÿÀÉ×÷ßÿ x", None, None, 0) for k in range(60)]
    rows = cases.rows() + more
    at = cases.folder(spark, str(tmp_path), cases.table(spark, rows, clashing=True))
    assert cases.plain_rows(op.op13_spelling(spark, at)) == brute(plain_words([r[:2] for r in rows]))


def test_query_on_the_small_table(spark):
    at = cases.sf()
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    got = cases.plain_rows(op.op13_spelling(spark, at))
    assert got == brute(plain_words(rows)) and got
