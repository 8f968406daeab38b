import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import overlap as op
from tests.llm import cases


def plain_set(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def brute(rows, percent=85, size=4):
    sets = [plain_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= max(len(x), len(y)) * percent and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d, len(s), least.get(find(k))) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def edited(text, r, times):
    words = text.split()
    for _ in range(times):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def groups(seed):
    """Chains of edits around the least similarity, a large group of near copies, texts of shared lines."""
    r = random.Random(seed)
    out = []
    for k in range(12):
        text = cases.prose(seed + k, r.randint(5, 160))
        for _ in range(8):
            out.append(text)
            text = edited(text, r, r.choice((1, 1, 2, 3, 5)))
    base = cases.prose(seed + 99, 140)
    out += [edited(base, r, r.choice((0, 1, 2, 4))) for _ in range(60)]
    lines = [cases.prose(seed + 200 + k, 12) for k in range(10)]
    out += [" ".join(r.sample(lines, r.randint(1, 9))) for _ in range(60)]
    out += [f"{lines[0]} x{k}" for k in range(50)] + ["One two", "one  TWO", "one two three", "", " ", None, "a b c d", "A b c d"]
    r.shuffle(out)
    return [(k, t) for k, t in enumerate(out)]


def test_operator_against_brute_force(spark):
    rows = groups(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert cases.plain_rows(op.overlap_components(docs, 85, 4)) == brute(rows)
    assert cases.plain_rows(op.overlap_components(docs)) == brute(rows, 80, 5)


def test_search_without_hubs_and_with_parts(spark):
    rows = groups(2)
    docs = spark.createDataFrame([(d, t) for d, t in rows if plain_set(t)], "doc_id long, text string").dropDuplicates(["text"])
    scratch = op.Scratch(spark, "test")
    texts = scratch.table(docs.selectExpr("doc_id AS row_id", "doc_id", "cast(text AS binary) AS text"), "texts")
    sets = scratch.table(op.signatures(texts, 4, 85).withColumnRenamed("row_id", "id"), "signed")
    want = {(a, b) for a, x in texts_of(texts) for b, y in texts_of(texts) if a < b and 100 * len(x & y) >= 85 * len(x | y)}
    got = {tuple(r) for r in op.overlap_links(sets, texts, scratch, 85, 4, long=10**9, most_ids=7).collect()}
    assert got == want and len(want) > 100


def texts_of(texts, held={}):  # noqa: B006
    if texts not in held:
        held[texts] = [(r["row_id"], plain_set(bytes(r["text"]).decode())) for r in texts.collect()]
    return held[texts]


@given(st.lists(st.sets(st.integers(0, 30), max_size=20), max_size=12), st.integers(1, 12))
@settings(max_examples=500, deadline=None)
def test_occurrences(lists, need):
    times = Counter(x for s in lists for x in s)
    assert op.occurring([sorted(s) for s in lists], need) == sorted(x for x, n in times.items() if n >= need)
    own = {x: need + x % 3 for x in times}
    assert op.occurring([sorted(s) for s in lists], need, own) == sorted(x for x, n in times.items() if n >= own[x])


@given(st.sets(st.integers(0, 400), min_size=1, max_size=150), st.sets(st.integers(0, 400), max_size=12), st.integers(0, 12))
@settings(max_examples=500, deadline=None)
def test_similar_sets_share_the_required_keys(a, more, less):
    b = (a - set(sorted(a, key=lambda x: x * 7919 % 401)[:less])) | more
    if not b or 100 * len(a & b) < 85 * len(a | b):
        return
    kept = [set(sorted(x)[: len(x) - op.least_overlap(len(x), 85) + op.required(len(x))]) for x in (a, b)]
    for x in (a, b):
        assert len(kept[0] & kept[1]) >= op.required(op.least_overlap(len(x), 85))


def test_query_against_brute_force(spark, tmp_path):
    rows = [r[:2] for r in cases.rows()] + [(1000 + k, t) for k, t in groups(3)]
    at = cases.folder(spark, str(tmp_path), cases.table(spark, [(*r, None, None, 0) for r in rows], clashing=True))
    assert cases.plain_rows(op.op12_ngram_join(spark, at)) == brute(rows)


def test_query_on_the_small_table(spark):
    at = cases.sf()
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    assert cases.plain_rows(op.op12_ngram_join(spark, at)) == brute(rows)
