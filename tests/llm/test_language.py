import zlib

import numpy as np
import pytest

from quarrylight.llm import language as op
from tests.llm import cases


def test_held_out_accuracy(spark):
    at = cases.sf("sf0.01")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    found = {r["doc_id"]: r for r in op.op4_language(spark, at).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= found[r["doc_id"]]["score"] <= 1
        assert (found[r["doc_id"]]["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    judged = [r for r in rows if found[r["doc_id"]]["held_out"] and r["lang"] and any(c.isalpha() for c in r["text"] or "")]
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in judged) >= 0.9 * len(judged)


def test_slopes_by_backpropagation_through_time():
    """Against differences, in double precision where the piecewise gates allow it."""
    rng = np.random.default_rng(1)
    layer = op.Direction(3, rng)
    codes = rng.integers(97, 101, (5, 4))
    target = rng.normal(size=(5, 3, 4)).astype(np.float32)
    loss = lambda: float((layer.states(codes).astype(float) * target).sum())
    layer.states(codes, keep=True)
    de, du = layer.learn(codes, target)
    for parameter, slope in ((layer.e, de), (layer.u, du)):
        places = [(k, c) for k in range(9) for c in ((97, 99) if parameter is layer.e else (0, 2))]
        for at in places:
            was, step = parameter[at], 1e-3
            parameter[at] = was + step
            up = loss()
            parameter[at] = was - step
            down = loss()
            parameter[at] = was
            assert abs((up - down) / (2 * step) - slope[at]) < 0.05 + 0.05 * abs(slope[at])


def test_every_position_counts_and_nothing_of_the_label():
    """The answer to a text is the same whatever stands in the other columns or beside it in a batch."""
    rng = np.random.default_rng(2)
    texts = [cases.prose(k, 80).encode() for k in range(20)]
    windows = np.stack([np.frombuffer(x[:64], np.uint8) for x in texts])
    tagger = op.ByteTagger(["a", "b"]).fit(windows, rng.integers(0, 2, 20), epochs=1)
    whole = tagger.pool(texts)
    alone = np.concatenate([tagger.pool([x]) for x in texts])
    assert np.allclose(whole, alone, atol=1e-5) and np.allclose(whole.sum(1), 1, atol=1e-4)
    assert not np.allclose(tagger.pool([texts[0] + b" zzzzzz qqqq" * 40]), whole[:1], atol=1e-4)


def test_the_query_is_the_network_over_whole_texts(spark):
    """Against one process that trains on the same windows and reads every text whole."""
    at = cases.sf()
    docs = spark.read.parquet(f"{at}/documents.parquet")
    data, labels, languages = op.training_windows(docs, 300, 4, 64)
    tagger = op.ByteTagger(languages, stretch=64).fit(data, labels)
    rows = docs.select("doc_id", "text").collect()
    p = tagger.pool([(r["text"] or "").encode() for r in rows])
    found = {r["doc_id"]: r for r in op.op4_language(spark, at).collect()}
    for r, own in zip(rows, p, strict=True):
        if op.A_LETTER.search(r["text"] or ""):
            assert found[r["doc_id"]]["lang_pred"] == languages[own.argmax()] and abs(found[r["doc_id"]]["score"] - own.max()) < 1e-4


def test_all_languages_are_learned(spark):
    rows = [(k, cases.prose(k, 40), f"l{k % 7}", "s", 1) for k in range(70)]
    docs = cases.table(spark, rows)
    data, labels, languages = op.training_windows(docs, 300, 4, 64)
    assert len(languages) == 7 and len(data) == len(labels) and set(labels) == set(range(7))


def test_without_languages_or_letters(spark):
    rows = [(k, t, None, "s", 1) for k, t in enumerate(["abc def", "", None, "12 ²", "ß"])]
    assert {r["lang_pred"] for r in op.identify(cases.table(spark, rows)).collect()} == {"und"}
    found = {r["doc_id"]: r for r in op.identify(cases.table(spark)).collect()}
    assert [found[k]["lang_pred"] for k in (400, 401, 402, 403)] == ["und"] * 4 and found[403]["score"] == 0
    assert found[404]["lang_pred"] in ("xa", "xb")


def test_more_languages_than_the_bound_are_an_error(spark):
    docs = spark.createDataFrame([(k, "some text here", f"l{k % 5}") for k in range(60)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 4 languages"):
        op.training_windows(docs, 10, 1, 64, most_languages=4)
    assert len(op.training_windows(docs, 10, 1, 64, most_languages=5)[2]) == 5
