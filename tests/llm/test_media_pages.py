from quarrylight.llm import media as op
from quarrylight.llm.common import Scratch
from tests.llm import cases


def test_whole_texts_enter_the_sequences(spark):
    rows = [(1, "Head " * 20 + "\nsecond <b> & line\n\nthird line"), (2, "short"), (3, None), (4, cases.prose(9, 300))]
    scratch = Scratch(spark, "media-test")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = op.document_sequences(docs, scratch.table(op.media_features(op.store_payloads(docs, scratch)), "features"))
    got = {r["doc_id"]: r["items"] for r in found.collect()}
    for d, text in rows:
        items = got[d]
        assert [x["position"] for x in items] == list(range(len(items)))
        assert "".join("".join(x["text"].split()) for x in items if x["kind"] == "text") == "".join((text or "").split())
        assert all((x["payload_bytes"] is not None) == (x["kind"] == "media") for x in items)
    assert [x["kind"] for x in got[1]] == ["text", "media", "text", "media", "text", "media", "text"]
