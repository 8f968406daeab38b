import hashlib
import zlib

import numpy as np
import pytest

from quarrylight.llm import media as op
from tests.llm import cases


def brute(rows):
    out = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        stored = op.to_pgm(payload)
        digest = hashlib.sha256(payload).hexdigest()
        feature = op.image_features(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        items = whole_page((text or ""), digest, len(raw))
        lines = [f"{k}\t{kind}\t{words}\t{ref}\t{caption}\t{feature if ref else ''}" for k, (kind, words, ref, caption) in enumerate(items)]
        out.append((doc_id, len(raw), len(payload), digest, zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), len(items), sum(len(x[1].encode()) for x in items), zlib.crc32("\n".join(lines).encode())))
    return sorted(out, key=repr)


def whole_page(text, digest, n_bytes):
    """The items that a document's page has: its start, the payload with a caption, then its other lines with the payload between."""
    plain = lambda x: " ".join(x.split())
    out = [("text", plain(text[:60]), "", "")] if text[:60].strip() else []
    out.append(("media", "", f"sha256:{digest}", f"{n_bytes} bytes"))
    for k, line in enumerate(x for x in text[60:].split("\n") if x.strip()):
        out += [("media", "", f"sha256:{digest}", "")] if k else []
        out += [("text", plain(line), "", "")] if plain(line) else []
    return out


def check(found, rows):
    got = found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_items", "text_bytes", "items_crc32")
    assert cases.plain_rows(got) == brute(rows)
    assert found.where("caption <> concat(n_bytes, ' bytes') or position <> 1 and n_bytes > 0").count() == 0
    by_text = {}
    for r in found.collect():
        assert by_text.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]


def test_against_brute_force(spark, tmp_path):
    at = cases.folder(spark, str(tmp_path), cases.table(spark, clashing=True))
    found = op.op5_media(spark, at)
    got = found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_items", "text_bytes", "items_crc32")
    assert cases.plain_rows(got) == brute(cases.rows())
    assert found.where("caption <> concat(n_bytes, ' bytes')").count() == 0


def test_whole_table(spark):
    at = cases.sf()
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    check(op.op5_media(spark, at), rows)


def test_round_trip_and_damage(spark):
    payload = bytes(range(256)) * 3
    assert op.from_pgm(op.to_pgm(payload)).tobytes() == payload
    with pytest.raises(ValueError):
        op.from_pgm(b"P6\n64 1\n255\n" + bytes(64))
    damaged = spark.createDataFrame([("00" * 32, bytearray(op.to_pgm(payload)))], "digest string, media binary")
    with pytest.raises(Exception, match="damaged"):
        op.media_features(damaged).collect()


def test_sequences_stay_in_order():
    html = """<html><head><title>T &amp; t</title><style>p {}</style><script>var x = "<p>no</p>";</script></head>
      <body><p>One <b>bold</b> word</p><figure><img src="sha256:aa" alt="alt"><figcaption>The  caption</figcaption></figure>
      <p>Two</p><img src="b.png"><video src="c.mp4"></video><p>Three<br>Four</body>"""
    found = op.interleave(html)
    assert [x["position"] for x in found] == list(range(len(found)))
    assert [(x["kind"], x["text"] or x["ref"], x["caption"]) for x in found] == [
        ("text", "T & t", None), ("text", "One bold word", None), ("media", "sha256:aa", "The caption"), ("text", "Two", None), ("media", "b.png", None), ("media", "c.mp4", None), ("text", "Three", None), ("text", "Four", None),
    ]
    assert op.interleave(None) == op.interleave("") == []
    op.interleave("<p <<>> &bogus; </figure><figcaption>x")  # broken pages don't fail


def test_sequences_are_packed_without_loss():
    items = op.interleave('<p>é "quoted" \\ \x00 😀</p><img src="sha256:' + "ab" * 32 + '" alt="x\ty">')
    assert op.unpacked(op.packed(items)) == items and [op.digest_of(x) for x in items] == [None, "ab" * 32]
    assert op.unpacked(op.packed([])) == []


def test_references_resolve_and_align(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="sha256:' + "ab" * 32 + '"><p>b</p><img src="sha256:' + "cd" * 32 + '" alt="lost">'), (2, None), (3, "")], "page_id long, html string")
    store = spark.createDataFrame([("ab" * 32, 7)], "digest string, media_bytes long")
    items = {r["page_id"]: r["items"] for r in op.align(op.sequences(pages, "page_id", "html"), "page_id", store, "media_bytes").collect()}
    assert [(x["kind"], x["text"], x["caption"], x["media_bytes"]) for x in items[1]] == [("text", "a", None, None), ("media", None, None, 7), ("text", "b", None, None), ("media", None, "lost", None)]
    assert [x["position"] for x in items[1]] == [0, 1, 2, 3] and items[2] == items[3] == []


def test_features_of_the_pages_table(spark):
    at = cases.sf()
    found = op.sequences(spark.read.parquet(f"{at}/pages.parquet"), "page_id", "html")
    assert found.count() == spark.read.parquet(f"{at}/pages.parquet").count()
    assert sum(len(op.unpacked(bytes(r["sequence"]))) for r in found.collect()) > 0
    assert np.isfinite(op.from_pgm(op.to_pgm(bytes(64))).mean())
