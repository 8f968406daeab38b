"""Interleaved document sequences with media columns.

HTML becomes an ordered sequence of structs: text, or a media reference with its caption, each with its position. Payloads
lie in a content-addressed store as 8-bit grey images (binary PGM, 64 samples a row); a join on the digest resolves the
references, and the sequence is put together again in its order, so that positions and captions stay aligned. While
sequences move to meet what was found for them, each is one compressed piece of bytes; its texts stay in it to the end.

Defined results: null text or HTML counts as empty (an empty text's payload is 64 zero bytes, empty HTML an empty
sequence); a reference that the store lacks stays with null media; a null doc_id is carried through; repeated rows get
equal values; an empty table gives an empty result; further columns are ignored. Texts are taken whole, however long (one
text's page and payload lie in one task's memory); a reference that occurs twice resolves twice.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarrylight.llm.common import Scratch, documents, slices, text_or_empty

WIDTH = 64
ITEM_COLUMNS = "position int, kind string, text string, ref string, caption string"
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "figcaption", "td", "tr", "br", "title", "blockquote", "pre"}
SILENT = {"script", "style", "template"}
MEDIA = {"img", "audio", "video", "source", "embed"}


class Interleaver(HTMLParser):
    """Ordered items of a page; a figure's caption goes to the media in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.held: list[str] = []
        self.silent = 0
        self.figure: list[dict] | None = None
        self.in_caption = False

    def _flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if not text:
            return
        if self.in_caption and self.figure is not None:
            for x in self.figure:
                x["caption"] = text
        else:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        if tag in BLOCKS or tag in MEDIA:
            self._flush()
        if tag == "figure":
            self.figure = []
        if tag == "figcaption":
            self.in_caption = True
        own = dict(attrs)
        if tag in MEDIA and own.get("src"):
            item = {"position": len(self.items), "kind": "media", "text": None, "ref": own["src"], "caption": own.get("alt") or None}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in BLOCKS:
            self._flush()
        if tag == "figcaption":
            self.in_caption = False
        if tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.held.append(data)


def interleave(html: str | None) -> list[dict]:
    parser = Interleaver()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser.items


ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])


def packed(items: list[dict]) -> bytes:
    """A sequence as compressed JSON."""
    return zstandard.compress(json.dumps([list(x.values()) for x in items], ensure_ascii=False).encode(), 3)


def unpacked(data: bytes) -> list[dict]:
    return [dict(zip(ITEM.names, x, strict=True)) for x in json.loads(zstandard.decompress(data))]


def sequences(pages: DataFrame, key: str, html: str, *carried: str) -> DataFrame:
    """key, the carried columns, sequence (packed: an ordered list of text and media-reference structs) and digests, those
    that its references (sha256:<digest>) name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, html, 2 << 20):
            rest, found, digests = part.drop_columns([html]), [], []
            for x in part.column(html):
                items = interleave(x.as_py())
                found.append(packed(items))
                digests.append(sorted({d for i in items if (d := digest_of(i))}))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, pa.binary()), pa.array(digests, pa.list_(pa.string()))], [*rest.schema.names, "sequence", "digests"])

    rows = pages.select(F.col(key).cast("long").alias(key), *carried, html)
    return rows.mapInArrow(run, T.StructType([*rows.drop(html).schema, T.StructField("sequence", T.BinaryType()), T.StructField("digests", T.ArrayType(T.StringType()))]))


def digest_of(item: dict) -> str | None:
    """The digest that a media reference names."""
    ref = item["ref"] or ""
    return ref[7:71] if item["kind"] == "media" and ref.startswith("sha256:") else None


def align(found: DataFrame, key: str, store: DataFrame, *columns: str) -> DataFrame:
    """found with items in the place of sequence and digests: its structs in order, with the store's columns in every media
    item (null where the store lacks the digest).

    found: key (rows of one key refer to the same), sequence, digests and further columns; store: digest (unique) and the
    columns. What a page refers to goes through the digest join once, and the sequences move once, to meet what was found.
    """
    taken = {c.lower() for c in found.columns}
    own, media = (next(n for n in (name + "_" * k for k in range(99)) if n.lower() not in taken) for name in ("_key", "_media"))
    refs = found.select(F.col(key).alias(own), F.explode("digests").alias("digest")).distinct()
    known = refs.join(store.select("digest", *columns), "digest").groupBy(own).agg(F.collect_list(F.struct("digest", *columns)).alias(media))
    kinds = [store.schema[c] for c in columns]
    shape = T.StructType([*T.StructType.fromDDL(ITEM_COLUMNS).fields, *(T.StructField(f.name, f.dataType) for f in kinds)])
    rest = [c for c in found.columns if c not in ("sequence", "digests")]
    joined = found.join(known, F.col(key) == F.col(own), "left").select(*rest, "sequence", media)
    item = to_arrow_type(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "sequence", 1 << 18):
            out = []
            for data, held in zip(part.column("sequence"), part.column(media).to_pylist(), strict=True):
                values = {x["digest"]: x for x in held or ()}
                out.append([i | {c: values.get(digest_of(i), {}).get(c) for c in columns} for i in unpacked(data.as_py())])
            kept = part.select(rest)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.list_(item))], [*kept.schema.names, "items"])

    return joined.mapInArrow(run, T.StructType([*joined.select(*rest).schema, T.StructField("items", T.ArrayType(shape))]))


def to_pgm(payload: bytes) -> bytes:
    """A payload of whole rows as a binary PGM image."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_pgm(media: bytes) -> np.ndarray:
    """The samples, rows x 64."""
    magic, size, depth, _ = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255":
        raise ValueError("not an 8-bit grey image")
    at = len(magic) + len(size) + len(depth) + 3
    return np.frombuffer(media, np.uint8, width * height, at).reshape(height, width)


def image_features(samples: np.ndarray) -> str:
    """Size, mean, spread, entropy in bits and an average hash over 8 x 8 fields."""
    count = np.bincount(samples.ravel(), minlength=256)
    share = count[count > 0] / samples.size
    columns = samples.reshape(samples.shape[0], 8, WIDTH // 8).mean(2)
    rows = np.array([x.mean(0) for x in np.array_split(columns, 8)] if len(columns) >= 8 else [columns[k % len(columns)] for k in range(8)])
    bits = np.packbits((rows > rows.mean()).ravel()).tobytes().hex()
    values = np.arange(256)
    mean = float((count * values).sum() / samples.size)
    spread = float(np.sqrt((count * (values - mean) ** 2).sum() / samples.size))
    return f"{samples.shape[1]}x{samples.shape[0]};mean={mean:.4f};std={spread:.4f};entropy={-(share * np.log2(share)).sum():.4f};ahash={bits}"


def page(raw: bytes, digest: str) -> str:
    """The whole text as a page: its start as heading, a figure that refers to the payload, then a paragraph a line, with
    further references to the payload between paragraphs."""
    text, image = raw.decode(errors="replace"), f'<img src="sha256:{digest}" alt="">'
    lines = [f"<p>{escape(x)}</p>" for x in text[60:].split("\n") if x.strip()]
    return f"<article><h1>{escape(text[:60])}</h1><figure>{image}<figcaption>{len(raw)} bytes</figcaption></figure>{image.join(lines)}</article>"


def payload_of(raw: bytes) -> bytes:
    """A text's bytes with zeros to whole rows, one at least."""
    return raw + bytes(-len(raw) % WIDTH) if raw else bytes(WIDTH)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("text"))


def store_payloads(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Written table: digest, media. A task stores each payload once; tasks may store the same one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in slices(batches, "text", 2 << 20):
            digests, media = [], []
            for x in part.column("text"):
                payload = payload_of(x.as_py())
                digest = hashlib.sha256(payload)
                if digest.digest() not in seen:
                    seen.add(digest.digest())
                    digests.append(digest.hexdigest())
                    media.append(to_pgm(payload))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    made = _texts(docs).mapInArrow(run, "digest string, media binary")
    made.write.option("compression", "zstd").parquet(scratch.path("media"))
    return docs.sparkSession.read.schema(made.schema).parquet(scratch.path("media"))


def payload_pages(docs: DataFrame) -> DataFrame:
    """item (a hash of doc_id and digest), doc_id, n_bytes and html: each document's page, which refers to its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            raw = [x.as_py() for x in part.column("text")]
            digests = [hashlib.sha256(payload_of(x)).hexdigest() for x in raw]
            pages = [page(x, d) for x, d in zip(raw, digests, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(digests, pa.string()), pa.array(pages, pa.string())], ["doc_id", "n_bytes", "digest", "html"])

    found = _texts(docs).mapInArrow(run, "doc_id long, n_bytes long, digest string, html string")
    return found.select(F.xxhash64("doc_id", "digest").alias("item"), "doc_id", "n_bytes", "html")


def media_features(stored: DataFrame) -> DataFrame:
    """One row a digest, from the stored bytes read back: payload_bytes ... feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in slices(batches, "media", 2 << 20):
            out = []
            for digest, x in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
                media = x.as_py()
                samples = from_pgm(media)
                payload = samples.tobytes()
                own = hashlib.sha256(payload).hexdigest()
                if own != digest:
                    raise ValueError(f"the stored bytes of {digest} are damaged")
                out.append((digest, len(payload), own, zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), image_features(samples)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names)

    found = stored.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.dropDuplicates(["digest"])


def document_sequences(docs: DataFrame, features: DataFrame) -> DataFrame:
    """item, doc_id, n_bytes and items: the whole page of each document, in order, with the features of its media."""
    columns = [c for c in features.columns if c != "digest"]
    return align(sequences(payload_pages(docs), "item", "html", "doc_id", "n_bytes"), "item", features, *columns)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's payload as the first media item of its own page, taken from the aligned sequence.

    text_bytes and items_crc32 (over position, kind, text, reference, caption and feature of each item, in order) hold the
    whole sequence: every paragraph, caption and resolved reference of the page counts.
    """
    scratch, docs = Scratch(spark, "media"), documents(spark, sf_dir)
    features = scratch.table(media_features(store_payloads(docs, scratch)), "features")
    scratch.drop("media")  # read back, verified and described: the result names payloads by digest and needs the bytes no more
    first = F.get(F.filter("items", lambda x: x["kind"] == "media"), F.lit(0))
    text_bytes = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.octet_length(x["text"]), F.lit(0)))
    lines = F.transform("items", lambda x: F.concat_ws("\t", *(F.coalesce(x[c].cast("string"), F.lit("")) for c in ("position", "kind", "text", "ref", "caption", "feature"))))
    found = document_sequences(docs, features).select("doc_id", "n_bytes", first.alias("m"), F.size("items").cast("long").alias("n_items"), text_bytes.alias("text_bytes"), F.crc32(F.array_join(lines, "\n").cast("binary")).alias("items_crc32"))
    return found.select("doc_id", "n_bytes", "m.payload_bytes", "m.payload_sha256", "m.tail_crc32", "m.media_bytes", "m.media_sha256", "m.feature", "m.position", "m.caption", "n_items", "text_bytes", "items_crc32")
